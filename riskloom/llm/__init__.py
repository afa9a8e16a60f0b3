"""Training-data operators: tokenizing, de-duplication, archives, scoring and search over document tables."""
