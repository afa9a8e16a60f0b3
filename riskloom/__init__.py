"""Transaction-risk analytics as Spark DataFrame plans."""
