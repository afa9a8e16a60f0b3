"""Results as Parquet, CSV and JSON; NaN and infinities become null where the format has no word for them."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities as null."""
    real = {c for c, t in df.dtypes if t in ("double", "float")}
    return df.select(*(F.when(~F.isnan(c) & (F.abs(c) < math.inf), F.col(c)).alias(c) if c in real else F.col(c) for c in df.columns))


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    """Files with a header, as many as the table has partitions."""
    df.write.mode("overwrite").csv(path, header=True, compression="gzip" if gzip else "none")


def write_json(df: DataFrame, path: str) -> None:
    finite(df).write.mode("overwrite").json(path)


def plain(x):
    """Nested values as JSON takes them."""
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, list | tuple):
        return [plain(v) for v in x]
    if hasattr(x, "item"):
        x = x.item()
    return None if isinstance(x, float) and not math.isfinite(x) else x


def write_summary(summary: dict, path: str) -> None:
    """A small dictionary of results, on the driver."""
    Path(path).write_text(json.dumps(plain(summary), indent=2, sort_keys=True, allow_nan=False))
