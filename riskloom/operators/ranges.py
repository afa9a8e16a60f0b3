"""Joins of events to windows of time by buckets, and counts of events in windows.

A window is copied to the buckets that it meets and an event lies in one bucket, so a pair of both meets once, by a join on
equal columns. ``width`` is the length of a bucket: a window of that length has two or three copies. Windows hold their start
and not their end; null keys, times or ends meet nothing, and so do windows that end where they start or before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(at: str | Column, width: int) -> Column:
    c = F.col(at) if isinstance(at, str) else at
    return F.floor((c - F.pmod(c, F.lit(width))) / width).cast("long")  # exact for long numbers below 2^53 buckets, negative ones too


def _pieces(windows: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """A row for each bucket ``_b`` that a window meets."""
    return windows.where(F.col(start) < F.col(end)).withColumn("_b", F.explode(F.sequence(_bucket(start, width), _bucket(F.col(end) - 1, width))))


def range_join(events: DataFrame, windows: DataFrame, keys: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs of events and windows of equal ``keys`` with start <= at < end; times are whole numbers. Beside the keys, column names must differ."""
    return events.withColumn("_b", _bucket(at, width)).join(_pieces(windows, start, end, width), [*keys, "_b"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_b")


def range_counts(events: DataFrame, windows: DataFrame, keys: list[str], at: str, start: str, end: str, width: int, name: str = "n", of: DataFrame | None = None) -> DataFrame:
    """``windows`` with the number of events in each. ``of``: rows of the same windows, where ``windows`` has other columns by now.

    A window holds what lies before its end less what lies before its start. Events are counted by time; both ends of the
    windows are put among the times of their bucket, and a running count over the bucket, with that of the key's earlier
    buckets, tells what lies before each. So a crowded key makes as many rows as it has times and windows, never pairs of both.
    """
    known = " AND ".join(f"`{k}` IS NOT NULL" for k in keys) or "true"
    times = events.select(*keys, F.col(at).alias("_at")).where(f"{known} AND _at IS NOT NULL").groupBy(*keys, "_at").agg(F.count("*").alias("_n"))
    each = (windows if of is None else of).select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e")).where(f"{known} AND _s < _e").distinct()
    ends = each.select(*keys, "_s", "_e", F.explode(F.array(F.struct(F.col("_s").alias("_at"), F.lit(-1).alias("_sign")), F.struct(F.col("_e").alias("_at"), F.lit(1).alias("_sign")))).alias("x")).select(*keys, "_s", "_e", "x.*", F.lit(0).cast("long").alias("_n"))
    line = times.unionByName(ends, allowMissingColumns=True).withColumn("_b", _bucket("_at", width))
    totals = line.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"))
    earlier = totals.select(*keys, "_b", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))  # a row for each bucket
    within = Window.partitionBy(*keys, "_b").orderBy("_at", F.col("_sign").isNull()).rowsBetween(Window.unboundedPreceding, 0)  # ends come before the events of their time
    asked = line.withColumn("_before", F.sum("_n").over(within)).where("_sign is not null").join(earlier, [*keys, "_b"])
    counts = asked.groupBy(*keys, "_s", "_e").agg(F.sum(F.col("_sign") * (F.col("_before") + F.col("_earlier"))).alias("_n")).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [F.col(f"_k_{k}") == F.col(k) for k in keys] + [F.col("_s") == F.col(start), F.col("_e") == F.col(end)]
    return windows.join(counts, same, "left").withColumn(name, F.coalesce("_n", F.lit(0)).cast("long")).drop("_n", "_s", "_e", *(f"_k_{k}" for k in keys))


def parity_counts(tx: DataFrame) -> DataFrame:
    """Numbers of earlier rows, by second, of the sender in an hour and in a day, and of the recipient and of the device in a day; rows of one second don't count each other."""
    rows = tx.select("transaction_id", "sender", "recipient", "device_id", F.floor(F.col("us") / 1_000_000).cast("long").alias("_sec"))
    out = rows
    for name, key, back in (("sender_tx_1h", "sender", 3600), ("sender_tx_24h", "sender", 86400), ("recipient_fanin_24h", "recipient", 86400), ("device_activity_24h", "device_id", 86400)):
        since = lambda df, back=back: df.withColumn("_from", F.col("_sec") - back)
        out = range_counts(rows, since(out), [key], "_sec", "_from", "_sec", max(back // 8, 1), name, since(rows)).drop("_from")
    return out.select("transaction_id", "sender_tx_1h", "sender_tx_24h", "recipient_fanin_24h", "device_activity_24h")
