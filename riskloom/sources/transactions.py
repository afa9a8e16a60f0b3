"""Transaction sources: the fixture view over ``events``, PaySim-shaped files, a simulator, audits and time splits."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAYSIM_SCHEMA = "step int, type string, amount double, nameOrig string, oldbalanceOrg double, newbalanceOrig double, nameDest string, oldbalanceDest double, newbalanceDest double, isFraud int, isFlaggedFraud int"
TYPES = ("CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER")
#: Published shape of the full PaySim table: rows, frauds, first and last step.
CANONICAL = {"rows": 6_362_620, "fraud": 8_213, "min_step": 1, "max_step": 743}


def fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions made of ``events``: labels and scores are fixed functions of the id, for tests of operators only."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    ts = F.col("ts").cast("timestamp")
    kind = F.when(F.col("event_type") == "click", "PAYMENT").when(F.col("event_type") == "purchase", "TRANSFER").when(F.col("event_type") == "error", "CASH_OUT").when(F.col("event_type") == "view", "CASH_IN").otherwise("DEBIT")
    t = e.select(
        F.col("event_id").alias("transaction_id"), F.unix_micros(ts).alias("us"), F.expr("CAST(unix_micros(CAST(ts AS TIMESTAMP)) DIV 3600000000 - 473351 AS INT)").alias("step"), kind.alias("type"), F.col("value").alias("amount"),
        F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("sender"), F.concat(F.lit("M"), F.get_json_object("props", "$.k")).alias("recipient"),
        F.concat(F.lit("D"), (F.col("event_id") % 40).cast("string")).alias("device_id"), F.when((F.col("event_id") * 7919) % 97 < 3, 1).otherwise(0).alias("is_fraud"),
    )
    t = t.withColumn("is_flagged_fraud", F.when((F.col("is_fraud") == 1) & (F.col("amount") > 100), 1).otherwise(0))
    t = t.withColumns({"old_balance_sender": ((F.col("transaction_id") * 131) % 1000).cast("double"), "old_balance_recipient": ((F.col("transaction_id") * 37) % 1000).cast("double"), "event_key": F.col("transaction_id")})
    t = t.withColumns({"new_balance_sender": F.greatest(F.lit(0.0), F.col("old_balance_sender") - F.col("amount")), "new_balance_recipient": F.col("old_balance_recipient") + F.col("amount")})
    return t.withColumn("score", F.least(F.lit(1.0), ((F.col("transaction_id") * 7919) % 1000) / F.lit(1000.0) * 0.7 + F.col("is_fraud") * 0.3))


def read_paysim(spark: SparkSession, path: str, max_step: int | None = None) -> DataFrame:
    """CSV or Parquet with the PaySim columns, as normalised transactions; the step filter reaches the scan."""
    raw = spark.read.parquet(path) if ".parquet" in path else spark.read.csv(path, header=True, schema=PAYSIM_SCHEMA)
    missing = {c.split()[0] for c in PAYSIM_SCHEMA.split(", ")} - set(raw.columns)
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}")
    if max_step is not None:
        raw = raw.where(F.col("step") <= max_step)
    if raw.isEmpty():
        raise ValueError("no rows")
    key = F.xxhash64("step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig", "nameDest", "oldbalanceDest", "newbalanceDest")
    cast = lambda c, kind, name=None: F.col(c).cast(kind).alias(name or c)
    rows = raw.select(
        F.monotonically_increasing_id().alias("_order"), cast("step", "int"), F.expr("timestamp_seconds(1577836800 + step * 3600)").alias("timestamp"), F.expr("CAST((step - 1) DIV 24 AS INT)").alias("day"), "type", cast("amount", "double"),
        cast("nameOrig", "string", "sender"), cast("nameDest", "string", "recipient"), cast("oldbalanceOrg", "double", "old_balance_sender"), cast("newbalanceOrig", "double", "new_balance_sender"),
        cast("oldbalanceDest", "double", "old_balance_recipient"), cast("newbalanceDest", "double", "new_balance_recipient"), cast("isFraud", "int", "is_fraud"), cast("isFlaggedFraud", "int", "is_flagged_fraud"), key.alias("event_key"), *(F.lit(0).alias(c) for c in ("account_age_days", "device_change", "country_mismatch", "recipient_new")),
    )
    return numbered(rows)


def numbered(rows: DataFrame) -> DataFrame:
    """``_order`` as transaction_id without gaps: a row's place in its partition after the sizes of those before, which are read at once."""
    part, at = F.shiftright("_order", 33), F.col("_order").bitwiseAND((1 << 33) - 1)
    sizes, before, start = {r[0]: r[1] for r in rows.groupBy(part).count().collect()}, F.lit(0).cast("long"), 0
    spark = rows.sparkSession
    offsets = []
    for p in sorted(sizes):
        offsets.append((p, start))
        start += sizes[p]
    table = F.broadcast(spark.createDataFrame(offsets, "_p long, _start long"))  # a row for each partition
    return rows.withColumn("_p", part.cast("long")).join(table, "_p").select((F.col("_start") + at).alias("transaction_id"), *(c for c in rows.columns if c != "_order"))


def load_split(features: DataFrame, columns: list[str], start: int | None = None, stop: int | None = None) -> DataFrame:
    """The named columns of rows with start <= step < stop, in order of step and event_key; step filter and columns reach the scan."""
    rows = features
    if start is not None:
        rows = rows.where(F.col("step") >= start)
    if stop is not None:
        rows = rows.where(F.col("step") < stop)
    return rows.select("step", "event_key", "amount", "is_fraud", "is_flagged_fraud", *columns).orderBy("step", unsigned("event_key"))


def unsigned(key: str):
    """A signed 64-bit key in the order of its unsigned value."""
    return F.col(key).bitwiseXOR(F.expr("CAST(-9223372036854775808 AS BIGINT)"))


#: Kinds of known fraud and their cumulative shares.
KNOWN = {"account_takeover": 0.46, "transfer_burst": 0.75, "mule_cashout": 1.0}
NOVEL = "novel_shared_device_microburst"


def simulate(spark: SparkSession, n: int = 180_000, seed: int = 42, days: int = 60) -> DataFrame:
    """Payments with three kinds of known fraud throughout and, from day 48 on, small payments of many senders over a few shared devices.

    Columns are hashes of the id and the seed, so that any part of the table comes out the same whenever it is computed.
    """
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed * 1000 + k), "id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = lambda k: F.sqrt(-2 * F.log(u(k))) * F.cos(2 * math.pi * u(k + 1))
    whole = lambda x, m: F.floor(x * m).cast("long")
    t = spark.range(n).withColumn("secs", whole(u(1), days * 86400)).withColumn("day", F.floor(F.col("secs") / 86400).cast("int"))
    pick = F.when(u(3) < KNOWN["account_takeover"], "account_takeover").when(u(3) < KNOWN["transfer_burst"], "transfer_burst").otherwise("mule_cashout")
    t = t.withColumn("fraud_type", F.when((F.col("day") >= 48) & (u(2) < 0.010), NOVEL).when(u(4) < 0.012, pick).otherwise("legitimate"))
    is_ = lambda k: F.col("fraud_type") == k
    ato, burst, mule, novel, known = is_("account_takeover"), is_("transfer_burst"), is_("mule_cashout"), is_(NOVEL), F.col("fraud_type").isin(*KNOWN)
    kind = F.when(ato | burst, "TRANSFER").when(mule, "CASH_OUT").when(novel, "PAYMENT").otherwise(F.element_at(F.array(*map(F.lit, TYPES)), (whole(u(5), 5) + 1).cast("int")))
    t = t.withColumn("type", kind)
    usual = F.least(F.greatest(F.exp(4.0 + 1.05 * normal(6)), F.lit(1.0)), F.lit(25_000.0))
    amount = F.when(ato, usual * (3 + 5 * u(8))).when(burst, usual * (1.4 + 2.6 * u(8))).when(mule, usual * (2 + 4 * u(8))).when(novel, F.least(F.greatest(F.exp(3.15 + 0.35 * normal(6)), F.lit(5.0)), F.lit(120.0))).otherwise(usual)
    sender = F.when(novel, 300 + whole(u(9), 60)).when(known, whole(u(9), 220)).otherwise(whole(u(9) * u(10), 14_000))  # some senders are far busier
    recipient = F.when(novel, F.concat(F.lit("M"), (200 + whole(u(11), 40)).cast("string"))).when(mule, F.concat(F.lit("C"), whole(u(11), 70).cast("string")))
    recipient = recipient.when(F.col("type") == "PAYMENT", F.concat(F.lit("M"), whole(u(11), 2500).cast("string"))).otherwise(F.concat(F.lit("C"), whole(u(11), 9000).cast("string")))
    prefix = F.when(novel, F.concat(F.lit("SHARED_"), whole(u(12), 4).cast("string"))).when(ato, F.concat(F.lit("NEW_"), F.col("id").cast("string"))).when(burst, F.concat(F.lit("B_"), F.col("id").cast("string"))).when(mule, F.concat(F.lit("MC_"), F.col("id").cast("string")))
    flag = lambda p: p.cast("int")
    t = t.select(
        F.col("id").alias("transaction_id"), F.expr("timestamp_seconds(1767225600 + secs)").alias("timestamp"), ((F.col("secs") + 1767225600) * 1_000_000).alias("us"), "day", "type", amount.alias("amount"), F.concat(F.lit("C"), sender.cast("string")).alias("sender"), recipient.alias("recipient"),
        F.least(F.greatest(F.exp(7.4 + normal(13)), F.lit(50.0)), F.lit(250_000.0)).alias("old_balance_sender"), (5 + whole(u(15), 2495)).cast("int").alias("account_age_days"), prefix.otherwise(whole(u(12), 22_000).cast("string")).alias("device_id"),
        flag(~novel & (u(16) < F.when(ato, 0.88).otherwise(0.035))).alias("device_change"), flag(~novel & (u(17) < F.when(ato, 0.48).otherwise(0.012))).alias("country_mismatch"), flag(~novel & ~mule & (u(18) < F.when(ato, 0.90).when(burst, 0.78).otherwise(0.18))).alias("recipient_new"),
        flag(F.col("fraud_type") != "legitimate").alias("is_fraud"), "fraud_type",
    )
    return t.withColumn("new_balance_sender", F.greatest(F.lit(0.0), F.col("old_balance_sender") - F.col("amount")))


def audit(tx: DataFrame) -> DataFrame:
    return tx.agg(
        F.count("*").alias("n"), F.sum("is_fraud").cast("long").alias("fraud"), F.round(F.avg("is_fraud"), 9).alias("fraud_rate"), F.min("step").alias("min_step"), F.max("step").alias("max_step"), F.sum("is_flagged_fraud").cast("long").alias("flagged")
    )


def data_audit(tx: DataFrame) -> DataFrame:
    """One row: size, frauds, their rate, first and last time and the number of days from one to the other."""
    day = F.floor(F.col("us") / 86_400_000_000)
    return tx.agg(F.count("*").alias("n"), F.sum("is_fraud").cast("long").alias("fraud_n"), F.round(F.avg("is_fraud"), 9).alias("fraud_rate"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), (F.max(day) - F.min(day) + 1).cast("long").alias("days"))


def canonical_status(tx: DataFrame) -> dict:
    row = audit(tx).first()
    actual = {"rows": row["n"], "fraud": row["fraud"], "min_step": row["min_step"], "max_step": row["max_step"]}
    return {"actual": actual, "expected": CANONICAL, "matches": actual == CANONICAL}


def validate_canonical(tx: DataFrame) -> None:
    status = canonical_status(tx)
    if not status["matches"]:
        raise ValueError(f"not the full table: {status}")


@dataclass(frozen=True)
class Split:
    validation_start: int
    test_start: int


def cut_points(tx: DataFrame) -> DataFrame:
    """One row: first steps of validation and future, at 60 and 80 % of the distinct steps."""
    steps = tx.select("step").distinct()
    ranked = steps.withColumn("r", F.row_number().over(Window.orderBy("step"))).crossJoin(steps.agg(F.count("*").alias("k")))  # a row for each hour
    at = lambda share: F.max(F.when(F.col("r") == F.floor(F.col("k") * share) + 1, F.col("step")))
    return ranked.agg(at(0.6).alias("validation_start"), at(0.8).alias("test_start"), F.count("*").alias("n_steps"))


def determine_split(tx: DataFrame) -> Split:
    row = cut_points(tx).first()
    if row["n_steps"] < 10:
        raise ValueError("at least 10 distinct steps are needed")
    return Split(row["validation_start"], row["test_start"])


def with_period(tx: DataFrame, split: Split) -> DataFrame:
    return tx.withColumn("period", F.when(F.col("step") < split.validation_start, "train").when(F.col("step") < split.test_start, "validation").otherwise("future_test"))


def split_summary(tx: DataFrame, split: Split) -> DataFrame:
    return with_period(tx, split).groupBy("period").agg(F.count("*").alias("n"), F.round(F.avg("is_fraud"), 9).alias("fraud_rate"), F.min("step").alias("min_step"), F.max("step").alias("max_step"))
