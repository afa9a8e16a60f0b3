"""Detection metrics by aggregation; ties share their place, undefined ratios are null."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import ratio
from .order import at_places, counted, joined, quantile, quantiles, running

def fraud() -> Column:
    return F.col("is_fraud") == 1


def legit() -> Column:
    return F.col("is_fraud") == 0


def count(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def value(cond: Column) -> Column:
    return F.sum(F.when(cond, F.col("amount")).otherwise(F.lit(0.0)))


def alert_columns(alert: Column) -> list[Column]:
    """Alerts, precision, recall, legitimate flag rate and value recall of a condition."""
    r = lambda c: F.round(c, 9)
    return [
        count(alert).cast("long").alias("alerts"), r(ratio(count(alert & fraud()), count(alert))).alias("precision"), r(ratio(count(alert & fraud()), count(fraud()))).alias("recall"),
        r(ratio(count(alert & legit()), count(legit()))).alias("legit_flag_rate"), r(ratio(value(alert & fraud()), value(fraud()))).alias("fraud_value_recall"),
    ]


SUMS = {"p": "CASE WHEN is_fraud = 1 THEN 1 ELSE 0 END", "l": "CASE WHEN is_fraud = 0 THEN 1 ELSE 0 END", "v": "CASE WHEN is_fraud = 1 THEN amount ELSE 0.0D END"}


def summed(df: DataFrame, column: str = "score", keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``n``, frauds ``p``, others ``l`` and fraud value ``v`` at each score: all that metrics of a threshold need, ties in one row."""
    return counted(df, column, keys, **SUMS)


def alert_columns_of_sums(hit: Column) -> list[Column]:
    """``alert_columns`` of rows summed by score."""
    r = lambda a, b: F.round(ratio(a, b), 9)
    of = lambda c: F.sum(F.when(hit, F.col(c)).otherwise(0))
    return [of("n").cast("long").alias("alerts"), r(of("p"), of("n")).alias("precision"), r(of("p"), F.sum("p")).alias("recall"), r(of("l"), F.sum("l")).alias("legit_flag_rate"), r(of("v"), F.sum("v")).alias("fraud_value_recall")]


def by_score(df: DataFrame, column: str = "score", keys: tuple[str, ...] = ()) -> DataFrame:
    """Frauds and others at each score and from there up. Rows are summed by score before scores are ordered."""
    g = df.groupBy(*keys, column).agg(count(fraud()).alias("p"), count(legit()).alias("n"))
    return running(g, column, {"tp": "p", "fp": "n"}, keys)


def average_ranks_auc(df: DataFrame, column: str = "score", keys: tuple[str, ...] = ()) -> DataFrame:
    """Area under the curve of each group, ties half."""
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2))
    return by_score(df, column, keys).groupBy(*keys).agg(F.round(ratio(area, F.sum("p") * F.sum("n")), 9).alias("roc_auc"))


def roc_auc(df: DataFrame) -> DataFrame:
    return average_ranks_auc(df)


def average_precision(df: DataFrame) -> DataFrame:
    s = by_score(df)
    return s.agg(F.round(ratio(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.sum("p")), 9).alias("average_precision"))


def brier() -> Column:
    return F.round(F.avg(F.pow(F.col("score") - F.col("is_fraud"), 2)), 9).alias("brier")


def brier_and_log_loss(df: DataFrame, eps: float = 1e-15) -> DataFrame:
    p = F.least(F.greatest("score", F.lit(eps)), F.lit(1 - eps))
    return df.agg(brier(), F.round(-F.avg(F.when(fraud(), F.log(p)).otherwise(F.log(1 - p))), 9).alias("log_loss"))


def calibration_bin(p: Column, bins: int = 10) -> Column:
    """Number of the bin that a probability lies in. Its edges are the doubles i * (1 / bins), so 0.3, 0.6 and 0.7 lie just below theirs; the last bin holds 1."""
    return sum((p >= F.lit(i * (1 / bins))).cast("int") for i in range(1, bins))


def calibration_error(df: DataFrame, bins: int = 10) -> DataFrame:
    g = df.groupBy(calibration_bin(F.col("score"), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("s"), F.avg("is_fraud").alias("y"))
    return g.agg(F.round(F.sum(F.col("n") * F.abs(F.col("s") - F.col("y"))) / F.sum("n"), 9).alias("ece"))


def psi(expected: DataFrame, actual: DataFrame, by: str | None = None, bins: int = 10) -> DataFrame:
    """Population stability of ``actual`` scores, for each value of ``by``, by quantile cuts of ``expected``; fewer than three cuts give 0."""
    found = quantiles(counted(expected, "score"), "score", [i / bins for i in range(bins + 1)]).first()
    cuts = sorted(set(found["q"] if found else []))
    keys = [by] if by else []
    if len(cuts) < 3:
        return actual.groupBy(*keys).agg(F.lit(0.0).alias("psi"))
    inner = cuts[1:-1]
    bin_ = sum(F.when(F.col("score") >= c, 1).otherwise(0) for c in inner)
    share = lambda df, k, n: df.groupBy(*k, bin_.alias("bin")).agg(F.count("*").alias("n")).withColumn(n, F.col("n") / F.sum("n").over(Window.partitionBy(*k))).drop("n")
    e = share(expected, [], "e")
    a = share(actual, keys, "a")
    grid = actual.select(*keys).distinct().crossJoin(actual.sparkSession.range(len(inner) + 1).select(F.col("id").cast("int").alias("bin"))) if by else actual.sparkSession.range(len(inner) + 1).select(F.col("id").cast("int").alias("bin"))  # groups times bins
    full = grid.join(e, "bin", "left").join(a, [*keys, "bin"], "left")
    ee, aa = F.greatest(F.coalesce("e", F.lit(0.0)), F.lit(1e-6)), F.greatest(F.coalesce("a", F.lit(0.0)), F.lit(1e-6))
    return full.groupBy(*keys).agg(F.round(F.sum((aa - ee) * F.log(aa / ee)), 6).alias("psi"))


def threshold_at_fpr(df: DataFrame, target: float) -> float:
    """Linear quantile of the legitimate scores."""
    return quantile(df.where(legit()), "score", 1 - target)


def hard_caps(df: DataFrame, target: float, column: str = "score", keys: tuple[str, ...] = ()) -> dict[tuple, float]:
    """For each group the lowest threshold at which no more than the target share of legitimate rows is flagged, whatever the ties.

    With k = floor(target * n) the threshold is the k-th highest legitimate score, or just above it where its ties go
    beyond k; just above the highest if k is 0, and the lowest score if the target is 1.
    """
    if not 0 <= target <= 1:
        raise ValueError("a target between 0 and 1 is needed")
    g = counted(df.where(legit()), column, keys)
    bad = F.sum(F.when(F.col(column).isNull() | F.isnan(column) | (F.abs(F.col(column)) == math.inf), F.col("n")).otherwise(0))
    ends = g.groupBy(*keys).agg(F.sum("n").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"), bad.alias("bad"))
    k = F.floor(F.lit(float(target)) * F.col("n")).cast("long")
    at = at_places(g, column, ends.where(k > 0).select(*keys, F.lit(0).alias("_i"), (k - 1).alias("_r")), keys, descending=True)
    found = joined(ends, at, list(keys), "left").collect()  # a row for each group
    if not found or any(not r["n"] or r["bad"] for r in found):
        raise ValueError("legitimate rows with finite scores are needed")
    out = {}
    for r in found:
        group = tuple(r[c] for c in keys)
        if target == 1:
            out[group] = r["low"]
        elif r["_v"] is None:
            out[group] = math.nextafter(r["high"], math.inf)
        else:
            out[group] = r["_v"] if r["_before"] + r["_at"] <= r["_r"] + 1 else math.nextafter(r["_v"], math.inf)
    return out


def threshold_at_legit_rate(df: DataFrame, target: float) -> float:
    """The hard cap of the whole table."""
    return hard_caps(df, target)[()]


def _in_bounds(df: DataFrame) -> None:
    bad = df.agg(count(F.col("score").isNull() | F.isnan("score") | ~F.col("score").between(0, 1))).first()[0]
    if bad:
        raise ValueError("probabilities in [0, 1] are needed")


def ranking(df: DataFrame) -> DataFrame:
    """One row of what depends on the order of scores alone, from rows summed by score once: roc_auc and pr_auc."""
    area, precision = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return by_score(df).agg(F.round(ratio(area, F.sum("p") * F.sum("n")), 9).alias("roc_auc"), F.round(ratio(precision, F.sum("p")), 9).alias("pr_auc"))


def binary_metrics(df: DataFrame, threshold: float) -> DataFrame:
    """One row of ranking, calibration and threshold metrics; probabilities outside [0, 1] are an error."""
    _in_bounds(df)
    return ranking(df).crossJoin(df.agg(brier(), F.lit(threshold).alias("threshold"), *alert_columns(F.col("score") >= threshold)))  # one row each


def at_thresholds(df: DataFrame, thresholds: list[float]) -> list[dict]:
    """``binary_metrics`` at each threshold: rows are ordered once and counted once for all of them."""
    _in_bounds(df)
    each = [F.struct(brier(), F.lit(t).alias("threshold"), *alert_columns(F.col("score") >= t)) for t in thresholds]
    order = ranking(df).first().asDict()
    return [order | r.asDict() for r in df.agg(F.array(*each)).first()[0]]


def model_metrics(name: str, df: DataFrame, threshold: float) -> DataFrame:
    """As binary_metrics by the names of the model table; precision without alerts is 0."""
    m = binary_metrics(df, threshold)
    return m.select(
        F.lit(name).alias("model"), "pr_auc", "roc_auc", "brier", F.col("threshold").alias("threshold_at_1pct_fpr"), F.coalesce("precision", F.lit(0.0)).alias("precision_at_1pct_fpr"), F.coalesce("recall", F.lit(0.0)).alias("recall_at_1pct_fpr"),
        F.col("fraud_value_recall").alias("fraud_value_recall_at_1pct_fpr"), "legit_flag_rate",
    )


def value_concentration(df: DataFrame, shares=(0.1, 0.25, 0.5)) -> DataFrame:
    """Share of fraud value in the largest fraud cases: of n cases the first ceil(share * n), at least one."""
    cases = running(counted(df.where(fraud()), "amount"), "amount", {"_upto": "n"})
    cases = cases.crossJoin(F.broadcast(cases.agg(F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("amount")).alias("_v"))))  # one row of sums
    most = lambda s: F.greatest(F.lit(1), F.ceil(F.col("_n") * s))
    taken = lambda s: F.greatest(F.lit(0), F.least(F.col("n"), most(s) - (F.col("_upto") - F.col("n"))))
    return cases.agg(*(F.round(F.sum(taken(s) * F.col("amount")) / F.max("_v"), 9).alias(f"top_{int(s * 100)}") for s in shares))


def locked(df: DataFrame, threshold: float, target: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each group at a threshold fixed beforehand: size, alerts, the multiple of the alert budget, and quantiles of the score; ``_rate`` is the flag rate of the others.

    Rows are summed by score once; sums and quantiles are made of that.
    """
    g = summed(df, keys=keys)
    r9 = lambda c: F.round(c, 9)
    hit = F.col("score") >= threshold
    rate = ratio(F.sum(F.when(hit, F.col("l")).otherwise(0)), F.sum("l"))
    one = g.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("p").cast("long").alias("fraud_n"), r9(F.sum("p") / F.sum("n")).alias("fraud_rate"), F.lit(threshold).alias("threshold"), *alert_columns_of_sums(hit), r9(ratio(F.sum(F.when(hit, F.col("n")).otherwise(0)), F.sum("n"))).alias("alert_rate"),
        F.round(rate * 10_000, 6).alias("legit_alerts_per_10k"), F.round(rate / target if target else F.lit(None).cast("double"), 6).alias("budget_multiplier_vs_target"), rate.alias("_rate"),
    )
    q = quantiles(g, "score", [0.5, 0.9, 0.99, 0.999], keys)
    return joined(one, q, list(keys), "left").withColumns({x: r9(F.col("q")[i]) for i, x in enumerate(("score_p50", "score_p90", "score_p99", "score_p999"))}).drop("q")


def threshold_drift(df: DataFrame, threshold: float, by: str = "period") -> DataFrame:
    """Distribution of scores and amounts and performance at a locked threshold for each period; scores and amounts go through the same passes. Periods come in the order of time."""
    both = F.explode(F.array(F.struct(F.lit(0).alias("_of"), F.col("score").alias("x")), F.struct(F.lit(1).alias("_of"), F.col("amount").alias("x"))))
    g = counted(df.select(by, "is_fraud", both.alias("s")).select(by, "is_fraud", "s.*"), "x", (by, "_of"), p=SUMS["p"], l=SUMS["l"])
    r9, hit = lambda c: F.round(c, 9), F.col("x") >= threshold
    of = lambda c: F.sum(F.when(hit, F.col(c)).otherwise(0))
    one = g.where("_of = 0").groupBy(by).agg(
        F.sum("n").alias("n"), r9(F.sum("p") / F.sum("n")).alias("fraud_rate"), r9(F.sum(F.col("x") * F.col("n")) / F.sum(F.when(F.col("x").isNotNull(), F.col("n")))).alias("mean_score"),
        of("n").cast("long").alias("alerts"), r9(ratio(of("p"), F.sum("p"))).alias("recall_at_locked_threshold"), r9(ratio(of("l"), F.sum("l"))).alias("legit_flag_rate_at_locked_threshold"),
    )
    q = quantiles(g, "x", [0.5, 0.9, 0.99], (by, "_of")).groupBy(by).agg(*(F.max(F.when(F.col("_of") == i, F.col("q"))).alias(c) for i, c in enumerate(("_s", "_a"))))
    named = {x: r9(F.col("_s")[i]) for i, x in enumerate(("score_p50", "score_p90", "score_p99"))} | {"amount_p99": F.round(F.col("_a")[2], 6)}
    in_time = F.expr(f"CASE `{by}` WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END")
    return joined(one, q, [by], "left").withColumns(named).drop("_s", "_a").orderBy(in_time, by)


def locked_threshold_drift(df: DataFrame, threshold: float, target: float = 0.001, by: str = "period", base: str = "validation") -> DataFrame:
    """Each period at the locked threshold, its flag rate also as a multiple of the base period's."""
    out = locked(df, threshold, target, (by,))
    base_rate = F.max(F.when(F.col(by) == base, F.col("_rate"))).over(Window.partitionBy())  # a row for each period
    return out.withColumn("budget_multiplier_vs_validation_actual", F.when(F.col(by) == base, 1.0).otherwise(F.round(F.try_divide("_rate", base_rate), 6))).drop("_rate")


def posthoc_threshold_cap(df: DataFrame, target: float = 0.001) -> DataFrame:
    """The hard cap found on the rows themselves: a diagnostic after the fact."""
    row = locked(df, threshold_at_legit_rate(df, target), target).drop("_rate")
    return row.select(F.lit("future_test_posthoc_threshold_cap").alias("period"), "*", F.lit(True).alias("diagnostic_only"), F.lit(True).alias("may_underuse_budget_due_to_ties"))


posthoc_budget_match = posthoc_threshold_cap
