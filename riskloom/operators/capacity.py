"""Exact review capacity: the k highest scores, ties by a key that says nothing of labels or amounts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import priority, ratio
from ..sources.transactions import unsigned
from .metrics import alert_columns, average_ranks_auc, count, fraud, hard_caps, legit, SUMS, summed
from .order import LARGEST, counted, firsts, joined, large, quantile, quantiles

ALPHAS = (0.0, 0.25, 0.5, 0.75, 1.0)
BUDGETS = (10, 25, 50, 100)


def step_windows(df: DataFrame, n: int = 3) -> DataFrame:
    """Adds ``window``, ``step_min`` and ``step_max``: contiguous runs of distinct steps, the first ones one step longer if need be."""
    steps = df.select("step").distinct().withColumn("window", F.ntile(n).over(Window.orderBy("step")))  # a row for each hour
    w = Window.partitionBy("window")
    steps = steps.withColumn("step_min", F.min("step").over(w)).withColumn("step_max", F.max("step").over(w))
    return df.join(F.broadcast(steps), "step")


def _r9(c: Column) -> Column:
    return F.round(c, 9)


def frontier(df: DataFrame, budgets=BUDGETS, score: str = "score", keys: tuple[str, ...] = (), tie: str | None = None) -> DataFrame:
    """Metrics of the floor(budget * n / 10,000) highest rows for each budget and group of ``keys``.

    Rows are summed by score, and the score at each budget's end is found among these sums; what lies above it is
    conditional sums of them. Only of rows tied at an end that not all fit in, the key ``tie`` says which do: the unsigned
    event_key where there is one, else transaction_id; it tells rows of one score apart. Negative budgets, empty tables and
    scores that aren't finite are errors.
    """
    if any(b < 0 for b in budgets):
        raise ValueError("budgets must not be negative")
    n, bad = df.agg(F.count("*"), count(F.col(score).isNull() | F.isnan(score) | (F.abs(F.col(score)) == math.inf))).first()
    if not n or bad:
        raise ValueError("rows with finite scores are needed")
    tie = tie or ("event_key" if "event_key" in df.columns else "transaction_id")
    df = df.select(*keys, score, "is_fraud", "amount", (unsigned(tie) if tie == "event_key" else F.col(tie)).alias("_tie"))
    rate = lambda a, b, digits=9, by="": f"round(CAST({a} AS DOUBLE) / nullif({b}, 0){by}, {digits})"
    plan = ", ".join(f"struct({i} AS _i, {float(b)!r}D AS budget)" for i, b in enumerate(budgets))
    out = (_selected if large(df) else _ranked)(df, f"inline(array({plan}))", score, list(keys)).selectExpr("*", "fraud_alerts + legit_alerts AS alerts")
    return out.selectExpr(
        *keys, "budget", "capacity", "CAST(alerts AS BIGINT) AS alerts", f"{rate('alerts', 'n', 6, ' * 10000')} AS actual_alerts_per_10k", f"{rate('fraud_alerts', 'alerts')} AS precision", f"{rate('fraud_alerts', 'fraud_n')} AS recall",
        f"{rate('legit_alerts', 'legit_n')} AS legit_flag_rate", f"{rate('legit_alerts', 'legit_n', 6, ' * 10000')} AS legit_alerts_per_10k", f"{rate('_v', 'fraud_value')} AS fraud_value_recall", "CAST(fraud_alerts AS BIGINT) AS fraud_alerts", "CAST(legit_alerts AS BIGINT) AS legit_alerts",
        "round(_b, 9) AS boundary_score", "CAST(coalesce(_at, 0) AS BIGINT) AS boundary_tie_n", "CAST(CASE WHEN capacity > 0 THEN capacity - _before ELSE 0 END AS BIGINT) AS boundary_tie_selected_n", "'stable_non_label_key' AS tie_breaker", "n", "fraud_n",
    )


CAPACITY = "CAST(floor(budget * n / 10000) AS BIGINT) AS capacity"


def _ranked(df: DataFrame, plan: str, score: str, keys: list[str]) -> DataFrame:
    """Counts and values of each budget from rows ranked within their groups: one shuffle, for tables that a task can order."""
    of = f"PARTITION BY {', '.join(keys)}" if keys else ""
    alike = ", ".join([*keys, f"`{score}`"])
    rows = df.selectExpr("*", f"row_number() OVER ({of} ORDER BY `{score}` DESC, _tie) AS _r", f"rank() OVER ({of} ORDER BY `{score}` DESC) - 1 AS _k", f"count(*) OVER (PARTITION BY {alike}) AS _c", f"count(*) OVER ({of}) AS n")
    rows = rows.selectExpr("*", plan).selectExpr("*", CAPACITY)
    add = lambda x, name, cond="_r <= capacity": F.expr(f"sum(CASE WHEN {cond} THEN {x} ELSE 0 END) AS {name}")
    ends = (F.expr(f"max(CASE WHEN _r = capacity THEN {x} END) AS {name}") for x, name in ((f"`{score}`", "_b"), ("_c", "_at"), ("_k", "_before")))
    return rows.groupBy(*keys, "budget", "capacity", "n").agg(add(SUMS["p"], "fraud_alerts"), add(SUMS["l"], "legit_alerts"), add(SUMS["v"], "_v"), add(SUMS["p"], "fraud_n", "true"), add(SUMS["l"], "legit_n", "true"), add(SUMS["v"], "fraud_value", "true"), *ends)


def _selected(df: DataFrame, plan: str, score: str, keys: list[str]) -> DataFrame:
    """The same without ranks: the score at each budget's end is found among rows summed by score, and what lies above is conditional sums of these."""
    g = summed(df, score, tuple(keys))
    each = g.groupBy(*keys).agg(*map(F.expr, ("sum(n) AS n", "sum(p) AS fraud_n", "sum(l) AS legit_n", "sum(v) AS fraud_value")))
    each = each.selectExpr("*", plan).selectExpr("*", CAPACITY)
    ends = firsts(df, score, each.where("capacity > 0").selectExpr(*keys, "_i", "capacity AS _n"), keys, "_tie", g)
    edges = ends.selectExpr(*keys, "_i", "_v AS _b", "_t", "_at", "_before")
    whole = f"`{score}` > _b OR (`{score}` = _b AND _t = {LARGEST})"
    sums = joined(g, edges, keys).groupBy(*keys, "_i").agg(*(F.expr(f"sum(CASE WHEN {whole} THEN {c} ELSE 0 END) AS {c}_whole") for c in "plv"), *(F.expr(f"first({c}) AS {c}") for c in ("_b", "_at", "_before")))
    some = edges.where(f"_t <> {LARGEST}").selectExpr(*keys, "_i", f"_b AS `{score}`", "_t")
    tied = joined(df, some, [*keys, score]).where("_tie <= _t").groupBy(*keys, "_i").agg(*(F.expr(f"sum({x}) AS {c}_some") for c, x in SUMS.items()))
    out = joined(joined(each, sums, [*keys, "_i"], "left"), tied, [*keys, "_i"], "left")
    return out.selectExpr("*", *(f"coalesce({c}_whole, 0) + coalesce({c}_some, 0) AS {n}" for c, n in (("p", "fraud_alerts"), ("l", "legit_alerts"), ("v", "_v"))))


def capacity_windows(df: DataFrame, per_10k: float = 50, n: int = 3, keys: tuple[str, ...] = (), score: str = "score") -> DataFrame:
    """The same capacity in each window of steps."""
    out = frontier(step_windows(df, n), (per_10k,), score, (*keys, "window", "step_min", "step_max"))
    return out.select(*keys, F.concat(F.lit("future_window_"), F.col("window").cast("string")).alias("period"), *(c for c in out.columns if c not in (*keys, "window")))


def amount_scale(df: DataFrame) -> float:
    """Median of positive amounts, else 1."""
    found = quantile(df.where("amount > 0"), "amount", 0.5)
    return 1.0 if found is None else found


def with_priority(df: DataFrame) -> DataFrame:
    """Adds ``priority`` from score, amount, alpha and amount_scale, rounded so that equal priorities tie."""
    return df.withColumn("priority", F.round(priority(F.col("score"), F.col("amount"), F.col("alpha"), F.col("amount_scale")), 12))


def alpha_grid(df: DataFrame, scale: float, per_10k: float = 50, alphas=ALPHAS, keys: tuple[str, ...] = ()) -> DataFrame:
    """Capacity metrics for each weight alpha of the amount, with the harmonic mean of both recalls."""
    if scale <= 0 or any(a < 0 for a in alphas):
        raise ValueError("a positive scale and weights of 0 or more are needed")
    grid = with_priority(df.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas)))).withColumn("amount_scale", F.lit(float(scale))))
    out = frontier(grid, (per_10k,), "priority", ("alpha", "amount_scale", *keys))
    both = F.col("recall") + F.col("fraud_value_recall")
    return out.withColumn("balanced_hmean", _r9(F.when(both > 0, 2 * F.col("recall") * F.col("fraud_value_recall") / both).otherwise(0.0)))


#: Objectives of each profile in order; on ties the smaller alpha.
PROFILES = {"case_first": ["recall", "precision", "fraud_value_recall"], "balanced": ["balanced_hmean", "precision", "recall"], "value_first": ["fraud_value_recall", "precision", "recall"]}
ROBUST_PROFILES = {
    "case_first": ["min_recall", "mean_recall", "mean_precision", "mean_fraud_value_recall"],
    "balanced": ["min_balanced_hmean", "mean_balanced_hmean", "mean_precision"],
    "value_first": ["min_fraud_value_recall", "mean_fraud_value_recall", "mean_precision", "mean_recall"],
}


def select_profiles(grid: DataFrame, specs=PROFILES, split: str = "validation") -> DataFrame:
    """For each profile the row of the grid, one for each alpha, that is best by its objectives, the smaller alpha on ties."""
    rows = grid.withColumn("profile", F.explode(F.array(*map(F.lit, specs))))
    order = [F.desc_nulls_last(F.coalesce(*(F.when(F.col("profile") == p, F.col(cols[i])) for p, cols in specs.items() if i < len(cols)))) for i in range(max(map(len, specs.values())))]
    first = F.row_number().over(Window.partitionBy("profile").orderBy(*order, "alpha"))
    return rows.withColumn("_r", first).where("_r = 1").drop("_r").withColumn("selection_split", F.lit(split))


def robust_profiles(summary: DataFrame) -> DataFrame:
    return select_profiles(summary, ROBUST_PROFILES, "validation_windows_only")


def _with_profiles(df: DataFrame, selected: DataFrame) -> DataFrame:
    chosen = selected.select("profile", "alpha", "amount_scale").collect()  # three profiles
    each = F.explode(F.array(*(F.struct(*(F.lit(r[c]).alias(c) for c in r.__fields__)) for r in chosen)))
    return with_priority(df.withColumn("_p", each).select("*", "_p.*").drop("_p"))


def evaluate_selected_profiles(selected: DataFrame, df: DataFrame, budgets=BUDGETS) -> DataFrame:
    """Profiles chosen before, each at its alpha and scale, on later rows."""
    return frontier(_with_profiles(df, selected), budgets, "priority", ("profile", "alpha", "amount_scale"))


def evaluate_profile_windows(selected: DataFrame, df: DataFrame, per_10k: float = 50, n: int = 3) -> DataFrame:
    return capacity_windows(_with_profiles(df, selected), per_10k, n, ("profile", "alpha"), "priority")


def robustness(grid: DataFrame) -> DataFrame:
    """Worst, mean and range over windows for each alpha."""
    m = ["recall", "precision", "fraud_value_recall", "balanced_hmean"]
    spread = lambda c: _r9(F.max(c) - F.min(c))
    return grid.groupBy("alpha").agg(F.first("amount_scale").alias("amount_scale"), *(_r9(f(c)).alias(f"{p}_{c}") for c in m for p, f in (("min", F.min), ("mean", F.avg))), spread("recall").alias("recall_range"), spread("fraud_value_recall").alias("value_recall_range"))


SIGNALS = ["recipient_fanin_24h", "recipient_tx_7d", "recipient_amount_24h", "recipient_unique_senders_7d", "recipient_intensity_score"]


def signal_audit(validation: DataFrame, future: DataFrame, signals: list[str] = SIGNALS, target: float = 0.001) -> DataFrame:
    """Each signal, its hard cap on validation as threshold, on the future: alerts, area under the curve, and quantiles of both classes."""
    long = lambda df: df.select("is_fraud", "amount", F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("v")) for s in signals))).alias("x")).select("is_fraud", "amount", "x.*")
    caps = hard_caps(long(validation), target, "v", ("signal",))
    cut = validation.sparkSession.createDataFrame([(s, t) for (s,), t in caps.items()], "signal string, t double")
    past = long(validation).join(F.broadcast(cut), "signal").groupBy("signal").agg(_r9(ratio(count(legit() & (F.col("v") >= F.col("t"))), count(legit()))).alias("validation_actual_legit_flag_rate"))
    now = long(future).join(F.broadcast(cut), "signal").groupBy("signal").agg(F.round(F.max("t"), 6).alias("validation_threshold"), F.lit(target).alias("target_validation_legit_flag_rate"), *alert_columns(F.col("v") >= F.col("t")))
    spread = quantiles(counted(long(future), "v", ("signal", "is_fraud")), "v", [0.5, 0.9], ("signal", "is_fraud"))
    of = lambda y, i: F.round(F.max(F.when(F.col("is_fraud") == y, F.col("q")[i])), 6)
    spread = spread.groupBy("signal").agg(of(1, 0).alias("future_fraud_median"), of(0, 0).alias("future_legit_median"), of(1, 1).alias("future_fraud_p90"), of(0, 1).alias("future_legit_p90"))
    now = now.join(spread, "signal")
    return now.join(past, "signal").join(average_ranks_auc(long(future), "v", ("signal",)).withColumnRenamed("roc_auc", "future_auc"), "signal")
