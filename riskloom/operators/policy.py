"""Rules, approve/review/block policies, costs, prevalence and monitoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import log_amount, precision_from_rates, ratio
from .metrics import alert_columns, count, fraud, legit, psi, value

#: Costs, fixed values: share of loss that blocking and reviewing prevent, cost of a review, of a false block and of a false review.
SCENARIOS = {
    "reference": (0.95, 0.65, 0.75, 5.0, 1.5),
    "high_customer_friction": (0.95, 0.65, 1.0, 20.0, 5.0),
    "conservative_intervention": (0.85, 0.45, 1.5, 10.0, 3.0),
    "strong_intervention_low_friction": (0.98, 0.80, 0.5, 2.0, 0.5),
}


def rule_backtest(tx: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """Metrics of (name, type, least amount) rules, most fraud value first, then fewest flags; each row meets the rules given, a handful."""
    r = F.explode(F.array(*(F.struct(F.lit(n).alias("rule_name"), F.lit(t).alias("tx_type"), F.lit(a).alias("min_amount")) for n, t, a in rules)))
    rows = tx.select("type", "amount", "is_fraud", r.alias("r")).select("*", "r.*")
    return rows.groupBy("rule_name").agg(*alert_columns((F.col("type") == F.col("tx_type")) & (F.col("amount") >= F.col("min_amount")))).orderBy(F.desc_nulls_last("fraud_value_recall"), F.asc_nulls_last("legit_flag_rate"), "rule_name")


def incrementality(tx: DataFrame, scores: DataFrame, rule_threshold: float, model_threshold: float, start: int) -> DataFrame:
    """A type and amount rule against a model on the future."""
    t = tx.where(F.col("step") >= start).drop("score").join(scores.select("transaction_id", "score"), "transaction_id")
    rule = F.col("type").isin("TRANSFER", "CASH_OUT") & (log_amount() >= rule_threshold)
    pair = F.array(F.struct(F.lit("simple_amount_type_rule").alias("detector"), rule.alias("alert")), F.struct(F.lit("ml_model").alias("detector"), (F.col("score") >= model_threshold).alias("alert")))
    return t.select("is_fraud", "amount", F.explode(pair).alias("x")).select("is_fraud", "amount", "x.*").groupBy("detector").agg(*alert_columns(F.col("alert")))


def typology_sizing(tx: DataFrame, bands=(10_000, 50_000, 200_000)) -> DataFrame:
    """Sizes of type and amount band, with their share of all fraud value."""
    a, b, c = bands
    band = F.when(F.col("amount") < a, "1").when(F.col("amount") < b, "2").when(F.col("amount") < c, "3").otherwise("4")
    g = tx.groupBy("type", band.alias("amount_band")).agg(F.count("*").alias("transactions"), count(fraud()).cast("long").alias("fraud_transactions"), F.round(value(fraud()), 4).alias("fraud_value"), F.round(F.sum("amount"), 4).alias("total_value"), F.round(F.avg("is_fraud"), 9).alias("fraud_rate"))
    total = g.agg(F.sum("fraud_value").alias("_all"))
    return g.crossJoin(total).withColumn("share_of_fraud_value", F.round(ratio(F.col("fraud_value"), F.col("_all")), 6)).drop("_all")  # one row of a sum


def grid_thresholds() -> list[tuple[int, float, float]]:
    """(id, review, block) of the policy grid."""
    out = []
    for r in np.arange(0.03, 0.46, 0.03):
        out += [(float(r), float(b)) for b in np.arange(max(0.25, r + 0.10), 0.96, 0.05)]
    return [(i, r, b) for i, (r, b) in enumerate(out)]


def grid_counts(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """For each pair of thresholds the counts and values that any cost model needs.

    The pairs share some thirty thresholds. Rows are summed by the number of thresholds they reach; a pair's sums are those
    of the numbers from its own place on.
    """
    grid = grid_thresholds()
    edges = sorted({t for _, *pair in grid for t in pair})
    reached = F.expr(" + ".join(f"CASE WHEN score >= {t!r}D THEN 1 ELSE 0 END" for t in edges))
    by = df.groupBy(*keys, reached.alias("_at")).agg(F.count("*").alias("n"), count(legit()).alias("legit"), value(fraud()).alias("v"))
    pairs = ", ".join(f"struct({i}L AS grid_id, {r!r}D AS review_threshold, {b!r}D AS block_threshold, {edges.index(r)} AS _r, {edges.index(b)} AS _b)" for i, r, b in grid)
    x = by.selectExpr("*", f"inline(array({pairs}))")  # thresholds times pairs
    block, review = F.col("_at") > F.col("_b"), (F.col("_at") > F.col("_r")) & (F.col("_at") <= F.col("_b"))
    s = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0))
    return x.groupBy(*keys, "grid_id", "review_threshold", "block_threshold").agg(
        s(block, "v").alias("v_block"), s(review, "v").alias("v_review"), F.sum("v").alias("v_all"), s(block, "legit").alias("l_block"), s(review, "legit").alias("l_review"), F.sum("legit").alias("l_all"), s(review, "n").alias("n_review"), s(block, "n").alias("n_block"), F.sum("n").alias("n_all")
    )


def policy_cost(costs) -> Column:
    block, review, case, false_block, false_review = costs
    return F.col("v_all") - F.col("v_block") * block - F.col("v_review") * review + F.col("n_review") * case + F.col("l_block") * false_block + F.col("l_review") * false_review


def grid_metrics(counted: DataFrame, costs) -> DataFrame:
    """Value prevented, friction, rates and costs of each pair of thresholds."""
    prevented = F.col("v_block") * costs[0] + F.col("v_review") * costs[1]
    operational = F.col("n_review") * costs[2] + F.col("l_block") * costs[3] + F.col("l_review") * costs[4]
    return counted.select(
        "grid_id", F.round("review_threshold", 9).alias("review_threshold"), F.round("block_threshold", 9).alias("block_threshold"), F.round(prevented, 4).alias("fraud_value_prevented"), F.round(prevented / F.greatest("v_all", F.lit(1.0)), 9).alias("fraud_value_prevented_rate"),
        F.round((F.col("l_block") + F.col("l_review")) / F.greatest("l_all", F.lit(1)), 9).alias("legit_friction_rate"), F.round(F.col("n_review") / F.col("n_all"), 9).alias("review_rate"), F.round(F.col("n_block") / F.col("n_all"), 9).alias("block_rate"),
        F.round(F.col("v_all") - prevented, 4).alias("residual_fraud_loss"), F.round(operational, 4).alias("operational_and_friction_cost"), F.round(policy_cost(costs), 6).alias("total_policy_cost"),
    )


def policy_grid(df: DataFrame, costs=SCENARIOS["reference"]) -> DataFrame:
    return grid_metrics(grid_counts(df), costs)


def cheapest(grid: DataFrame) -> DataFrame:
    """The pair of least cost, the first of equal ones: one row."""
    return grid.orderBy("total_policy_cost", "grid_id").limit(1)


def policy_summary(val: DataFrame, test: DataFrame, costs=SCENARIOS["reference"]) -> DataFrame:
    """The pair that is cheapest on validation, and what it does on later rows."""
    best = cheapest(policy_grid(val, costs)).select("grid_id")
    return policy_grid(test, costs).join(F.broadcast(best), "grid_id").select(
        "review_threshold", "block_threshold", F.col("fraud_value_prevented_rate").alias("test_fraud_value_prevented_rate"), F.col("legit_friction_rate").alias("test_legitimate_friction_rate"), F.col("review_rate").alias("test_review_rate"), F.col("block_rate").alias("test_block_rate")
    )


def policy_sensitivity(val: DataFrame, test: DataFrame, scenarios=SCENARIOS) -> DataFrame:
    """For each cost scenario the pair that is cheapest on validation, its cost on the future, and its regret against the pair cheapest there."""
    a, b, out = grid_counts(val), grid_counts(test), None
    for name, costs in scenarios.items():
        chosen = cheapest(grid_metrics(a, costs)).select("grid_id", F.col("total_policy_cost").alias("_val"))
        t = grid_metrics(b, costs)
        row = t.join(F.broadcast(chosen), "grid_id").crossJoin(t.agg(F.min("total_policy_cost").alias("_best")))  # one row each
        terms = dict(zip(("block_efficacy", "review_efficacy", "review_case_cost", "false_block_cost_unit", "false_review_cost_unit"), costs, strict=True))
        row = row.select(
            F.lit(name).alias("scenario"), *(F.lit(v).alias(k) for k, v in terms.items()), F.col("review_threshold").alias("selected_review_threshold"), F.col("block_threshold").alias("selected_block_threshold"), F.round("_val", 4).alias("validation_total_cost"),
            F.col("fraud_value_prevented_rate").alias("test_fraud_value_prevented_rate"), F.col("legit_friction_rate").alias("test_legit_friction_rate"), F.round("total_policy_cost", 4).alias("test_total_cost"), F.round("_best", 4).alias("test_oracle_total_cost"),
            F.round((F.col("total_policy_cost") - F.col("_best")) / F.greatest("_best", F.lit(1e-9)), 6).alias("test_policy_regret"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def prevalence_sensitivity(df: DataFrame, threshold: float, prevalences=(0.001, 0.0025, 0.005, 0.01, 0.02)) -> DataFrame:
    """Precision that the same recall and flag rate give at other shares of fraud."""
    hit = F.col("score") >= threshold
    one = df.agg(ratio(count(hit & fraud()), count(fraud())).alias("tpr"), ratio(count(hit & legit()), count(legit())).alias("fpr"))
    rows = one.withColumn("fraud_prevalence", F.explode(F.array(*map(F.lit, prevalences))))
    return rows.select("fraud_prevalence", F.round("tpr", 9).alias("measured_tpr"), F.round("fpr", 9).alias("measured_fpr"), F.round(precision_from_rates(F.col("fraud_prevalence"), F.col("tpr"), F.col("fpr")), 9).alias("expected_alert_precision"))


def week_label() -> Column:
    """Monday and Sunday of the week of ``us``, as 2024-01-01/2024-01-07."""
    monday = F.date_add(F.lit("1969-12-29").cast("date"), (F.floor((F.floor(F.col("us") / 86_400_000_000) + 3) / 7) * 7).cast("int"))
    return F.concat(monday.cast("string"), F.lit("/"), F.date_add(monday, 6).cast("string"))


def weekly_monitor(df: DataFrame, baseline: DataFrame, threshold: float, tail_threshold: float | None = None, baseline_tail_rate: float | None = None) -> DataFrame:
    """Each week's rates, score stability against the baseline, and a status; rows with ``tail_score`` may also raise the tail alarm.

    The alarm is a share of tail alerts of 0.005 or more and of 1.5 times that of the baseline.
    """
    r9 = lambda c: F.round(c, 9)
    z = df.withColumn("week", week_label())
    share = lambda cond: r9(F.avg(cond.cast("int")))
    tail = [share(F.col("tail_score") > tail_threshold).alias("tail_alert_rate")] if tail_threshold is not None else []
    g = z.groupBy("week").agg(
        F.count("*").alias("n"), r9(F.avg("is_fraud")).alias("fraud_rate"), F.round(value(fraud()), 4).alias("fraud_value"), share(F.col("score") >= threshold).alias("model_alert_rate"), r9(F.avg("score")).alias("mean_model_score"), r9(F.avg(F.pow(F.col("score") - F.col("is_fraud"), 2))).alias("brier"),
        share(F.col("fraud_type") == "novel_shared_device_microburst").alias("novel_fraud_rate"), *tail,
    ).join(psi(baseline, z, "week").withColumnRenamed("psi", "score_psi_vs_validation"), "week")
    alarm = F.col("tail_alert_rate") >= max(0.005, 1.5 * baseline_tail_rate) if tail and baseline_tail_rate is not None else F.lit(False)
    drift = F.col("score_psi_vs_validation")
    return g.withColumn("status", F.when(alarm | (drift >= 0.25), "INVESTIGATE").when(drift >= 0.10, "WATCH").otherwise("NORMAL"))
