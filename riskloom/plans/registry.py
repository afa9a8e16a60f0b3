"""Queries over the driver's tables, each with SQL of its own to check it by."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import capacity, isolation, metrics, models, pit, policy, queues, ranges
from ..sources import transactions as src
from . import benchmark

#: Places of the split of the fixture's 720 steps at 60 and 80 %.
VAL, TEST = 433, 577
RULES = [("transfer_100", "TRANSFER", 100.0), ("transfer_250", "TRANSFER", 250.0), ("cashout_100", "CASH_OUT", 100.0), ("cashout_250", "CASH_OUT", 250.0)]
THRESHOLD, ANOMALY = 0.6, 300.0

TX = """WITH b AS (SELECT event_id AS transaction_id, epoch_us(ts) AS us, CAST(epoch_us(ts) // 3600000000 - 473351 AS INT) AS step,
 CASE event_type WHEN 'click' THEN 'PAYMENT' WHEN 'purchase' THEN 'TRANSFER' WHEN 'error' THEN 'CASH_OUT' WHEN 'view' THEN 'CASH_IN' ELSE 'DEBIT' END AS type,
 value AS amount, concat('C', CAST(user_id AS VARCHAR)) AS sender, concat('M', json_extract_string(props,'$.k')) AS recipient, concat('D', CAST(event_id % 40 AS VARCHAR)) AS device_id,
 CAST(CASE WHEN (event_id*7919) % 97 < 3 THEN 1 ELSE 0 END AS INT) AS is_fraud FROM events),
tx AS (SELECT *, CAST(CASE WHEN is_fraud=1 AND amount>100 THEN 1 ELSE 0 END AS INT) AS is_flagged_fraud, amount AS anomaly,
 LEAST(1.0::DOUBLE, ((transaction_id*7919) % 1000)/1000.0::DOUBLE*0.7::DOUBLE + is_fraud*0.3::DOUBLE) AS score,
 CASE WHEN is_fraud=0 THEN 'none' WHEN step>=577 AND transaction_id%2=0 THEN 'novel_shared_device_microburst' WHEN transaction_id%3=0 THEN 'account_takeover' WHEN transaction_id%3=1 THEN 'transfer_burst' ELSE 'mule_cashout' END AS fraud_type FROM b),
val AS (SELECT * FROM tx WHERE step >= 433 AND step < 577), fut AS (SELECT * FROM tx WHERE step >= 577), eval AS (SELECT *, CASE WHEN step < 577 THEN 'validation' ELSE 'future_test' END AS period FROM tx WHERE step >= 433) """


def tx(spark: SparkSession, d: str) -> DataFrame:
    return labelled(src.fixture(spark, d).withColumn("anomaly", F.col("amount")))


def val(spark: SparkSession, d: str) -> DataFrame:
    return tx(spark, d).where(F.col("step").between(VAL, TEST - 1))


def fut(spark: SparkSession, d: str) -> DataFrame:
    return tx(spark, d).where(F.col("step") >= TEST)


def evaluation(spark: SparkSession, d: str) -> DataFrame:
    return src.with_period(tx(spark, d).where(F.col("step") >= VAL), src.Split(VAL, TEST))


def alerts(cond: str, legit: str = "is_fraud=0") -> str:
    """SQL of the alert columns."""
    s = lambda c, v="1": f"SUM(CASE WHEN {c} THEN {v} ELSE 0 END)"
    r = lambda a, b: f"ROUND(CAST({a} AS DOUBLE)/NULLIF({b},0), 9)"
    return (f"CAST({s(cond)} AS BIGINT) AS alerts, {r(s(f'({cond}) AND is_fraud=1'), s(cond))} AS precision, {r(s(f'({cond}) AND is_fraud=1'), s('is_fraud=1'))} AS recall, "
            f"{r(s(f'({cond}) AND is_fraud=0'), s('is_fraud=0'))} AS legit_flag_rate, {r(s(f'({cond}) AND is_fraud=1', 'amount'), s('is_fraud=1', 'amount'))} AS fraud_value_recall")  # fmt: skip


def frame(key: str, at: str, back: int) -> str:
    return f"(PARTITION BY {key} ORDER BY {at} RANGE BETWEEN {back} PRECEDING AND 1 PRECEDING)"


H = pit.HOUR
CURVE = "s AS (SELECT score, SUM(is_fraud) p, SUM(1-is_fraud) n FROM eval GROUP BY score), c AS (SELECT *, SUM(p) OVER w tp, SUM(n) OVER w fp FROM s WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) "
FEATURES = f"""f AS (SELECT *, COUNT(*) OVER {frame('recipient', 'step', 24)} AS recipient_tx_24h, ROUND(COALESCE(SUM(amount) OVER {frame('recipient', 'step', 24)},0),4) AS recipient_amount_24h,
 COUNT(*) OVER {frame('recipient', 'step', 168)} AS recipient_tx_7d, COUNT(DISTINCT sender) OVER {frame('recipient', 'step', 168)} AS unique_senders_7d, COUNT(*) OVER {frame('sender, recipient', 'step', 168)} AS pair_tx_7d FROM tx) """
def frontier_sql(source: str, key: str = "", score: str = "score", budgets: str = "(10.0),(25.0),(50.0),(100.0)", more: str = "", head: str = "") -> str:
    """SQL of capacity metrics: rows ranked in each group, each budget's first k of them, and the ties at its last one."""
    names = [x.strip() for x in key.split(",")] if key else []
    of = lambda t: "".join(f"{t}.{x}, " for x in names)
    k = f"{key}, " if key else ""
    same = lambda t, u: " AND ".join(f"{t}.{x}={u}.{x}" for x in names) or "TRUE"
    r = lambda a, b, by="": f"ROUND(CAST({a} AS DOUBLE)/NULLIF({b},0){by},{6 if by else 9})"
    return f""", r AS (SELECT {k}is_fraud, amount, {score} AS s, ROW_NUMBER() OVER ({'PARTITION BY ' + key if key else ''} ORDER BY {score} DESC, transaction_id) rn FROM {source}),
z AS (SELECT {k}COUNT(*) n, SUM(is_fraud) f, SUM(1-is_fraud) l, SUM(amount*is_fraud) v FROM {source} {'GROUP BY ' + key if key else ''}),
a AS (SELECT {of('z')}b.budget, CAST(FLOOR(b.budget*z.n/10000) AS BIGINT) AS k, z.n, z.f, z.l, z.v FROM z CROSS JOIN (VALUES {budgets}) b(budget)),
o AS (SELECT {of('a')}a.budget, MAX(a.k) k, SUM(CASE WHEN rn<=a.k THEN is_fraud ELSE 0 END) tp, SUM(CASE WHEN rn<=a.k THEN 1-is_fraud ELSE 0 END) fp, SUM(CASE WHEN rn<=a.k THEN amount*is_fraud ELSE 0 END) tv, MIN(CASE WHEN rn<=a.k THEN s END) bs, MAX(f) f, MAX(l) l, MAX(v) v, MAX(n) n FROM a JOIN r ON {same('a', 'r')} GROUP BY ALL),
t AS (SELECT {of('o')}o.budget, SUM(CASE WHEN s=bs THEN 1 ELSE 0 END) tn, SUM(CASE WHEN s=bs AND rn<=o.k THEN 1 ELSE 0 END) ts FROM o JOIN r ON {same('o', 'r')} GROUP BY ALL)
SELECT {head or of('o')}CAST(o.budget AS DOUBLE) budget, o.k AS capacity, CAST(tp+fp AS BIGINT) AS alerts, {r('(tp+fp)', 'o.n', '*10000')} AS actual_alerts_per_10k, {r('tp', '(tp+fp)')} AS precision, {r('tp', 'f')} AS recall, {r('fp', 'l')} AS legit_flag_rate, {r('fp', 'l', '*10000')} AS legit_alerts_per_10k, ROUND(tv/NULLIF(v,0),9) AS fraud_value_recall,
 CAST(tp AS BIGINT) AS fraud_alerts, CAST(fp AS BIGINT) AS legit_alerts, ROUND(bs,9) AS boundary_score, CAST(tn AS BIGINT) AS boundary_tie_n, CAST(ts AS BIGINT) AS boundary_tie_selected_n, 'stable_non_label_key' AS tie_breaker, o.n AS n, CAST(f AS BIGINT) AS fraud_n{more} FROM o JOIN t ON {same('o', 't')} AND o.budget=t.budget"""


WINDOWS = ", wy AS (SELECT step, NTILE(3) OVER (ORDER BY step) nt FROM (SELECT DISTINCT step FROM {t}) q), w AS (SELECT x.*, CAST(nt AS INT) AS win, MIN(y.step) OVER (PARTITION BY nt) step_min, MAX(y.step) OVER (PARTITION BY nt) step_max FROM {t} x JOIN wy y USING (step))"
SCALE = "(SELECT COALESCE(MEDIAN(amount) FILTER (WHERE amount>0),1.0) FROM val)"
PRIORITY = "ROUND(CASE WHEN alpha=0 THEN score ELSE score*POW(GREATEST(amount,0)/sc.v, alpha) END, 12)"
ALPHA = ", sc AS (SELECT " + SCALE + " AS v), g AS (SELECT x.*, alpha, sc.v AS amount_scale, " + PRIORITY + " AS priority FROM {t} x CROSS JOIN sc CROSS JOIN (VALUES (0.0::DOUBLE),(0.25),(0.5),(0.75),(1.0)) q(alpha)), scale AS (SELECT v AS amount_scale FROM sc)"
HMEAN = ", ROUND(CASE WHEN ROUND(CAST(tp AS DOUBLE)/NULLIF(f,0),9)+ROUND(tv/NULLIF(v,0),9)>0 THEN 2*ROUND(CAST(tp AS DOUBLE)/NULLIF(f,0),9)*ROUND(tv/NULLIF(v,0),9)/(ROUND(CAST(tp AS DOUBLE)/NULLIF(f,0),9)+ROUND(tv/NULLIF(v,0),9)) ELSE 0 END,9) AS balanced_hmean"
GRID_VALUES = ",".join(f"({i},{r!r}::DOUBLE,{b!r}::DOUBLE)" for i, r, b in policy.grid_thresholds())


def grid_sql(name: str, source: str) -> str:
    s = lambda c, v: f"SUM(CASE WHEN {c} THEN {v} ELSE 0 END)"
    bl, rv = "score>=block_t", "score>=review_t AND score<block_t"
    return f""", {name} AS (SELECT grid_id, MAX(review_t) review_t, MAX(block_t) block_t, {s(bl, 'amount*is_fraud')} v_block, {s(rv, 'amount*is_fraud')} v_review, SUM(amount*is_fraud) v_all, {s(bl, '1-is_fraud')} l_block, {s(rv, '1-is_fraud')} l_review, SUM(1-is_fraud) l_all, {s(rv, '1')} n_review, {s(bl, '1')} n_block, COUNT(*) n_all
 FROM {source} CROSS JOIN (VALUES {GRID_VALUES}) g(grid_id, review_t, block_t) GROUP BY grid_id)"""


def cost_sql(c) -> str:
    return f"v_all-v_block*{c[0]}-v_review*{c[1]}+n_review*{c[2]}+l_block*{c[3]}+l_review*{c[4]}"


def _scale(spark, d):
    return capacity.amount_scale(val(spark, d))


def _grid(spark, d):
    return capacity.alpha_grid(val(spark, d), _scale(spark, d))


def _window_grid(spark, d):
    return capacity.alpha_grid(capacity.step_windows(val(spark, d)), _scale(spark, d), keys=("window", "step_min", "step_max"))


def _signals(spark, d):
    t = tx(spark, d)
    f = pit.recipient_features(t.where(F.col("step") >= VAL - pit.WEEK)).where(F.col("step") >= VAL).withColumn("recipient_intensity_score", F.round(scoring.recipient_intensity(), 9))
    with models.kept(f.select("step", "is_fraud", "amount", *capacity.SIGNALS)) as f:
        out = capacity.signal_audit(f.where(F.col("step").between(VAL, TEST - 1)), f.where(F.col("step") >= TEST), target=0.01)
        return spark.createDataFrame(out.collect(), out.schema)  # a row for each signal, while the rows are kept


def _candidates(spark, d):
    return queues.lanes(evaluation(spark, d), 0.45, 0.65, 400.0)


def _legit_rate(spark, d):
    t = metrics.threshold_at_legit_rate(val(spark, d), 0.01)
    return fut(spark, d).agg(F.round(F.lit(t), 9).alias("threshold"), *metrics.alert_columns(F.col("score") >= t))


def _fpr(spark, d):
    t = metrics.threshold_at_fpr(val(spark, d), 0.01)
    return fut(spark, d).agg(F.round(F.lit(t), 9).alias("threshold"), *metrics.alert_columns(F.col("score") >= t))


def _periods(spark, d):
    return src.with_period(tx(spark, d), src.Split(VAL, TEST))


def _robust(spark, d):
    return capacity.robust_profiles(capacity.robustness(_window_grid(spark, d)))


def _investigation(spark, d):
    t = evaluation(spark, d)
    return queues.investigation_queue(t.join(pit.payment_features(tx(spark, d)), "transaction_id"))


def _tail_rows(spark, d):
    t = tx(spark, d)
    return t.withColumn("tail_score", F.round(F.log1p("amount") / 5, 9))


def _weekly(spark, d):
    t = _tail_rows(spark, d)
    past = t.where(F.col("step").between(VAL, TEST - 1))
    return policy.weekly_monitor(t.where(F.col("step") >= TEST), past, THRESHOLD, 1.2, 0.05)


#: Bind parameters take the place of literals; the text is SQL as an analyst would send it.
BOUND_SQL = """SELECT CASE WHEN step < :validation_start THEN 'train' WHEN step < :test_start THEN 'validation' ELSE 'future_test' END AS period, COUNT(*) AS n,
 CAST(SUM(CASE WHEN score >= :threshold THEN 1 ELSE 0 END) AS BIGINT) AS alerts, ROUND(SUM(CASE WHEN score >= :threshold THEN is_fraud ELSE 0 END) / NULLIF(CAST(SUM(is_fraud) AS DOUBLE), 0), 9) AS recall FROM {tx} GROUP BY 1"""


def _bound(spark, d):
    return spark.sql(BOUND_SQL, args={"validation_start": VAL, "test_start": TEST, "threshold": THRESHOLD}, tx=tx(spark, d))


def _features_out(df: DataFrame) -> DataFrame:
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.select("transaction_id", *(F.round(c, 7).alias(c) if c in doubles else c for c in df.columns if c.startswith(("sender_", "recipient_", "pair_", "type_", "log_", "amount_vs"))))


TAILS = ["sender_tx_24h", "recipient_fanin_24h", "recipient_tx_7d", "sender_unique_recipients_7d", "recipient_unique_senders_7d"]
FEATURES_ML = ["log_amount", *TAILS, "sender_tx_1h", "sender_tx_7d", "pair_tx_7d", "amount_vs_7d_mean", "type_cash_out", "type_transfer"]
#: Trees of the fixture's models; the operators' own default is that of the full workflow.
TREES = 8
KINDS = ("account_takeover", "transfer_burst", "mule_cashout")


def labelled(t: DataFrame) -> DataFrame:
    """The fixture's days and kinds of fraud, fixed functions of step and id."""
    kind = F.when(F.col("is_fraud") == 0, "none").when((F.col("step") >= TEST) & (F.col("transaction_id") % 2 == 0), models.NOVEL).otherwise(F.element_at(F.array(F.lit("account_takeover"), F.lit("transfer_burst"), F.lit("mule_cashout")), (F.col("transaction_id") % 3 + 1).cast("int")))
    return t.withColumn("day", F.floor(F.col("step") / 24).cast("int")).withColumn("fraud_type", kind)


def _ml(s, d):
    return pit.step_features(tx(s, d)).select("transaction_id", "step", "day", "is_fraud", "fraud_type", "amount", "score", *FEATURES_ML)


def _span(s, d, low: int | None, high: int | None, features: list[str]) -> DataFrame:
    """Features of the steps from ``low`` to before ``high``. Frames end before a row and begin a week earlier at most, so rows outside of that are in none of them."""
    t = tx(s, d)
    t = t if high is None else t.where(F.col("step") < high)
    f = pit.step_features(t if low is None else t.where(F.col("step") >= low - pit.WEEK), any(c.startswith(("pair_", "sender_recipient_")) for c in features))
    return (f if low is None else f.where(F.col("step") >= low)).select("transaction_id", "step", "is_fraud", "fraud_type", "amount", "score", *features)


def _tail(s, d):
    with models.kept(_span(s, d, None, VAL, TAILS)) as past:
        scales = models.fit_tail(past.where(metrics.legit()), TAILS)
    return _span(s, d, TEST, None, TAILS).select("transaction_id", F.round(models.tail_score(scales), 7).alias("tail_score"))


def _detectors(s, d):
    with models.kept(_span(s, d, None, None, TAILS)) as f:
        past = f.where((F.col("step") < VAL) & metrics.legit())
        forest, scales = isolation.fit(past, TAILS), models.fit_tail(past, TAILS)
        with models.kept(isolation.score(f.where(F.col("step") >= VAL), forest, TAILS).withColumn("tail", models.tail_score(scales))) as both:
            cut = {c: metrics.threshold_at_fpr(both.where(F.col("step") < TEST).withColumn("score", F.col(c)), 0.01) for c in ("score", "isolation", "tail")}
            known, iso, tail = F.col("score") >= cut["score"], F.col("isolation") >= cut["isolation"], F.col("tail") > cut["tail"]
            out = models.compare_detectors(both.where(F.col("step") >= TEST), {"supervised_1pct_fpr": known, "isolation_forest_1pct_fpr": iso, "tail_velocity_1pct_fpr": tail, "hybrid_supervised_tail": known | tail})
            return s.createDataFrame(out.collect(), out.schema)  # a row for each detector, while the rows are kept


def _prior_shift(s, d):
    raw = models.prior_shift(fut(s, d), 0.03)
    return models.mean_and_sd(raw, ["target_prevalence", "method"], ["n", "observed_prevalence", "mean_predicted_risk", "brier", "log_loss", "ece_10bin"])


def _logistic(s, d):
    with models.kept(_span(s, d, None, TEST, FEATURES_ML)) as f:
        m = models.fit_logistic(f.where(F.col("step") < VAL), FEATURES_ML)
        c = models.fit_sigmoid(models._scored(m.transform(f.where(F.col("step") >= VAL)), "raw"))
    return models.calibrate(c, models._scored(m.transform(_span(s, d, TEST, None, FEATURES_ML).drop("score")), "raw")).select("transaction_id", F.round("score", 6).alias("score"))


def _verification(s, d):
    raw = models.verification_bias(_ml(s, d), FEATURES_ML, F.col("transaction_id") % 50 == 0, (18, 24), types=KINDS, trees=TREES)
    return models.mean_and_sd(raw, ["audit_rate"], ["labelled_train_n", "labelled_train_rate", "labelled_fraud_n", "labelled_fraud_rate", *(f"labelled_{t}_n" for t in KINDS), "known_test_pr_auc", "legit_flag_rate", *(f"recall_{t}" for t in KINDS)])


def _ablation(s, d):
    sets = {"static_only": ["log_amount", "type_cash_out", "type_transfer"], "static_plus_velocity": ["log_amount", "type_cash_out", "type_transfer", "sender_tx_1h", "sender_tx_24h", "sender_tx_7d", "amount_vs_7d_mean"], "static_plus_velocity_network": FEATURES_ML}
    with models.kept(_ml(s, d).drop("score")) as f:
        return models.feature_ablation(f.where(F.col("step") < VAL), f.where(F.col("step").between(VAL, TEST - 1)), f.where(F.col("step") >= TEST), sets, TREES)


def _benchmark(s, d):
    out = benchmark.run(s, tx(s, d).drop("score", "anomaly"), target=0.01)
    return models._table(tx(s, d), out["model_ablation"], benchmark.ABLATION).withColumn("champion", F.col("model") == out["balance_free_reference_model"])


def _importances(s, d):
    with models.kept(_ml(s, d).where(F.col("step") < VAL)) as f:
        return s.createDataFrame(models.fit_trees(f, FEATURES_ML, TREES).importances(), "feature string, importance double")


QUERIES = {
    "transaction_velocity": lambda s, d: pit.velocity(tx(s, d)),
    "recipient_fanin": lambda s, d: pit.fan_in(tx(s, d)),
    "device_activity": lambda s, d: pit.device_activity(tx(s, d)),
    "parity_counts": lambda s, d: ranges.parity_counts(tx(s, d)),
    "pit_features": lambda s, d: pit.payment_features(tx(s, d)),
    "paysim_features": lambda s, d: _features_out(pit.step_features(tx(s, d))),
    "recipient_investigation": lambda s, d: pit.recipient_investigation(tx(s, d)).select("transaction_id", "recipient_tx_24h", F.round("recipient_amount_24h", 4).alias("recipient_amount_24h"), "unique_senders_7d", "pair_tx_7d"),
    "recipient_concentration": lambda s, d: pit.recipient_concentration(tx(s, d)),
    "recipient_candidate_queue": lambda s, d: pit.candidate_queue(tx(s, d)),
    "rule_backtest": lambda s, d: policy.rule_backtest(tx(s, d), RULES),
    "rule_incrementality": lambda s, d: policy.incrementality(tx(s, d), tx(s, d), 5.0, THRESHOLD, TEST),
    "threshold_drift": lambda s, d: metrics.threshold_drift(_periods(s, d), THRESHOLD),
    "typology_sizing": lambda s, d: policy.typology_sizing(tx(s, d), (50, 150, 300)),
    "audit": lambda s, d: src.audit(tx(s, d)),
    "temporal_split": lambda s, d: src.cut_points(tx(s, d)),
    "split_summary": lambda s, d: src.split_summary(tx(s, d), src.Split(VAL, TEST)),
    "rule_metrics": lambda s, d: evaluation(s, d).groupBy("period").agg(*metrics.alert_columns(F.col("is_flagged_fraud") == 1)),
    "roc_auc": lambda s, d: metrics.roc_auc(evaluation(s, d)),
    "average_precision": lambda s, d: metrics.average_precision(evaluation(s, d)),
    "brier": lambda s, d: metrics.brier_and_log_loss(evaluation(s, d)),
    "ece": lambda s, d: metrics.calibration_error(evaluation(s, d)),
    "psi": lambda s, d: metrics.psi(val(s, d), fut(s, d)),
    "threshold_at_fpr": _fpr,
    "threshold_at_legit_rate": _legit_rate,
    "value_concentration": lambda s, d: metrics.value_concentration(evaluation(s, d)),
    "budget_windows": lambda s, d: metrics.locked(capacity.step_windows(fut(s, d)).withColumn("period", F.concat(F.lit("future_window_"), F.col("window").cast("string"))), THRESHOLD, 0.01, ("period", "step_min", "step_max")).drop("_rate"),
    "capacity_frontier": lambda s, d: capacity.frontier(fut(s, d)),
    "capacity_windows": lambda s, d: capacity.capacity_windows(fut(s, d)),
    "recipient_signal_audit": _signals,
    "alpha_grid": _grid,
    "select_profiles": lambda s, d: capacity.select_profiles(_grid(s, d)),
    "window_alpha_grid": _window_grid,
    "robustness_summary": lambda s, d: capacity.robustness(_window_grid(s, d)),
    "robust_profiles": _robust,
    "policy_grid": lambda s, d: policy.policy_grid(val(s, d)),
    "policy_sensitivity": lambda s, d: policy.policy_sensitivity(val(s, d), fut(s, d)),
    "prevalence_sensitivity": lambda s, d: policy.prevalence_sensitivity(fut(s, d), THRESHOLD),
    "prior_adjust": lambda s, d: tx(s, d).select("transaction_id", F.round(scoring.adjust_for_prior(F.col("score"), 0.03, 0.001), 9).alias("adjusted")),
    "weekly_monitor": _weekly,
    "two_lane_queue": lambda s, d: queues.two_lane(evaluation(s, d), 100).select("transaction_id", "lane"),
    "queue_metrics": lambda s, d: queues.queue_metrics(evaluation(s, d)),
    "exploration_sensitivity": lambda s, d: queues.exploration_sensitivity(evaluation(s, d)),
    "investigation_queue": _investigation,
    "hourly_arrivals": lambda s, d: queues.hourly_arrivals(_candidates(s, d)),
    "adaptive_routing": lambda s, d: queues.adaptive_routing(_candidates(s, d), 1.0),
    "queue_sla_stress": lambda s, d: queues.sla_stress(_candidates(s, d)),
    "decision_action": lambda s, d: tx(s, d).select("transaction_id", scoring.decision(F.col("score"), 0.3, 0.7).alias("action")),
    "admitted_candidates": lambda s, d: queues.admitted(_candidates(s, d), 1.0, (1.0, 2.5)).select("transaction_id", "lane", "traffic_multiplier"),
    "locked_threshold_drift": lambda s, d: metrics.locked_threshold_drift(evaluation(s, d), THRESHOLD, 0.01),
    "posthoc_threshold_cap": lambda s, d: metrics.posthoc_threshold_cap(fut(s, d), 0.01).withColumn("threshold", F.round("threshold", 9)),
    "binary_metrics": lambda s, d: metrics.binary_metrics(fut(s, d), THRESHOLD),
    "model_metrics": lambda s, d: metrics.model_metrics("fixture", fut(s, d), THRESHOLD),
    "selected_profile_frontier": lambda s, d: capacity.evaluate_selected_profiles(capacity.select_profiles(_grid(s, d)), fut(s, d)),
    "selected_profile_windows": lambda s, d: capacity.evaluate_profile_windows(_robust(s, d), fut(s, d)),
    "policy_summary": lambda s, d: policy.policy_summary(val(s, d), fut(s, d)),
    "percentile_ranks": lambda s, d: queues.percentile_rank(evaluation(s, d), "amount", "amount_rank").select("transaction_id", F.round("amount_rank", 9).alias("amount_rank")),
    "rule_scores": lambda s, d: tx(s, d).select("transaction_id", F.round(scoring.rule_score(), 9).alias("rule_score")),
    "bound_threshold_drift": _bound,
    "data_audit": lambda s, d: src.data_audit(tx(s, d)),
    "balance_features": lambda s, d: tx(s, d).select("transaction_id", *(F.round(c, 7).alias(n) for c, n in zip(pit.balance_features(), benchmark.BALANCES))),
    "ordered_split": lambda s, d: src.load_split(benchmark.features(tx(s, d)), ["log_amount", "sender_tx_24h"], VAL, TEST).withColumn("log_amount", F.round("log_amount", 7)),
    "simulated_shape": lambda s, d: src.simulate(s).groupBy("fraud_type").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.countDistinct("device_id").alias("devices")),
}


def two_lane_sql(k: int, explore: int, model: str = "score", source: str = "eval", tag: str = "") -> str:
    return f"""e{tag} AS (SELECT * FROM {source} ORDER BY {model} DESC, transaction_id LIMIT {k - explore}),
x{tag} AS (SELECT * FROM {source} WHERE transaction_id NOT IN (SELECT transaction_id FROM e{tag}) ORDER BY anomaly DESC, transaction_id LIMIT {explore})"""


def week(t: str) -> str:
    return f"CAST(FLOOR((FLOOR({t}/86400000000.0)+3)/7) AS BIGINT)"


QUERIES |= {
    "tail_score": _tail,
    "detector_comparison": _detectors,
    "prior_shift": _prior_shift,
    "logistic_scores": _logistic,
    "fraud_typology": lambda s, d: models.fraud_typology(fut(s, d)),
    "experiment_design": lambda s, d: models.experiment_design(val(s, d), 0.3, 0.5),
    "rolling_backtest": lambda s, d: models.rolling_backtest(_ml(s, d), FEATURES_ML, 18, 2, trees=TREES),
    "feature_ablation": _ablation,
    "full_benchmark": _benchmark,
    "feature_importance": _importances,
    "delayed_label_retraining": lambda s, d: models.delayed_label_retraining(_ml(s, d), FEATURES_ML, (18, 24), 26, 4, TREES),
    "feedback_curve": lambda s, d: models.feedback_curve(_ml(s, d), FEATURES_ML, TAILS, (18, 24, 27), trees=TREES),
    "verification_bias": _verification,
}

#: Bin of a score by the edges i * 0.1, doubles as numpy's linspace gives them.
BIN = "+".join(f"CASE WHEN score>={i * 0.1!r}::DOUBLE THEN 1 ELSE 0 END" for i in range(1, 10))


def ratio_sql(a: str, b: str, digits: int = 9) -> str:
    return f"ROUND(CAST({a} AS DOUBLE)/NULLIF({b},0),{digits})"


def total(cond: str, v: str = "1") -> str:
    return f"SUM(CASE WHEN {cond} THEN {v} ELSE 0 END)"


def locked_sql(t: str, target: float = 0.01) -> str:
    rate = f"CAST({total(f'score>={t} AND is_fraud=0')} AS DOUBLE)/NULLIF(SUM(1-is_fraud),0)"
    q = ", ".join(f"ROUND(QUANTILE_CONT(score,{x}),9) AS score_{n}" for x, n in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"), (0.999, "p999")))
    return f"COUNT(*) AS n, CAST(SUM(is_fraud) AS BIGINT) AS fraud_n, ROUND(AVG(is_fraud),9) AS fraud_rate, {alerts(f'score>={t}')}, {ratio_sql(total(f'score>={t}'), 'COUNT(*)')} AS alert_rate, ROUND({rate}*10000,6) AS legit_alerts_per_10k, ROUND({rate}/{target}::DOUBLE,6) AS budget_multiplier_vs_target, {q}"


def cap_sql(name: str, source: str, target: float = 0.01, column: str = "score", by: str = "") -> str:
    """SQL of the hard cap: the k-th highest legitimate score, or the next number above it where its ties go beyond k."""
    k, part = f"{by}," if by else "", f"PARTITION BY {by}" if by else ""
    return f""", {name}_r AS (SELECT {k}{column} AS s, ROW_NUMBER() OVER ({part} ORDER BY {column} DESC) i, CAST(FLOOR({target}::DOUBLE*COUNT(*) OVER ({part})) AS BIGINT) k FROM {source} WHERE is_fraud=0),
{name}_b AS (SELECT {k}MAX(k) k, MAX(s) high, MAX(CASE WHEN i=k THEN s END) b FROM {name}_r {'GROUP BY ' + by if by else ''}),
{name} AS (SELECT {"b." + by + "," if by else ""} CASE WHEN MAX(b.k)=0 THEN nextafter(MAX(high),'inf'::DOUBLE) WHEN {total('r.s>=b.b')}>MAX(b.k) THEN nextafter(MAX(b.b),'inf'::DOUBLE) ELSE MAX(b.b) END AS t FROM {name}_b b JOIN {name}_r r ON {f"b.{by}=r.{by}" if by else "TRUE"} {'GROUP BY b.' + by if by else ''})"""


ALPHA_KEYS = "alpha, amount_scale"
ALPHA_GRID = ALPHA.format(t="val") + frontier_sql("g", ALPHA_KEYS, "priority", "(50.0)", HMEAN)
WINDOW_GRID = WINDOWS.format(t="val") + ALPHA.format(t="w") + frontier_sql("g", "alpha, amount_scale, win, step_min, step_max", "priority", "(50.0)", HMEAN, 'o.alpha, o.amount_scale, o.win AS "window", o.step_min, o.step_max, ')


def within(sql: str, name: str) -> str:
    """The last SELECT of a chain of tables as a table of its own."""
    head, tail = sql.rsplit("\nSELECT ", 1)
    return f"{head}, {name} AS (SELECT {tail})"


ROBUSTNESS = "SELECT alpha, MAX(amount_scale) AS amount_scale, " + ", ".join(f"ROUND({f}({c}),9) AS {n}_{c}" for c in ("recall", "precision", "fraud_value_recall", "balanced_hmean") for n, f in (("min", "MIN"), ("mean", "AVG"))) + ", ROUND(MAX(recall)-MIN(recall),9) AS recall_range, ROUND(MAX(fraud_value_recall)-MIN(fraud_value_recall),9) AS value_recall_range FROM wg GROUP BY alpha"


def picks_sql(source: str, specs: dict, split: str) -> str:
    return " UNION ALL ".join(f"(SELECT *, '{p}' AS profile, '{split}' AS selection_split FROM {source} ORDER BY {', '.join(c + ' DESC NULLS LAST' for c in cols)}, alpha LIMIT 1)" for p, cols in specs.items())


PROFILE_SPECS = {"case_first": ["recall", "precision", "fraud_value_recall"], "balanced": ["balanced_hmean", "precision", "recall"], "value_first": ["fraud_value_recall", "precision", "recall"]}
ROBUST_SPECS = {"case_first": ["min_recall", "mean_recall", "mean_precision", "mean_fraud_value_recall"], "balanced": ["min_balanced_hmean", "mean_balanced_hmean", "mean_precision"], "value_first": ["min_fraud_value_recall", "mean_fraud_value_recall", "mean_precision", "mean_recall"]}
PROFILED = ", pf AS (SELECT x.*, p.profile, p.alpha, p.amount_scale, ROUND(CASE WHEN p.alpha=0 THEN score ELSE score*POW(GREATEST(amount,0)/p.amount_scale, p.alpha) END, 12) AS priority FROM {t} x CROSS JOIN pk p)"


def renamed(sql: str, tag: str) -> str:
    """The chain with its tables r, z, a, o and t under other names, so that a second chain can follow."""
    for n in "rzaot":
        sql = re.sub(rf"(?<![\w.'\"]){n} AS \(", f"{n}_{tag} AS (", sql)
        sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {n}_{tag} {n}", sql)
    return sql


PAYMENT_FRAMES = f"pf AS (SELECT transaction_id, COUNT(*) OVER {frame('sender', 'sec', 3600)} AS sender_tx_1h, COUNT(*) OVER {frame('sender', 'sec', 86400)} AS sender_tx_24h, COUNT(*) OVER {frame('recipient', 'sec', 86400)} AS recipient_fanin_24h, COUNT(*) OVER {frame('device_id', 'sec', 86400)} AS device_activity_24h, COUNT(DISTINCT sender) OVER {frame('device_id', 'sec', 86400)} AS device_unique_senders_24h FROM (SELECT *, us // 1000000 AS sec FROM tx) y)"
FRICTION = "ROUND(CAST(l_block+l_review AS DOUBLE)/GREATEST(l_all,1),9)"


def grid_out(c) -> str:
    prevented = f"(v_block*{c[0]}::DOUBLE+v_review*{c[1]}::DOUBLE)"
    return f"CAST(grid_id AS BIGINT) AS grid_id, ROUND(review_t,9) AS review_threshold, ROUND(block_t,9) AS block_threshold, ROUND({prevented},4) AS fraud_value_prevented, ROUND({prevented}/GREATEST(v_all,1.0),9) AS fraud_value_prevented_rate, {FRICTION} AS legit_friction_rate, ROUND(CAST(n_review AS DOUBLE)/n_all,9) AS review_rate, ROUND(CAST(n_block AS DOUBLE)/n_all,9) AS block_rate, ROUND(v_all-{prevented},4) AS residual_fraud_loss, ROUND(n_review*{c[2]}::DOUBLE+l_block*{c[3]}::DOUBLE+l_review*{c[4]}::DOUBLE,4) AS operational_and_friction_cost, ROUND({cost_sql(c)},6) AS total_policy_cost"


def sensitivity_sql(n: str, c) -> str:
    names = ("block_efficacy", "review_efficacy", "review_case_cost", "false_block_cost_unit", "false_review_cost_unit")
    best = f"(SELECT MIN(ROUND({cost_sql(c)},6)) FROM gb)"
    pick = f"(SELECT grid_id, ROUND({cost_sql(c)},6) AS vc FROM ga ORDER BY 2, 1 LIMIT 1)"
    return f"(SELECT '{n}' AS scenario, {', '.join(f'{v}::DOUBLE AS {k}' for k, v in zip(names, c))}, ROUND(review_t,9) AS selected_review_threshold, ROUND(block_t,9) AS selected_block_threshold, ROUND(vc,4) AS validation_total_cost, ROUND((v_block*{c[0]}+v_review*{c[1]})/GREATEST(v_all,1.0),9) AS test_fraud_value_prevented_rate, {FRICTION} AS test_legit_friction_rate, ROUND(ROUND({cost_sql(c)},6),4) AS test_total_cost, ROUND({best},4) AS test_oracle_total_cost, ROUND((ROUND({cost_sql(c)},6)-{best})/GREATEST({best},1e-9),6) AS test_policy_regret FROM gb JOIN {pick} USING (grid_id))"


QUEUED = """, q AS (SELECT *, (RANK() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score)-1)/2.0::DOUBLE)/COUNT(*) OVER () mr, (RANK() OVER (ORDER BY anomaly) + (COUNT(*) OVER (PARTITION BY anomaly)-1)/2.0::DOUBLE)/COUNT(*) OVER () ar, COUNT(*) OVER () nn FROM eval),
h AS (SELECT *, GREATEST(mr,ar)+1e-4::DOUBLE*ar AS hybrid FROM q), rk AS (SELECT *, ROW_NUMBER() OVER (ORDER BY mr DESC, transaction_id) rm, ROW_NUMBER() OVER (ORDER BY hybrid DESC, transaction_id) rh FROM h),
c AS (SELECT {pick}, CAST(GREATEST(1,CEIL(nn*cap/10000.0)) AS BIGINT) k FROM (SELECT COUNT(*) nn FROM eval) x CROSS JOIN (VALUES {caps}) v(cap{share})),
p AS (SELECT *, CASE WHEN {explores} AND k>1 THEN GREATEST(1, CAST(ROUND_EVEN(k*sh,0) AS BIGINT)) ELSE 0 END xk FROM c),
l AS (SELECT p.*, rk.*, CASE WHEN qn='hybrid' THEN rh ELSE rm END<=p.k-xk AS taken FROM p CROSS JOIN rk),
e AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY qn, cap, sh, taken ORDER BY ar DESC, transaction_id) ri FROM l),
u AS (SELECT * FROM e WHERE taken OR (xk>0 AND ri<=xk)),
w AS (SELECT SUM(is_fraud) f, SUM(amount*is_fraud) v, SUM(CASE WHEN fraud_type='novel_shared_device_microburst' THEN 1 ELSE 0 END) n FROM eval)
SELECT {out} FROM u CROSS JOIN w GROUP BY qn, cap, sh"""
QUEUE_CELLS = {"review_n": "COUNT(*)", "precision": "ROUND(AVG(is_fraud),9)", "fraud_recall": "ROUND(SUM(is_fraud)/CAST(MAX(f) AS DOUBLE),9)", "fraud_value_recall": "ROUND(SUM(amount*is_fraud)/MAX(v),9)", "novel_fraud_recall": "ROUND(SUM(CASE WHEN fraud_type='novel_shared_device_microburst' THEN 1 ELSE 0 END)/NULLIF(CAST(MAX(n) AS DOUBLE),0),9)"}
LANES = ", ln AS (SELECT *, us//3600000000 AS hour, score>=0.65 AS blocked, CASE WHEN score>=0.45 AND score<0.65 THEN 'exploit' WHEN anomaly>400 AND score<0.65 THEN 'explore' END AS lane FROM eval), hr AS (SELECT UNNEST(RANGE((SELECT MIN(hour) FROM ln),(SELECT MAX(hour)+1 FROM ln))) AS hour), arr AS (SELECT hr.hour, CAST(COUNT(*) FILTER (WHERE lane='exploit') AS BIGINT) exploit, CAST(COUNT(*) FILTER (WHERE lane='explore') AS BIGINT) explore FROM hr LEFT JOIN ln USING (hour) GROUP BY hr.hour)"


def slots_sql(multipliers: str, capacity: float = 1.0, share: float = 0.2) -> str:
    """SQL of the slots of each hour and those kept for exploration: tokens are carried over from hour to hour."""
    return f""", sl AS (SELECT m, (SELECT MIN(hour) FROM ln)-1 AS hour, 0::BIGINT AS slots, 0::BIGINT AS xs, 0.0::DOUBLE AS tok, 0.0::DOUBLE AS res FROM (VALUES {multipliers}) v(m)
UNION ALL SELECT m, hour+1, s2, x2, t1-s2, r1-x2 FROM (SELECT *, CASE WHEN s2>0 THEN LEAST(s2, CAST(FLOOR(r1+1e-12) AS BIGINT)) ELSE 0 END AS x2 FROM (SELECT m, hour, tok+{capacity}::DOUBLE/m AS t1, CAST(FLOOR(tok+{capacity}::DOUBLE/m+1e-12) AS BIGINT) AS s2, res+CASE WHEN FLOOR(tok+{capacity}::DOUBLE/m+1e-12)>0 THEN FLOOR(tok+{capacity}::DOUBLE/m+1e-12)*{share}::DOUBLE ELSE 0 END AS r1 FROM sl) y) z WHERE hour<(SELECT MAX(hour) FROM ln)),
adm AS (SELECT sl.m, arr.hour, exploit, explore, slots, xs, LEAST(exploit, slots-xs) e0, LEAST(explore, xs) x0 FROM arr JOIN sl USING (hour)),
adn AS (SELECT *, e0+LEAST(exploit-e0, slots-e0-x0) AS te FROM adm), ado AS (SELECT *, x0+LEAST(explore-x0, slots-te-x0) AS tx_ FROM adn),
rkd AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY hour, lane ORDER BY CASE WHEN lane='exploit' THEN score ELSE anomaly END DESC, transaction_id) rn FROM ln WHERE lane IS NOT NULL),
chosen AS (SELECT rkd.*, ado.m FROM rkd JOIN ado USING (hour) WHERE rn<=CASE WHEN lane='exploit' THEN te ELSE tx_ END)"""


NOVEL_SQL = "fraud_type='novel_shared_device_microburst'"
ROUTING = LANES + slots_sql("(1.0::DOUBLE),(1.5),(2.0),(4.0)") + f""", g AS (SELECT m, hour, COUNT(*) n, SUM(amount*is_fraud) sv, {total(NOVEL_SQL)} sn, SUM(1-is_fraud) sl, MIN(CASE WHEN lane='exploit' THEN score END) ce, MIN(CASE WHEN lane='explore' THEN anomaly END) cx FROM chosen GROUP BY m, hour),
s AS (SELECT m, SUM(n) n, MAX(n) mx, SUM(sv) sv, SUM(sn) sn, SUM(sl) sl, MEDIAN(ce) ce, MEDIAN(cx) cx FROM g GROUP BY m),
w AS (SELECT COUNT(lane) cn, SUM(amount*is_fraud) v, {total('lane IS NOT NULL', 'amount*is_fraud')} cv, {total(NOVEL_SQL)} nv, {total(NOVEL_SQL + ' AND lane IS NOT NULL')} cnv, SUM(1-is_fraud) l, {total('blocked', 'amount*is_fraud')} bv, {total(NOVEL_SQL + ' AND blocked')} bn, MAX(hour)-MIN(hour)+1 AS hs, (SELECT MAX(exploit+explore) FROM arr) mc FROM ln)
SELECT m AS traffic_multiplier, 1.0::DOUBLE AS analyst_capacity_per_hour, 0.2::DOUBLE AS exploration_share, cn AS candidate_n, CAST(n AS BIGINT) AS admitted_n_source_stream, ROUND(n/GREATEST(cn,1)::DOUBLE,9) AS candidate_acceptance_rate, ROUND(n*m/hs,9) AS scaled_reviews_per_hour, ROUND(n*m/hs,9) AS capacity_utilisation_after_admission, ROUND(sv/v,9) AS analyst_reviewed_fraud_value_share, ROUND(sv/cv,9) AS candidate_fraud_value_retention,
 ROUND((sv+bv)/v,9) AS system_fraud_value_coverage_with_blocks, ROUND(sn/GREATEST(nv,1)::DOUBLE,9) AS analyst_reviewed_novel_recall, ROUND(sn/GREATEST(cnv,1)::DOUBLE,9) AS candidate_novel_retention, ROUND((sn+bn)/NULLIF(nv,0)::DOUBLE,9) AS system_novel_recall_with_blocks, ROUND(sl/NULLIF(l,0)::DOUBLE,9) AS legitimate_review_rate, ROUND(cn/hs::DOUBLE,9) AS mean_hourly_candidates_source_stream, CAST(mc AS BIGINT) AS max_hourly_candidates_source_stream, CAST(mx AS BIGINT) AS max_hourly_admitted_source_stream, ROUND(ce,9) AS median_dynamic_exploit_cutoff, ROUND(cx,9) AS median_dynamic_explore_cutoff FROM s CROSS JOIN w"""
#: The recurrence of both backlogs: lanes are served first, then what is left goes to the longer one.
BACKLOG = LANES + """, st AS (SELECT cap, mul, (SELECT MIN(hour) FROM arr)-1 AS hour, 0.0::DOUBLE e, 0.0::DOUBLE x, 0.0::DOUBLE served, 0.0::DOUBLE came FROM (VALUES (4.0::DOUBLE),(6.0),(8.0)) c(cap) CROSS JOIN (VALUES (0.5::DOUBLE),(1.0),(1.5),(2.0),(4.0)) v(mul)
UNION ALL SELECT cap, mul, hour, CASE WHEN e2>=x2 THEN e2-LEAST(e2,sp) ELSE e2-LEAST(e2,sp-LEAST(x2,sp)) END, CASE WHEN e2>=x2 THEN x2-LEAST(x2,sp-LEAST(e2,sp)) ELSE x2-LEAST(x2,sp) END, served+LEAST(cap, e1+x1) , came+new FROM (
 SELECT *, e1-LEAST(e1,cap-cap*0.2::DOUBLE) e2, x1-LEAST(x1,cap*0.2::DOUBLE) x2, cap-LEAST(e1,cap-cap*0.2::DOUBLE)-LEAST(x1,cap*0.2::DOUBLE) sp FROM (
 SELECT st.cap, st.mul, arr.hour, st.served, st.came, st.e+arr.exploit*mul e1, st.x+arr.explore*mul x1, (arr.exploit+arr.explore)*mul AS new FROM st JOIN arr ON arr.hour=st.hour+1) y) z),
en AS (SELECT cap, mul, COUNT(*) n, MAX(e+x) mx, MAX_BY(e+x, hour) last, MAX(came) came, MAX(served) served, SUM(CASE WHEN e+x>1e-9 THEN 1 ELSE 0 END) bh FROM st WHERE hour>=(SELECT MIN(hour) FROM arr) GROUP BY cap, mul)
SELECT mul AS traffic_multiplier, cap AS analyst_capacity_per_hour, 0.2::DOUBLE AS exploration_share, n AS hours, came/mul/n AS observed_candidate_arrival_rate_per_hour, came/mul/n*mul AS scaled_arrival_rate_per_hour, came AS arrivals, served, came/(cap*n) AS capacity_utilisation, mx AS max_backlog_cases, last AS final_backlog_cases, bh/n::DOUBLE AS hours_with_backlog_rate, mx/cap AS max_wait_proxy_hours, last<1e-9 AS stable_by_end, came/(cap*n)<1.0 AND mx/cap<=4.0 AS meets_4h_sla_proxy FROM en"""

ORACLE_SQL = {
    "transaction_velocity": f"SELECT transaction_id, COUNT(*) OVER {frame('sender', 'us', H)} AS sender_tx_1h, COUNT(*) OVER {frame('sender', 'us', 24 * H)} AS sender_tx_24h, ROUND(SUM(amount) OVER {frame('sender', 'us', 24 * H)},4) AS sender_amount_24h FROM tx",
    "recipient_fanin": f"SELECT transaction_id, COUNT(*) OVER {frame('recipient', 'us', 24 * H)} AS recipient_fanin_24h, ROUND(SUM(amount) OVER {frame('recipient', 'us', 24 * H)},4) AS recipient_value_24h FROM tx",
    "device_activity": f"SELECT transaction_id, COUNT(*) OVER {frame('device_id', 'us', 24 * H)} AS device_activity_24h FROM tx",
    "pit_features": f""", s AS (SELECT *, us // 1000000 AS sec FROM tx) SELECT transaction_id, COUNT(*) OVER {frame('sender', 'sec', 3600)} AS sender_tx_1h, COUNT(*) OVER {frame('sender', 'sec', 86400)} AS sender_tx_24h, ROUND(COALESCE(SUM(amount) OVER {frame('sender', 'sec', 86400)},0),4) AS sender_amount_24h,
 ROUND(COALESCE(AVG(amount) OVER {frame('sender', 'sec', 604800)},amount),7) AS sender_mean_amount_7d, COUNT(*) OVER {frame('recipient', 'sec', 86400)} AS recipient_fanin_24h, COUNT(*) OVER {frame('device_id', 'sec', 86400)} AS device_activity_24h, COUNT(*) OVER {frame('sender, recipient', 'sec', 86400)} AS pair_tx_24h,
 COUNT(DISTINCT recipient) OVER {frame('sender', 'sec', 86400)} AS sender_unique_recipients_24h, COUNT(DISTINCT sender) OVER {frame('recipient', 'sec', 86400)} AS recipient_unique_senders_24h, COUNT(DISTINCT sender) OVER {frame('device_id', 'sec', 86400)} AS device_unique_senders_24h, CAST(us//3600000000 % 24 AS INT) AS hour, CAST(us//3600000000 % 24 <= 5 AS INT) AS is_night FROM s""",
    "paysim_features": f""", f AS (SELECT *, COUNT(*) OVER {frame('sender', 'step', 1)} a1, COUNT(*) OVER {frame('sender', 'step', 24)} a2, COUNT(*) OVER {frame('sender', 'step', 168)} a3, COALESCE(SUM(amount) OVER {frame('sender', 'step', 24)},0) a4, COALESCE(SUM(amount) OVER {frame('sender', 'step', 168)},0) a5, COALESCE(AVG(amount) OVER {frame('sender', 'step', 168)},amount) a6,
 COUNT(*) OVER {frame('recipient', 'step', 24)} b1, COUNT(*) OVER {frame('recipient', 'step', 168)} b2, COALESCE(SUM(amount) OVER {frame('recipient', 'step', 24)},0) b3, COUNT(*) OVER {frame('sender, recipient', 'step', 168)} c1, COALESCE(SUM(amount) OVER {frame('sender, recipient', 'step', 168)},0) c2, COUNT(DISTINCT recipient) OVER {frame('sender', 'step', 168)} d1, COUNT(DISTINCT sender) OVER {frame('recipient', 'step', 168)} d2 FROM tx)
SELECT transaction_id, a1 AS sender_tx_1h, a2 AS sender_tx_24h, a3 AS sender_tx_7d, ROUND(a4,7) AS sender_amount_24h, ROUND(a5,7) AS sender_amount_7d, ROUND(a6,7) AS sender_mean_amount_7d, b1 AS recipient_fanin_24h, b2 AS recipient_tx_7d, ROUND(b3,7) AS recipient_amount_24h, c1 AS pair_tx_7d, ROUND(c2,7) AS pair_amount_7d, d1 AS sender_unique_recipients_7d, d2 AS recipient_unique_senders_7d,
 ROUND(LN(1+GREATEST(amount,0)),7) AS log_amount, ROUND(amount/GREATEST(a6,1.0),7) AS amount_vs_7d_mean, ROUND(LEAST(GREATEST(c2/GREATEST(a5,1.0),0.0),1.0),7) AS sender_recipient_share_7d, {','.join(f"CAST(type='{t}' AS INT) AS type_{t.lower()}" for t in src.TYPES)} FROM f""",
    "recipient_investigation": f", {FEATURES} SELECT transaction_id, recipient_tx_24h, recipient_amount_24h, unique_senders_7d, pair_tx_7d FROM f",
    "recipient_concentration": f""", {FEATURES.replace("ROUND(COALESCE(SUM(amount) OVER " + frame('recipient', 'step', 24) + ",0),4)", "COALESCE(SUM(amount) OVER " + frame('recipient', 'step', 24) + ",0)")}, r AS (SELECT *, NTILE(100) OVER (ORDER BY recipient_amount_24h DESC, unique_senders_7d DESC, recipient_tx_24h DESC, transaction_id) p FROM f)
SELECT CAST(p AS BIGINT) AS investigation_percentile, COUNT(*) AS transactions, ROUND(AVG(is_fraud),9) AS fraud_rate, ROUND(SUM(CASE WHEN is_fraud=1 THEN amount ELSE 0 END),4) AS fraud_value, ROUND(AVG(recipient_tx_24h),6) AS avg_recipient_tx_24h, ROUND(AVG(unique_senders_7d),6) AS avg_unique_senders_7d, ROUND(AVG(pair_tx_7d),6) AS avg_pair_tx_7d FROM r WHERE p<=10 GROUP BY p""",
    "recipient_candidate_queue": f""", {FEATURES}, p AS (SELECT *, PERCENT_RANK() OVER (PARTITION BY step ORDER BY recipient_tx_24h) p1, PERCENT_RANK() OVER (PARTITION BY step ORDER BY recipient_amount_24h) p2, PERCENT_RANK() OVER (PARTITION BY step ORDER BY recipient_tx_7d) p3, PERCENT_RANK() OVER (PARTITION BY step ORDER BY unique_senders_7d) p4 FROM f)
SELECT transaction_id, step, sender, recipient, type, amount, recipient_tx_24h AS recipient_fanin_24h, recipient_amount_24h, recipient_tx_7d, unique_senders_7d AS recipient_unique_senders_7d, pair_tx_7d, ROUND(0.25*p1+0.25*p2+0.15*p3+0.35*p4,6) AS investigation_score,
 CONCAT_WS('|', CASE WHEN p4>=0.99 THEN 'MANY_PRIOR_SENDERS' END, CASE WHEN p1>=0.99 THEN 'HIGH_PRIOR_FAN_IN' END, CASE WHEN p2>=0.99 THEN 'HIGH_PRIOR_RECIPIENT_VALUE' END, CASE WHEN pair_tx_7d=0 THEN 'NEW_SENDER_RECIPIENT_PAIR' END) AS reasons FROM p""",
    "rule_backtest": f"SELECT rule_name, {alerts('type=tx_type AND amount>=min_amount')} FROM tx CROSS JOIN (VALUES {','.join(str(r) for r in RULES)}) r(rule_name, tx_type, min_amount) GROUP BY rule_name",
    "rule_incrementality": ", l AS (SELECT 'simple_amount_type_rule' AS detector, is_fraud, amount, type IN ('TRANSFER','CASH_OUT') AND LN(1+GREATEST(amount,0))>=5.0 AS alert FROM fut UNION ALL SELECT 'ml_model', is_fraud, amount, score>=0.6 FROM fut) SELECT detector, " + alerts("alert") + " FROM l GROUP BY detector",
    "threshold_drift": ", p AS (SELECT *, CASE WHEN step<433 THEN 'train' WHEN step<577 THEN 'validation' ELSE 'future_test' END AS period FROM tx) SELECT period, COUNT(*) AS n, ROUND(AVG(is_fraud),9) AS fraud_rate, ROUND(AVG(score),9) AS mean_score, ROUND(QUANTILE_CONT(score,0.5),9) AS score_p50, ROUND(QUANTILE_CONT(score,0.9),9) AS score_p90, ROUND(QUANTILE_CONT(score,0.99),9) AS score_p99, ROUND(QUANTILE_CONT(amount,0.99),6) AS amount_p99, " + f"CAST({total('score>=0.6')} AS BIGINT) AS alerts, {ratio_sql(total('score>=0.6', 'is_fraud'), 'SUM(is_fraud)')} AS recall_at_locked_threshold, {ratio_sql(total('score>=0.6', '1-is_fraud'), 'SUM(1-is_fraud)')} AS legit_flag_rate_at_locked_threshold FROM p GROUP BY period",
    "typology_sizing": ", g AS (SELECT type, CASE WHEN amount<50 THEN '1' WHEN amount<150 THEN '2' WHEN amount<300 THEN '3' ELSE '4' END AS amount_band, COUNT(*) AS transactions, CAST(SUM(is_fraud) AS BIGINT) AS fraud_transactions, ROUND(SUM(amount*is_fraud),4) AS fraud_value, ROUND(SUM(amount),4) AS total_value, ROUND(AVG(is_fraud),9) AS fraud_rate FROM tx GROUP BY 1,2) SELECT *, ROUND(fraud_value/NULLIF(SUM(fraud_value) OVER (),0),6) AS share_of_fraud_value FROM g",
    "audit": "SELECT COUNT(*) AS n, CAST(SUM(is_fraud) AS BIGINT) AS fraud, ROUND(AVG(is_fraud),9) AS fraud_rate, MIN(step) AS min_step, MAX(step) AS max_step, CAST(SUM(is_flagged_fraud) AS BIGINT) AS flagged FROM tx",
    "temporal_split": ", d AS (SELECT step, ROW_NUMBER() OVER (ORDER BY step) r, COUNT(*) OVER () k FROM (SELECT DISTINCT step FROM tx) q) SELECT MAX(CASE WHEN r=FLOOR(k*0.6)+1 THEN step END) AS validation_start, MAX(CASE WHEN r=FLOOR(k*0.8)+1 THEN step END) AS test_start, COUNT(*) AS n_steps FROM d",
    "split_summary": "SELECT CASE WHEN step<433 THEN 'train' WHEN step<577 THEN 'validation' ELSE 'future_test' END AS period, COUNT(*) AS n, ROUND(AVG(is_fraud),9) AS fraud_rate, MIN(step) AS min_step, MAX(step) AS max_step FROM tx GROUP BY 1",
    "rule_metrics": "SELECT period, " + alerts("is_flagged_fraud=1") + " FROM eval GROUP BY period",
    "roc_auc": f", {CURVE} SELECT ROUND(SUM(n*(tp-p/2.0))/(SUM(p)*SUM(n)),9) AS roc_auc FROM c",
    "average_precision": f", {CURVE} SELECT ROUND(SUM(CAST(p AS DOUBLE)*tp/(tp+fp))/SUM(p),9) AS average_precision FROM c",
    "brier": "SELECT ROUND(AVG(POW(score-is_fraud,2)),9) AS brier, ROUND(-AVG(CASE WHEN is_fraud=1 THEN LN(LEAST(GREATEST(score,1e-15),1-1e-15)) ELSE LN(1-LEAST(GREATEST(score,1e-15),1-1e-15)) END),9) AS log_loss FROM eval",
    "ece": f", g AS (SELECT {BIN} b, COUNT(*) n, AVG(score) s, AVG(is_fraud) y FROM eval GROUP BY 1) SELECT ROUND(SUM(n*ABS(s-y))/SUM(n),9) AS ece FROM g",
    "psi": ", q AS (SELECT UNNEST(QUANTILE_CONT(score,[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) c FROM val), d AS (SELECT DISTINCT c FROM q), e AS (SELECT b, COUNT(*)/SUM(COUNT(*)) OVER () x FROM (SELECT (SELECT COUNT(*) FROM d WHERE c<=score) b FROM val) z GROUP BY b), a AS (SELECT b, COUNT(*)/SUM(COUNT(*)) OVER () x FROM (SELECT (SELECT COUNT(*) FROM d WHERE c<=score) b FROM fut) z GROUP BY b) SELECT ROUND(SUM((GREATEST(COALESCE(a.x,0),1e-6)-GREATEST(COALESCE(e.x,0),1e-6))*LN(GREATEST(COALESCE(a.x,0),1e-6)/GREATEST(COALESCE(e.x,0),1e-6))),6) AS psi FROM e FULL JOIN a USING (b)",
    "threshold_at_fpr": ", t AS (SELECT QUANTILE_CONT(score,0.99) v FROM val WHERE is_fraud=0) SELECT ROUND(MAX(v),9) AS threshold, " + alerts("score>=v") + " FROM fut CROSS JOIN t",
    "value_concentration": ", r AS (SELECT amount, ROW_NUMBER() OVER (ORDER BY amount DESC, transaction_id) r, COUNT(*) OVER () n, SUM(amount) OVER () v FROM eval WHERE is_fraud=1) SELECT " + ", ".join(f"ROUND(SUM(CASE WHEN r<=GREATEST(1,CEIL(n*{s}::DOUBLE)) THEN amount ELSE 0 END)/MAX(v),9) AS top_{int(s * 100)}" for s in (0.1, 0.25, 0.5)) + " FROM r",
    "budget_windows": WINDOWS.format(t="fut") + " SELECT concat('future_window_', win) AS period, step_min, step_max, 0.6::DOUBLE AS threshold, " + locked_sql("0.6") + " FROM w GROUP BY win, step_min, step_max",
    "capacity_frontier": frontier_sql("fut"),
    "capacity_windows": WINDOWS.format(t="fut") + frontier_sql("w", "win, step_min, step_max", budgets="(50.0)", head="concat('future_window_', o.win) AS period, o.step_min, o.step_max, "),
    "recipient_signal_audit": f""", {FEATURES}, fi AS (SELECT *, ROUND(LN(1+recipient_tx_24h)+0.5::DOUBLE*LN(1+recipient_tx_7d)+0.25::DOUBLE*LN(1+GREATEST(recipient_amount_24h,0))+LN(1+unique_senders_7d),9) AS intensity FROM f), l AS (SELECT step, is_fraud, amount, UNNEST(['recipient_fanin_24h','recipient_tx_7d','recipient_amount_24h','recipient_unique_senders_7d','recipient_intensity_score']) AS signal, UNNEST([recipient_tx_24h::DOUBLE,recipient_tx_7d::DOUBLE,recipient_amount_24h::DOUBLE,unique_senders_7d::DOUBLE,intensity]) AS v FROM fi),
lv AS (SELECT * FROM l WHERE step>=433 AND step<577), lf AS (SELECT * FROM l WHERE step>=577){cap_sql('cp', 'lv', 0.01, 'v', 'signal')}, va AS (SELECT signal, {ratio_sql(total('v>=t', '1-is_fraud'), 'SUM(1-is_fraud)')} AS validation_actual_legit_flag_rate FROM lv JOIN cp USING (signal) GROUP BY signal),
cu AS (SELECT signal, v, SUM(is_fraud) p, SUM(1-is_fraud) n FROM lf GROUP BY signal, v), cc AS (SELECT *, SUM(p) OVER (PARTITION BY signal ORDER BY v DESC ROWS UNBOUNDED PRECEDING) tp FROM cu), au AS (SELECT signal, ROUND(SUM(n*(tp-p/2.0))/(SUM(p)*SUM(n)),9) AS future_auc FROM cc GROUP BY signal),
nw AS (SELECT signal, ROUND(MAX(t),6) AS validation_threshold, 0.01::DOUBLE AS target_validation_legit_flag_rate, {alerts('v>=t')}, ROUND(QUANTILE_CONT(v,0.5) FILTER (WHERE is_fraud=1),6) AS future_fraud_median, ROUND(QUANTILE_CONT(v,0.5) FILTER (WHERE is_fraud=0),6) AS future_legit_median, ROUND(QUANTILE_CONT(v,0.9) FILTER (WHERE is_fraud=1),6) AS future_fraud_p90, ROUND(QUANTILE_CONT(v,0.9) FILTER (WHERE is_fraud=0),6) AS future_legit_p90 FROM lf JOIN cp USING (signal) GROUP BY signal) SELECT * FROM nw JOIN va USING (signal) JOIN au USING (signal)""",
    "alpha_grid": ALPHA_GRID,
    "window_alpha_grid": WINDOW_GRID,
    "policy_grid": grid_sql("g", "val") + f" SELECT {grid_out(policy.SCENARIOS['reference'])} FROM g",
    "policy_sensitivity": grid_sql("ga", "val") + grid_sql("gb", "fut") + " " + " UNION ALL ".join(sensitivity_sql(n, c) for n, c in policy.SCENARIOS.items()),
    "prevalence_sensitivity": ", r AS (SELECT CAST(SUM(CASE WHEN score>=0.6 THEN is_fraud ELSE 0 END) AS DOUBLE)/SUM(is_fraud) t, CAST(SUM(CASE WHEN score>=0.6 THEN 1-is_fraud ELSE 0 END) AS DOUBLE)/SUM(1-is_fraud) f FROM fut) SELECT p AS fraud_prevalence, ROUND(t,9) AS measured_tpr, ROUND(f,9) AS measured_fpr, ROUND(p*t/NULLIF(p*t+(1-p)*f,0),9) AS expected_alert_precision FROM r CROSS JOIN (VALUES (0.001::DOUBLE),(0.0025),(0.005),(0.01),(0.02)) v(p)",
    "prior_adjust": ", q AS (SELECT transaction_id, LEAST(GREATEST(score,1e-8),1-1e-8) p FROM tx), o AS (SELECT transaction_id, p/(1-p)*(0.001::DOUBLE/(1-0.001::DOUBLE))/(0.03::DOUBLE/(1-0.03::DOUBLE)) o FROM q) SELECT transaction_id, ROUND(o/(1+o),9) AS adjusted FROM o",
    "two_lane_queue": ", " + two_lane_sql(100, 20) + " SELECT transaction_id, 'exploit' AS lane FROM e UNION ALL SELECT transaction_id, 'explore' FROM x",
    "investigation_queue": f""", {PAYMENT_FRAMES}, q AS (SELECT QUANTILE_CONT(score,0.99) a, QUANTILE_CONT(anomaly,0.99) b FROM eval), k AS (SELECT *, GREATEST((RANK() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score)-1)/2.0::DOUBLE)/COUNT(*) OVER (), (RANK() OVER (ORDER BY anomaly) + (COUNT(*) OVER (PARTITION BY anomaly)-1)/2.0::DOUBLE)/COUNT(*) OVER ()) pp FROM eval), t AS (SELECT * FROM k ORDER BY pp DESC, transaction_id LIMIT 100),
c AS (SELECT t.*, pf.sender_tx_1h, pf.sender_tx_24h, pf.recipient_fanin_24h, pf.device_activity_24h, pf.device_unique_senders_24h, CONCAT_WS('|', CASE WHEN score>=a THEN 'HIGH_MODEL_RISK' END, CASE WHEN anomaly>=b THEN 'BEHAVIOURAL_TAIL' END, CASE WHEN device_unique_senders_24h>=3 THEN 'SHARED_DEVICE' END, CASE WHEN sender_tx_1h>=3 THEN 'RAPID_SENDER_VELOCITY' END, CASE WHEN recipient_fanin_24h>=5 THEN 'RECIPIENT_CONCENTRATION' END) r FROM t CROSS JOIN q JOIN pf USING (transaction_id))
SELECT transaction_id, us, sender, recipient, type, amount, sender_tx_1h, sender_tx_24h, recipient_fanin_24h, device_activity_24h, device_unique_senders_24h, is_fraud, fraud_type, score AS model_score, anomaly AS anomaly_score, ROUND(pp,9) AS priority_percentile, CASE WHEN r='' THEN 'RISK_RANK' ELSE r END AS reason_codes FROM c""",
    "hourly_arrivals": LANES + " SELECT hour, exploit, explore FROM arr",
    "decision_action": "SELECT transaction_id, CASE WHEN LEAST(GREATEST(score,0.0),1.0)>=0.7 THEN 'block' WHEN LEAST(GREATEST(score,0.0),1.0)>=0.3 THEN 'review' ELSE 'approve' END AS action FROM tx",
}
ORACLE_SQL |= {
    "threshold_at_legit_rate": cap_sql("cp", "val") + f" SELECT ROUND(MAX(t),9) AS threshold, {alerts('score>=t')} FROM fut CROSS JOIN cp",
    "locked_threshold_drift": f", g AS (SELECT period, {locked_sql('0.6')}, CAST({total('score>=0.6', '1-is_fraud')} AS DOUBLE)/SUM(1-is_fraud) AS rt FROM eval GROUP BY period) SELECT * EXCLUDE (rt), 0.6::DOUBLE AS threshold, CASE WHEN period='validation' THEN 1.0::DOUBLE ELSE ROUND(rt/(SELECT rt FROM g WHERE period='validation'),6) END AS budget_multiplier_vs_validation_actual FROM g",
    "posthoc_threshold_cap": cap_sql("cp", "fut") + f", h AS (SELECT fut.*, t FROM fut CROSS JOIN cp) SELECT 'future_test_posthoc_threshold_cap' AS period, ROUND(MAX(t),9) AS threshold, {locked_sql('t')}, true AS diagnostic_only, true AS may_underuse_budget_due_to_ties FROM h",
    "binary_metrics": ", " + CURVE.replace("FROM eval", "FROM fut") + f", m AS (SELECT ROUND(SUM(n*(tp-p/2.0))/(SUM(p)*SUM(n)),9) AS roc_auc, ROUND(SUM(CAST(p AS DOUBLE)*tp/(tp+fp))/SUM(p),9) AS pr_auc FROM c), k AS (SELECT ROUND(AVG(POW(score-is_fraud,2)),9) AS brier, 0.6::DOUBLE AS threshold, {alerts('score>=0.6')} FROM fut) SELECT * FROM m CROSS JOIN k",
    "model_metrics": ", " + CURVE.replace("FROM eval", "FROM fut") + f", m AS (SELECT ROUND(SUM(n*(tp-p/2.0))/(SUM(p)*SUM(n)),9) AS roc_auc, ROUND(SUM(CAST(p AS DOUBLE)*tp/(tp+fp))/SUM(p),9) AS pr_auc FROM c), k AS (SELECT ROUND(AVG(POW(score-is_fraud,2)),9) AS brier, {alerts('score>=0.6')} FROM fut) SELECT 'fixture' AS model, pr_auc, roc_auc, brier, 0.6::DOUBLE AS threshold_at_1pct_fpr, COALESCE(precision,0.0) AS precision_at_1pct_fpr, COALESCE(recall,0.0) AS recall_at_1pct_fpr, fraud_value_recall AS fraud_value_recall_at_1pct_fpr, legit_flag_rate FROM m CROSS JOIN k",
    "select_profiles": within(ALPHA_GRID, "ag") + " " + picks_sql("ag", PROFILE_SPECS, "validation"),
    "robustness_summary": within(WINDOW_GRID, "wg") + " " + ROBUSTNESS,
    "robust_profiles": within(WINDOW_GRID, "wg") + f", rb AS ({ROBUSTNESS}) " + picks_sql("rb", ROBUST_SPECS, "validation_windows_only"),
    "selected_profile_frontier": renamed(within(ALPHA_GRID, "ag"), "v") + f", pk AS ({picks_sql('ag', PROFILE_SPECS, 'validation')})" + PROFILED.format(t="fut") + frontier_sql("pf", "profile, alpha, amount_scale", "priority"),
    "selected_profile_windows": renamed(within(WINDOW_GRID, "wg"), "v") + f", rb AS ({ROBUSTNESS}), pk AS ({picks_sql('rb', ROBUST_SPECS, 'x')})" + WINDOWS.format(t="fut").replace("wy ", "wy2 ").replace(", w AS", ", w2 AS") + PROFILED.format(t="w2") + frontier_sql("pf", "profile, alpha, win, step_min, step_max", "priority", "(50.0)", head="o.profile, o.alpha, concat('future_window_', o.win) AS period, o.step_min, o.step_max, "),
    "policy_summary": grid_sql("ga", "val") + grid_sql("gb", "fut") + f", x AS (SELECT {grid_out(policy.SCENARIOS['reference'])} FROM gb) SELECT review_threshold, block_threshold, fraud_value_prevented_rate AS test_fraud_value_prevented_rate, legit_friction_rate AS test_legitimate_friction_rate, review_rate AS test_review_rate, block_rate AS test_block_rate FROM x WHERE grid_id=(SELECT grid_id FROM ga ORDER BY ROUND({cost_sql(policy.SCENARIOS['reference'])},6), grid_id LIMIT 1)",
    "percentile_ranks": "SELECT transaction_id, ROUND((RANK() OVER (ORDER BY amount) + (COUNT(*) OVER (PARTITION BY amount)-1)/2.0::DOUBLE)/COUNT(*) OVER (),9) AS amount_rank FROM eval",
    "rule_scores": "SELECT transaction_id, ROUND(CASE WHEN type IN ('TRANSFER','CASH_OUT') THEN LN(1+GREATEST(amount,0)) ELSE -1e9 END,9) AS rule_score FROM tx",
    "bound_threshold_drift": "SELECT CASE WHEN step<433 THEN 'train' WHEN step<577 THEN 'validation' ELSE 'future_test' END AS period, COUNT(*) AS n, " + f"CAST({total('score>=0.6')} AS BIGINT) AS alerts, {ratio_sql(total('score>=0.6', 'is_fraud'), 'SUM(is_fraud)')} AS recall FROM tx GROUP BY 1",
    "data_audit": "SELECT COUNT(*) AS n, CAST(SUM(is_fraud) AS BIGINT) AS fraud_n, ROUND(AVG(is_fraud),9) AS fraud_rate, MIN(us) AS start_us, MAX(us) AS end_us, MAX(us//86400000000)-MIN(us//86400000000)+1 AS days FROM tx",
    "balance_features": "SELECT transaction_id, ROUND(LEAST(GREATEST(amount/GREATEST((transaction_id*131)%1000,1)::DOUBLE,0.0),20.0),7) AS balance_fraction, ROUND((transaction_id*131)%1000-GREATEST(0.0::DOUBLE,(transaction_id*131)%1000-amount),7) AS orig_balance_delta, ROUND(((transaction_id*37)%1000+amount)-(transaction_id*37)%1000,7) AS dest_balance_delta FROM tx",
    "ordered_split": f"SELECT step, transaction_id AS event_key, amount, is_fraud, is_flagged_fraud, ROUND(LN(1+GREATEST(amount,0)),7) AS log_amount, c AS sender_tx_24h FROM (SELECT *, COUNT(*) OVER {frame('sender', 'step', 24)} c FROM tx) q WHERE step>=433 AND step<577",
    "queue_metrics": QUEUED.format(pick="qn, cap, 0.2::DOUBLE AS sh", caps="(25),(50),(100),(200)", share="", explores="qn='two_lane_80_20'", out="qn AS queue, CAST(cap AS INT) AS capacity_per_10k, " + ", ".join(f"{v} AS {k}" for k, v in QUEUE_CELLS.items())).replace("v(cap))", "v(cap) CROSS JOIN (VALUES ('model'),('hybrid'),('two_lane_80_20')) qq(qn))"),
    "exploration_sensitivity": QUEUED.format(pick="'two_lane' AS qn, cap, sh", caps="(100),(200)", share="", explores="sh>0", out="CAST(cap AS INT) AS capacity_per_10k, sh AS exploration_share, " + ", ".join(f"{v} AS {k}" for k, v in QUEUE_CELLS.items() if k not in ("review_n", "fraud_recall"))).replace("v(cap))", "v(cap) CROSS JOIN (VALUES (0.0::DOUBLE),(0.1),(0.2),(0.3),(0.4)) ss(sh))"),
    "admitted_candidates": LANES + slots_sql("(1.0::DOUBLE),(2.5)") + " SELECT transaction_id, lane, m AS traffic_multiplier FROM chosen",
    "adaptive_routing": ROUTING,
    "queue_sla_stress": BACKLOG,
    "weekly_monitor": f""", tt AS (SELECT *, ROUND(LN(1+amount)/5,9) AS tail_score, DATE '1969-12-29' + CAST(FLOOR((FLOOR(us/86400000000.0)+3)/7)*7 AS INT) AS mon FROM tx), vv AS (SELECT * FROM tt WHERE step>=433 AND step<577), ff AS (SELECT *, concat(CAST(mon AS VARCHAR), '/', CAST(mon+6 AS VARCHAR)) AS week FROM tt WHERE step>=577),
q AS (SELECT UNNEST(QUANTILE_CONT(score,[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) c FROM vv), d AS (SELECT DISTINCT c FROM q WHERE c>(SELECT MIN(score) FROM vv) AND c<(SELECT MAX(score) FROM vv)), bins AS (SELECT UNNEST(RANGE(0,(SELECT COUNT(*)+1 FROM d))) b), e AS (SELECT b, COUNT(*)/SUM(COUNT(*)) OVER () x FROM (SELECT (SELECT COUNT(*) FROM d WHERE c<=score) b FROM vv) z GROUP BY b),
aw AS (SELECT week, b, COUNT(*)/SUM(COUNT(*)) OVER (PARTITION BY week) x FROM (SELECT week, (SELECT COUNT(*) FROM d WHERE c<=score) b FROM ff) z GROUP BY week, b), wk AS (SELECT DISTINCT week FROM ff), fp AS (SELECT week, GREATEST(COALESCE(aw.x,0),1e-6) aa, GREATEST(COALESCE(e.x,0),1e-6) ee FROM wk CROSS JOIN bins LEFT JOIN e USING (b) LEFT JOIN aw USING (week, b)), ps AS (SELECT week, ROUND(SUM((aa-ee)*LN(aa/ee)),6) AS score_psi_vs_validation FROM fp GROUP BY week),
g AS (SELECT week, COUNT(*) AS n, ROUND(AVG(is_fraud),9) AS fraud_rate, ROUND(SUM(amount*is_fraud),4) AS fraud_value, ROUND(AVG(CASE WHEN score>=0.6 THEN 1 ELSE 0 END),9) AS model_alert_rate, ROUND(AVG(score),9) AS mean_model_score, ROUND(AVG(POW(score-is_fraud,2)),9) AS brier, ROUND(AVG(CASE WHEN {NOVEL_SQL} THEN 1 ELSE 0 END),9) AS novel_fraud_rate, ROUND(AVG(CASE WHEN tail_score>1.2 THEN 1 ELSE 0 END),9) AS tail_alert_rate FROM ff GROUP BY week)
SELECT *, CASE WHEN tail_alert_rate>=0.075 OR score_psi_vs_validation>=0.25 THEN 'INVESTIGATE' WHEN score_psi_vs_validation>=0.10 THEN 'WATCH' ELSE 'NORMAL' END AS status FROM g JOIN ps USING (week)""",
}
_T = ["sender_tx_24h", "recipient_fanin_24h", "recipient_tx_7d", "sender_unique_recipients_7d", "recipient_unique_senders_7d"]
_PAST = f"""t AS (SELECT transaction_id, step, is_fraud, COUNT(*) OVER {frame('sender', 'step', 24)} AS sender_tx_24h, COUNT(*) OVER {frame('recipient', 'step', 24)} AS recipient_fanin_24h, COUNT(*) OVER {frame('recipient', 'step', 168)} AS recipient_tx_7d,
 COUNT(DISTINCT recipient) OVER {frame('sender', 'step', 168)} AS sender_unique_recipients_7d, COUNT(DISTINCT sender) OVER {frame('recipient', 'step', 168)} AS recipient_unique_senders_7d FROM tx)"""
ORACLE_SQL |= {
    "tail_score": f", {_PAST}, q AS (SELECT " + ", ".join(f"GREATEST(QUANTILE_CONT(LN(1+{c}),0.99),1e-6) AS q_{c}" for c in _T) + " FROM t WHERE step<433 AND is_fraud=0) SELECT transaction_id, ROUND(GREATEST(" + ", ".join(f"LN(1+{c})/q_{c}" for c in _T) + "),7) AS tail_score FROM t CROSS JOIN q WHERE step>=577",
    "fraud_typology": ", k AS (SELECT amount, CASE WHEN transaction_id%2=0 THEN 'novel_shared_device_microburst' WHEN transaction_id%3=0 THEN 'account_takeover' WHEN transaction_id%3=1 THEN 'transfer_burst' ELSE 'mule_cashout' END AS fraud_type FROM fut WHERE is_fraud=1) SELECT fraud_type, COUNT(*) AS transactions, ROUND(SUM(amount),4) AS fraud_value, ROUND(AVG(amount),4) AS mean_amount, ROUND(COUNT(*)/SUM(COUNT(*)) OVER (),9) AS transaction_share, ROUND(SUM(amount)/SUM(SUM(amount)) OVER (),9) AS value_share FROM k GROUP BY fraud_type",
    "experiment_design": ", band AS (SELECT COUNT(*) FILTER (WHERE score>=0.3 AND score<0.5) AS n, COALESCE(AVG(is_fraud) FILTER (WHERE score>=0.3 AND score<0.5), AVG(is_fraud)) AS p FROM val), t AS (SELECT n, p, GREATEST(1e-6, p*0.75::DOUBLE) AS q FROM band) SELECT n AS eligible_n, ROUND(p,9) AS baseline_fraud_rate, ROUND(q,9) AS target_fraud_rate, CAST(CEIL(POWER((1.959963984540054::DOUBLE*SQRT((p+q)*(1-(p+q)/2))+0.8416212335729143::DOUBLE*SQRT(p*(1-p)+q*(1-q)))/(p-q),2)) AS BIGINT) AS required_n_per_arm FROM t",
}
_EARLIER = lambda key, back, name: f"(SELECT COUNT(*) FROM s h WHERE h.{key}=t.{key} AND h.sec<t.sec AND h.sec>=t.sec-{back}) AS {name}"
ORACLE_SQL["parity_counts"] = f", s AS (SELECT *, us // 1000000 AS sec FROM tx) SELECT transaction_id, {_EARLIER('sender', 3600, 'sender_tx_1h')}, {_EARLIER('sender', 86400, 'sender_tx_24h')}, {_EARLIER('recipient', 86400, 'recipient_fanin_24h')}, {_EARLIER('device_id', 86400, 'device_activity_24h')} FROM s t"
RECURSIVE = {"adaptive_routing", "admitted_candidates", "queue_sla_stress"}
ORACLE_SQL = {k: (TX.replace("WITH b", "WITH RECURSIVE b", 1) if k in RECURSIVE else TX) + v for k, v in ORACLE_SQL.items()}
