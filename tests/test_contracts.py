"""Small cases with known answers: history, caps, capacity, profiles, queues and sources."""

import math

import pytest
from pyspark.sql import functions as F

from riskloom.functions import scoring
from riskloom.operators import capacity, metrics, models, pit, policy, queues
from riskloom.plans import benchmark
from riskloom.sources import transactions as src

H = 3_600_000_000


def scored(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "transaction_id long, is_fraud int, score double, amount double")


def payments(spark, rows):
    return spark.createDataFrame([(i, int(at * H), s, r, d, 10.0) for i, (at, s, r, d) in enumerate(rows)], "transaction_id long, us long, sender string, recipient string, device_id string, amount double")


def by_id(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("transaction_id").collect()]


def test_history_sees_only_the_past(spark):
    f = pit.payment_features(payments(spark, [(0, "A", "B", "D"), (0.5, "A", "B", "D"), (0.5, "A", "B", "D"), (2, "A", "B", "D")]))
    assert by_id(f, "sender_tx_1h", "sender_tx_24h", "hour", "is_night") == [(0, 0, 0, 1), (1, 1, 0, 1), (1, 1, 0, 1), (0, 3, 2, 1)]
    assert by_id(f, "sender_amount_24h", "sender_mean_amount_7d") == [(0, 10), (10, 10), (10, 10), (30, 10)]


def test_distinct_neighbours(spark):
    f = pit.payment_features(payments(spark, [(0, "C1", "C9", "D1"), (1 / 6, "C2", "C9", "D1"), (1 / 3, "C1", "C8", "D1")]))
    assert by_id(f, "device_unique_senders_24h", "recipient_unique_senders_24h", "sender_unique_recipients_24h", "pair_tx_24h") == [(0, 0, 0, 0), (1, 1, 0, 0), (2, 0, 1, 0)]


def test_null_keys_lose_no_rows(spark):
    rows = [(0, None, "B", "D"), (1, None, "B", None), (2, "A", None, "D"), (3, "A", None, None)]
    assert by_id(pit.payment_features(payments(spark, rows)), "sender_tx_24h", "recipient_fanin_24h", "recipient_unique_senders_24h", "device_activity_24h") == [(0, 0, 0, 0), (1, 1, 0, 0), (0, 0, 0, 1), (1, 1, 1, 1)]
    tx = payments(spark, rows).withColumns({"step": (F.col("us") / H).cast("int"), "type": F.lit("DEBIT"), "is_fraud": F.lit(0)})
    assert pit.step_features(tx).count() == pit.recipient_investigation(tx).count() == 4


def test_counts_agree_with_correlated_queries(spark):
    tx = payments(spark, [(i * 0.37, f"S{i % 3}", f"R{i % 4}", f"D{i % 2}") for i in range(120)])
    tx.withColumn("at", F.expr("us DIV 1000000")).createOrReplaceTempView("parity_tx")
    past = lambda key, back: f"(SELECT COUNT(*) FROM parity_tx h WHERE h.{key} = t.{key} AND h.at < t.at AND h.at >= t.at - {back})"
    want = spark.sql(f"SELECT transaction_id, {past('sender', 3600)} AS a, {past('sender', 86400)} AS b, {past('recipient', 86400)} AS c, {past('device_id', 86400)} AS d FROM parity_tx t")
    assert by_id(pit.payment_features(tx), "sender_tx_1h", "sender_tx_24h", "recipient_fanin_24h", "device_activity_24h") == by_id(want, "a", "b", "c", "d")


def test_hard_cap(spark):
    cap = lambda legit, target: metrics.threshold_at_legit_rate(scored(spark, [(0, s, 1.0) for s in legit] + [(1, 0.5, 1.0)]), target)
    assert cap([0.9, 0.5, 0.5, *[0.1] * 7], 0.2) == math.nextafter(0.5, math.inf)
    assert cap([0.0] * 998 + [0.9] * 2, 0.001) == math.nextafter(0.9, math.inf)
    even = [i / 999 for i in range(1000)]
    at = cap(even, 0.001)
    assert sum(s >= at for s in even) == 1 and cap(even, 1) == 0 and cap(even, 0) > 1
    with pytest.raises(ValueError):
        cap([float("nan")], 0.1)


def test_metrics(spark):
    rows = [(1, 0.0, float(a)) for a in range(10, 0, -1)] + [(0, 0.0, 999.0)]
    got = metrics.value_concentration(scored(spark, rows)).first()
    assert (got["top_10"], got["top_50"]) == (pytest.approx(10 / 55), pytest.approx(40 / 55))
    with pytest.raises(ValueError):
        metrics.binary_metrics(scored(spark, [(1, 3.0, 1.0)]), 0.5)
    drift = metrics.locked_threshold_drift(scored(spark, [(0, s, 1.0) for s in (0.1, 0.7, 0.8, 0.9)]).withColumn("period", F.lit("future_test")), 0.5, 0.25).first()
    assert (drift["legit_flag_rate"], drift["budget_multiplier_vs_target"], drift["budget_multiplier_vs_validation_actual"]) == (0.75, 3.0, None)
    x = scored(spark, [(0, i / 50, 1.0) for i in range(50)])
    assert metrics.psi(x, x).first()[0] == 0


def test_capacity_ties(spark):
    df = scored(spark, [(int(i % 7 == 0), 0.9 if i % 100 == 0 else 0.1, float(i)) for i in range(10_000)])
    r = capacity.frontier(df, (50,)).first()
    assert (r["capacity"], r["alerts"], r["boundary_tie_n"], r["boundary_tie_selected_n"], r["boundary_score"]) == (50, 50, 100, 50, 0.9)
    with pytest.raises(ValueError):
        capacity.frontier(df, (-1,))
    with pytest.raises(ValueError):
        capacity.frontier(df.limit(0), (50,))
    steps = capacity.step_windows(spark.createDataFrame([(i,) for i in range(1, 7)], "step int"))
    assert sorted(map(tuple, steps.select("window", "step_min", "step_max").distinct().collect())) == [(1, 1, 2), (2, 3, 4), (3, 5, 6)]


def test_profiles(spark):
    one = lambda alpha: scored(spark, [(1, 0.4, 50.0)]).select(scoring.priority(F.col("score"), F.col("amount"), F.lit(alpha), F.lit(100.0))).first()[0]
    assert (one(0.0), one(1.0)) == (0.4, pytest.approx(0.2))
    for score, amount, alpha, scale in ((1.5, 1.0, 0.5, 1.0), (float("nan"), 1.0, 0.5, 1.0), (0.5, float("inf"), 0.0, 1.0), (0.5, 1.0, 2.0, 1.0), (0.5, 1.0, 0.5, 0.0)):
        with pytest.raises(Exception, match="must"):
            scored(spark, [(1, score, amount)]).select(scoring.priority(F.col("score"), F.col("amount"), F.lit(alpha), F.lit(scale))).collect()
    amounts = lambda *a: capacity.amount_scale(spark.createDataFrame([(float(x),) for x in a], "amount double"))
    assert (amounts(0, 10, 20, 100), amounts(0, 0)) == (20, 1)
    grid = spark.createDataFrame([(0.0, 0.5, 0.2, 0.3, 0.4), (0.5, 0.5, 0.3, 0.3, 0.4), (1.0, 0.4, 0.9, 0.9, 0.4)], "alpha double, recall double, precision double, fraud_value_recall double, balanced_hmean double")
    assert {r["profile"]: r["alpha"] for r in capacity.select_profiles(grid).collect()} == {"case_first": 0.5, "balanced": 1.0, "value_first": 1.0}
    assert benchmark.select_balance_free_champion([{"model": m, "validation_pr_auc": v} for m, v in zip(benchmark.FEATURE_SETS, (0.2, 0.25, 0.3, 0.99))]) == "transaction_plus_relational"
    with pytest.raises(ValueError):
        benchmark.select_balance_free_champion([])


def test_queues(spark):
    assert (queues.lanes_of(10, 0.0), queues.lanes_of(10, 0.25), queues.lanes_of(1, 0.5)) == ((10, 0), (8, 2), (1, 0))
    df = spark.createDataFrame([(i, i * H, 0, 1.0, 0.5, 0.0, "none") for i in range(24)], "transaction_id long, us long, is_fraud int, amount double, score double, anomaly double, fraud_type string")
    rows = queues.lanes(df, 0.4, 0.9, 1.0)
    last = {(r["analyst_capacity_per_hour"], r["traffic_multiplier"]): r["final_backlog_cases"] for r in queues.sla_stress(rows, (1.0,), (1.0, 2.0)).collect()}
    assert last[1.0, 1.0] == 0 and last[1.0, 2.0] == 24
    got = {r["traffic_multiplier"]: r["admitted_n_source_stream"] for r in queues.adaptive_routing(rows, 1.0, (1.0, 2.0)).collect()}
    assert got == {1.0: 24, 2.0: 12}
    with pytest.raises(ValueError):
        queues.adaptive_routing(rows, 0.0)
    few = scored(spark, [(i % 2, i / 10, 1.0) for i in range(6)]).withColumns({"anomaly": F.col("transaction_id") * -1.0, "fraud_type": F.lit("none")})
    lanes = lambda k, share: sorted((r["lane"], r["transaction_id"]) for r in queues.two_lane(few, k, share).collect())
    assert lanes(3, 0.34) == [("exploit", 4), ("exploit", 5), ("explore", 0)] and lanes(2, 1.0) == [("explore", 0), ("explore", 1)] and len(lanes(50, 0.2)) == 6
    assert all(r["review_n"] in (0, None) for r in queues.queue_metrics(few.limit(0)).collect())
    places = queues.percentile_rank(df.withColumn("v", F.col("transaction_id") % 2), "v", "p")
    assert sorted({r["p"] for r in places.collect()}) == [6.5 / 24, 18.5 / 24]


def test_small_expressions(spark):
    kinds = spark.createDataFrame([("TRANSFER", math.e - 1), ("CASH_OUT", 0.0), ("DEBIT", 5.0)], "type string, amount double")
    assert [r[0] for r in kinds.select(scoring.rule_score()).collect()] == [pytest.approx(1), 0, -1e9]
    p = spark.createDataFrame([(0.1,), (0.3,), (0.9,)], "p double")
    assert [r[0] for r in p.select(scoring.decision(F.col("p"), 0.2, 0.7)).collect()] == ["approve", "review", "block"]
    assert [r[0] for r in p.select(scoring.adjust_for_prior(F.col("p"), 0.02, 0.02)).collect()] == pytest.approx([0.1, 0.3, 0.9])
    assert p.select(models._logit("p")).first()[0] == pytest.approx(math.log(1 / 9))
    assert set(policy.SCENARIOS) == {"reference", "high_customer_friction", "conservative_intervention", "strong_intervention_low_friction"}


def test_paysim_files(spark, tmp_path):
    head = [c.split()[0] for c in src.PAYSIM_SCHEMA.split(", ")]
    lines = [",".join(head)] + [f"{s},TRANSFER,{a},C1,100,{100 - a},M1,0,{a},0,0" for s, a in ((1, 10), (1, 20), (2, 30), (2, 40), (3, 50), (3, 60))]
    path = tmp_path / "p.csv"
    path.write_text("\n".join(lines) + "\n")
    tx = src.read_paysim(spark, str(path), max_step=2)
    assert sorted(r["transaction_id"] for r in tx.collect()) == [0, 1, 2, 3] and tx.agg(F.max("step")).first()[0] == 2
    with pytest.raises(ValueError):
        src.read_paysim(spark, str(path), max_step=0)
    with pytest.raises(ValueError):
        src.validate_canonical(tx)
    with pytest.raises(ValueError):
        src.determine_split(tx)
    b = tx.select("transaction_id", *pit.balance_features()).orderBy("transaction_id").first()
    assert (b["balance_fraction"], b["orig_balance_delta"], b["dest_balance_delta"]) == (0.1, 10, 10)
    split = src.load_split(pit.step_features(tx), ["log_amount"], 1, 2).collect()
    assert len(split) == 2 and split[0]["step"] == 1


def test_simulator(spark):
    t = src.simulate(spark, 20_000)
    kinds = {r["fraud_type"]: r for r in t.groupBy("fraud_type").agg(F.min("day").alias("day"), F.countDistinct("device_id").alias("devices"), F.min("is_fraud").alias("y"), F.max("amount").alias("top")).collect()}
    novel = kinds["novel_shared_device_microburst"]
    assert set(kinds) == {"legitimate", *src.KNOWN, src.NOVEL} and novel["day"] >= 48 and novel["devices"] <= 4 and novel["top"] <= 120 and kinds["legitimate"]["y"] == 0
    assert t.agg(F.sum(F.hash(*t.columns).cast("long"))).first() == t.repartition(7).agg(F.sum(F.hash(*t.columns).cast("long"))).first()
