"""What large tables spare: cuts that no key can need, rows counted or computed twice."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators import order, pit, queues
from riskloom.plans import registry

DATA = "/root/testdata/sf0.001"


def test_lines_of_few_times_are_not_cut(spark, monkeypatch):
    """Hourly steps are fewer than a piece however many rows there are, so nothing is cut; a wider span of times still is."""
    df = registry.tx(spark, DATA)
    plain = sorted(map(tuple, pit.step_features(df).select("transaction_id", *registry.FEATURES_ML).collect()))
    monkeypatch.setattr(pit, "large", lambda df: True)
    assert not pit.crowded(df, "step") and pit.crowded(df, "us") and not pit.crowded(df.limit(0), "us")
    cuts = []
    real = pit._cut_points
    monkeypatch.setattr(pit, "_cut_points", lambda *a: cuts.append(1) or real(*a))
    assert sorted(map(tuple, pit.step_features(df).select("transaction_id", *registry.FEATURES_ML).collect())) == plain and not cuts
    pit.device_activity(df)
    assert cuts


def test_sightings_are_summed_by_time(spark):
    """A key's line has no row for each of its values."""
    df = spark.range(2000).selectExpr("'k' AS k", "id AS v", "CAST(id % 3 AS LONG) AS _at")
    steps = pit._sightings(df, None, ["k"], "v", 1, "d")
    assert sorted((r["_at"], r["d"]) for r in steps.collect()) == [(1, 667), (2, 667 - 667), (3, 666 - 667), (4, -666)]


@pytest.mark.parametrize("name", ["recipient_signal_audit", "queue_metrics", "exploration_sensitivity", "recipient_concentration"])
def test_results_of_few_rows_are_read_while_rows_are_kept(spark, name):
    assert registry.QUERIES[name](spark, DATA).inputFiles() == []


def test_scores_of_later_steps_leave_out_earlier_ones(spark, monkeypatch):
    """The week before the scored steps is all that their features need."""
    seen = []
    real = pit.step_features
    monkeypatch.setattr(pit, "step_features", lambda t, *a: seen.append(t.agg(F.min("step"), F.max("step")).first()) or real(t, *a))
    registry.QUERIES["logistic_scores"](spark, DATA)
    assert len(seen) == 2 and seen[0][1] < registry.TEST and seen[1][0] >= registry.TEST - pit.WEEK


def test_counts_that_are_few_are_ordered_at_once(spark, monkeypatch):
    """With every table large by the optimizer, queues order the kept counts of values by their true size."""
    df = registry.evaluation(spark, DATA)
    want = sorted(map(tuple, queues.queue_metrics(df).collect()))
    passes = []
    real = order._digits
    monkeypatch.setattr(order, "SMALL", 40_000)
    monkeypatch.setattr(order, "_digits", lambda g, c, d: passes.append(c) or real(g, c, d))
    assert sorted(map(tuple, queues.queue_metrics(df).collect())) == want
    assert not {"score", "anomaly", "amount"} & set(passes)
