"""Scores of isolation, the sample size, and what sinks write."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions.scoring import two_proportion_sample_size
from riskloom.operators import isolation, models, pit
from riskloom.plans import benchmark, registry
from riskloom.sources import sinks


def test_isolation_ranks_what_lies_apart_first(spark):
    r = np.random.default_rng(1)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(r.normal(0, 1, (400, 2)))] + [(1000, 12.0, -12.0), (1001, None, None)]
    df = spark.createDataFrame(rows, "transaction_id long, a double, b double")
    out = isolation.score(df, isolation.fit(df, ["a", "b"], trees=40), ["a", "b"]).toPandas().sort_values("isolation", ascending=False)
    assert out.iloc[0]["transaction_id"] == 1000 and out["isolation"].between(0, 1).all()
    assert isolation.fit(df.limit(0), ["a", "b"]).trees == []


def test_tail_score_is_the_largest_scaled_feature(spark):
    df = spark.createDataFrame([(0.0, 9.0), (99.0, 0.0)], "a double, b double")
    assert models.fit_tail(df.limit(0), ["a"]) == {"a": 1e-6}
    got = [x[0] for x in df.select(models.tail_score({"a": 2.0, "b": 1.0})).collect()]
    assert got == pytest.approx([np.log(10), np.log(100) / 2])


def test_training_needs_both_classes(spark):
    with pytest.raises(ValueError):
        models.balanced(spark.createDataFrame([(1, 0.5)], "is_fraud int, x double"))


def test_sample_size():
    assert two_proportion_sample_size(0.5, 0.4) == 388  # (1.96 * 0.7036 + 0.8416 * 0.7) ** 2 / 0.01 = 387.3
    with pytest.raises(ValueError):
        two_proportion_sample_size(0.5, 0.5)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 0.5), (4, None)], "i int, x double")
    assert [r["x"] for r in sinks.finite(df).orderBy("i").collect()] == [None, None, 0.5, None]
    sinks.write_csv(df, str(tmp_path / "c"), gzip=True)
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 4
    sinks.write_features(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4
    sinks.write_summary({"a": float("nan"), "b": np.float64(1.5), "c": [float("inf")]}, str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text()) == {"a": None, "b": 1.5, "c": [None]}


def test_drawn_rows_end_where_an_ordering_ends_them(spark):
    """Bands that are too narrow widen until the end lies within; equal hashes are told apart by id."""
    from pyspark.sql import functions as F

    each = spark.range(3000).selectExpr("CAST(id % 3 AS INT) AS repeat", "CAST(id % 5 = 0 AS INT) AS is_fraud", "id AS transaction_id", "CASE WHEN id % 7 = 0 THEN 5L ELSE xxhash64(id) END AS _h")
    rows = [tuple(r) for r in each.collect()]
    sizes = [(0, 1), (0, 400), (1, 100), (1, 200)]
    want = {}
    for r in range(3):
        for i, (y, k) in enumerate(sizes):
            line = sorted((-h, t) for a, b, t, h in rows if (a, b) == (r, y))
            want[r, i] = (-line[k - 1][0], line[k - 1][1])
    for spread in (0.001, 8.0):
        got = models._hash_ends(each, 3, sizes, {0: 800, 1: 200}, spread)
        assert {(r["repeat"], r["_i"]): (r["_end"], r["_t"]) for r in got.collect()} == want
    scored = spark.range(6000).select(F.col("id").alias("transaction_id"), (F.col("id") % 40 == 0).cast("int").alias("is_fraud"), ((F.col("id") * 7919 % 1000) / 1000).alias("score"))
    out = models.prior_shift(scored, 0.025, repeats=2)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()  # no whole class is ordered
    assert {(r["target_prevalence"], r["n"]) for r in out.collect()} == {(0.001, 5856), (0.0025, 5865), (0.005, 5879), (0.01, 5909), (0.02, 5969)}


def test_features_of_a_span_are_those_of_the_whole(spark):
    d = "/root/testdata/sf0.001"
    for features in (registry.TAILS, registry.FEATURES_ML):
        whole = pit.step_features(registry.tx(spark, d)).select("transaction_id", "step", *features)
        for low, high in ((None, 300), (500, None), (200, 400)):
            got = registry._span(spark, d, low, high, features).select("transaction_id", "step", *features)
            want = whole.where((F.col("step") >= (low or 0)) & (F.col("step") < (high or 1000)))
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert not any(c.startswith("pair_") for c in pit.step_features(registry.tx(spark, d), pairs=False).columns)


def test_detectors_are_compared_while_their_rows_are_kept(spark):
    assert registry.QUERIES["detector_comparison"](spark, "/root/testdata/sf0.001").inputFiles() == []  # nothing is computed again when the result is read


def test_the_whole_study_grows_all_its_trees(spark, monkeypatch):
    """The fixture's few trees are not those of ``full_benchmark``: its models have the study's 250."""
    asked = []

    def fit(train, validation, names, trees):
        asked.append(trees)
        raise InterruptedError

    monkeypatch.setattr(benchmark.models, "fit_detector", fit)
    with pytest.raises(InterruptedError):
        registry.QUERIES["full_benchmark"](spark, "/root/testdata/sf0.001")
    assert set(asked) == {250}
