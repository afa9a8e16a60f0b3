"""Leaf-wise trees against a plain search over all splits, in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import boosting, models


def table(spark, n=600, seed=0):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(0, 1, (n, 3)), 1)
    x[:, 2] = np.where(r.random(n) < 0.1, np.nan, x[:, 2])
    y = ((x[:, 0] > 0.4) ^ (x[:, 1] > 0.2)) | (r.random(n) < 0.05)
    rows = [(int(a), *(None if np.isnan(v) else float(v) for v in b)) for a, b in zip(y, x, strict=True)]
    return spark.createDataFrame(rows, "is_fraud int, a double, b double, c double"), x, y.astype(float)


def plain(x, y, edges, trees, leaves, least, ridge, rate):
    """The same trees with every split of every leaf tried from the rows themselves."""
    bins = np.stack([np.where(np.isnan(x[:, j]), len(e) + 1, np.searchsorted(e, x[:, j], side="left")) for j, e in enumerate(edges)], 1)
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    out = []

    def best(g, h, rows):
        found = (-np.inf, 0, 0)
        power = lambda s: g[s].sum() ** 2 / (h[s].sum() + ridge)
        for f in range(bins.shape[1]):
            for b in range(bins[:, f].max() + 1):
                left, right = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
                if min(len(left), len(right)) >= least and min(h[left].sum(), h[right].sum()) >= 1e-3:
                    gain = power(left) + power(right) - power(rows)
                    if gain > found[0] + 1e-9:
                        found = (gain, f, b)
        return found

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at = [np.arange(len(y))]
        splits = []
        while len(at) < leaves:
            gains = [best(g, h, rows) for rows in at]
            i = max(range(len(at)), key=lambda i: gains[i][0])
            gain, f, b = gains[i]
            if gain <= 1e-12:
                break
            splits.append((f, b, round(gain, 6)))
            rows = at.pop(i)
            at += [rows[bins[rows, f] <= b], rows[bins[rows, f] > b]]
        for rows in at:
            margin[rows] -= rate * g[rows].sum() / (h[rows].sum() + ridge)
        out.append(sorted(splits))
    return out, 1 / (1 + np.exp(-margin))


def test_trees_are_those_of_a_plain_search(spark):
    df, x, y = table(spark)
    edges = boosting.edges_of(df, ["a", "b", "c"], 16)
    model = boosting.fit(df, ["a", "b", "c"], trees=5, leaves=7, rate=0.3, least=10, share=1.0, columns=1.0, edges=edges)
    splits, p = plain(x, y, edges, 5, 7, 10, 1.5, 0.3)
    got = [sorted((n[0], n[1], round(g, 6)) for n, g in zip(t.nodes, t.gains, strict=True) if n[0] >= 0) for t in model.trees]
    assert got == splits
    scored = model.score(df).collect()
    assert [r["score"] for r in scored] == pytest.approx(p.tolist(), abs=1e-9)
    again = boosting.Boosted.from_json(model.to_json())
    assert [r["score"] for r in again.score(df).collect()] == [r["score"] for r in scored]
    gains = {c: sum(g for s in splits for f, _, g in s if f == j) for j, c in enumerate("abc")}
    assert dict(model.importances()) == pytest.approx({c: g / sum(gains.values()) for c, g in gains.items()}, abs=1e-6)


def test_weights_count_as_rows_in_gradients(spark):
    df, _, _ = table(spark, 200)
    args = {"trees": 2, "leaves": 4, "rate": 0.3, "share": 1.0, "columns": 1.0, "edges": boosting.edges_of(df, ["a", "b"], 8), "ridge": 0.0}
    once = boosting.fit(df.withColumn("w", F.lit(2.0)), ["a", "b"], least=1, weight="w", **args)
    twice = boosting.fit(df.unionAll(df), ["a", "b"], least=2, **args)
    assert [t.nodes for t in once.trees] == [t.nodes for t in twice.trees]
    assert [v for t in once.trees for v in t.values] == pytest.approx([v for t in twice.trees for v in t.values])


def test_edge_cases(spark):
    df, _, _ = table(spark, 100)
    for bad in (df.limit(0), df.where("is_fraud = 1")):
        with pytest.raises(ValueError):
            boosting.fit(bad, ["a"], trees=1)
    flat = df.withColumn("a", F.lit(1.0)).withColumn("b", F.lit(None).cast("double"))
    model = boosting.fit(flat, ["a", "b"], trees=2, least=1, columns=1.0)
    assert all(t.nodes == [[-1, 0, 0, 0]] for t in model.trees)
    assert model.score(df.limit(0)).count() == 0


def test_detectors_come_back_from_their_files(spark, tmp_path):
    df, _, _ = table(spark, 400)
    d = models.fit_detector(df, df, ["a", "b"], 2)
    d.save(spark, str(tmp_path / "d"))
    d.save(spark, str(tmp_path / "d"))
    back = models.Detector.load(spark, str(tmp_path / "d"))
    assert back.threshold == d.threshold and back.model == d.model
    assert [r["score"] for r in back.score(df).collect()] == [r["score"] for r in d.score(df).collect()]


def test_leaves_of_few_rows_are_grown_by_one_task(spark, monkeypatch):
    """The same trees, whether leaves are grown by passes, by tasks of their own or by both, and a job or two a tree where all rows are few."""
    df, _, _ = table(spark, 900, 3)
    args = {"trees": 4, "leaves": 15, "rate": 0.3, "least": 5, "edges": boosting.edges_of(df, ["a", "b", "c"], 16)}
    models_ = []
    for few in (0, 60, 1 << 20):
        monkeypatch.setattr(boosting, "FEW", few)
        spark.sparkContext.setJobGroup(f"few {few}", "")
        models_.append(boosting.fit(df, ["a", "b", "c"], **args))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"few {1 << 20}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 4 + 2 * 4
    for m in models_[1:]:
        assert [t.nodes for t in m.trees] == [t.nodes for t in models_[0].trees]
        assert [v for t in m.trees for v in t.values] == pytest.approx([v for t in models_[0].trees for v in t.values])


def test_what_a_task_is_told_does_not_grow_with_every_tree(spark, monkeypatch):
    """Blocks are made from the rows anew after some trees, which are the same trees."""
    df = spark.range(400).selectExpr("id AS transaction_id", "CAST(id % 7 IN (1, 3) AS INT) AS is_fraud", "CAST(id % 50 AS DOUBLE) AS a", "CAST(id * 37 % 100 AS DOUBLE) AS b")
    args = {"trees": 12, "leaves": 4, "rate": 0.3, "least": 5, "edges": boosting.edges_of(df, ["a", "b"], 8)}
    depth, grow = [], boosting._grow

    def grown(blocks, *rest):
        depth.append(blocks.toDebugString().count(b"PythonRDD"))
        return grow(blocks, *rest)

    monkeypatch.setattr(boosting, "_grow", grown)
    whole = boosting.fit(df, ["a", "b"], **args)
    monkeypatch.setattr(boosting, "CHAIN", 3)
    depth.clear()
    cut = boosting.fit(df, ["a", "b"], **args)
    assert depth == depth[:3] * 4
    assert [t.nodes for t in cut.trees] == [t.nodes for t in whole.trees] and [t.values for t in cut.trees] == [t.values for t in whole.trees]
