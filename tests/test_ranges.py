"""Range joins against all pairs."""

import random

import pytest

from riskloom.operators import ranges


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(5)
    key = lambda: r.choice(["hot"] * 6 + ["a", "b", None])
    events = [(i, key(), r.choice([None, *range(-60, 60)])) for i in range(300)]
    windows = [(i, key(), s, None if s is None or r.random() < 0.1 else s + r.choice([-3, 0, 1, 7, 10, 45])) for i, s in enumerate(r.choice([None, *range(-70, 70)]) for _ in range(120))]
    return events, windows, spark.createDataFrame(events, "e long, k string, at long"), spark.createDataFrame(windows, "w long, k string, lo long, hi long")


def meet(event, window):
    return None not in (*event, *window) and event[1] == window[1] and window[2] <= event[2] < window[3]


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_pairs_and_counts(tables, width):
    events, windows, e, w = tables
    pairs = ranges.range_join(e, w, ["k"], "at", "lo", "hi", width)
    assert sorted((r["e"], r["w"]) for r in pairs.collect()) == sorted((x[0], y[0]) for x in events for y in windows if meet(x, y))
    counts = ranges.range_counts(e, w, ["k"], "at", "lo", "hi", width)
    assert sorted((r["w"], r["n"]) for r in counts.collect()) == [(y[0], sum(meet(x, y) for x in events)) for y in windows]
    for plan in (pairs, counts):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_empty_and_repeated(tables):
    _, windows, e, w = tables
    assert ranges.range_join(e.limit(0), w, ["k"], "at", "lo", "hi", 10).count() == 0
    assert ranges.range_counts(e, w.limit(0), ["k"], "at", "lo", "hi", 10).count() == 0
    assert [r["n"] for r in ranges.range_counts(e.limit(0), w.unionAll(w), ["k"], "at", "lo", "hi", 10).collect()] == [0] * 2 * len(windows)


def test_crowded_keys_make_no_pairs(spark):
    """4000 events of one key in one bucket and a window up to each: no step of the plan makes more rows than a few for each event, where pairs would be 8 million."""
    e = spark.range(4000).selectExpr("'hot' AS k", "id AS at")
    got = ranges.range_counts(e, e.selectExpr("k", "at - 5000 AS lo", "at AS hi"), ["k"], "at", "lo", "hi", 10_000)
    assert sorted(r["n"] for r in got.collect()) == list(range(4000))
    made = []
    nodes = [got._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            nodes.append(node.plan())
        if node.metrics().contains("numOutputRows"):
            made.append(node.metrics().apply("numOutputRows").value())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert made and max(made) <= 5 * 4000
