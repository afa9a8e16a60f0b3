"""Order statistics, places and running totals against sorted lists."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import capacity, order

VALUES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1e-310, 1.0, math.nextafter(1.0, 2), math.nextafter(1.0, 0), 2.0, 3.0, 1e308, -1e308, float("inf"), float("-inf"), 0.1, 0.3, -7.25, 2.0**52 + 1, 1e15 + 0.25, 4.0, 8.0, 1 / 3]


def test_sortable_keeps_the_order(spark):
    r = random.Random(2)
    many = VALUES + [2.0**e for e in range(-1074, 1024, 7)] + [x for x in (struct.unpack("d", r.randbytes(8))[0] for _ in range(3000)) if x == x]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(many)] + [(-1, None), (-2, float("nan"))], "i int, x double")
    got = {row["i"]: row["k"] for row in df.select("i", order.sortable(df, "x").alias("k")).collect()}
    assert got[-1] is None and got[-2] == order.LARGEST
    known = sorted(range(len(many)), key=lambda i: many[i])
    for a, b in zip(known, known[1:]):
        assert (got[a] == got[b]) if many[a] == many[b] else (got[a] < got[b]), (many[a], many[b])
    whole = spark.createDataFrame([(-(2**63),), (5,), (2**63 - 1,)], "x long")
    assert [row[0] for row in whole.select(order.sortable(whole, "x")).collect()] == [-(2**63), 5, 2**63 - 1]


@pytest.fixture(params=["window", "digits"], autouse=True)
def path(request, monkeypatch):
    """Both ways, whatever the size of the tables."""
    monkeypatch.setattr(order, "SMALL", -1 if request.param == "digits" else 1 << 62)


def rows(spark, n=3000):
    r = random.Random(4)
    data = [(i, r.choice(["a", "b", None]), r.choice(VALUES[:9] + VALUES[15:]) if r.random() < 0.6 else round(r.gauss(0, 100), 2)) for i in range(n)]
    data += [(n + i, "ties", 0.5 if i % 50 else float(i)) for i in range(n)]  # 98 % of one value
    return data, spark.createDataFrame(data, "transaction_id long, k string, v double")


def grouped(data):
    out = {}
    for i, k, v in data:
        out.setdefault(k, []).append((v, i))
    return out


def test_quantiles(spark):
    data, df = rows(spark)
    shares = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {r["k"]: r["q"] for r in order.quantiles(order.counted(df, "v", ["k"]), "v", shares, ["k"]).collect()}
    for k, vs in grouped(data).items():
        assert got[k] == pytest.approx(np.quantile([v for v, _ in vs], shares), rel=1e-12)
    assert order.quantile(df, "v", 0.37) == pytest.approx(np.quantile([v for *_, v in data], 0.37), rel=1e-12)
    assert order.quantile(df.where("false"), "v", 0.5) is None and order.quantile(df.select(F.lit(None).cast("double").alias("v")), "v", 0.5) is None


@pytest.mark.parametrize("descending", [True, False])
def test_running_totals(spark, descending):
    data, df = rows(spark)
    got = order.running(order.counted(df, "v", ["k"]), "v", {"upto": "n"}, ["k"], descending).collect()
    for r in got:
        assert r["upto"] == sum((v >= r["v"]) if descending else (v <= r["v"]) for v, _ in grouped(data)[r["k"]])
    every = order.running(order.counted(df, "v"), "v", {"upto": "n"}, descending=descending).agg(F.max("upto")).first()[0]
    assert every == len(data)


def test_first_rows_and_ties(spark):
    data, df = rows(spark)
    ks = [1, 7, 400, 1500]
    wanted = df.select("k").distinct().withColumn("x", F.explode(F.array(*(F.struct(F.lit(i).alias("_i"), F.lit(n).cast("long").alias("_n")) for i, n in enumerate(ks))))).select("k", "x.*")
    ends = order.firsts(df, "v", wanted, ["k"])
    got = order.joined(df, ends, ["k"]).where(order.among("v", "_v", "transaction_id", "_t")).select("k", "_i", "transaction_id").collect()
    found = {}
    for r in got:
        found.setdefault((r["k"], r["_i"]), set()).add(r["transaction_id"])
    for k, vs in grouped(data).items():
        best = [i for _, i in sorted(vs, key=lambda x: (-x[0], x[1]))]
        for i, n in enumerate(ks):
            if n <= len(best):
                assert found[k, i] == set(best[:n])
            else:
                assert (k, i) not in found


def test_equal_values_are_not_gathered(spark):
    """98 % equal values: no task of the plan reads more than a small part of the rows once they are summed by value."""
    df = spark.range(0, 20_000, 1, 8).select(F.col("id").alias("transaction_id"), F.when(F.col("id") % 50 == 0, F.col("id").cast("double")).otherwise(0.5).alias("v"))
    place = order.average_place(df, "v", "p")
    n, ties = 20_000, 20_000 - 400
    assert place.where("v = 0.5").select("p").distinct().collect()[0][0] == (1 + (ties + 1) / 2) / n  # one value, 0, lies below
    assert order.counted(df, "v").count() == 401
    ends = order.firsts(df, "v", spark.createDataFrame([(0, 10_000)], "_i int, _n long")).first()
    assert (ends["_v"], ends["_before"], ends["_at"]) == (0.5, 399, ties) and df.where((F.col("v") == 0.5) & (F.col("transaction_id") <= ends["_t"])).count() == 10_000 - 399


def test_percent_places(spark):
    data, df = rows(spark, 600)
    got = order.percent_places(df.withColumn("w", F.expr("transaction_id % 7")), {"a": "v", "b": "w"}, ["k"]).collect()
    assert len(got) == len(data)
    for r in got:
        vs = grouped(data)[r["k"]]
        assert r["a"] == pytest.approx(sum(v < r["v"] for v, _ in vs) / (len(vs) - 1)) and r["b"] == pytest.approx(sum(i % 7 < r["w"] for _, i in vs) / (len(vs) - 1))


def test_capacity_by_selection_is_that_by_ranks(spark):
    """Counts by sorting, with ties at every budget, in groups, whichever way the plan takes."""
    r = random.Random(9)
    data = [(i, r.choice("ab"), int(r.random() < 0.1), r.choice([0.1, 0.5, 0.5, 0.9, r.random()]), float(r.randint(1, 9))) for i in range(2000)]
    df = spark.createDataFrame(data, "transaction_id long, k string, is_fraud int, score double, amount double")
    for row in capacity.frontier(df, (0, 3, 700, 5000, 10_000), keys=("k",)).collect():
        rows = sorted((x for x in data if x[1] == row["k"]), key=lambda x: (-x[3], x[0]))
        first = rows[: int(row["budget"] * len(rows) / 10_000)]
        assert (row["capacity"], row["alerts"], row["fraud_alerts"], row["n"]) == (len(first), len(first), sum(x[2] for x in first), len(rows))
        assert row["fraud_value_recall"] == pytest.approx(sum(x[2] * x[4] for x in first) / sum(x[2] * x[4] for x in rows), abs=1e-8)
        if first:
            last = first[-1][3]
            assert (row["boundary_score"], row["boundary_tie_n"], row["boundary_tie_selected_n"]) == (round(last, 9), sum(x[3] == last for x in rows), sum(x[3] == last for x in first))


def test_kept_tables_have_partitions_by_size(spark):
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning")}
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.optimizer.canChangeCachedPlanOutputPartitioning", "false")
    try:
        with order.kept(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count()) as rows:
            assert rows.count() == 100
            assert rows.rdd.getNumPartitions() < 10
            assert spark.conf.get("spark.sql.optimizer.canChangeCachedPlanOutputPartitioning") == "false"
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
