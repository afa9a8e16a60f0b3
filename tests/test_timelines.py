"""Time lines that are cut into ranges give what uncut ones and a plain count give."""

import random

from pyspark.sql import functions as F

from riskloom.operators import order, pit
from riskloom.plans import registry

MEASURES = {"n_short": ("count", None, 5), "n_long": ("count", None, 300), "total": ("sum", "amount", 300), "mean": ("mean", "amount", 40), "values": ("distinct", "v", 60), "long_values": ("distinct", "v", 900)}


def made(spark, n=600):
    r = random.Random(11)
    rows = [(i, "hot" if r.random() < 0.5 else r.choice([None, "a", "b"]), r.choice([None, *range(0, 2000)]) if r.random() < 0.9 else 77, r.choice([None, "x", "y", f"z{i % 40}"]), r.choice([None, float("nan"), -3.25, 0.1, 1e15 + 0.125, r.random()])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, k string, t long, v string, amount double")


def plain(rows, k, t):
    def past(back):
        return [] if t is None else [(v, a) for _, key, at, v, a in rows if key == k and at is not None and t - back <= at < t]

    def sums(back):
        got = [a for _, a in past(back) if a is not None and a == a]
        return sum(got) if got else None, sum(got) / len(got) if got else None

    return len(past(5)), len(past(300)), sums(300)[0], sums(40)[1], len({v for v, _ in past(60)} - {None}), len({v for v, _ in past(900)} - {None})


def test_ranges_of_time(spark, monkeypatch):
    rows, df = made(spark)
    want = {r[0]: plain(rows, r[1], r[2]) for r in rows}
    monkeypatch.setattr(pit, "PIECE", 30)
    assert order.large(spark.range(10**9).join(spark.range(5), "id")) and not order.large(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    for split in (False, True):
        got = pit.history(df, ["k"], "t", MEASURES, split=split).collect()
        assert len(got) == len(rows)
        for r in got:
            for a, b in zip((r[m] for m in MEASURES), want[r["id"]], strict=True):
                assert a == b or (a is not None and b is not None and abs(a - b) <= 1e-9 * max(1, abs(b))), (r, want[r["id"]])


def test_a_crowded_key_is_spread(spark, monkeypatch):
    """Half of all rows are one key's: no range of its time line holds more than a few of them."""
    monkeypatch.setattr(pit, "PIECE", 1000)
    df = spark.range(8000).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") * F.col("id") % 10_007).alias("t"))
    times = df.select("k", F.col("t").alias("_at")).distinct()
    cut = pit._ranged(times, pit._cut_points(times, ["k"]), ["k"]).withColumn("p", pit._piece(F.col("_at")))
    sizes = [r["count"] for r in cut.where("k = 'hot'").groupBy("p").count().collect()]
    assert len(sizes) > 200 and max(sizes) < 60 and cut.where("k <> 'hot' and p <> 0").count() == 0
    got = pit.history(df, ["k"], "t", {"n": ("count", None, 500)}, split=True)
    assert got.where("k = 'hot'").agg(F.sum("n")).first()[0] == pit.history(df, ["k"], "t", {"n": ("count", None, 500)}, split=False).where("k = 'hot'").agg(F.sum("n")).first()[0]


def test_cuts_are_the_same_however_rows_are_dealt(spark):
    """A plan may compute the cuts once for each use, and tasks end in any order: two versions of them would lose or repeat steps."""
    times = spark.range(300_000).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % 3_000_017).alias("_at"))
    cuts = [pit._cut_points(df, ["k"]).first()["_cuts"] for df in (times, times.orderBy(F.desc("_at")).coalesce(3), times.repartition(7, F.xxhash64("_at")))]
    assert cuts[0] == cuts[1] == cuts[2] and cuts[0] == sorted(cuts[0]) and len(cuts[0]) == pit.PARTS - 1
    edges = [0, *cuts[0], 3_000_017]
    assert max(b - a for a, b in zip(edges, edges[1:])) < 4 * 3_000_017 / pit.PARTS


def test_rows_that_take_part_in_the_line(spark, monkeypatch):
    """What ``history`` gives, crowded keys and values included, with rows moved once."""
    rows, df = made(spark)
    want = {r[0]: plain(rows, r[1], r[2]) for r in rows}
    for piece in (1 << 16, 30):
        monkeypatch.setattr(pit, "PIECE", piece)
        cuts, values = pit.crowds(df.withColumn("_at", F.col("t")), [["k"], ["k", "v"]])
        assert (cuts is None) == (piece > 30) and (cuts is None or "hot" in {r["k"] for r in cuts.collect()})
        for ranged in {False, values is not None}:
            found = pit.followed(df, ["k"], "t", MEASURES, df, cuts, ranged)
            assert found.columns == [*df.columns, *MEASURES]
            got = found.collect()
            assert len(got) == len(rows)
            for r in got:
                for a, b in zip((r[m] for m in MEASURES), want[r["id"]], strict=True):
                    assert a == b or (a is not None and b is not None and abs(a - b) <= 1e-9 * max(1, abs(b))), (piece, ranged, r, want[r["id"]])


def test_payment_features_move_rows_once_a_key(spark):
    """Disk fails first: rows are moved by sender, recipient and device, and no copy of them is joined back."""
    d = "/root/testdata/sf0.001"
    df = pit.payment_features(registry.tx(spark, d))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count(" Exchange hashpartitioning") == 3 and "Join" not in plan
