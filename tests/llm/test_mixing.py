"""Mixing against a running total over sorted rows, and on awkward tables."""

import hashlib
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from riskloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, taken string, rank int"
LONG = " ".join(f"w{i}" for i in range(20_000))


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def expected(rows, share=1):
    """Copies of each (doc_id, text, source) by sorting each source's documents."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    wanted, out = mixing.targets(sizes, share=share), []
    for source, target in wanted.items():
        whole = min(3, int(target // sizes[source])) if sizes[source] else 0
        left = target - whole * sizes[source]
        key = lambda r: hashlib.md5(f"{'null' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest()[:15]
        for r in sorted((r for r in rows if r[2] == source), key=key):
            n = size(r[1])
            more = n > 0 and left > 0 and 2 * left >= n
            left = left - n if more else 0
            out.append((*r, whole + more))
    return sorted(out, key=str)


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, None: 100}) == {"a": 50.0, "b": 100.0, None: 150.0}
    assert mixing.targets({"a": 900, "b": 10, "c": 10}) == {"a": 860.0, "b": 30.0, "c": 30.0}
    assert mixing.targets({"b": 0, "a": 0}) == {"a": 0.0, "b": 0.0} and mixing.targets({}) == {}
    assert sum(mixing.targets({f"s{i}": i * i for i in range(40)}).values()) == pytest.approx(sum(i * i for i in range(40)))


def test_same_as_sorting(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    got = mixing.mix(docs, (Fraction(1, 4), 1), with_text=True)
    assert set(docs.columns) < set(got.columns)
    got = got.select("doc_id", "text", "source", "_copies").collect()
    for i, share in enumerate((Fraction(1, 4), 1)):
        assert sorted(((r["doc_id"], r["text"], r["source"], r["_copies"][i]) for r in got), key=str) == expected(rows, share)
    assert all(r["_copies"][0] <= r["_copies"][1] <= 3 for r in got)  # nested


def test_awkward(spark):
    """Null columns, empty and very long texts, ids and texts repeated, columns with names of the result."""
    rows = [(i % 7 if i % 5 else None, None if i % 11 == 0 else " ".join(["x"] * (i % 13)), None if i % 4 == 0 else f"s{i % 3}") for i in range(400)] + [(1, LONG, "s1"), (2, "", "empty")]
    docs = spark.createDataFrame([(*r, "keep", 3) for r in rows], SCHEMA)
    got = mixing.mix(docs, with_text=True)
    by = got.groupBy("source").agg(F.sum(F.col("_size") * F.col("_copies")[0]).alias("taken"), F.first(F.col("_targets")[0]).alias("target"), F.first("_source_size").alias("size")).collect()
    assert sum(r["size"] for r in by) == sum(size(t) for _, t, _ in rows)
    assert all(abs(r["taken"] - r["target"]) <= (10_000 if r["source"] == "s1" else 6) for r in by)
    assert got.where("taken <> 'keep' or rank <> 3").count() == 0 and got.count() == len(rows)
    once = sorted((str(r["doc_id"]), r["text"] or "", r["source"] or "", r["_copies"][0]) for r in got.collect())
    assert once == sorted((str(r["doc_id"]), r["text"] or "", r["source"] or "", r["_copies"][0]) for r in mixing.mix(docs, with_text=True).collect())


def test_a_group_of_equal_rows_is_split(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 1000, "a").otherwise("b").alias("source"))
    got = mixing.mix(docs.repartition(5)).groupBy("source").agg(F.sum(F.col("_size") * F.col("_copies")[0]).alias("n")).collect()
    assert {r["source"]: r["n"] for r in got} == {"a": 3000, "b": 6000}


def test_empty_and_wrong(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(docs).count() == 0
    for wrong in (lambda: mixing.mix(docs.withColumn("_h", F.lit(1))), lambda: mixing.mix(docs, (2,)), lambda: mixing.mix(docs, ())):
        with pytest.raises(ValueError):
            wrong()
