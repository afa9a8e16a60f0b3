"""Nearest neighbours by largest inner product: multi-index hashing over learned rotated binary codes.

Vectors are brought to one length by an added component, so that the largest inner product is the smallest angle.
Rotations learned by alternating sign codes and orthogonal fits give 64 bits each. A code is split into bytes, each
with an index of its own: the codes near a value in that byte. By the pigeonhole principle a code within the radius is
near the query's in at least one byte, so the union of the bytes' lists holds every code within the radius; those are
reranked by inner products of the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

ROTATIONS = 4
#: The rotations and the radius are learned from at most so many vectors, those of least hash.
SAMPLE = 8192
#: The radius holds all k true neighbours of this share of the sample's queries, each different vector counted once.
ALL_FOUND = 0.9
#: Vectors indexed at a time, queries broadcast at a time, and queries that a task looks at together.
CHUNK, BLOCK, ASKED = 8192, 4096, 128


class Codes:
    def __init__(self, sample: np.ndarray, longest: float, k: int, seed: int = 11):
        self.longest, r = max(longest, 1e-300), np.random.default_rng(seed)
        x = self.lifted(sample)
        self.rotations = []
        for _ in range(ROTATIONS):
            basis = np.linalg.qr(r.normal(size=(x.shape[1], x.shape[1])))[0]
            p = basis if x.shape[1] <= 64 else basis[:, :64]
            p = np.concatenate([p] * -(-64 // p.shape[1]), axis=1)[:, :64]
            v, rot = x @ p, np.linalg.qr(r.normal(size=(64, 64)))[0]
            for _ in range(8):
                u, _, w = np.linalg.svd(v.T @ np.where(v @ rot >= 0, 1.0, -1.0))
                rot = u @ w
            self.rotations.append(p @ rot)
        x = np.unique(x, axis=0)  # copies of one vector must not stand for many queries
        codes, need = self.of(x), []
        for a in range(0, len(x), max(1, len(x) // 400)):
            near = _top(np.delete(x @ x[a], a), np.delete(np.arange(len(x)), a), k)
            need.append(int(np.bitwise_count(codes[near] ^ codes[a]).sum(axis=1).max(initial=0)))
        self.radius = int(np.quantile(need, ALL_FOUND)) if len(x) > 1 else 64 * ROTATIONS

    def lifted(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        if query:
            return np.concatenate([v / norm, np.zeros_like(norm)], axis=1)
        return np.concatenate([v / self.longest, np.sqrt(np.maximum(0, 1 - (norm / self.longest) ** 2))], axis=1)

    def of(self, lifted: np.ndarray) -> np.ndarray:
        """Codes as ROTATIONS 64-bit integers."""
        return np.concatenate([np.packbits(lifted @ r >= 0, axis=1).view(np.uint64) for r in self.rotations], axis=1)


class Index:
    """For each byte of the codes and each value, a bitmap of the codes near the value in that byte."""

    def __init__(self, codes: np.ndarray, radius: int):
        self.columns, self.radius, m = np.ascontiguousarray(codes.T), radius, codes.shape[1] * 8
        parts = np.ascontiguousarray(codes).view(np.uint8).reshape(len(codes), m)
        each = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)) <= radius // m
        self.lists = np.stack([np.packbits(each[:, parts[:, j]], axis=1) for j in range(m)])

    def within(self, code: np.ndarray) -> np.ndarray:
        """Places of all codes within the radius."""
        parts = code.view(np.uint8)
        some = np.bitwise_or.reduce(self.lists[np.arange(len(parts)), parts], axis=0)
        at = np.flatnonzero(np.unpackbits(some, count=self.columns.shape[1]))
        far = np.zeros(len(at), np.uint16)
        for column, c in zip(self.columns, code, strict=True):
            far += np.bitwise_count(column[at] ^ c)
        return at[far <= self.radius]


def inner(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Products summed in one order for each row, so that equal vectors score equal."""
    return (v * q).sum(axis=1)


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def _may_lead(product: np.ndarray, slack: np.ndarray, floor: np.ndarray, k: int) -> np.ndarray:
    """Which of each row's products may be among its k largest and not below ``floor``, which rises to the k-th; -inf takes no part. What a product can't tell (overflow) stays."""
    plain = np.where(np.isfinite(product), product, -np.inf)
    if plain.shape[1] >= k:
        np.maximum(floor, np.partition(plain, -k, axis=1)[:, -k] - slack, out=floor)
    return ((plain >= floor[:, None] - slack[:, None]) & (plain > -np.inf)) | np.isnan(product) | (product == np.inf)


def _search(shared, k: int, dims: int, exact: bool):
    """Nearest of each query within each chunk of vectors. Matrix products say which rows may be among the k nearest of their chunk, and of those before it in the task; only these are scored one by one and ordered."""

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids, vecs = [], []
        for pdf in batches:
            if len(pdf):
                ids.append(pdf["vec_id"].to_numpy(np.int64))
                vecs.append(np.stack(pdf["v"].to_numpy()).astype(np.float64))
            if sum(map(len, ids)) >= CHUNK:
                yield np.concatenate(ids), np.concatenate(vecs)
                ids, vecs = [], []
        if ids:
            yield np.concatenate(ids), np.concatenate(vecs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, qids, q = shared.value
        asked = codes.of(codes.lifted(q, query=True))
        floor, lengths = np.full(len(qids), -np.inf), np.linalg.norm(q, axis=1)
        for ids, vecs in chunks(batches):
            index = None if exact else Index(codes.of(codes.lifted(vecs)), codes.radius)
            slack = 1e-9 * lengths * np.linalg.norm(vecs, axis=1).max()  # far more than sums in another order differ by
            for a in range(0, len(qids), ASKED):
                some = slice(a, a + ASKED)
                product = q[some] @ vecs.T
                for i, code in enumerate([] if exact else asked[some]):
                    beyond = np.ones(len(ids), bool)
                    beyond[index.within(code)] = False
                    product[i, beyond] = -np.inf
                product[qids[some][:, None] == ids] = -np.inf
                of, at = np.nonzero(_may_lead(product, slack[some], floor[some], k))
                s = inner(q[some][of], vecs[at])
                order = np.lexsort((ids[at], -s, of))
                order = order[np.arange(len(of)) - np.searchsorted(of, of) < k]  # np.nonzero goes by rows, so ``of`` is in order
                yield pd.DataFrame({"query_id": qids[some][of[order]], "vec_id": ids[at[order]], "score": s[order]})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of ``vectors`` (vec_id, embedding) for each of ``queries``, without rows of the query's own id.

    Every vector is indexed; rotations and radius are learned from at most SAMPLE vectors, and the radius holds all true
    neighbours of ALL_FOUND of them. Queries are taken in blocks of BLOCK, each broadcast (a few MB) for one pass over the
    vectors. A query that finds fewer than k within the radius is searched again against all vectors. Null ids and
    vectors that are null, empty, zero, or hold null or non-finite components, and those of another length than the
    first by id, take no part. Rows repeating a vec_id count once each among the neighbours of others.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0))

    rows = usable(vectors)
    first = rows.agg(F.min(F.struct("vec_id", F.size("v").alias("n")))["n"], F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    schema = "query_id long, vec_id long, score double"
    if first[0] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, longest = first[0], float(np.sqrt(first[1]))
    rows = rows.where(F.size("v") == dims)
    asked = usable(queries).where(F.size("v") == dims)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    codes = Codes(np.stack(sample["v"].to_numpy()), longest, k)
    n, distinct = rows.count(), rows.select("vec_id").distinct().count()

    def passes(asked: DataFrame, exact: bool) -> DataFrame:
        total = asked.count()
        blocks = -(-total // BLOCK) or 1
        found = None
        for b in range(blocks):
            pdf = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).dropDuplicates(["vec_id"]).toPandas()
            if not len(pdf):
                continue
            shared = spark.sparkContext.broadcast((codes, pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["v"].to_numpy())))
            part = rows.mapInPandas(_search(shared, k, dims, exact), schema)
            found = part if found is None else found.unionByName(part)
        if found is None:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return materialise(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")

    found = passes(asked, False)
    need = min(k, n - 1)
    short = asked.join(found.groupBy("query_id").count().where(F.col("count") >= need).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    short = materialise(short, "short")
    if not short.isEmpty() and distinct > 1:
        found = found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(passes(short, True))
    return found


def op8_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.where("vec_id % 20 = 0"))
