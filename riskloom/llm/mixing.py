"""Mixing sources to target weights: whole documents drawn by the threshold of a hash, found in histograms, never by a sort.

A document's place is a 60-bit hash of its id and text. Words are summed by source and hash bucket; the bucket in which a
source's running total meets its budget is the only one that is looked into again, bits by bits, until it holds one
document. Every document below the threshold is taken, so the draw of a smaller budget is part of that of a larger one.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

WEIGHTS = (1, 2, 3)
#: A source's documents are repeated so often at most.
REPEATS = 3
#: Bits of the hash and of a row's number, which tells rows of one hash apart, and bits that one pass resolves.
HASH_BITS, ROW_BITS, STEP = 60, 63, 12
#: More sources than this are an error: totals of sources are read by the driver and their thresholds are broadcast.
SOURCES = 100_000


def words(text: str | Column) -> Column:
    """Number of runs of characters other than space and control white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, share: Fraction | int = 1) -> dict[str | None, float]:
    """Words that each source gives to a mix of ``share`` times all words.

    Sources by code point, null last, weigh ``weights`` in turn. A target stops at ``repeats`` times its source's words,
    and the excess goes to the others by weight until none is above. Comparisons are exact; the result is the nearest
    double of (words * weight) / weights, or the bound itself.
    """
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = Fraction(share) * sum(sizes.values()), list(order), {}
    while free:
        total = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] > repeats * sizes[s] * total]
        if not above:
            out |= {s: float(left) * weight[s] / total for s in free}
            break
        for s in above:
            out[s] = float(repeats * sizes[s])
            left -= repeats * sizes[s]
        free = [s for s in free if s not in out]
    return out


def _digit(level: int) -> Column:
    """Bits of a row's place that pass number ``level`` looks at: first those of the hash, then those of the row's number."""
    hashes = HASH_BITS // STEP
    if level < hashes:
        return F.shiftright("_h", HASH_BITS - STEP * (level + 1)).bitwiseAND((1 << STEP) - 1)
    return F.shiftrightunsigned("_n", max(0, ROW_BITS - STEP * (level - hashes + 1))).bitwiseAND((1 << STEP) - 1)


LEVELS = HASH_BITS // STEP + -(-ROW_BITS // STEP)


def thresholds(rows: DataFrame, budgets: list[tuple[str | None, int, float]]) -> dict[tuple[str | None, int], tuple[int, int] | None]:
    """For each (source, number of the budget, words): the last (hash, row number) that is taken, or None for none.

    ``rows`` has _source, _size, _h and _n. Each pass sums sizes by source and the next bits within the buckets that hold
    a boundary, a few thousand sums for each, and gives one bucket for each budget. The document at the boundary is taken
    if the total comes nearer to the budget by it.
    """
    spark, found = rows.sparkSession, {}
    at = [(s, b, float(left), 0, 0) for s, b, left in budgets]  # source, budget, words left, bits of the hash and of the row number so far
    for level in range(LEVELS):
        if not at:
            break
        edges = F.broadcast(spark.createDataFrame(at, "_e_source string, _budget int, _left double, _e_h long, _e_n long"))  # a row for each source and budget
        inside = F.col("_source").eqNullSafe(F.col("_e_source"))
        hashed = min(HASH_BITS, STEP * level)
        if hashed:
            inside &= F.shiftright("_h", HASH_BITS - hashed) == F.col("_e_h")
        numbered = min(ROW_BITS, max(0, STEP * level - HASH_BITS))
        if numbered:
            inside &= F.shiftrightunsigned("_n", ROW_BITS - numbered) == F.col("_e_n")
        sums = rows.where("_size > 0").join(edges, inside).groupBy("_source", "_budget", "_left", "_e_h", "_e_n", _digit(level).alias("_d")).agg(F.sum("_size").alias("_s"), F.count("*").alias("_c"), F.max("_h").alias("_mh"), F.max("_n").alias("_mn"))
        upto = F.sum("_s").over(Window.partitionBy("_source", "_budget").orderBy("_d").rowsBetween(Window.unboundedPreceding, 0))  # 2^STEP sums at most
        met = sums.withColumn("_before", upto - F.col("_s")).where((F.col("_left") >= F.col("_before")) & (F.col("_left") < F.col("_before") + F.col("_s")))
        at = []
        for r in met.collect():
            source, budget, left = r["_source"], r["_budget"], r["_left"] - r["_before"]
            if r["_c"] == 1:
                last = (r["_mh"], r["_mn"])
                found[source, budget] = last if 2 * left >= r["_s"] else (last[0], last[1] - 1)
            else:
                h = (r["_e_h"] << STEP) | r["_d"] if level < HASH_BITS // STEP else r["_e_h"]
                bits = min(STEP, ROW_BITS - numbered)
                n = r["_e_n"] if level < HASH_BITS // STEP else (r["_e_n"] << bits) | (r["_d"] & ((1 << bits) - 1))
                at.append((source, budget, left, h, n))
    return found


def mix(docs: DataFrame, shares: tuple[Fraction | int, ...] = (1,), weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, with_text: bool = False) -> DataFrame:
    """``docs``, with or without their text, and beside them _size, _source_size, and arrays _targets and _copies with a place for each share of all words.

    A document is taken 0 to ``repeats`` times; its hash says which documents get one time more than others of their
    source. The place needs doc_id and text alone, so reruns agree; rows equal in both are told apart by their number
    and may change places with each other. Null texts have size 0, null sources are a source of their own, null ids
    count as the word null. Columns of ``docs`` keep their values; any of the four new names, or of the helpers _h, _n,
    _source, among them is an error. One scan of the texts; all else runs over
    the table written in it.
    """
    taken = {"_size", "_source_size", "_targets", "_copies", "_h", "_n", "_source"} & set(docs.columns)
    if taken:
        raise ValueError(f"columns in the way: {sorted(taken)}")
    if not shares or any(not 0 <= s <= 1 for s in shares) or repeats < 1 or any(w <= 0 for w in weights):
        raise ValueError("shares within 0 and 1, positive weights and repeats are needed")
    spark = docs.sparkSession
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col("text"), F.lit(""))))
    rows = docs.select(*(c for c in docs.columns if with_text or c != "text"), words("text").alias("_size"), F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long").alias("_h"), F.monotonically_increasing_id().alias("_n"), F.col("source").cast("string").alias("_source"))
    rows = materialise(rows, "mix")
    found = rows.groupBy("_source").agg(F.sum("_size").alias("s")).limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    sizes = {r["_source"]: r["s"] for r in found}
    wanted = [targets(sizes, weights, repeats, s) for s in shares]
    whole, budgets = {}, []
    for b, t in enumerate(wanted):
        for s, target in t.items():
            whole[s, b] = min(repeats, int(target // sizes[s])) if sizes[s] else 0
            left = target - whole[s, b] * sizes[s]
            if 0 < left < sizes[s]:
                budgets.append((s, b, left))
    last = thresholds(rows, budgets)
    plan = [(s, n, [t[s] for t in wanted], [whole[s, b] for b in range(len(shares))], [last.get((s, b), (-1, -1))[0] for b in range(len(shares))], [last.get((s, b), (-1, -1))[1] for b in range(len(shares))]) for s, n in sizes.items()]
    plan = spark.createDataFrame(plan, "_p_source string, _source_size long, _targets array<double>, _whole array<int>, _th array<long>, _tn array<long>")
    below = lambda i: (F.col("_h") < F.col("_th")[i]) | ((F.col("_h") == F.col("_th")[i]) & (F.col("_n") <= F.col("_tn")[i]))
    copies = F.array(*(F.col("_whole")[i] + below(i).cast("int") for i in range(len(shares))))
    return rows.join(F.broadcast(plan), F.col("_source").eqNullSafe(F.col("_p_source"))).withColumn("_copies", copies).drop("_p_source", "_whole", "_th", "_tn", "_h", "_n", "_source")  # a row for each source


def op11_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_targets")[0].alias("target"), (F.col("_size") * F.col("_copies")[0]).alias("taken"))


ORACLE = r"""WITH d AS (SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, substr(md5(concat(COALESCE(CAST(doc_id AS VARCHAR), 'null'), ':', COALESCE(text, ''))), 1, 15) AS h FROM documents),
s AS (SELECT source, CAST(SUM(size) AS HUGEINT) AS n, CAST(1 + (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS HUGEINT) AS w FROM d GROUP BY source),
c AS (SELECT *, SUM(n) OVER () AS total, 3 * (SUM(n) OVER o - n) AS capped, SUM(w) OVER () - (SUM(w) OVER o - w) AS free FROM s WINDOW o AS (ORDER BY 6 * n // w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, (total - capped) * w > 3 * n * free AS above FROM c),
t AS (SELECT source, n, CASE WHEN above THEN CAST(3 * n AS DOUBLE) ELSE CAST(total - (SELECT COALESCE(SUM(3 * n), 0) FROM k WHERE above) AS DOUBLE) * CAST(w AS DOUBLE) / CAST((SELECT SUM(w) FROM k WHERE NOT above) AS DOUBLE) END AS target FROM k),
q AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE LEAST(3, CAST(FLOOR(target / n) AS BIGINT)) END AS whole FROM t),
r AS (SELECT d.doc_id, d.size, q.n, q.target, q.whole, q.target - q.whole * q.n AS budget, COALESCE(SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target, CAST(size * (whole + CASE WHEN size > 0 AND budget > past AND (past + size <= budget OR 2 * (budget - past) >= size) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r"""
