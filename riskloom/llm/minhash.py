"""Near-duplicate documents: MinHash bands for candidates, odd sketches to judge them, full shingle sets to confirm.

An odd sketch folds the MinHash samples of a set into a parity bitmap. The bits in which two bitmaps differ tell how
many samples differ, most precisely where few do: at the high similarities asked for here.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, materialise, mix, shingles, whole_groups
from .graph import components

ROWS, BANDS = 4, 20
#: Samples and bits of the sketch that all sets get, and of the finer one for members of buckets that hold several components.
#: A pair whose sketches estimate a similarity this far below the threshold is not confirmed: over five deviations of the estimate.
COARSE, FINE = (256, 512, 0.17), (2048, 4096, 0.055)
#: A block of a bucket that holds several components has about so many bytes of sets and sketches on either side.
BLOCK_BYTES = 8 << 20
SETS = "doc_id long, n long, fp binary, bands array<long>, sketch array<long>"


@lru_cache
def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint32)


def signature(items: np.ndarray, samples: int = COARSE[0]) -> np.ndarray:
    """MinHash samples of a set of 64-bit hashes."""
    a, b = _family(samples)
    x = (items >> np.uint64(32)).astype(np.uint32)
    out = np.full(samples, 0xFFFFFFFF, np.uint32)
    step = (1 << 18) // samples
    for i in range(0, len(x), step):
        np.minimum(out, (x[i : i + step, None] * a + b).min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    out = np.arange(BANDS, dtype=np.uint64)
    for row in sig[: BANDS * ROWS].reshape(BANDS, ROWS).T:
        out = mix(out ^ row.astype(np.uint64)) + np.uint64(7)
    return out.view(np.int64)


def odd_sketch(sig: np.ndarray, bits: int = COARSE[1]) -> np.ndarray:
    """Parity bitmap of the samples: each sets or clears the bit that its value and its place choose."""
    slots = mix(sig.astype(np.uint64) | (np.arange(len(sig), dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    return np.packbits((np.bincount(slots.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def most_differing_bits(similarity: float, samples: int, bits: int) -> int:
    """Expected differing bits of sketches of sets this similar."""
    return int(np.ceil(bits / 2 * (1 - (1 - 2 / bits) ** (2 * samples * (1 - similarity)))))


def fingerprint(items: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(items.tobytes())


def _sets(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for pdf in batches:
            rows = []
            for t in pdf["t"]:
                items = shingles(words.of(t), n)
                if len(items):
                    sig = signature(items)
                    rows.append((len(items), fingerprint(items), band_keys(sig), odd_sketch(sig)))
                else:
                    rows.append((0, None, None, None))
            yield pd.DataFrame(rows, columns=["n", "fp", "bands", "sketch"]).assign(doc_id=pdf["doc_id"].to_numpy())[["doc_id", "n", "fp", "bands", "sketch"]]

    return run


def _own(n: int):
    """Of rows (doc_id, t, fp), those whose text has the fingerprint; others share only the doc_id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for pdf in batches:
            own = [fingerprint(shingles(words.of(t), n)) == bytes(fp) for t, fp in zip(pdf["t"], pdf["fp"], strict=True)]
            yield pdf.loc[np.array(own, bool), ["fp", "t"]]

    return run


def _finer(n: int):
    """Finer sketch and full set of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for pdf in batches:
            sets = [shingles(words.of(t), n) for t in pdf["t"]]
            yield pd.DataFrame({"fp": pdf["fp"], "fine": [odd_sketch(signature(x, FINE[0]), FINE[1]).tobytes() for x in sets], "items": [x.tobytes() for x in sets]})

    return run


def _confirm(n: int, percent: int):
    """Pairs (a, b, ta, tb) of which the full shingle sets are alike enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, last = WordHashes(), {}

        def of(text: str, fp: bytes) -> np.ndarray:
            if fp not in last:
                if len(last) > 64:
                    last.clear()
                last[fp] = shingles(words.of(text), n)
            return last[fp]

        for pdf in batches:
            keep = []
            for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"], strict=True):
                x, y = of(ta, bytes(a)), of(tb, bytes(b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    return run


def _differ(a: str, b: str):
    return sum(F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(COARSE[1] // 64))


def joining_links(pdf: pd.DataFrame, limit: int, percent: int) -> list[tuple[bytes, bytes]]:
    """Confirmed links of a block that join two components, fewer than the block has members.

    Each open member asked (side 0) is held against the others (side 1) of other components whose finer sketch is
    within ``limit``, nearest first, on full sets; what is linked counts as one component from then on. Two open members
    meet where the one of the greater fingerprint is asked.
    """
    sketch = np.frombuffer(b"".join(pdf["fine"]), np.uint64).reshape(len(pdf), -1)
    items = [np.frombuffer(x, np.uint64) for x in pdf["items"]]
    size, fp, open_ = np.fromiter(map(len, items), np.int64, len(items)), pdf["fp"].to_numpy(), pdf["open"].to_numpy(bool)
    label, order = pd.factorize(pdf["root"])[0], np.array(list(fp), "S16")
    side = pdf["side"].to_numpy()
    other, out = np.flatnonzero(side == 1), []
    theirs = sketch[other]
    for m in np.flatnonzero(side == 0):
        apart = np.bitwise_count(theirs ^ sketch[m]).sum(axis=1)
        asked = (apart <= limit) & (~open_[other] | (order[other] < order[m]))
        near = other[asked][np.argsort(apart[asked], kind="stable")]
        for some in (near[:16], near[16:]):
            some = some[label[some] != label[m]]
            if not len(some):
                continue
            flat = np.concatenate([items[o] for o in some])
            met = items[m][np.minimum(np.searchsorted(items[m], flat), size[m] - 1)] == flat
            both = np.add.reduceat(met.astype(np.int64), np.cumsum(size[some]) - size[some])
            for o in some[100 * both >= percent * (size[m] + size[some] - both)]:
                if label[o] != label[m]:
                    out.append((fp[m], fp[o]))
                    label[label == label[o]] = label[m]
    return out


def _within_blocks(limit: int, percent: int):
    """Over rows sorted by (key, i, j), the block: its joining links."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ["key", "i", "j"]):
            key = pdf[["key", "i", "j"]].to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1), [True]]))
            out = [link for s, e in zip(edges[:-1], edges[1:], strict=True) for link in joining_links(pdf.iloc[s:e], limit, percent)]
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row: documents linked where 100 * |A & B| >= percent * |A | B|.

    Rows with equal sets are one class from the start. Representatives of classes meet in MinHash buckets (20 bands of
    4 rows: a pair at 0.85 is missed once in a million, at 0.8 once in 30,000). Each is first held against the hub of
    its buckets, the member that meets most others in all of its own; components follow. Where a bucket then still
    holds several components, members outside its largest one are held against all others, in blocks of bounded bytes,
    and a block gives only links that join components. So no bucket is expanded into its pairs, and no link that decides
    a component is lost.

    Null or empty texts and texts without words have no shingles: n_shingles 0, linked with nothing. A null doc_id is
    linked with nothing either: component_id null, kept true. Rows repeating a doc_id share its component if their
    texts are alike. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t"))
    sets = materialise(rows.mapInPandas(_sets(shingle), SETS), "sets")
    classes = sets.where("doc_id is not null and n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = materialise(classes, "classes")
    bands = classes.select("fp", "copies", F.explode("bands").alias("key"))
    company = bands.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    met = bands.join(company, "key").groupBy("fp").agg(F.sum("members").alias("met"), F.max("copies").alias("copies"), F.collect_list("key").alias("keys"))  # BANDS keys at most
    met = materialise(met.select("fp", "met", "copies", F.explode("keys").alias("key")), "met")  # members of buckets with company
    hubs = met.groupBy("key").agg(F.max(F.struct("met", "copies", "fp"))["fp"].alias("hub"))
    shared = materialise(met.join(hubs, "key").select("key", "fp", "hub"), "shared")
    asked = shared.select("fp").distinct().join(classes.select("fp", "least"), "fp")
    texts = sets.select("doc_id", "fp").join(asked, "fp").where("doc_id = least").select("doc_id", "fp").distinct()
    texts = materialise(rows.join(texts, "doc_id").mapInPandas(_own(shingle), "fp binary, t string").dropDuplicates(["fp"]), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that hold on full sets."""
        one, two = texts.select(F.col("fp").alias("a"), F.col("t").alias("ta")), texts.select(F.col("fp").alias("b"), F.col("t").alias("tb"))
        return materialise(pairs.join(one, "a").join(two, "b").mapInPandas(_confirm(shingle, percent), "a binary, b binary"), "links")

    def limit(samples: int, bits: int, slack: float) -> int:
        return most_differing_bits(percent / 100 - slack, samples, bits)

    sk = classes.select("fp", "sketch")
    first = shared.where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()
    first = first.join(sk.select(F.col("fp").alias("a"), F.col("sketch").alias("sa")), "a").join(sk.select(F.col("fp").alias("b"), F.col("sketch").alias("sb")), "b")
    roots = materialise(components(confirmed(first.where(_differ("sa", "sb") <= limit(*COARSE)).select("a", "b"))), "roots")
    member = shared.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    by_root = member.groupBy("key", "root").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.sum(F.xxhash64("root", "fp").cast("decimal(38,0)")).alias("y"))
    mixed = by_root.groupBy("key").agg(F.max_by("root", "n").alias("main"), F.count("*").alias("roots"), F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("y").alias("y")).where("roots > 1")
    member = materialise(member.join(mixed.dropDuplicates(["n", "x", "y"]).select("key", "main"), "key"), "mixed")  # buckets of the same members count once
    fine = texts.join(member.select("fp").distinct(), "fp").mapInPandas(_finer(shingle), "fp binary, fine binary, items binary")
    fine = materialise(fine.withColumn("bytes", F.octet_length("fine") + F.octet_length("items")), "fine")
    held = member.join(fine, "fp").withColumn("open", F.col("root") != F.col("main"))
    sizes = held.groupBy("key").agg(F.ceil(F.sum(F.when(F.col("open"), F.col("bytes"))) / BLOCK_BYTES).alias("minors"), F.ceil(F.sum("bytes") / BLOCK_BYTES).alias("blocks"))
    held, spot, zero = held.join(sizes, "key"), F.abs(F.hash("fp")).cast("long"), F.lit(0).cast("long")
    row = ["key", "i", "j", "side", "open", "fp", "root", "fine", "items"]
    asked = held.where("open").withColumn("i", spot % F.col("minors")).withColumn("j", F.explode(F.sequence(zero, F.col("blocks") - 1))).withColumn("side", F.lit(0))
    others = held.withColumn("i", F.explode(F.sequence(zero, F.col("minors") - 1))).withColumn("j", spot % F.col("blocks")).withColumn("side", F.lit(1))
    blocks = asked.select(*row).unionByName(others.select(*row)).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    links = materialise(blocks.mapInPandas(_within_blocks(limit(*FINE), percent), "a binary, b binary"), "links")
    if not links.isEmpty():
        roots = materialise(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links)), "roots")
    named = classes.select("fp", "least").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(lowest, "root").select("fp", "component_id")
    out = sets.select("doc_id", F.col("n").alias("n_shingles"), "fp").join(named, "fp", "left")
    own = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, percent=85)
