"""Language-model scoring with a probabilistic suffix tree over the words of a text.

A text is read as its lower-cased words and an end mark. The root is the smoothed word count; a state is the word, or the
two words, before. Counts come from all training texts; a next word seen once after a context isn't kept, its count goes
to the words that the suffix foretells. A context is retained if its distribution diverges from that of its longest
retained suffix, and each distribution is smoothed by the suffix's. A word is scored in the longest retained suffix of
what precedes it.

Since back-off multiplies, the log probability of a text is a sum of values looked up one by one: of its words, its pairs
and its triples of words. The tree grows with the corpus and stays in tables. Values of the most frequent words and grams
are broadcast; the other words and grams of many texts go together, packed, to the range of hashes that holds theirs, and
a task for each range sends back one sum a text. A bitmap of hash prefixes, of one size whatever the input, spares this
most grams that aren't in the tree; it never hides one that is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, WordHashes, drop, freed_shuffles, materialise

#: A next word must follow a context so often, whatever the size of the input, to be kept there.
LEAST = 2
#: Least divergence, in nats, between a context's and its suffix's next-word distributions, times the context's count.
GAIN = 3.0
#: Weight of the suffix's distribution, in observations.
PRIOR = 0.5
#: So many of the most frequent words are scored from a broadcast table; the rest are joined.
FREQUENT = 1 << 18
#: At most so many of the most frequent grams are scored from a broadcast table; the rest are joined.
FREQUENT_GRAMS = 1 << 20
#: About so many rows of the tables of words and grams are held by a task that scores what isn't broadcast.
RANGE = 1 << 20
#: Bits of a hash that place a gram in the bitmap (16 MB).
PREFIX = 27
#: Words are 64-bit hashes; these stand for the root, and for what is before and after a text.
ROOT, START, END = 0, 1, 2
#: Tokens handled at once; a text is never split.
BATCH = 1 << 19
GRAM = "c long, w long, n long"


def canonical(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _rotate(column: str, by: int):
    return F.shiftleft(column, by).bitwiseOR(F.shiftrightunsigned(column, 64 - by))


def pairs(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token, and the hash of both."""
    before = np.roll(words, 1)
    before[first] = START
    return before, _rotated(before, 17) ^ words


def triples(pair: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of all tokens but the first of a text, the pair that ends before each, and the hash of it and the pair that ends there."""
    at = np.setdiff1d(np.arange(len(pair)), first, assume_unique=True)
    return at, pair[at - 1], _rotated(pair[at - 1], 41) ^ pair[at]


def _batches(frames: Iterator[pd.DataFrame], most: int = BATCH) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Rows of whole texts with their words, ends included, and where each text starts; ``most`` tokens or one more text at a time."""
    hashes = WordHashes()
    for pdf in frames:
        held, size, start = [], 0, 0
        for i, t in enumerate(pdf["t"]):
            words = canonical(t)
            held.append(np.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), np.uint64(END)))
            size += len(words) + 1
            if size >= most or i == len(pdf) - 1:
                sizes = np.fromiter(map(len, held), np.int64, len(held))
                yield pdf.iloc[start : i + 1], np.concatenate(held), np.cumsum(sizes) - sizes
                held, size, start = [], 0, i + 1


def _counted(c: np.ndarray, w: np.ndarray, key: np.ndarray) -> pd.DataFrame:
    _, at, n = np.unique(key, return_index=True, return_counts=True)
    return pd.DataFrame({"c": c[at].view(np.int64), "w": w[at].view(np.int64), "n": n})


def _count_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for _, w, first in _batches(frames, 2 * BATCH):
        yield _counted(np.full(len(w), ROOT, np.uint64), w, w)
        before, pair = pairs(w, first)
        yield _counted(before, w, pair)


def _count_triples(kept):
    """Counts of (pair before, pair) where both pairs may be kept: a triple is never more frequent than its pairs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, w, first in _batches(frames, 2 * BATCH):
            pair = pairs(w, first)[1]
            at, before, triple = triples(pair, first)
            met = may_hold(kept.value, pair)
            both = np.flatnonzero(met[at] & met[at - 1])
            yield _counted(before[both], pair[at[both]], triple[both])

    return run


def bitmap(ids: DataFrame) -> np.ndarray:
    """Bits of the hash prefixes that occur in column ``id``: 2^PREFIX bits, made by Spark word by word."""
    place = F.shiftrightunsigned("id", 64 - PREFIX)
    bits = ids.select(F.shiftrightunsigned(place, 6).cast("int").alias("k"), place.bitwiseAND(63).cast("int").alias("at")).selectExpr("k", "shiftleft(1L, at) as b")
    with freed_shuffles(ids.sparkSession):
        got = bits.groupBy("k").agg(F.bit_or("b").alias("b")).toArrow().to_pandas()
    out = np.zeros(1 << (PREFIX - 6), np.uint64)
    out[got["k"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).view(np.uint64)
    return out


def may_hold(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """False only for ids that the bitmap's table lacks."""
    at = ids >> np.uint64(64 - PREFIX)
    return ((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def count(train: DataFrame, mapper, name: str) -> DataFrame:
    """(c, w, n): how often w follows c, where it does so LEAST times; all words after the root."""
    found = train.mapInPandas(mapper, GRAM).groupBy("c", "w").agg(F.sum("n").alias("n"))
    return materialise(found.where((F.col("n") >= LEAST) | (F.col("c") == ROOT)), name)


def level(grams: DataFrame, suffix: DataFrame, contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From grams (c, w, id, n), suffix (w, q) with q the suffix's probability, and contexts (c, of): retained contexts (c, backed), and all grams (id, n, p, e).

    ``backed``: log10 weight of the suffix's distribution. ``p``: probability in the longest retained suffix. ``e``: log10
    of what a gram's probability is beyond backed * q; 0 in contexts that aren't retained.
    """
    over = Window.partitionBy("c")  # a context's kept words; both joins and the sums over it shuffle a gram twice in all
    known = grams.join(suffix, "w").join(contexts, "c").withColumn("left", F.col("of") - F.sum("n").over(over))
    back = (F.col("left") + PRIOR) / (F.col("of") + PRIOR)
    own = F.col("n") / (F.col("of") + PRIOR) + back * F.col("q")
    known = known.select("c", "id", "n", "q", "left", back.alias("back"), own.alias("own"))
    known = known.withColumn("gain", F.sum(F.col("n") * F.log(F.col("own") / F.col("q"))).over(over) + F.col("left") * F.log("back"))
    of_state = F.col("gain") >= GAIN
    p, e = F.when(of_state, F.col("own")).otherwise(F.col("q")), F.when(of_state, F.log10(F.col("own") / F.col("q")) - F.log10("back")).otherwise(0.0)
    out = materialise(known.select("c", "id", "n", p.alias("p"), e.alias("e"), F.when(of_state, F.log10("back")).alias("backed")), "grams")
    states = materialise(out.where("backed is not null").groupBy("c").agg(F.first("backed").alias("backed")), "states")
    return states, out.select("id", "n", "p", "e")


def fit(train: DataFrame) -> tuple[DataFrame, DataFrame, int, int, float]:
    """The tree of the texts in column ``t``: words (w, n, backed), grams (id, n, v), tokens, distinct tokens, and the value of a text's start.

    ``backed`` of a word and what a gram's ``v`` holds for it as a context are 0 where that context isn't retained.
    """
    sc = train.sparkSession.sparkContext
    counted = count(train, _count_pairs, "pairs")
    words = counted.where(F.col("c") == ROOT).select("w", "n")
    n_all, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    root = words.select("w", ((F.col("n") + 0.1) / (n_all + 0.1 * (distinct + 1))).alias("q"))
    two = counted.where(F.col("c") != ROOT).withColumn("id", _rotate("c", 17).bitwiseXOR(F.col("w")))
    # nothing follows an end, and each text has a start and an end
    before = words.select(F.when(F.col("w") == END, F.lit(START).cast("long")).otherwise(F.col("w")).alias("c"), F.col("n").alias("of"))
    first_states, first = level(two, root, before)
    start = first_states.where(F.col("c") == START).first()
    words = materialise(words.join(first_states.withColumnRenamed("c", "w"), "w", "left").select("w", "n", F.coalesce("backed", F.lit(0.0)).alias("backed")), "words")
    drop(counted, first_states)
    counted = count(train, _count_triples(sc.broadcast(bitmap(first))), "triples")
    three = counted.withColumn("id", _rotate("c", 41).bitwiseXOR(F.col("w")))
    second_states, second = level(three, first.select(F.col("id").alias("w"), F.col("p").alias("q")), first.select(F.col("id").alias("c"), F.col("n").alias("of")))
    drop(counted)
    values = first.join(second_states.withColumnRenamed("c", "id"), "id", "left").select("id", "n", (F.col("e") + F.coalesce("backed", F.lit(0.0))).alias("v")).unionByName(second.select("id", "n", F.col("e").alias("v")))
    values = materialise(values.where("v != 0"), "values")
    drop(first, second_states, second)
    return words, values, n_all, distinct, start["backed"] if start else 0.0


def most_frequent(table: DataFrame, most: int) -> pd.DataFrame:
    """The most frequent rows, ``most`` of them at most, cut where counts fall by a sixteenth of a doubling; without a sort."""
    of = F.floor(16 * F.log2("n")).cast("int")
    held, cut = 0, 1 << 30
    for r in table.groupBy(of.alias("b")).count().orderBy(F.desc("b")).collect():
        held += r["count"]
        if held > most:
            break
        cut = r["b"]
    return table.where(of >= cut).toArrow().to_pandas()


def _sorted(table: pd.DataFrame, key: str, *columns: str) -> tuple[np.ndarray, ...]:
    ids = table[key].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(ids)
    return ids[order], *(table[c].to_numpy(np.float64)[order] for c in columns)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys if len(table) else np.zeros(len(keys), bool)


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers byte by byte, the lowest bytes of all first: what is zero in all of them is packed well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplaned(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind)[:, 0]


def _range(ids: np.ndarray, ranges: int) -> np.ndarray:
    return ((ids >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)


def _range_of(column: str, ranges: int):
    return F.shiftrightunsigned(F.shiftrightunsigned(column, 32) * F.lit(ranges), 32).cast("int")


#: Texts that are read together: kind 0 has what is known of them so far (doc_ids, whether these aren't null, and four sums); 1 and 2 their words and grams that the broadcast tables lack, in a range of hashes. ``row`` is the first text's.
PACKED = "range int, kind int, row long, ids binary, of binary, sums binary"
SUMMED = "row long, kind int, ids binary, of binary, sums binary"
SCORED = "doc_id long, n_tokens long, n_known long, base double, score double"


def _score(frequent, n_all: int, distinct: int, start: float, ranges: int):
    """Texts to PACKED."""

    def lacking(kind: int, row: int, owner: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(ids)
        ids, owner = ids[order], owner[order].astype(np.uint32)
        held, cut = np.unique(_range(ids, ranges), return_index=True)
        for r, a, b in zip(held.tolist(), cut.tolist(), [*cut[1:].tolist(), len(ids)], strict=True):
            yield r, kind, row, _planes(np.diff(ids[a:b], prepend=np.uint64(0))), _planes(owner[a:b]), None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (common, counts, backed), (held, values), bits = frequent.value
        log_counts, log_all = np.log10(counts + 0.1), np.log10(n_all + 0.1 * (distinct + 1))
        for pdf, w, first in _batches(frames):
            row, sizes = int(pdf["row"].iloc[0]), np.diff(np.append(first, len(w)))  # rows are numbered one by one
            owner = np.repeat(np.arange(len(pdf)), sizes)
            at, found = _find(common, w)
            base = np.bincount(owner[found], log_counts[at[found]], len(pdf)) - sizes * log_all
            known = np.bincount(owner[found], minlength=len(pdf))
            score = base + np.bincount(owner[found], backed[at[found]], len(pdf)) + start
            out = [*lacking(1, row, owner[~found], w[~found])] if not found.all() else []
            pair = pairs(w, first)[1]
            later, _, triple = triples(pair, first)
            rest = []
            for ids, of in ((pair, owner), (triple, owner[later])):
                met = np.flatnonzero(may_hold(bits, ids))
                ids, of = ids[met], of[met]
                at, found = _find(held, ids)
                score += np.bincount(of[found], values[at[found]], len(pdf))
                rest.append((of[~found], ids[~found]))
            of, ids = map(np.concatenate, zip(*rest, strict=True))
            out += [*lacking(2, row, of, ids)] if len(ids) else []
            out.append((row % ranges, 0, row, pdf["doc_id"].to_numpy(np.int64).tobytes(), pdf["has_id"].to_numpy(bool).tobytes(), np.stack([sizes.astype(float), known, base, score]).tobytes()))
            yield pd.DataFrame(out, columns=["range", "kind", "row", "ids", "of", "sums"])

    return run


def _looked_up(packed: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
    """One range: PACKED and the words (kind 1: id, n, v the weight of what follows) and grams (kind 2: id, v) there to SUMMED: what is known of texts as it came (kind 0), and a row of sums for all others of the texts read together (kind 1)."""
    words, grams = (_sorted(table[table["kind"] == kind], "id", "n", "v") for kind in (1, 2))
    out = []
    for row, batch in packed.groupby("row"):
        owners, base, known, score = [np.zeros(0, np.uint32)], [np.zeros(0)], [np.zeros(0)], [np.zeros(0)]
        for kind, ids, of, sums in zip(batch["kind"], batch["ids"], batch["of"], batch["sums"], strict=True):
            if kind == 0:
                out.append((row, 0, ids, of, sums))
                continue
            ids, of = np.cumsum(_unplaned(ids, np.uint64)), _unplaned(of, np.uint32)
            held, n, v = words if kind == 1 else grams
            at, found = _find(held, ids)
            if kind == 1:
                log_n, add = np.full(len(ids), -1.0), np.zeros(len(ids))  # log10(0.1) of unknown words
                log_n[found], add[found] = np.log10(n[at[found]] + 0.1), v[at[found]]
            else:
                of, add = of[found], v[at[found]]
                log_n, found = np.zeros(len(of)), np.zeros(len(of), bool)
            owners.append(of)
            base.append(log_n)
            known.append(found.astype(float))
            score.append(log_n + add)
        mine, which = np.unique(np.concatenate(owners), return_inverse=True)
        if len(mine):
            sums = np.stack([np.bincount(which, np.concatenate(x), len(mine)) for x in (known, base, score)])
            out.append((row, 1, None, mine.astype(np.uint32).tobytes(), sums.tobytes()))
    return pd.DataFrame(out, columns=["row", "kind", "ids", "of", "sums"])


def _added_up(summed: pd.DataFrame) -> pd.DataFrame:
    """SUMMED of texts read together to SCORED, a row for each text."""
    first = summed[summed["kind"] == 0].iloc[0]
    n_tokens, known, base, score = np.frombuffer(first["sums"]).reshape(4, -1).copy()
    rest = summed[summed["kind"] == 1]
    for of, sums in sorted(zip(rest["of"], rest["sums"], strict=True)):
        at = np.frombuffer(of, np.uint32)
        for total, part in zip((known, base, score), np.frombuffer(sums).reshape(3, -1), strict=True):
            total[at] += part
    doc_id = pd.array(np.frombuffer(first["ids"], np.int64), "Int64")
    doc_id[~np.frombuffer(first["of"], bool)] = pd.NA
    return pd.DataFrame({"doc_id": doc_id, "n_tokens": n_tokens.astype(np.int64), "n_known": known.astype(np.int64), "base": base, "score": score})


def score_texts(docs: DataFrame, train: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` under a tree fitted to all of ``train``.

    Null text counts as empty and is scored as its end alone; repeated rows and null keys are scored row by row. With
    no training rows all counts are 0, no context is retained and both scores rest on the prior of the words.
    """
    sc = docs.sparkSession.sparkContext
    words, values, n_all, distinct, start = fit(train.select(F.col("text").alias("t")))
    frequent = sc.broadcast((_sorted(most_frequent(words, FREQUENT), "w", "n", "backed"), _sorted(most_frequent(values, FREQUENT_GRAMS), "id", "v"), bitmap(values)))
    tables = words.select(F.lit(1).alias("kind"), F.col("w").alias("id"), "n", F.col("backed").alias("v")).unionByName(values.select(F.lit(2).alias("kind"), "id", F.lit(0).cast("long").alias("n"), "v"))
    ranges = -(-tables.count() // RANGE) or 1
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").cast("long").isNotNull().alias("has_id"), F.col("text").alias("t"))
    packed = rows.mapInPandas(_score(frequent, n_all, distinct, start, ranges), PACKED)
    sums = packed.groupBy("range").cogroup(tables.withColumn("range", _range_of("id", ranges)).groupBy("range")).applyInPandas(_looked_up, SUMMED)
    done = sums.groupBy("row").applyInPandas(_added_up, SCORED)
    return done.select("doc_id", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def held_out(mod: int, rest: int):
    """Whether crc32 of the doc_id as text leaves this remainder; never for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))


def op4_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score_texts(docs, docs.where(~held_out(10, 0)))
    return out.select("doc_id", held_out(10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
