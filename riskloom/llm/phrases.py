"""Phrase collocation mining with compressed position bitmaps.

Tasks read whole texts into shards of one language. In a shard every token has a position, every piece ends with an empty
one, and every word has a bitmap of its positions of which only machine words that aren't zero are kept. A phrase's
bitmap, shifted by one and combined by AND with a word's, is that of the phrase with the word behind it, and never
crosses a piece; its population count is the shard's number of occurrences. Spark sums the counts of all shards.

A phrase is at most as frequent as its parts, so each length is counted after the one before: only phrases whose first
and last parts reached the least count in the whole corpus are extended. What shards know of that is a bitmap of hash
prefixes of one size whatever the input. It never hides a frequent part; sums are exact. Words are 64-bit hashes between
the passes; the first one compares all words of a hash, and begins anew with another if two differ.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, materialise, mix
from .pst import bitmap, may_hold

LEAST, LONGEST, SHOWN = 30, 4, 2000
#: A longer candidate with so many of 100 occurrences of a phrase within it stands for the phrase.
COVERED = 80
#: What ends a word, and what ends a piece too.
SPACES, BREAKS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"
SEPARATOR = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]")
KIND = np.zeros(256, np.uint8)
KIND[list(SPACES)], KIND[list(BREAKS)] = 1, 2
#: Bytes of text of a shard; a longer text is read in windows. Bytes hashed at once, and entries of bitmaps extended at once.
SHARD, PIECE, CHUNK = 3 << 19, 1 << 18, 1 << 14
#: Bits of a machine word of a bitmap. A block of so many positions is met by so many words at most.
BITS = 16


class Reader:
    """Texts to tokens: a 64-bit hash for each word, 0 for the end of a piece."""

    def __init__(self, seed: int):
        self.base = (xxhash.xxh3_64_intdigest(b"base", seed) | 5) & ~2  # 1 modulo 4, so that powers are of full period
        self.powers, self.inverses = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, PIECE + PIECE // 8)
            steps = lambda b: np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, b, np.uint64)))
            self.powers, self.inverses = steps(self.base), steps(pow(self.base, -1, 1 << 64))

    def tokens(self, data: bytes, lang: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of lower-cased ``data``, and where its words start and end. A word's hash is that of its bytes and the language alone."""
        found, at = [], 0
        while at < len(data) or not found:  # some bytes at a time, so that arrays of 8 bytes for each of them stay small
            m = SEPARATOR.search(data, at + PIECE) if len(data) - at > PIECE else None
            stop = m.end() if m else len(data)
            found.append(self._tokens(data[at:stop], at, lang))
            at = stop
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def _tokens(self, data: bytes, offset: int, lang: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.frombuffer(data, np.uint8)
        self._grow(len(x))
        kind = KIND[x]
        word = kind == 0
        edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
        start, end, breaks = edges[::2], edges[1::2], np.flatnonzero(kind == 2)
        value = (x + np.uint64(1)) * self.powers[: len(x)]
        value[~word] = 0
        hashes = mix(np.add.reduceat(value, start) * self.inverses[start] ^ lang) if len(start) else np.zeros(0, np.uint64)
        hashes[hashes == 0] = 1
        order = np.argsort(np.concatenate([start, breaks]), kind="stable")
        return np.concatenate([hashes, np.zeros(len(breaks), np.uint64)])[order], start + offset, end + offset


def language(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))


def position_bitmaps(at: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, block, bits) of words, numbers below ``words``, at rising positions; by block. Bit i of block b is position BITS * b + i."""
    key = (at // BITS) * np.int64(words) + word
    order = np.argsort(key, kind="stable")
    key, bit = key[order], np.uint16(1) << (at[order] % BITS).astype(np.uint16)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    bits = np.bitwise_or.reduceat(bit, first) if len(first) else bit
    return (key[first] % words).astype(np.int32), key[first] // words, bits


def shifted(block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bitmaps moved on by one position: (entry it comes from, block, bits). What leaves a block enters the next."""
    on, over = bits << np.uint16(1), bits >> np.uint16(BITS - 1)
    a, b = np.flatnonzero(on), np.flatnonzero(over)
    return np.concatenate([a, b]), np.concatenate([block[a], block[b] + 1]), np.concatenate([on[a], over[b]])


def phrase_hash(words: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases from the columns of their words' hashes; of one word its own."""
    if len(words) == 1:
        return words[0]
    out = np.full(len(words[0]), len(words), np.uint64)
    for k, w in enumerate(words):
        out = mix(out ^ w) + np.uint64(k)
    return out


class Miner:
    """Counts of phrases of one length in a shard; ``frequent`` holds a bitmap of hash prefixes for each shorter length. Phrases that end within the first ``seen`` tokens were counted before."""

    def __init__(self, tokens: np.ndarray, frequent: list[np.ndarray], seen: int = 0):
        self.length, self.frequent, self.seen = len(frequent) + 1, frequent, seen
        at = np.flatnonzero(tokens)
        at = at[may_hold(frequent[0], tokens[at])]
        self.words, number = np.unique(tokens[at], return_inverse=True)
        self.word, self.block, self.bits = position_bitmaps(at, number, max(1, len(self.words)))
        self.start = np.searchsorted(self.block, np.arange(len(tokens) // BITS + 3))
        self.phrases: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def _may(self, phrases: np.ndarray) -> np.ndarray:
        return may_hold(self.frequent[phrases.shape[1] - 1], phrase_hash([self.words[phrases[:, k]] for k in range(phrases.shape[1])]))

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """Phrases as rows of word hashes, and how often each occurs."""
        order = np.argsort(self.word, kind="stable")
        word, block, bits = self.word[order], self.block[order], self.bits[order]
        new = np.diff(word, prepend=-1) != 0
        self._deeper(word[new][:, None], np.cumsum(new) - 1, block, bits)
        phrases, n = np.concatenate([np.zeros((0, self.length), np.int32), *self.phrases]), np.concatenate([np.zeros(0, np.int64), *self.counts])
        return self.words[phrases], n

    def _deeper(self, phrases: np.ndarray, of: np.ndarray, block: np.ndarray, bits: np.ndarray) -> None:
        """Extend phrases whose bitmaps are the entries (of, block, bits), in order of ``of``, depth first, some phrases at a time."""
        if phrases.shape[1] == self.length:
            if self.seen:
                bits = np.where(block == 0, bits & ~np.uint16((1 << self.seen) - 1), bits)
            n = np.bincount(of, np.bitwise_count(bits), len(phrases)).astype(np.int64)
            self.phrases.append(phrases[n > 0])
            self.counts.append(n[n > 0])
            return
        at = 0
        while at < len(of):
            stop = min(at + CHUNK, len(of))
            if stop < len(of):  # a phrase stays whole
                cut = int(np.searchsorted(of, of[stop]))
                stop = cut if cut > at else int(np.searchsorted(of, of[stop], "right"))
            self._extended(phrases, of[at:stop], block[at:stop], bits[at:stop])
            at = stop

    def _extended(self, phrases: np.ndarray, of: np.ndarray, block: np.ndarray, bits: np.ndarray) -> None:
        found = []
        for a in range(0, len(of), CHUNK):  # a phrase of very many entries, some of them at a time
            entry, b, moved = shifted(block[a : a + CHUNK], bits[a : a + CHUNK])
            many = self.start[b + 1] - self.start[b]
            left = np.repeat(np.arange(len(b)), many)
            right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many - self.start[b], many)
            both = moved[left] & self.bits[right]
            hit = np.flatnonzero(both)
            left, right = left[hit], right[hit]
            found.append((of[a + entry[left]].astype(np.int64) * len(self.words) + self.word[right], b[left], both[hit]))
        key, block, bits = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(key):
            return
        order = np.argsort(key, kind="stable")
        key, block, bits = key[order], block[order], bits[order]
        new = np.diff(key, prepend=-1) != 0
        distinct, of = key[new], np.cumsum(new) - 1
        longer = np.column_stack([phrases[distinct // len(self.words)], (distinct % len(self.words)).astype(np.int32)])
        good = self._may(longer) if longer.shape[1] < self.length else self._may(longer[:, 1:])
        kept = np.flatnonzero(good[of])
        if len(kept):
            self._deeper(longer[good], (np.cumsum(good) - 1)[of[kept]], block[kept], bits[kept])


def shards(frames: Iterator[pd.DataFrame], seed: int, overlap: int) -> Iterator[tuple[str, bytes, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(language, text, tokens, starts and ends of words, tokens seen before) of whole texts, SHARD bytes together; of a longer text in windows that begin with the last ``overlap`` tokens of the one before."""
    reader, held, sizes = Reader(seed), {}, {}

    def read(lang: str, data: bytes, before: np.ndarray) -> tuple:
        tokens, start, end = reader.tokens(data, language(lang))
        return lang, data, np.concatenate([before, tokens]), start, end, len(before)

    none = np.zeros(0, np.uint64)
    for pdf in frames:
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            data, before, at = text.encode("utf-8", "surrogatepass").lower(), none, 0
            while len(data) - at > SHARD:
                m = SEPARATOR.search(data, at + SHARD)
                stop = m.end() if m else len(data)
                out = read(lang, data[at:stop], before)
                yield out
                before, at = out[2][max(0, len(out[2]) - overlap) :], stop
            if at:
                yield read(lang, data[at:] + b"\n", before)
                continue
            held.setdefault(lang, []).append(data)
            sizes[lang] = sizes.get(lang, 0) + len(data) + 1
            if sizes[lang] >= SHARD or sum(sizes.values()) >= 4 * SHARD:
                most = max(sizes, key=sizes.get)
                yield read(most, b"\n".join(held.pop(most)) + b"\n", none)
                del sizes[most]
    for lang, texts in held.items():
        yield read(lang, b"\n".join(texts) + b"\n", none)


def count_words(seed: int):
    """mapInPandas function over (lang, text): (id, lang, word, n), the shards' counts of words; n of the empty word is the number of all."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, data, tokens, start, end, _ in shards(frames, seed, 0):
            words, first, n = np.unique(tokens[tokens != 0], return_index=True, return_counts=True)
            text = [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            empty = mix(np.array([language(lang)]))
            yield pd.DataFrame({"id": np.append(words, empty).view(np.int64), "lang": np.full(len(n) + 1, lang, object), "word": np.array([*text, ""], object), "n": np.append(n, n.sum())})

    return run


def count_phrases(seed: int, frequent):
    """mapInPandas function over (lang, text): (w1, w2, .. and n), the shards' counts of phrases one word longer than the last of ``frequent``, a broadcast list of bitmaps for each shorter length."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = frequent.value
        for _, _, tokens, _, _, seen in shards(frames, seed, len(bits)):
            phrases, n = Miner(tokens, bits, seen).run()
            yield pd.DataFrame({f"w{k + 1}": phrases[:, k].view(np.int64) for k in range(phrases.shape[1])} | {"n": n})

    return run


def _hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        yield pd.DataFrame({"id": phrase_hash([pdf[c].to_numpy(np.int64).view(np.uint64) for c in pdf]).view(np.int64)})


def _words(texts: DataFrame, least: int) -> tuple[int, DataFrame]:
    """A seed under which no two words share a hash, and (id, lang, word, n) of the frequent words and of the languages' totals."""
    seed = 0
    while True:
        sums = texts.mapInPandas(count_words(seed), "id long, lang string, word string, n long").groupBy("id").agg(F.sum("n").alias("n"), *(f(c).alias(f"{c}{i}") for c in ("lang", "word") for i, f in enumerate((F.min, F.max))))
        clash = (F.col("lang0") != F.col("lang1")) | (F.col("word0") != F.col("word1"))
        found = materialise(sums.where((F.col("n") >= least) | (F.col("word0") == "") | clash), "words")
        if not found.where(clash).limit(1).count():
            return seed, found.select("id", F.col("lang0").alias("lang"), F.col("word0").alias("word"), "n")
        drop(found)
        seed += 1


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, length, f) of all phrases of up to ``longest`` words that occur ``least`` times, and (lang, n), the number of words of each language.

    Null languages count as ``und``, null texts as empty; repeated rows count as often as they come; ids and other
    columns play no part. A pass over the texts for each length.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")
    seed, words = _words(texts, least)
    sizes, words = words.where("word = ''").select("lang", "n"), words.where("word <> ''")
    bits = [bitmap(words.select("id"))]
    level = words.select(F.col("id").alias("w1"), "lang", F.col("word").alias("phrase"), F.col("n").alias("f"))
    out = level.select("lang", "phrase", F.lit(1).alias("length"), "f")
    for length in range(2, longest + 1):
        keys, known = [f"w{k + 1}" for k in range(length)], spark.sparkContext.broadcast(bits)
        counted = texts.mapInPandas(count_phrases(seed, known), ", ".join(f"{k} long" for k in [*keys, "n"])).groupBy(*keys).agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        last = words.select(F.col("id").alias(keys[-1]), "word")
        named = counted.join(level.drop("f"), keys[:-1]).join(last, keys[-1]).select(*keys, "lang", F.concat("phrase", F.lit(" "), "word").alias("phrase"), "f")
        level = materialise(named, f"phrases{length}")
        known.unpersist()
        out = out.unionByName(level.select("lang", "phrase", F.lit(length).alias("length"), "f"))
        if length < longest:
            bits = [*bits, bitmap(level.select(*keys).mapInPandas(_hashed, "id long"))]
    return out, sizes


def _part(words: Column, start: int | Column, size: int | Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of 2 to ``longest`` words that occur ``least`` times and that no longer one stands for.

    The cut of lowest floor(2000000 * a / (l + r)) counts, the first of equal ones; l and r are the counts of both parts.
    Quotients are of exact decimals. Joins and sums are by phrase, so no language is gathered in a task.
    """
    counts, sizes = frequent_phrases(docs, least, longest)
    words = F.split("phrase", " ", -1)
    long = counts.where("length > 1").withColumnRenamed("f", "a")
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1))).select("lang", "phrase", "a", "k", _part(words, F.lit(1), F.col("k")).alias("first"), _part(words, F.col("k") + 1, F.col("length") - F.col("k")).alias("rest"))
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr("(CAST(a AS DECIMAL(20,0)) * 2000000) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.cast("long").alias("score"), "k", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.*")
    inner = [F.struct(_part(words, i + 1, k).alias("phrase")) for k in range(2, longest) for i in range(longest - k + 1)]
    shape = [(k, i) for k in range(2, longest) for i in range(longest - k + 1)]
    inner = F.filter(F.array(*(F.when(F.col("length") >= i + k + (i == 0), x) for (k, i), x in zip(shape, inner, strict=True))), lambda x: x.isNotNull())
    within = long.where("length > 2").select("lang", F.explode(inner).alias("p"), "a").groupBy("lang", F.col("p.phrase").alias("phrase")).agg(F.max("a").alias("most"))
    left = best.join(within, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * covered))
    return left.join(sizes, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def top(found: DataFrame, shown: int = SHOWN) -> DataFrame:
    """The first ``shown`` of each language by score, count and phrase (in the order of its UTF-8 bytes), with ``rank`` from 1. The first of 64 parts of each language are found before those of the language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    near = found.withColumn("_part", part).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_r") <= shown).drop("_part", "_r")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= shown)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text")
    return top(collocations(docs)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""WITH p AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM (SELECT COALESCE(lang, 'und') AS lang, regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents)),
z AS (SELECT lang, CAST(SUM(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i+k-1], ' ') AS phrase, COUNT(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p WHERE len(w) > 0) CROSS JOIN (VALUES (1), (2), (3), (4)) v(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING COUNT(*) >= 30),
c AS (SELECT lang, phrase, f AS a, k, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM g WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.a, j, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score FROM c JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:j], ' ') JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j+1:c.k], ' ')),
b AS (SELECT * FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT lang, array_to_string(w[o:o+m-1], ' ') AS phrase, MAX(a) AS most FROM (SELECT lang, k, a, w, unnest(range(1, k)) AS o FROM (SELECT DISTINCT lang, k, a, w FROM c WHERE k > 2)) CROSS JOIN (VALUES (2), (3)) v(m) WHERE m < k AND o + m - 1 <= k GROUP BY ALL)
SELECT b.lang, ROW_NUMBER() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score FROM b JOIN z ON z.lang = b.lang LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE most IS NULL OR 100 * CAST(most AS HUGEINT) < 80 * CAST(a AS HUGEINT) QUALIFY rank <= 2000"""
