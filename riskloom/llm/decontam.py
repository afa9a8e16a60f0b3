"""Benchmark decontamination under edit distance: CGK embedding, bit-sampling LSH over item-sized windows, exact verification.

A text is read lower-cased (A-Z) with runs of white space made one space. An item is leaked if some part of the text
is within ``ratio`` times its length of it in edit distance. By the q-gram lemma such a part shares many of the item's
8-grams, at nearly one offset: these offsets say where windows of the item's size are worth embedding. The CGK random
walk copies each symbol and moves on by a coin that depends on place and symbol, so that strings a few edits apart soon
walk in step; keys of sampled places of the walk are looked up among the items' keys, over repeated embeddings.
Walks of long strings seldom stay in step, so an item is cut into equal parts of PART bytes at most: if the item is
within the bound, so is one of its parts at least. Items with a part that agrees are verified by exact edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back

RATIO, SHORTEST = 0.1, 20
GRAM = 8
#: Embeddings and sampled places of each: a window is a candidate if all sampled places of one embedding agree with the item's.
REPEATS, PLACES = 40, 4
#: Parts so long, embedded REPEATS times, are meant to keep this share of the items edited to the full bound, whatever their length.
PART, TARGET = 100, 0.99
#: Coins are drawn for so many places of the walks at a time.
COINS = 256
#: Items are broadcast in blocks of so many bytes at most, one pass over the documents for each block.
BLOCK_BYTES = 8 << 20


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def edit_distance(item: bytes, text: bytes) -> tuple[int, int]:
    """Least edit distance of ``item`` to any part of ``text``, and where the first such part ends: Myers' bit vectors in one integer."""
    m, peq = len(item), {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = mask, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        if score < best:
            best, at = score, j
    return best, at


@lru_cache(maxsize=4)
def _coins(seed: int, block: int) -> np.ndarray:
    """Coins by (place, repeat, symbol) for a block of COINS places of the walks."""
    return np.random.default_rng((seed, 0, block)).integers(0, 2, (COINS, REPEATS, 256), dtype=np.uint8)


@lru_cache(maxsize=4096)
def _places(seed: int, length: int) -> np.ndarray:
    """Sampled places by (repeat, sample), rising, for items of a length: within the walk of about its first 0.8 parts."""
    r, steps = np.random.default_rng((seed, 1, length)), max(PLACES, int(1.6 * length))
    return np.sort(np.stack([r.choice(steps, PLACES, replace=False) for _ in range(REPEATS)]), axis=1)


class Embedding:
    """CGK walks, all strings and repeats at once: place p of a walk holds the symbol at hand; a coin for (repeat, p, symbol) moves on or stays."""

    def __init__(self, seed: int = 5):
        self.seed = seed

    def keys(self, strings: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """(string, repeat) keys of the places sampled for an item of the given length; a string that ends goes on as zeros."""
        out = np.zeros((len(strings), REPEATS), np.uint64)
        order = np.argsort(lengths, kind="stable")
        start = 0
        while start < len(order):  # strings of like length together, in bounded space
            rows = order[start : start + max(1, (1 << 18) // (int(lengths[order[start]]) + 64))]
            rows = rows[lengths[rows] <= 1.25 * lengths[rows[0]] + 16]
            out[rows] = self._walk([strings[i] for i in rows], lengths[rows])
            start += len(rows)
        return out

    def _walk(self, strings: list[bytes], lengths: np.ndarray) -> np.ndarray:
        width = max(map(len, strings)) + 1
        text = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in strings), np.uint8)
        base = np.repeat(np.arange(len(strings)) * width, REPEATS)  # walks by (string, repeat)
        coin_at = np.tile(np.arange(REPEATS) * 256, len(strings))
        places = np.stack([_places(self.seed, int(n)) for n in lengths]).ravel()
        due = np.argsort(places, kind="stable")
        edges = np.searchsorted(places[due], np.arange(places[due[-1]] + 2))
        symbols, at = np.zeros(len(places), np.uint64), np.zeros(len(base), np.int64)
        for p in range(len(edges) - 1):
            c = text[base + np.minimum(at, width - 1)]
            here = due[edges[p] : edges[p + 1]]
            symbols[here] = c[here // PLACES]
            at += _coins(self.seed, p // COINS)[p % COINS].ravel()[coin_at + c]
        key = np.zeros(len(base), np.uint64)
        for k in range(PLACES):
            key = (key << np.uint64(8)) | symbols[k::PLACES]
        return key.reshape(len(strings), REPEATS)


class Items:
    """What a pass over the documents looks up: grams of all items with their item and offset, and LSH keys."""

    def __init__(self, ids: list[int], texts: list[bytes], ratio: float):
        keep = [i for i, t in enumerate(texts) if t]
        self.ids, self.whole = [ids[i] for i in keep], [texts[i] for i in keep]
        self.room = [int(ratio * len(t)) if len(t) >= SHORTEST else 0 for t in self.whole]
        #: Parts, the item of each, and where in it each begins.
        self.texts, self.of, self.begin = [], [], []
        for i, t in enumerate(self.whole):
            n = -(-len(t) // PART)
            edges = [len(t) * k // n for k in range(n + 1)]
            self.texts += [t[a:b] for a, b in zip(edges, edges[1:])]
            self.of += [i] * n
            self.begin += edges[:-1]
        self.allowed = np.array([int(ratio * len(t)) if len(t) >= SHORTEST else 0 for t in self.texts], np.int64)
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        short = self.sizes < SHORTEST  # looked for whole
        self.short = [i for i in np.flatnonzero(short)]
        #: A part of n bytes within k edits shares n - GRAM + 1 - k * GRAM grams at least.
        self.shared = np.maximum(1, self.sizes - GRAM + 1 - self.allowed * GRAM)
        grams, item, offset = [], [], []
        for i in np.flatnonzero(~short):
            g = gram_values(self.texts[i])
            grams.append(g)
            item.append(np.full(len(g), i))
            offset.append(np.arange(len(g)))
        self.grams = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(self.grams, kind="stable")
        self.grams, self.item, self.offset = self.grams[order], np.concatenate([*item, np.empty(0, np.int64)]).astype(np.int64)[order], np.concatenate([*offset, np.empty(0, np.int64)]).astype(np.int64)[order]
        self.log_slots = min(24, max(16, (16 * len(self.grams)).bit_length()))
        self.bits = np.zeros(1 << self.log_slots, bool)
        self.bits[slot(self.grams, self.log_slots)] = True
        self.embedding = Embedding()
        self.keys = self.embedding.keys(self.texts, self.sizes) if self.texts else np.zeros((0, REPEATS), np.uint64)
        self.least, self.span = (int(self.shared[~short].min()), int((self.sizes + self.allowed)[~short].max())) if (~short).any() else (0, 0)

    def dense(self, at: np.ndarray) -> np.ndarray:
        """Which of the rising places lie in a stretch of the longest window's size that has ``least`` of them."""
        out, k = np.zeros(len(at) + 1, np.int64), self.least - 1
        good = np.flatnonzero(at[k:] - at[: len(at) - k] < self.span) if len(at) > k else np.empty(0, np.int64)
        out[good] += 1
        out[good + k + 1] -= 1
        return np.cumsum(out[:-1]) > 0

    def windows(self, text: bytes) -> list[tuple[int, int]]:
        """(part, start): where enough of the part's grams lie on nearly one diagonal."""
        g = gram_values(text)
        if not len(g) or not len(self.grams):
            return []
        at = np.flatnonzero(self.bits.take(slot(g, self.log_slots)))
        if len(at) < self.least:
            return []
        at = at[self.dense(at)]
        left = np.searchsorted(self.grams, g[at])
        met = self.grams.take(left, mode="clip") == g[at]
        at, left = at[met], left[met]
        dense = self.dense(at)
        at, left = at[dense], left[dense]
        if not len(at):
            return []
        n = np.searchsorted(self.grams, g[at], side="right") - left
        row = np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, start = self.item[row], np.repeat(at, n) - self.offset[row]
        out = set()
        band = 2 * self.allowed[item] + 1
        for shift in (0, 1):  # a diagonal strip no wider than a band lies within one of two staggered cells
            cell = (start + shift * band) // (2 * band)
            order = np.lexsort((start, cell, item))
            i, c, s = item[order], cell[order], start[order]
            edges = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (c[1:] != c[:-1]), [True]])) if len(i) else np.zeros(1, np.int64)
            enough = np.flatnonzero(np.diff(edges) >= self.shared[i[edges[:-1]]])
            for a, b in zip(edges[enough], edges[enough + 1], strict=True):
                values, counts = np.unique(s[a:b], return_counts=True)
                out |= {(int(i[a]), int(v)) for v in {values[0], values[np.argmax(counts)], values[-1]}}
        return sorted(out)


def gram_values(text: bytes) -> np.ndarray:
    return np.ndarray((len(text) - GRAM + 1,), "<u8", text, strides=(1,)).copy() if len(text) >= GRAM else np.empty(0, np.uint64)


def slot(g: np.ndarray, log_slots: int) -> np.ndarray:
    return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - log_slots)).view(np.int64)


def find(items: Items, texts: list[str | None]) -> list[tuple[int, int, int]]:
    """(text, item, distance) of all leaks."""
    out, spans = {}, {}
    plain = [normal(t) for t in texts]
    spots = [(k, i, s) for k, t in enumerate(plain) for i, s in items.windows(t)]
    if spots:
        strings = [plain[k][max(0, s) : max(0, s) + int(items.sizes[i])] for k, i, s in spots]
        keys = items.embedding.keys(strings, items.sizes[[i for _, i, _ in spots]])
        candidate = (keys == items.keys[[i for _, i, _ in spots]]).any(axis=1)
        for (k, i, s), ok in zip(spots, candidate, strict=True):
            if ok:
                spans.setdefault((k, items.of[i]), set()).add(s - items.begin[i])
    for (k, i), starts in spans.items():
        room, size, joined = items.room[i], len(items.whole[i]), []
        for s in sorted(starts):  # windows that overlap are read as one
            if joined and s - 2 * room <= joined[-1][1]:
                joined[-1][1] = s + size + 2 * room
            else:
                joined.append([s - 2 * room, s + size + 2 * room])
        d = min(edit_distance(items.whole[i], plain[k][max(0, a) : max(0, b)])[0] for a, b in joined)
        if d <= room:
            out[k, i] = d
    for i in items.short:
        out |= {(k, items.of[i]): 0 for k, t in enumerate(plain) if items.texts[i] in t}
    return [(k, items.ids[i], d) for (k, i), d in sorted(out.items())]


def _blocks(benchmark: DataFrame, ratio: float) -> Iterator:
    """Broadcast items, BLOCK_BYTES of them at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("t")).where("item_id is not null and t is not null")
    blocks = -(-(items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // BLOCK_BYTES) or 1
    for b in range(blocks):
        pdf = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toPandas()
        yield spark.sparkContext.broadcast(Items(list(pdf["item_id"]), [normal(t) for t in pdf["t"]], ratio))


def _parts(texts: list[str | None], most: int = 4 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """Texts of about ``most`` characters at a time, and where each lot begins."""
    start = size = 0
    for i, t in enumerate(texts, 1):
        size += len(t or "")
        if size >= most or i == len(texts):
            yield start, texts[start:i]
            start, size = i, 0


def without_leaks(docs: DataFrame, benchmark: DataFrame, ratio: float = RATIO) -> DataFrame:
    """The rows of ``docs``, as they are, whose text holds no item; rows are judged one by one, whatever their doc_id."""
    for shared in _blocks(benchmark, ratio):
        docs = docs.where(_clean(shared)(F.col("text").cast("string")))
    return docs


def _clean(shared):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        give_back()
        for texts in batches:
            ok = np.ones(len(texts), bool)
            for start, some in _parts(list(texts)):
                ok[[start + k for k, _, _ in find(shared.value, some)]] = False
            yield pd.Series(ok)

    return clean


def leaks(docs: DataFrame, benchmark: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(doc_id, item_id, distance): every item that a row's text holds within ``ratio`` of the item's length in edits.

    No shuffle of documents: items are broadcast in blocks of BLOCK_BYTES at most. Items below SHORTEST bytes must be
    held exactly; empty or null items and null ids are passed over. Null text counts as empty. Repeated rows give
    repeated results.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t"))
    schema, out = "doc_id long, item_id long, distance int", None
    for shared in _blocks(benchmark, ratio):

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                ids, texts = pdf["doc_id"], list(pdf["t"])
                found = [(start + k, i, d) for start, some in _parts(texts) for k, i, d in find(shared.value, some)]
                yield pd.DataFrame({"doc_id": ids.iloc[[k for k, _, _ in found]].to_numpy(), "item_id": [i for _, i, _ in found], "distance": [d for _, _, d in found]}).astype({"item_id": "int64", "distance": "int32"})

        part = rows.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).distinct()
