"""Toxicity: a bidirectional gated recurrent network with attention pooling over overlapping windows of words, in numpy.

A word's input is the sum of its own embedding and those of its character n-grams (3 to 5 characters, edges marked),
all hashed. Windows of WINDOW words, each beginning STRIDE words after the one before, cover the whole text; a text's
logit is that of its most toxic window.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix
from .pst import held_out

WINDOW, STRIDE = 48, 40
EMBED, HIDDEN, SLOTS = 16, 8, 1 << 16
#: At most so many labelled texts of each class are used to fit, the ones with the least hash of text.
SAMPLE = 800
#: Of a text of more windows than these, those of most evidence are used to fit; scoring reads them all.
FITTED = 4
NGRAMS = (3, 4, 5)
#: Runs longer than 64 bytes are taken as words of 64 bytes.
PIECE = re.compile(rb"[^\x20\x09-\x0D]{1,64}")
THRESHOLD = 0.7


def slots_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each word itself and of its character n-grams, word after word, and how many each word has."""
    marked = [b"<" + w + b">" for w in words]
    n = np.fromiter(map(len, marked), np.int64, len(marked))
    raw, first = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64), np.cumsum(n) - n
    within = np.arange(len(raw)) - np.repeat(first, n)
    sizes = 1 + sum(np.maximum(n - k + 1, 0) for k in NGRAMS)
    start = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.int64)
    out[start] = np.fromiter(map(zlib.crc32, marked), np.int64, len(marked)) & (SLOTS - 1)
    to = start + 1
    for k in NGRAMS:
        at = np.flatnonzero(within <= np.repeat(n - k, n))
        gram = np.full(len(at), k, np.uint64)
        for j in range(k):
            gram = (gram << np.uint64(8)) | raw[at + j]
        out[np.repeat(to, n)[at] + within[at]] = (mix(gram) & np.uint64(SLOTS - 1)).astype(np.int64)
        to = to + np.maximum(n - k + 1, 0)
    return out, sizes


def features_of(words: set[bytes]) -> dict[bytes, np.ndarray]:
    """Slots of each of the words, and of the empty one that stands for an empty text."""
    known = list(words | {b""})
    flat, n = slots_of(known)
    return dict(zip(known, np.split(flat, np.cumsum(n)[:-1]), strict=True))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters: embedding E; for each direction input weights W, state weights U and biases b of update, reset and candidate; attention A, v; output o, c."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"E": r.normal(0, 0.1, (SLOTS, EMBED)).astype(np.float32)}
        for d in "fb":
            self.p[f"W{d}"] = r.normal(0, 0.3, (EMBED, 3 * HIDDEN)).astype(np.float32)
            self.p[f"U{d}"] = r.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)).astype(np.float32)
            self.p[f"b{d}"] = np.zeros(3 * HIDDEN, np.float32)
        self.p |= {"A": r.normal(0, 0.3, (2 * HIDDEN, HIDDEN)).astype(np.float32), "v": r.normal(0, 0.3, HIDDEN).astype(np.float32), "o": r.normal(0, 0.3, 2 * HIDDEN).astype(np.float32), "c": np.full(1, -2, np.float32)}

    def words(self, slots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Input vector of each word, given as in slots_of."""
        return np.add.reduceat(self.p["E"][slots], np.cumsum(sizes) - sizes, axis=0) / np.sqrt(sizes)[:, None].astype(np.float32)

    def forward(self, projected: dict[str, np.ndarray], at: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logit of each window. projected: a direction's input terms by word; at (time, window): word of each place; mask: 1 where there is one."""
        T, B = at.shape
        H, p = HIDDEN, self.p
        states, tape = np.zeros((T, B, 2 * H), np.float32), {}
        for k, d in enumerate("fb"):
            h = np.zeros((B, H), np.float32)
            for t in range(T) if d == "f" else range(T - 1, -1, -1):
                x, m = projected[d][at[t]], mask[t][:, None]
                zr = _sigmoid(x[:, : 2 * H] + h @ p[f"U{d}"][:, : 2 * H])
                z, r = zr[:, :H], zr[:, H:]
                n = np.tanh(x[:, 2 * H :] + (r * h) @ p[f"U{d}"][:, 2 * H :])
                new = m * ((1 - z) * h + z * n) + (1 - m) * h
                if keep:
                    tape[d, t] = (h, z, r, n)
                h = states[t, :, k * H : (k + 1) * H] = new
        q = np.tanh(states @ p["A"])
        e = q @ p["v"] + (mask - 1) * 1e9
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", a, states)
        logit = pooled @ p["o"] + p["c"]
        return (logit, states, q, a, pooled, tape) if keep else logit

    def project(self, inputs: np.ndarray) -> dict[str, np.ndarray]:
        return {d: inputs @ self.p[f"W{d}"] + self.p[f"b{d}"] for d in "fb"}

    def gradients(self, inputs: np.ndarray, at: np.ndarray, mask: np.ndarray, owner: np.ndarray, label: np.ndarray):
        """Gradients of the mean cross-entropy of texts, whose logit is that of their highest window; also those of the word inputs."""
        p, H = self.p, HIDDEN
        logit, states, q, a, pooled, tape = self.forward(self.project(inputs), at, mask, keep=True)
        best = np.array([np.flatnonzero(owner == i)[np.argmax(logit[owner == i])] for i in range(len(label))])
        dl = np.zeros_like(logit)
        dl[best] = (_sigmoid(logit[best]) - label) / len(label)
        g = {"o": pooled.T @ dl, "c": dl.sum(keepdims=True)}
        dpool = dl[:, None] * p["o"]
        da = np.einsum("bh,tbh->tb", dpool, states)
        de = a * (da - (a * da).sum(axis=0))
        dstates = a[:, :, None] * dpool
        dq = de[:, :, None] * p["v"] * (1 - q * q)
        g |= {"v": np.einsum("tb,tbh->h", de, q), "A": np.einsum("tbi,tbj->ij", states, dq)}
        dstates = dstates + dq @ p["A"].T
        dinputs = np.zeros_like(inputs)
        for k, d in enumerate("fb"):
            W, U = p[f"W{d}"], p[f"U{d}"]
            gW, gU, gb, dh = np.zeros_like(W), np.zeros_like(U), np.zeros_like(p[f"b{d}"]), np.zeros((at.shape[1], H), np.float32)
            for t in range(at.shape[0] - 1, -1, -1) if d == "f" else range(at.shape[0]):
                h, z, r, n = tape[d, t]
                m = mask[t][:, None]
                dh = dh + dstates[t, :, k * H : (k + 1) * H]
                dz, dn, back = m * dh * (n - h) * z * (1 - z), m * dh * z * (1 - n * n), m * dh * (1 - z) + (1 - m) * dh
                drh = dn @ U[:, 2 * H :].T
                dr = drh * h * r * (1 - r)
                dx = np.concatenate([dz, dr, dn], axis=1)
                gU[:, : 2 * H] += h.T @ dx[:, : 2 * H]
                gU[:, 2 * H :] += (r * h).T @ dn
                gW += inputs[at[t]].T @ dx
                gb += dx.sum(axis=0)
                np.add.at(dinputs, at[t], dx @ W.T)
                dh = back + drh * r + dx[:, : 2 * H] @ U[:, : 2 * H].T
            g |= {f"W{d}": gW, f"U{d}": gU, f"b{d}": gb}
        return g, dinputs, logit[best]


def windows(n: int) -> list[tuple[int, int]]:
    """(from, to) of the windows that cover n words; the last may be short, and one word before and after is shared with neighbours at least."""
    return [(a, min(n, a + WINDOW)) for a in range(0, max(1, n - WINDOW + STRIDE), STRIDE)]


def grid(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word index by (time, window), and 1 where there is a word."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    at = np.zeros((len(rows), int(sizes.max())), np.int32)
    mask = np.arange(at.shape[1]) < sizes[:, None]
    at[mask] = np.concatenate(rows)
    return np.ascontiguousarray(at.T), np.ascontiguousarray(mask.T).astype(np.float32)


def batch(texts: list[list[list[bytes]]], features: dict[bytes, np.ndarray]):
    """Of texts given by windows: slots of the vocabulary and their number by word, word index by (time, window), mask and text of each window."""
    index: dict[bytes, int] = {}
    rows = [np.array([index.setdefault(w, len(index)) for w in words or [b""]], np.int32) for text in texts for words in text]
    slots = [features[w] for w in index]
    return np.concatenate(slots), np.fromiter(map(len, slots), np.int64, len(slots)), *grid(rows), np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def tokens(text: str | None) -> list[bytes]:
    return PIECE.findall((text or "").encode("utf-8", "surrogatepass").lower())


def evidence(parsed: list[list[bytes]], labels: np.ndarray, features: dict[bytes, np.ndarray]) -> np.ndarray:
    """For each slot, how many deviations its share of toxic texts lies above its share of others, kept within 4 and scaled to 1."""
    n = np.zeros((2, SLOTS))
    for words, y in zip(parsed, labels, strict=True):
        if words:
            n[int(y), np.unique(np.concatenate([features[w] for w in set(words)]))] += 1
    of = np.array([[max(1, (labels == 0).sum())], [max(1, (labels == 1).sum())]])
    odds = np.log((n[1] + 0.5) / (of[1] + 1)) - np.log((n[0] + 0.5) / (of[0] + 1))
    return (np.clip(odds / np.sqrt(1 / (n[0] + 0.5) + 1 / (n[1] + 0.5)), -4, 4) / 4).astype(np.float32) * (n.sum(axis=0) > 0)


def telling(words: list[bytes], worth: dict[bytes, float]) -> list[list[bytes]]:
    """The FITTED windows of a text whose words have most evidence, in order."""
    spans = windows(len(words))
    if len(spans) > FITTED:
        sums = np.cumsum([0.0, *(worth[w] for w in words)])
        best = np.argsort([-(sums[b] - sums[a]) / (b - a) for a, b in spans], kind="stable")[:FITTED]
        spans = [spans[i] for i in np.sort(best)]
    return [words[a:b] for a, b in spans]


def train(texts: list[str], labels: np.ndarray, steps: int = 120, size: int = 48, rate: float = 0.02, seed: int = 7) -> Network:
    """Adam; embedding rows move only when met, and begin with the evidence of their slot in one place. Batches draw both classes as often."""
    net, r = Network(seed), np.random.default_rng(seed)
    parsed = [tokens(t) for t in texts]
    features = features_of({w for words in parsed for w in words})
    net.p["E"][:, 0] = evidence(parsed, labels, features)
    worth = {w: float(np.maximum(net.p["E"][x, 0], 0).mean()) for w, x in features.items()}
    parsed = [telling(words, worth) for words in parsed]
    classes = [np.flatnonzero(labels == c) for c in (0, 1)]
    first, second = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        pick = np.concatenate([r.choice(c, min(size // 2, len(c)), replace=False) for c in classes])
        slot, sizes, at, mask, owner = batch([parsed[j] for j in pick], features)
        g, dinputs, _ = net.gradients(net.words(slot, sizes), at, mask, owner, labels[pick].astype(np.float32))
        order = np.argsort(slot, kind="stable")
        rows, first_at = np.unique(slot[order], return_index=True)
        gE = np.add.reduceat((dinputs / np.sqrt(sizes)[:, None])[np.repeat(np.arange(len(sizes)), sizes)[order]], first_at, axis=0)
        lr = rate * (1 - 0.8 * step / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for k, grad in [*g.items(), ("E", gE)]:
            s = rows if k == "E" else slice(None)
            grad = np.clip(grad, -1, 1)
            first[k][s] = 0.9 * first[k][s] + 0.1 * grad
            second[k][s] = 0.999 * second[k][s] + 0.001 * grad * grad
            net.p[k][s] -= (lr * first[k][s] / (np.sqrt(second[k][s]) + 1e-8)).astype(np.float32)
    return net


class Projected(dict):
    """word -> row of the network's input terms for it; once there are more than ``bound`` words, it begins anew."""

    def __init__(self, net: Network, bound: int = 100_000):
        super().__init__()
        self.net, self.bound = net, bound
        self.terms = {d: np.empty((bound + (1 << 16), 3 * HIDDEN), np.float32) for d in "fb"}

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self)
        return i

    def ids(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        if len(self) > self.bound:
            self.clear()
        known = len(self)
        out = [np.fromiter(map(self.__getitem__, words or [b""]), np.int32, len(words) or 1) for words in texts]
        new = list(islice(self, known, None))
        for i in range(0, len(new), 1 << 14):
            for d, x in self.net.project(self.net.words(*slots_of(new[i : i + (1 << 14)]))).items():
                if len(self) > len(self.terms[d]):  # a text of very many different words
                    self.terms[d] = np.concatenate([self.terms[d], np.empty((len(self) - len(self.terms[d]), 3 * HIDDEN), np.float32)])
                self.terms[d][known + i : known + i + len(x)] = x
        return out


def score_batch(inputs: Projected, texts: list[str | None], most: int = 40_000) -> np.ndarray:
    """Scores of whole texts; words are taken about ``most`` at a time, windows of a very long text too."""
    out = np.full(len(texts), -np.inf)
    parsed: list[list[bytes]] = []
    start = held = 0

    def flush():
        rows, owner = [], []
        for i, ids in enumerate(inputs.ids(parsed), start):
            spans = windows(len(ids))
            rows += [ids[a:b] for a, b in spans]
            owner += [i] * len(spans)
        for i in range(0, len(rows), 2 * most // WINDOW):
            at, mask = grid(rows[i : i + 2 * most // WINDOW])
            np.maximum.at(out, owner[i : i + 2 * most // WINDOW], inputs.net.forward(inputs.terms, at, mask))

    for i, t in enumerate(texts):
        parsed.append(tokens(t))
        held += len(parsed[-1])
        if held >= most:
            flush()
            start, parsed, held = i + 1, [], 0
    if parsed:
        flush()
    return _sigmoid(out)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, limit: int) -> pd.DataFrame:
    """(text, y) of at most ``limit`` labelled texts of each class, those with the least hash; equal texts of a class count once."""
    docs = docs.select("doc_id", "text")
    y = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).alias("y"))
    rows = docs.where("text is not null and doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"))
    rows = rows.join(y, "doc_id").select("doc_id", "y", "h")
    rows = rows.groupBy("y", "h").agg(F.min("doc_id").alias("doc_id"))
    keys = [rows.where(F.col("y") == c).orderBy("h", "doc_id").limit(limit) for c in (0, 1)]
    picked = keys[0].unionByName(keys[1])
    return docs.withColumn("h", F.xxhash64("text")).join(F.broadcast(picked), ["doc_id", "h"]).select("doc_id", "text", "y", "h").dropDuplicates(["y", "h"]).orderBy("h", "doc_id", "y").toPandas()  # 2 * limit rows of ids are broadcast


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """A network from the labelled rows given; None if either class is missing, when every text scores 0."""
    pdf = labelled_sample(docs, labels, "toxic", sample)
    return train(list(pdf["text"]), pdf["y"].to_numpy()) if pdf["y"].nunique() == 2 else None


def scored(docs: DataFrame, net: Network | None):
    """Column of the score of ``text``: only texts go to Python and only scores come back. Null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # 4 MB

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        inputs = Projected(shared.value)
        for texts in batches:
            yield pd.Series(score_batch(inputs, list(texts)) if shared.value is not None and len(texts) else np.zeros(len(texts)))

    return run.asNondeterministic()(F.col("text").cast("string"))  # so that a filter does not score again


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, score) of every row's whole text; rows are scored one by one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), scored(docs, net).alias("score"))


def keep_below(docs: DataFrame, net: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, as they are, whose text scores below the threshold."""
    return docs.where(scored(docs, net) < threshold)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = fit(docs.where(~held_out(3, 1)), labels.where(~held_out(3, 1)))
    out = score(docs, net)
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
