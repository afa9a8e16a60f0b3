"""Quality by co-training: a text-content view and a page-metadata view teach each other, then score together.

Text view: hashed words and letter shapes of the whole text. Metadata view: language, source and counts of lines, words
and kinds of characters. The features of every row are made once and kept in a table. Each round, each view labels all
unlabelled rows that it is sure of for the other, whose weights then follow gradients summed by Spark over those rows. The
views' log-odds are calibrated on labelled rows that neither was fitted on, and added.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, materialise

#: Slots of whole words, and as many of their shapes and first and last letters.
SLOTS = 256
#: At most so many different labelled texts of each class are used to fit: those with the least hash of text.
SAMPLE = 1500
#: A view labels a row for the other if its log-odds are beyond SURE. Pseudo-labels weigh PSEUDO times the labelled rows, whatever their number.
ROUNDS, STEPS, SURE, PSEUDO, RIDGE = 3, 2, 2.0, 0.2, 5.0
META = ["n_chars", "n_lines", "n_words", "upper", "digit", "other", "space", "mean_word", "distinct_lines"]
KINDS = 64


def content(texts: list[str | None]) -> np.ndarray:
    """Hashed shares of words, and of words' first and last letters, shapes and trailing signs; square roots of shares in 255ths, so length matters little."""
    out = np.zeros((len(texts), 2 * SLOTS), np.uint8)
    kept: dict[bytes, tuple[int, ...]] = {}
    for i, t in enumerate(texts):
        words = WORD.findall((t or "").encode("utf-8", "surrogatepass"))
        slots: list[int] = []
        for w in words:
            if (s := kept.get(w)) is None:
                if len(kept) > 100_000:
                    kept.clear()
                shape = (b"A" if w.isupper() else b"a" if w.islower() else b"1" if w.isdigit() else b"x") + bytes(c for c in w if c < 128 and not chr(c).isalnum())
                s = kept[w] = (*(zlib.crc32(k + p) % SLOTS for k, p in ((b"s", shape), (b"l", w[-2:]), (b"f", w[:2]))), SLOTS + zlib.crc32(w.lower()) % SLOTS)
            slots += s
        if slots:
            out[i] = np.rint(255 * np.sqrt(np.bincount(slots, minlength=2 * SLOTS) / len(slots)))
    return out


def metadata(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts and shares of the whole text, and slots of language and source; missing values count as a value of their own."""
    rows = []
    for t in pdf["text"]:
        t = t or ""
        b = t.encode("utf-8", "surrogatepass")
        a = np.bincount(np.frombuffer(b, np.uint8), minlength=256) if b else np.zeros(256)
        n, lines, words = max(1, len(b)), t.split("\n"), a[9:14].sum() + a[32] + 1
        letters = a[65:91].sum() + a[97:123].sum() + a[128:].sum()
        rows.append((np.log1p(len(b)), np.log1p(len(lines)), np.log1p(words), a[65:91].sum() / n, a[48:58].sum() / n, (n - letters - a[48:58].sum() - words) / n, words / n, n / words, len(set(lines)) / len(lines)))
    kinds = np.array([[zlib.crc32(f"{c}={v}".encode()) % KINDS for v in pdf[c]] for c in ("lang", "source")], np.uint8)
    return np.array(rows, np.float32).reshape(len(pdf), len(META)), kinds.reshape(2, len(pdf)).T


def packed(pdf: pd.DataFrame) -> list[bytes]:
    """The features of each row in one string of bytes."""
    counts, kinds = metadata(pdf)
    whole = np.concatenate([content(list(pdf["text"])), kinds, np.ascontiguousarray(counts).view(np.uint8).reshape(len(pdf), 4 * len(META))], axis=1)
    return [r.tobytes() for r in whole]


def unpacked(x: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Both views' features from ``packed`` rows."""
    a = np.frombuffer(b"".join(map(bytes, x)), np.uint8).reshape(len(x), 2 * SLOTS + 2 + 4 * len(META))
    kinds = np.zeros((len(a), KINDS), np.float32)
    for k in (0, 1):
        kinds[np.arange(len(a)), a[:, 2 * SLOTS + k]] = 1
    counts = np.ascontiguousarray(a[:, 2 * SLOTS + 2 :]).view(np.float32)
    return a[:, : 2 * SLOTS].astype(np.float32) / 255, np.concatenate([counts, kinds], axis=1)


class View:
    """Logistic regression on standardised features, fitted by Newton steps with a ridge; then a calibrated slope and offset."""

    def standard(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -6, 6)
        return np.concatenate([z, np.ones((len(z), 1), z.dtype)], axis=1).astype(np.float64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> View:
        self.mean, self.sd = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.w, self.slope, self.offset = np.zeros(x.shape[1] + 1), 1.0, 0.0
        for _ in range(8):
            self.step(x, y)
        return self

    def step(self, x: np.ndarray, y: np.ndarray, taught: np.ndarray | float = 0.0, weight: float = 0.0) -> None:
        """A Newton step; with ``taught``, the gradient of pseudo-labelled rows of this weight, one by the bound of the curvature, which can't overshoot."""
        z = self.standard(x)
        p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
        v = np.full(len(p), 0.25) if weight else np.maximum(p * (1 - p), 1e-4)
        self.w = self.w - np.linalg.solve((1 + weight) * (z * v[:, None]).T @ z + RIDGE * np.eye(len(self.w)), z.T @ (p - y) + taught + RIDGE * self.w)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.w

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> View:
        """Platt scaling with smoothed targets, by steps that can't overshoot however few the rows."""
        r, t = self.raw(x), np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        size = np.abs(r).mean() + 1e-9
        z, w = np.stack([r / size, np.ones_like(r)], axis=1), np.array([1.0, 0.0])
        back = np.linalg.inv(z.T @ z / 4 + 1e-3 * np.eye(2))
        for _ in range(1000):
            w = w - back @ (z.T @ (1 / (1 + np.exp(-np.clip(z @ w, -30, 30))) - t))
        self.slope, self.offset = max(w[0] / size, 0.0), w[1]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.offset


def features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A table (doc_id, h, x, y) of every row's packed features, with its label where it has one; texts stay where they are."""
    y = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "h": pdf["h"], "x": packed(pdf)})

    cols = [F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source"))]
    made = docs.select(*cols, F.xxhash64("text").alias("h")).mapInPandas(run, "doc_id long, h long, x binary")
    return materialise(made.join(y, "doc_id", "left"), "features")


def gradients(unlabelled: DataFrame, views: list[View], teachers: list[View]) -> list[list[tuple[float, np.ndarray]]]:
    """For each view and label: how many of the rows its teacher is sure have it, and the gradient of the view's loss summed over them."""
    shared = unlabelled.sparkSession.sparkContext.broadcast((views, teachers))
    sizes = [len(v.w) + 1 for v in views]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pupils, sure = shared.value
        total = [np.zeros((2, n)) for n in sizes]
        for pdf in batches:
            if not len(pdf):
                continue
            x = unpacked(pdf["x"])
            for k, v in enumerate(pupils):
                said, z = sure[1 - k].raw(x[1 - k]), v.standard(x[k])
                p = 1 / (1 + np.exp(-np.clip(z @ v.w, -30, 30)))
                for label, met in enumerate((said < -SURE, said > SURE)):
                    total[k][label] += np.concatenate([[met.sum()], (p[met] - label) @ z[met]])
        flat = np.concatenate([t.ravel() for t in total])
        yield pd.DataFrame({"k": np.arange(len(flat), dtype=np.int32), "v": flat})

    flat = np.zeros(2 * sum(sizes))
    for r in unlabelled.select("x").mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # a row for each weight
        flat[r["k"]] = r["v"]
    first, second = flat[: 2 * sizes[0]].reshape(2, -1), flat[2 * sizes[0] :].reshape(2, -1)
    return [[(t[label, 0], t[label, 1:]) for label in (0, 1)] for t in (first, second)]


def co_train(table: DataFrame, sample: int = SAMPLE):
    """Calibrated views and the log-odds of the classes, which the sum of two views counts twice; None if a class has no labelled row.

    A view that is sure of rows of one class only teaches nothing in that step. Equal labelled texts count once, texts of any length take part, and so does every unlabelled row in every round.
    """
    known = table.where("y is not null").groupBy("y", "h").agg(F.min("doc_id").alias("doc_id"))
    keys = known.where("y = 0").orderBy("h").limit(sample).unionByName(known.where("y = 1").orderBy("h").limit(sample))
    got = table.join(F.broadcast(keys), ["y", "h", "doc_id"]).dropDuplicates(["y", "h", "doc_id"]).select("y", "h", "x").toPandas()  # 2 * sample ids are broadcast
    if got["y"].nunique() < 2:
        return None
    got = got.sort_values(["h", "y"], kind="stable")
    y, x = got["y"].to_numpy(int), unpacked(got["x"])
    held, used = np.zeros(len(y), bool), np.ones(len(y), bool)
    for label in (0, 1):  # a fifth of each class, by hash of text, calibrates; a class's only row does both
        rows = np.flatnonzero(y == label)
        held[rows[::5]] = True
        used[rows[::5]] = len(rows) == 1
    fit_x, fit_y = [v[used] for v in x], y[used]
    views = [View().fit(v, fit_y) for v in fit_x]
    unlabelled, share = table.where("y is null"), (1 - fit_y.mean(), fit_y.mean())
    for _ in range(ROUNDS):
        teachers = [View.__new__(View) for _ in views]
        for t, v in zip(teachers, views, strict=True):
            t.__dict__ = dict(v.__dict__)
        for _ in range(STEPS):
            for k, by_label in enumerate(gradients(unlabelled, views, teachers)):
                if not all(n for n, _ in by_label):  # rows of one class alone would only move the balance
                    continue
                weights = [PSEUDO * len(fit_y) * share[label] / n for label, (n, _) in enumerate(by_label)]
                taught = sum(w * g for w, (_, g) in zip(weights, by_label, strict=True))
                views[k].step(fit_x[k], fit_y, taught, sum(w * n for w, (n, _) in zip(weights, by_label, strict=True)) / len(fit_y))
    a, b = (v.calibrate(x[k][held], y[held].astype(float)) for k, v in enumerate(views))
    return a, b, float(np.log((y[held].mean() + 1e-3) / (1 - y[held].mean() + 1e-3)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Views from a bounded sample of labelled rows and all unlabelled ones; None if a class is missing."""
    return co_train(features(docs, labels), sample)


def score_features(table: DataFrame, model) -> DataFrame:
    """As ``score``, from a table of features."""
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a = b = s = np.full(len(pdf), 0.0)
            if shared.value is not None and len(pdf):
                one, two, prior = shared.value
                x = unpacked(pdf["x"])
                a, b = one.log_odds(x[0]), two.log_odds(x[1])
                s = a + b - prior
            yield pd.DataFrame({"doc_id": pdf["doc_id"], **{k: 1 / (1 + np.exp(-np.clip(v, -500, 500))) for k, v in (("content_score", a), ("metadata_score", b), ("score", s))}})

    return table.select("doc_id", "x").mapInPandas(run, "doc_id long, content_score double, metadata_score double, score double")


def score(docs: DataFrame, model) -> DataFrame:
    """(doc_id, content_score, metadata_score, score) of every row's whole text: probabilities of good quality; 0.5 without a model.

    Null texts count as empty, null language and source as values of their own; rows are scored one by one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "x": packed(pdf)})

    cols = [F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source"))]
    return score_features(docs.select(*cols).mapInPandas(run, "doc_id long, x binary"), model)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    table = features(docs, labels)
    return score_features(table, co_train(table)).withColumn("keep", F.col("score") >= 0.5)
