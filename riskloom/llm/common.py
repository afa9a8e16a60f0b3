"""What the training-data operators share: scratch tables, word hashes and group streams."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
FREE_SHUFFLE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, or a fresh local one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="riskloom-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions within are dropped as soon as each is over."""
    before = spark.conf.get(FREE_SHUFFLE, None)
    spark.conf.set(FREE_SHUFFLE, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLE) if before is None else spark.conf.set(FREE_SHUFFLE, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and a lost executor costs nothing before it.

    Shuffle files of the write are dropped as soon as it is over.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``materialise`` that nothing reads any more."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def give_back() -> None:
    """Memory that a reused worker's earlier tasks have freed goes back to the machine, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, kept for at most ``bound`` words at a time."""

    def __init__(self, bound: int = 150_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the words of a text, A-Z lower-cased; null counts as empty."""
        words = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; fewer words make one shingle, none make none."""
    if not len(words):
        return words
    n, out = min(n, len(words)), np.full(max(1, len(words) - n + 1), n, np.uint64)
    for i in range(n):
        out = mix(out ^ words[i : i + len(out)]) + np.uint64(i)
    return np.unique(out)


def whole_groups(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """From batches sorted by ``key``: frames that hold only whole groups, joined on as rows of the last group come."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        last = (pdf[key] == pdf[key].iloc[-1]).all(axis=1).to_numpy()
        cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        if not cut and rest and not (rest[-1][key].iloc[-1] == pdf[key].iloc[0]).all():
            yield pd.concat(rest, ignore_index=True)
            rest = []
        if cut:
            yield pd.concat([*rest, pdf.iloc[:cut]], ignore_index=True)
            rest = []
        rest.append(pdf.iloc[cut:])
    if rest:
        yield pd.concat(rest, ignore_index=True)
