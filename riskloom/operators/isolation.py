"""Isolation forest: trees of random cuts over bounded samples, scored by Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usual_depth(n: np.ndarray) -> np.ndarray:
    """Mean depth of a search that fails in a random tree of n rows."""
    n = np.asarray(n, float)
    many = 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, many, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """For each tree, by node: feature cut (-1 at a leaf), value, left child (the right one follows it), and depth of a leaf."""

    median: np.ndarray
    spread: np.ndarray
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    rows: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly of each row, between 0 and 1: higher is easier to isolate."""
        z, depth = (x - self.median) / self.spread, np.zeros(len(x))
        for feature, value, left, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            open_ = np.arange(len(x))
            while len(open_ := open_[feature[at[open_]] >= 0]):
                node = at[open_]
                at[open_] = left[node] + (z[open_, feature[node]] > value[node])
            depth += leaf[at]
        return 2 ** (-depth / max(1, len(self.trees)) / max(float(usual_depth(self.rows)), 1e-9))


def _grow(z: np.ndarray, r: np.random.Generator, most: int):
    feature, value, left, leaf = [-1], [0.0], [0], [0.0]
    stack = [(0, z, 0)]
    while stack:
        node, rows, depth = stack.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        open_ = np.flatnonzero(high > low)
        if len(rows) < 2 or depth >= most or not len(open_):
            leaf[node] = depth + float(usual_depth(len(rows)))
            continue
        f = int(r.choice(open_))
        feature[node], value[node], left[node] = f, float(r.uniform(low[f], high[f])), len(feature)
        above = rows[:, f] > value[node]
        for part in (rows[~above], rows[above]):
            stack.append((len(feature), part, depth + 1))
            for column, empty in ((feature, -1), (value, 0.0), (left, 0), (leaf, 0.0)):
                column.append(empty)
    return np.array(feature), np.array(value), np.array(left), np.array(leaf)


def fit(df: DataFrame, features: list[str], trees: int = 250, rows: int = 256, seed: int = 42) -> Forest:
    """A forest over robustly scaled features. At most ``trees * rows`` rows, those of least hash, are drawn; the scale is that of all rows."""
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]
    q = df.select(*cols).agg(*(F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000).alias(c) for c in features)).first()
    q = np.array([q[c] or [0.0, 0.0, 0.0] for c in features])
    spread = np.where(q[:, 2] > q[:, 0], q[:, 2] - q[:, 0], 1.0)
    drawn = df.select("transaction_id", *cols).orderBy(F.xxhash64(F.lit(seed), "transaction_id"), "transaction_id").limit(trees * rows).toPandas()
    z, r = (drawn[features].to_numpy(float) - q[:, 1]) / spread, np.random.default_rng(seed)
    n = min(rows, len(z))
    return Forest(q[:, 1], spread, [_grow(z[r.choice(len(z), n, replace=False)], r, int(np.ceil(np.log2(max(2, n))))) for _ in range(trees)] if n else [], n)


def score(df: DataFrame, forest: Forest, features: list[str], name: str = "isolation") -> DataFrame:
    """Adds the anomaly of each row. The broadcast forest has at most 2 * rows nodes a tree: 4 MB at 250 trees of 256 rows."""
    shared = df.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{name: shared.value.score(pdf[features].fillna(0).to_numpy(float))})

    return df.mapInPandas(run, f"{df._jdf.schema().toDDL()}, `{name}` double")
