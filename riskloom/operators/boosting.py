"""Leaf-wise boosted trees on histograms that Spark sums.

Features are binned once by quantiles. A tree grows at its leaf of most gain, up to a number of leaves. What a leaf
gains depends on its own rows only, so one pass over the rows sums the histograms of all leaves that may be split next,
and the driver then splits by falling gain for as long as the gains that it must compare are known. Of two siblings the
smaller is summed and the other is the parent less it. A leaf of at most FEW rows is grown to its end by one task, as the
driver would have grown it, and the driver takes from that as many splits as come to it by their gains. Rows stay on the executors in blocks of arrays, each row with its
margin, so a pass is one job of array operations and no query is planned or compiled for it; the driver holds histograms of at most ``leaves`` leaves, that is leaves * features * bins * 3 numbers.
"""

from __future__ import annotations

import heapq
import json
import pickle
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Tree:
    """Nodes by number: [feature, bin, left, right] of a split, rows of at most that bin going left; [-1, 0, 0, 0] of a leaf, with its value."""

    nodes: list[list[int]] = field(default_factory=lambda: [[-1, 0, 0, 0]])
    values: list[float] = field(default_factory=lambda: [0.0])
    gains: list[float] = field(default_factory=lambda: [0.0])

    def at(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each column of ``bins``, which has a row for each feature."""
        nodes, leaf, rest = np.array(self.nodes), np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
        while len(rest):
            f, split, left, right = nodes[leaf[rest]].T
            inner = f >= 0
            rest, f, split, left, right = (x[inner] for x in (rest, f, split, left, right))
            leaf[rest] = np.where(bins[f, rest] <= split, left, right)
        return leaf


@dataclass
class Boosted:
    """Trees over binned features. A feature's bin is the number of its edges below the value; nulls and NaN are in the last bin."""

    features: list[str]
    edges: list[list[float]]
    base: float
    trees: list[Tree]

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Adds the probability of fraud, computed by batches of rows."""
        features, edges, base = len(self.features), self.edges, self.base
        grown = [(t.at, np.array(t.values)) for t in self.trees]

        @F.pandas_udf("double")
        def probability(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                bins = _bins([c.to_numpy(float) for c in columns[:features]], edges)
                margin = np.full(len(columns[-1]), base)
                for at, values in grown:
                    margin += values[at(bins)]
                yield pd.Series(1 / (1 + np.exp(-margin)))

        return df.withColumn(name, probability(*(F.col(f"`{c}`").cast("double") for c in self.features), F.lit(0)))

    def importances(self) -> list[tuple[str, float]]:
        """Gains of each feature's splits, as shares of all gains."""
        total = dict.fromkeys(self.features, 0.0)
        for t in self.trees:
            for node, gain in zip(t.nodes, t.gains, strict=True):
                if node[0] >= 0:
                    total[self.features[node[0]]] += gain
        whole = sum(total.values()) or 1.0
        return sorted(((c, g / whole) for c, g in total.items()), key=lambda r: (-r[1], r[0]))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Boosted:
        d = json.loads(text)
        return Boosted(d["features"], d["edges"], d["base"], [Tree(**t) for t in d["trees"]])


def _bins(columns: list[np.ndarray], edges: list[list[float]]) -> np.ndarray:
    """Bins of the values, a row for each feature: the number of edges below the value, past all of them for NaN."""
    kind = np.uint8 if max(map(len, edges), default=0) < 255 else np.uint16
    out = np.empty((len(edges), len(columns[0]) if columns else 0), kind)
    for i, (x, e) in enumerate(zip(columns, edges, strict=True)):
        out[i] = np.where(np.isnan(x), len(e) + 1, np.searchsorted(np.array(e, float), x, side="left"))
    return out


def edges_of(df: DataFrame, features: list[str], bins: int = 64, accuracy: int = 10_000) -> list[list[float]]:
    """Edges between bins of about like numbers of rows: quantiles of every feature in one pass, by a mergeable summary of bounded size, at a rank error of 1/accuracy."""
    shares = [i / bins for i in range(1, bins)]
    x = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
    row = df.agg(*(F.percentile_approx(x(c), shares, accuracy).alias(f"q{i}") for i, c in enumerate(features)), *(F.max(x(c)).alias(f"m{i}") for i, c in enumerate(features))).first()
    # nothing lies above an edge at the largest value, so it is left out
    return [sorted({float(v) for v in row[f"q{i}"] or [] if v < row[f"m{i}"]}) for i in range(len(features))]


def _best(hist: np.ndarray, ridge: float, least: int, least_curvature: float) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best split of a leaf's histogram [feature, bin, (gradient, curvature, rows)]; the first feature and bin of equal ones."""
    left = hist.cumsum(axis=1)
    all_ = left[:, -1:, :]
    right = all_ - left
    power = lambda s: s[..., 0] ** 2 / (s[..., 1] + ridge)
    with np.errstate(invalid="ignore", divide="ignore"):  # empty sides, which are no splits
        gain = power(left) + power(right) - power(all_)
    ok = (left[..., 2] >= least) & (right[..., 2] >= least) & (left[..., 1] >= least_curvature) & (right[..., 1] >= least_curvature)
    gain = np.where(ok, gain, -np.inf)
    at = int(gain.argmax())
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


@dataclass
class Block:
    """Some rows of one task: label, weight, margin, trees that draw the row (a bit each, 62 to a number) and bins."""

    y: np.ndarray
    w: np.ndarray
    m: np.ndarray
    draws: np.ndarray
    bins: np.ndarray

    def after(self, trees: list[Tree]) -> Block:
        """The rows with the trees' values in their margins."""
        m = self.m
        for tree in trees:
            m = m + np.array(tree.values)[tree.at(self.bins)]
        return Block(self.y, self.w, m, self.draws, self.bins)


BITS = 62
#: After so many trees, blocks are made from the rows anew, or what a task is told would grow with every tree.
CHAIN = 50
#: A leaf of so many rows is one task's work: some 30 MB.
FEW = 1 << 20


def _packed(n_draws: int, edges: list[list[float]], base: float):
    """Rows (_y, _w, _d0.., _x0..) of a task as blocks, one for each batch of Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y, w, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            draws = np.array(rest[:n_draws], np.int64).reshape(n_draws, len(y))
            block = Block(y.astype(float), w.astype(float), np.full(len(y), base), draws, _bins([x.astype(float) for x in rest[n_draws:]], edges))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], names=["block"])

    return run


@dataclass
class Leaf:
    """What is known of a leaf: its value, rows, best split, histogram (not of leaves grown by one task) and, once they are known, its children."""

    value: float
    rows: float
    gain: float
    feature: int
    bin: int
    hist: np.ndarray | None = None
    children: tuple[Leaf, Leaf] | None = None


@dataclass
class Rules:
    """When and how leaves are split."""

    leaves: int
    least: int
    ridge: float
    least_curvature: float
    rate: float
    n_bins: int

    def leaf(self, hist: np.ndarray) -> Leaf:
        g, h, n = hist[0].sum(axis=0)
        return Leaf(float(-self.rate * g / (h + self.ridge)), float(n), *_best(hist, self.ridge, self.least, self.least_curvature), hist)

    def opened(self, parent: Leaf, found: np.ndarray, on_left: bool) -> tuple[Leaf, Leaf]:
        """The children, one's histogram given."""
        both = self.leaf(found), self.leaf(parent.hist - found)
        return both if on_left else both[::-1]


def _smaller_on_left(leaf: Leaf) -> bool:
    return bool(leaf.hist[leaf.feature, : leaf.bin + 1, 2].sum() * 2 <= leaf.rows)


def _sums(bins: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray | None, leaves: int, n_bins: int) -> np.ndarray:
    """Sums of gradient, curvature and rows by leaf, feature and bin: [leaves, features, n_bins, 3]; ``at``: places of the rows' leaves, none for one leaf."""
    out = np.empty((leaves, len(bins), n_bins, 3))
    for f in range(len(bins)):
        cell = bins[f] if at is None else at * n_bins + bins[f]
        for i, x in enumerate((g, h, None)):
            out[:, f, :, i] = np.bincount(cell, x, leaves * n_bins).reshape(leaves, n_bins)
    return out


def _drawn(b: Block, number: int, use: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, gradients and curvatures of the block's rows that a tree draws."""
    rows = np.flatnonzero(b.draws[number // BITS] >> (number % BITS) & 1) if len(b.draws) else np.arange(len(b.y))
    p = 1 / (1 + np.exp(-b.m[rows]))
    return b.bins[use][:, rows], (p - b.y[rows]) * b.w[rows], p * (1 - p) * b.w[rows]


def _of_leaves(bins: np.ndarray, tree: Tree, nodes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows that lie in some of the tree's nodes, and the place of each one's node among these."""
    slot = np.full(len(tree.nodes), -1)
    slot[nodes] = range(len(nodes))
    at = slot[tree.at(bins)]
    rows = np.flatnonzero(at >= 0)
    return rows, at[rows]


def _histograms(blocks: RDD, tree: Tree, number: int, use: list[int], pairs: dict[int, tuple[int, int, bool]] | None, n_bins: int) -> list[np.ndarray]:
    """Histograms of the sides (feature, bin, on the left) of the tree's leaves in ``pairs``; without, of all rows.

    Each task sums its own rows first, and sums of many tasks are added up by tasks before the driver reads them, so what
    is moved is bounded by histograms and not by rows.
    """
    leaves = 1 if pairs is None else len(pairs)

    def run(part: Iterator[Block]) -> Iterator[np.ndarray]:
        out = np.zeros((leaves, len(use), n_bins, 3))
        for b in part:
            bins, g, h = _drawn(b, number, use)
            at = None
            if pairs is not None:
                rows, at = _of_leaves(bins, tree, list(pairs))
                feature, split, on_left = np.array(list(pairs.values())).T[:, at]
                mine = (bins[feature, rows] <= split) == on_left
                rows, at = rows[mine], at[mine]
                bins, g, h = bins[:, rows], g[rows], h[rows]
            out += _sums(bins, g, h, at, leaves, n_bins)
        yield out

    return list(blocks.mapPartitions(run).treeReduce(np.add, 1 if blocks.getNumPartitions() <= 32 else 2))


def _split_up(bins: np.ndarray, g: np.ndarray, h: np.ndarray, rules: Rules, splits: int) -> Leaf:
    """A leaf of few rows with all that may follow it: the ``splits`` best splits below it, by falling gain."""
    sums = lambda rows: _sums(bins[:, rows], g[rows], h[rows], None, 1, rules.n_bins)[0]
    top = rules.leaf(_sums(bins, g, h, None, 1, rules.n_bins)[0])
    waiting, made = [(-top.gain, 0, top, np.arange(len(g)))], 0
    while waiting and splits and waiting[0][0] < -1e-12:
        _, _, leaf, rows = heapq.heappop(waiting)
        left = bins[leaf.feature, rows] <= leaf.bin
        on_left = _smaller_on_left(leaf)
        sides = rows[left], rows[~left]
        leaf.children = rules.opened(leaf, sums(sides[not on_left]), on_left)
        leaf.hist = None
        for child, side in zip(leaf.children, sides, strict=True):
            made += 1
            heapq.heappush(waiting, (-child.gain, made, child, side))
        splits -= 1
    for _, _, leaf, _ in waiting:
        leaf.hist = None
    return top


def _subtrees(blocks: RDD, tree: Tree, number: int, use: list[int], nodes: list[int], rules: Rules, splits: int) -> dict[int, Leaf]:
    """Leaves of at most FEW rows, each grown on by one task that is sent its rows, all of them in one job."""

    def rows_of(part: Iterator[Block]) -> Iterator[tuple[int, tuple]]:
        for b in part:
            bins, g, h = _drawn(b, number, use)
            rows, at = _of_leaves(bins, tree, nodes)
            for i in np.unique(at):
                mine = rows[at == i]
                yield int(i), (bins[:, mine], g[mine], h[mine])

    def grow(parts) -> Leaf:
        bins, g, h = zip(*parts, strict=True)
        return _split_up(np.concatenate(bins, 1), np.concatenate(g), np.concatenate(h), rules, splits)

    grown = blocks.mapPartitions(rows_of).groupByKey(min(len(nodes), blocks.getNumPartitions())).mapValues(grow).collect()  # splits of one tree each
    return {nodes[i]: leaf for i, leaf in grown}


def _grow(blocks: RDD, number: int, rows: int, use: list[int], rules: Rules) -> Tree:
    """The tree of a number over the features in ``use``, its nodes by their places there; ``rows`` at most draw it.

    A pass over the rows sums what may follow every leaf that can still be split, so there are no more of them than the
    tree is deep; a leaf of few rows is grown to its end in one more.
    """
    tree = Tree()
    root = _subtrees(blocks, tree, number, use, [0], rules, rules.leaves - 1).get(0) if rows <= FEW else rules.leaf(_histograms(blocks, tree, number, use, None, rules.n_bins)[0])
    waiting: list[tuple[float, int, Leaf]] = []

    def know(i: int, leaf: Leaf) -> None:
        tree.values[i] = leaf.value
        if leaf.gain > 1e-12:
            heapq.heappush(waiting, (-leaf.gain, i, leaf))

    if root is not None:  # no row may have been drawn
        know(0, root)
    count = 1
    while waiting and count < rules.leaves:
        if waiting[0][2].children is None:
            # only leaves that may still come before the last split are worth a pass
            ask = {i: leaf for _, i, leaf in heapq.nsmallest(rules.leaves - count, waiting) if leaf.children is None}
            few = [i for i, leaf in ask.items() if leaf.rows <= FEW]
            if few:
                for i, leaf in _subtrees(blocks, tree, number, use, few, rules, rules.leaves - count).items():
                    ask.pop(i).children = leaf.children
            if ask:
                pairs = {i: (leaf.feature, leaf.bin, _smaller_on_left(leaf)) for i, leaf in ask.items()}
                for i, found in zip(pairs, _histograms(blocks, tree, number, use, pairs, rules.n_bins), strict=True):
                    ask[i].children = rules.opened(ask[i], found, pairs[i][2])
        gain, i, leaf = heapq.heappop(waiting)
        left = len(tree.nodes)
        tree.nodes[i], tree.gains[i], tree.values[i] = [leaf.feature, leaf.bin, left, left + 1], -gain, 0.0
        tree.nodes += [[-1, 0, 0, 0], [-1, 0, 0, 0]]
        tree.values += [0.0, 0.0]
        tree.gains += [0.0, 0.0]
        for child, known in zip((left, left + 1), leaf.children, strict=True):
            know(child, known)
        count += 1
    return tree


def fit(df: DataFrame, features: list[str], trees: int = 160, leaves: int = 31, rate: float = 0.045, least: int = 80, ridge: float = 1.5, share: float = 0.9, columns: float = 0.9, bins: int = 64, weight: str | None = None, seed: int = 42, key: str = "transaction_id", edges: list[list[float]] | None = None) -> Boosted:
    """Boosted trees for ``is_fraud``.

    ``share`` of the rows, drawn by a hash of ``key`` (of all features where there is no such column), and ``columns`` of the features take part in each tree; a split
    leaves ``least`` rows on both sides. Studies that fit several models pass the ``edges`` of one. An empty table, or one without
    both classes, is an error; rows with a null label don't take part.
    """
    rng = np.random.default_rng(seed)
    edges = edges_of(df, features, bins) if edges is None else edges
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.where(F.col("is_fraud").isNotNull()).withColumn("_w", w)
    n, total, fraud = rows.agg(F.count("*"), F.sum("_w"), F.sum(F.col("_w") * F.col("is_fraud"))).first()
    if not fraud or fraud == total:
        raise ValueError("both classes are required")
    model = Boosted(list(features), edges, float(np.log(fraud / (total - fraud))), [])
    rules = Rules(leaves, least, ridge, 1e-3, rate, max(map(len, edges), default=0) + 2)
    row = F.xxhash64(key) if key in df.columns else F.xxhash64(*features)
    drawn = lambda t: F.pmod(F.xxhash64(F.lit(seed + t), "_row"), F.lit(1 << 20)) < int(share * (1 << 20))
    draws = [reduce(lambda a, b: a.bitwiseOR(b), (F.when(drawn(t), F.lit(1 << (t - first)).cast("long")).otherwise(F.lit(0).cast("long")) for t in range(first, min(first + BITS, trees)))) for first in range(0, trees, BITS)] if share < 1 else []
    x = [F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(features)]
    flat = rows.select(F.col("is_fraud").cast("double").alias("_y"), "_w", row.alias("_row"), *x).select("_y", "_w", *(d.alias(f"_d{i}") for i, d in enumerate(draws)), *(f"_x{i}" for i in range(len(x))))
    packed = flat.mapInArrow(_packed(len(draws), edges, model.base), "block binary").rdd.map(lambda r: pickle.loads(r[0]))
    blocks, before = packed.map(lambda b: b).persist(StorageLevel.MEMORY_AND_DISK), None
    try:
        for t in range(trees):
            use = sorted(rng.permutation(len(features))[: max(1, round(columns * len(features)))].tolist())
            tree = _grow(blocks, t, n, use, rules)
            tree.nodes = [[use[n[0]], *n[1:]] if n[0] >= 0 else n for n in tree.nodes]
            model.trees.append(tree)
            if before is not None:
                before.unpersist()  # the tree's passes have read all of what was made of it
            made, new = (packed, list(model.trees)) if (t + 1) % CHAIN == 0 else (blocks, [tree])
            before, blocks = blocks, made.map(lambda b, new=new: b.after(new)).persist(StorageLevel.MEMORY_AND_DISK)
    finally:
        for held in (before, blocks):
            if held is not None:
                held.unpersist()
    return model
