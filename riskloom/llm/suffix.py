"""Removal of repeated byte passages: suffix sorting compared through hashes, over windows that meet at anchors.

A window is a string of ``width`` bytes. Each has an anchor: the place of its smallest 16-byte gram hash, the leftmost
on ties. Equal windows have their anchors at the same place, so windows need only be compared where anchors are equal,
and neighbouring windows with the same anchor form one segment. Three steps find every window that also starts in a
document with a smaller id:

1. ``segments``: anchor hash, segment hash and place of each segment; within a batch, segments of which a smaller
   document in the batch has an equal one are settled at once, so that a common passage sends one row a batch.
2. ``settle``: rows sorted by anchor and segment hash. Equal segments settle whole segments. Where one anchor has
   unequal segments in several documents, one segment of each kind goes on.
3. ``repeats``: their bytes, grouped by anchor, are suffix-sorted: a merge sort whose comparisons find the common
   extension of two suffixes by binary search over prefix polynomial hashes; equal neighbours are verified byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, mix, whole_groups

GRAM = 16
#: Longer texts are read in pieces of so many bytes, each with its neighbourhood.
PIECE = 1 << 20
#: Places in a buffer take so many bits; anchors are chosen by the other bits of a gram's hash, alike in every buffer.
PLACE_BITS = 24
#: Anchors with more snippets than this are dealt out by their windows, in groups of about so many.
GROUP = 20_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: So many bytes of texts are cut into segments together.
TOGETHER = 6 << 20
SEGMENTS = "k long, s long, doc_id long, lo long, len int"


def _anchors(buf: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts side by side in ``buf``: first window, last window, anchor and anchor hash of each segment."""
    n, span = len(buf), width - GRAM + 1
    if n < width:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    words = np.ndarray((n + 8,), "<u8", padded, strides=(1,))
    gram = mix(words[: n - GRAM + 1] * BASE ^ mix(words[8 : n - GRAM + 9]))
    bits = np.uint64(PLACE_BITS)
    low = (gram >> bits << bits) | np.arange(len(gram), dtype=np.uint64)
    size = 1
    while size * 2 <= span:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # the anchor of each window
    crossing = np.zeros(n + 1, np.int32)
    starts = np.maximum(ends - width + 1, np.concatenate([[0], ends[:-1]]))
    np.add.at(crossing, starts, 1)
    np.add.at(crossing, ends, -1)
    inside = np.cumsum(crossing[: len(at)]) == 0
    first = np.flatnonzero(inside & np.concatenate([[True], (at[1:] != at[:-1]) | ~inside[:-1]]))
    last = np.flatnonzero(inside & np.concatenate([(at[1:] != at[:-1]) | ~inside[1:], [True]]))
    return first, last, at[first], gram[at[first]]


def _pieces(texts: list[bytes], width: int) -> Iterator[tuple[list[tuple[int, int, int, int]], bytes]]:
    """Buffers of about PIECE bytes, with (text, offset of the piece in the text, from, to) of each piece; anchors in from:to of the text are its own."""
    held, rows, size = [], [], 0
    for i, t in enumerate(texts):
        for start in range(0, max(len(t), 1), PIECE):
            a, b = max(0, start - 2 * width), min(len(t), start + PIECE + 2 * width)
            if b - a >= width:
                rows.append((i, a, start, start + PIECE))
                held.append(t[a:b])
                size += b - a
            if size >= PIECE:
                yield rows, b"".join(held)
                held, rows, size = [], [], 0
    if rows:
        yield rows, b"".join(held)


def _segments(ids: np.ndarray, texts: list[bytes], width: int) -> tuple[pd.DataFrame, np.ndarray]:
    """Segments of texts, and the text of each."""
    parts = []
    for rows, joined in _pieces(texts, width):
        buf = np.frombuffer(joined, np.uint8)
        which, offset, begin, end = (np.array(x) for x in zip(*rows, strict=True))
        sizes = np.array([min(len(texts[i]), e + 2 * width) - a for i, a, _, e in rows])
        ends = np.cumsum(sizes)
        first, last, at, key = _anchors(buf, ends, width)
        row = np.searchsorted(ends, first, side="right")
        shift = offset[row] - (ends[row] - sizes[row])
        mine = (at + shift >= begin[row]) & (at + shift < end[row])
        first, last, key, row, shift = first[mine], last[mine], key[mine], row[mine], shift[mine]
        view = memoryview(joined)
        digest, stop = xxhash.xxh3_64_intdigest, last + width
        s = np.fromiter((digest(view[a:b]) for a, b in zip(first.tolist(), stop.tolist(), strict=True)), np.uint64, len(first))
        parts.append((key.view(np.int64), s.view(np.int64), ids[which[row]], first + shift, (stop - first).astype(np.int32), which[row].astype(np.int32)))
    cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 4 + [np.empty(0, np.int32)] * 2
    return pd.DataFrame(dict(zip(("k", "s", "doc_id", "lo", "len"), cols[:5], strict=True))), cols[5]


def _merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of a document made one."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    if not len(doc):
        return doc, lo, hi
    group = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])
    reach = np.maximum.accumulate(hi + group * (int(hi.max()) + 2)) - group * (int(hi.max()) + 2)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (lo[1:] > reach[:-1])])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(doc) - 1]])
    return doc[new], lo[new], reach[last]


def _together(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Ids and texts of a batch, about TOGETHER bytes at a time."""
    ids, texts, start, size = pdf["doc_id"].to_numpy(np.int64), [], 0, 0
    for i, t in enumerate(pdf["t"], 1):
        texts.append(t.encode("utf-8", "surrogatepass"))
        size += len(texts[-1])
        if size >= TOGETHER or i == len(ids):
            yield ids[start:i], texts
            texts, start, size = [], i, 0


def segments(width: int):
    """mapInPandas function: rows (k, s, doc_id, lo, len); k null: the span is already known to be a repeat, and its bytes have been compared."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, texts in _together(pdf):
                seg, text = _segments(ids, texts, width)
                order = np.lexsort((seg["doc_id"], seg["s"], seg["k"]))
                k, s, doc = (seg[c].to_numpy()[order] for c in ("k", "s", "doc_id"))
                new = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])])[: len(k)]
                first = order[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
                alike = np.flatnonzero(doc > seg["doc_id"].to_numpy()[first])
                lo, size = seg["lo"].to_numpy(), seg["len"].to_numpy()
                known = np.zeros(len(seg), bool)
                for i, j in zip(order[alike].tolist(), first[alike].tolist(), strict=True):
                    known[i] = texts[text[i]][lo[i] : lo[i] + size[i]] == texts[text[j]][lo[j] : lo[j] + size[j]]
                for i in range(0, len(seg), 1 << 17):
                    yield seg[i : i + (1 << 17)][~known[i : i + (1 << 17)]]
                t, lo, hi = _merged(text[known].astype(np.int64), lo[known].astype(np.int64), (lo + size)[known].astype(np.int64))
                s = [_digest(texts[i][a:b]) for i, a, b in zip(t.tolist(), lo.tolist(), hi.tolist(), strict=True)]
                yield pd.DataFrame({"k": pd.array([None] * len(t), dtype="Int64"), "s": np.array(s, np.int64), "doc_id": ids[t], "lo": lo, "len": (hi - lo).astype(np.int32)})

    return run


def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows sorted by (k, s, doc_id): repeats as (doc_id, lo, len, s, null) and segments still to compare as (doc_id, lo, len, s, k).

    Only the first document and segment of the anchor at hand, and its rows if all of them are of one document, are kept between batches.
    """
    now = None  # anchor, segment, its least document, first document of the anchor, whether several documents have come
    waiting: list[pd.DataFrame] = []
    for pdf in batches:
        known = pdf["k"].isna().to_numpy()
        if known.any():
            yield pdf.loc[known, ["doc_id", "lo", "len", "s"]].assign(k=pd.array([None] * int(known.sum()), dtype="Int64"))
        pdf = pdf[~known]
        n = len(pdf)
        if not n:
            continue
        k, s, doc = (pdf[c].to_numpy(np.int64) for c in ("k", "s", "doc_id"))
        new_k = np.concatenate([[now is None or now[0] != k[0]], k[1:] != k[:-1]])
        new_s = new_k | np.concatenate([[now is None or now[1] != s[0]], s[1:] != s[:-1]])
        at_s = np.maximum.accumulate(np.where(new_s, np.arange(n), -1))
        least = np.where(at_s >= 0, doc[at_s], now[2] if now else 0)
        repeat = doc > least
        if repeat.any():
            yield pdf.loc[repeat, ["doc_id", "lo", "len", "s"]].assign(k=pd.array([None] * int(repeat.sum()), dtype="Int64"))
        at_k = np.maximum.accumulate(np.where(new_k, np.arange(n), -1))
        head = np.where(at_k >= 0, doc[at_k], now[3] if now else 0)
        group = np.cumsum(new_k)  # 0: the anchor carried over
        several = np.zeros(group[-1] + 1, bool)
        np.logical_or.at(several, group, ~repeat & (doc != head))
        several[0] |= bool(now and now[4])
        if waiting and (group[0] > 0 or several[0]):
            if several[0]:
                yield from waiting
            waiting = []
        out = pdf.loc[~repeat, ["doc_id", "lo", "len", "s", "k"]].astype({"k": "Int64"})
        g = group[~repeat]
        if (ready := several[g]).any():
            yield out[ready]
        if not several[-1] and (tail := (g == group[-1])).any():
            waiting.append(out[tail])
        now = (k[-1], s[-1], least[-1], head[-1], bool(several[-1]))


class Prefixes:
    """Prefix polynomial hashes of a buffer: equality of any two substrings in constant time."""

    def __init__(self, buf: np.ndarray):
        self.buf, n = buf, len(buf)
        self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, BASE), dtype=np.uint64)])
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.power[:n], dtype=np.uint64)])

    def of(self, a: np.ndarray, length: int) -> np.ndarray:
        """Hash of the substring of this length at each place, wherever it lies in the buffer."""
        return (self.sums[a + length] - self.sums[a]) * self.power[len(self.power) - 1 - a]

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Length of the common extension of the suffixes at a and b, up to ``most``, by binary search."""
        low, high = np.minimum(a, b), np.maximum(a, b)
        shift, from_low, from_high = self.power[high - low], self.sums[low], self.sums[high]
        reach = np.zeros(len(a), np.int64)
        for bit in range(most.bit_length() - 1, -1, -1):
            longer = reach + (1 << bit)
            tried = np.minimum(longer, most)
            same = (self.sums[low + tried] - from_low) * shift == self.sums[high + tried] - from_high
            reach = np.where(same, tried, reach)
        return reach

    def before(self, a: np.ndarray, b: np.ndarray, most: int, ties: np.ndarray | bool) -> np.ndarray:
        """Whether the suffix at a comes before that at b by its first ``most`` bytes; ``ties`` where they are equal."""
        reach = self.common(a, b, most)
        at = np.minimum(reach, most - 1)
        return np.where(reach < most, self.buf[a + at] < self.buf[b + at], ties)


def suffix_order(hashes: Prefixes, starts: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """Order of suffixes by (group, first ``width`` bytes): merge sort of the runs of each group, all groups at once. ``group`` must not fall."""
    n = len(starts)
    order, index = np.arange(n), np.arange(n)
    bounds = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))[: n or 0]
    sizes = np.diff(np.concatenate([bounds, [n]]))
    begin = np.repeat(bounds, sizes)
    end = begin + np.repeat(sizes, sizes)
    run = 1
    while True:
        longer = end - begin > run  # groups of one run are in order
        index, begin, end = index[longer], begin[longer], end[longer]
        if not len(index):
            return order
        rank = index - begin
        left = (rank // run) % 2 == 0
        base = index - rank % (2 * run)  # where the two runs that meet begin
        other_lo = np.minimum(np.where(left, base + run, base), end)
        other_hi = np.minimum(np.where(left, base + 2 * run, base + run), end)
        lo, hi, mine = other_lo.copy(), other_hi.copy(), starts[order[index]]
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            goes = hashes.before(starts[order[mid]], mine[open_], width, ~left[open_])
            lo[open_], hi[open_] = np.where(goes, mid + 1, lo[open_]), np.where(goes, hi[open_], mid)
        merged = order.copy()
        merged[index + (lo - other_lo) - np.where(left, 0, run)] = order[index]
        order, run = merged, run * 2


def _shared(anchor: np.ndarray, part: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which rows have an anchor and part that another document has too."""
    out = np.zeros(len(doc), bool)
    order = np.lexsort((doc, part, anchor))
    new = np.concatenate([[True], (anchor[order][1:] != anchor[order][:-1]) | (part[order][1:] != part[order][:-1])])[: len(order)]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(order) - 1]])[: len(first)]
    out[order] = np.repeat(doc[order][first] != doc[order][last], last - first + 1)
    return out


def repeated_windows(snippets: list[bytes], anchor: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """For snippets grouped by anchor (not falling): 1 for each window, in the order of snippets, that a snippet of a smaller document of its group has too.

    Windows of a group are compared where they lie alike around the anchor, given by the snippet's own anchor place. A
    window reaches ``near`` bytes or more beyond the anchor's gram to the left, or more than the rest of its width to the
    right: so only those go into the sort whose snippet shares that side of the anchor with another document.
    """
    buf = np.frombuffer(b"".join(snippets) + bytes(1), np.uint8)
    sizes = np.fromiter(map(len, snippets), np.int64, len(snippets))
    ends = np.cumsum(sizes)
    windows = sizes - width + 1
    out = np.zeros(int(windows.sum()), bool)
    _, _, at, _ = _anchors(buf[:-1], ends, width)
    place = at - (ends - sizes)  # one segment each, so one anchor each
    hashes = Prefixes(buf)
    near = (width - GRAM + 1) // 2
    beyond = width - GRAM - near + 1
    sides = np.zeros((2, len(sizes)), bool)
    for side, (fits, start, length) in enumerate(((place >= near, at - near, near + GRAM), (at + GRAM + beyond <= ends, at, GRAM + beyond))):
        i = np.flatnonzero(fits)
        sides[side, i] = _shared(anchor[i], hashes.of(start[i], length), doc[i])
    owner = np.repeat(np.arange(len(snippets)), windows)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    asked = np.flatnonzero(np.where(place[owner] - within >= near, sides[0, owner], sides[1, owner]))
    owner, within = owner[asked], within[asked]
    starts, lie = (ends - sizes)[owner] + within, place[owner] - within
    group = np.lexsort((lie, anchor[owner]))
    a, b = anchor[owner][group], lie[group]
    gid = np.cumsum(np.concatenate([[0], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))[: len(group)]
    order = group[suffix_order(hashes, starts[group], gid, width)]  # groups keep their places
    one, two = starts[order][:-1], starts[order][1:]
    same = (gid[1:] == gid[:-1]) & (hashes.of(one, width) == hashes.of(two, width))
    strings = np.lib.stride_tricks.sliding_window_view(buf, width) if len(buf) >= width else np.empty((0, width), np.uint8)
    alike = np.flatnonzero(same)
    for i in range(0, len(alike), 100_000):  # verified byte by byte: no hash collision gets through
        cut = alike[i : i + 100_000]
        same[cut] = (strings[one[cut]] == strings[two[cut]]).all(axis=1)
    klass = np.concatenate([[0], np.cumsum(~same)])[: len(order)]
    d = doc[owner][order]
    least = np.full(int(klass[-1]) + 1 if len(klass) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, klass, d)
    out[asked[order]] = d > least[klass]
    return out


def _window_spans(hit: np.ndarray, doc: np.ndarray, lo: np.ndarray, snippets: list[bytes], width: int) -> pd.DataFrame:
    windows = np.fromiter(map(len, snippets), np.int64, len(snippets)) - width + 1
    owner = np.repeat(np.arange(len(doc)), windows)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    i = np.flatnonzero(hit)
    j, a, b = _merged(owner[i], within[i], within[i] + width)
    s = [_digest(snippets[x][y:z]) for x, y, z in zip(j.tolist(), a.tolist(), b.tolist(), strict=True)]
    return pd.DataFrame({"doc_id": doc[j], "lo": lo[j] + a, "len": (b - a).astype(np.int32), "s": np.array(s, np.int64)})


def repeats(width: int, most: int = 4000):
    """mapInPandas function over (k, doc_id, lo, snippet) sorted by k: spans of windows that a smaller document of the anchor has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush():
            pdf = pd.concat(held, ignore_index=True)
            held.clear()
            doc, lo = pdf["doc_id"].to_numpy(np.int64), pdf["lo"].to_numpy(np.int64)
            snippets = list(pdf["snippet"])
            hit = repeated_windows(snippets, pdf["k"].to_numpy(np.int64), doc, width)
            return _window_spans(hit, doc, lo, snippets, width)

        for pdf in whole_groups(batches, ["k"]):
            held.append(pdf)
            if sum(map(len, held)) >= most:
                yield flush()
        if held:
            yield flush()

    return run


def _digest(b: bytes) -> int:
    """The 64-bit hash of a span's bytes as a signed number."""
    return int.from_bytes(xxhash.xxh3_64_digest(b), "big", signed=True)


def _is_at(text: bytes, span: dict) -> bool:
    """Whether a text of the span's doc_id has the span's bytes there: texts that share an id don't share what they lack."""
    part = text[span["lo"] : span["lo"] + span["len"]]
    return len(part) == span["len"] and _digest(part) == span["s"]


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc, text, spots in zip(pdf["doc_id"], pdf["t"], pdf["spots"], strict=True):
            b = text.encode("utf-8", "surrogatepass")
            rows += [(x["k"], doc, x["lo"], b[x["lo"] : x["lo"] + x["len"]]) for x in spots if _is_at(b, x)]
        yield pd.DataFrame(rows, columns=["k", "doc_id", "lo", "snippet"])


def _windows(width: int):
    """mapInPandas function over (k, n, doc_id, lo, snippet), n windows of the anchor in all: its windows, dealt by their bytes into groups of about GROUP.

    Of equal windows of one snippet batch the least document's goes on, and the others are repeats (k null).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            least: dict[tuple[int, int, bytes], tuple[int, list[int]]] = {}
            rows = []
            for k, n, doc, lo, b in zip(pdf["k"], pdf["n"], pdf["doc_id"], pdf["lo"], pdf["snippet"], strict=True):
                parts = 1 + int(n) // GROUP
                for i in range(len(b) - width + 1):
                    w = b[i : i + width]
                    first, places = least.setdefault((k, xxhash.xxh3_64_intdigest(w) % parts, w), (doc, []))
                    if doc == first:
                        places.append(lo + i)
                    elif doc > first:
                        rows.append((None, doc, lo + i, w))
                    else:
                        rows += [(None, first, at, w) for at in places]
                        least[k, xxhash.xxh3_64_intdigest(w) % parts, w] = (doc, [lo + i])
            for (k, part, w), (doc, places) in least.items():
                group = int.from_bytes(xxhash.xxh3_64_digest(k.to_bytes(8, "little", signed=True) + part.to_bytes(8, "little")), "little", signed=True)
                rows += [(group, doc, at, w) for at in places]
            yield pd.DataFrame(rows, columns=["k", "doc_id", "lo", "snippet"]).astype({"k": "Int64"})

    return run


SPANS = "doc_id long, lo long, len int, s long"


def _window_hashes(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lo": pdf["lo"], "len": np.full(len(pdf), width, np.int32), "s": np.array([_digest(w) for w in pdf["snippet"]], np.int64)})

    return run


def repeated_spans(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, lo, len, s): spans whose every byte lies in a ``width``-byte string that also starts in a document with a smaller doc_id. Spans may overlap.

    s is the hash of a span's bytes, which tells texts of one doc_id apart.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t")).where("doc_id is not null and octet_length(t) >= %d" % width)
    settled = rows.mapInPandas(segments(width), SEGMENTS).repartition(F.coalesce("k", F.xxhash64("doc_id"))).sortWithinPartitions("k", "s", "doc_id").mapInPandas(settle, "doc_id long, lo long, len int, s long, k long")
    settled = materialise(settled, "settled")
    whole, open_ = settled.where("k is null").drop("k"), settled.where("k is not null")
    spots = open_.groupBy("doc_id").agg(F.collect_list(F.struct("k", "lo", "len", "s")).alias("spots"))  # as many as the document's own bytes allow
    snippets = materialise(rows.join(spots, "doc_id").mapInPandas(_cut, "k long, doc_id long, lo long, snippet binary"), "snippets")
    heavy = snippets.groupBy("k").agg(F.count("*").alias("rows"), F.sum(F.octet_length("snippet") - width + 1).alias("n")).where(F.col("rows") > GROUP)
    heavy = materialise(heavy.select("k", "n"), "heavy")
    if not heavy.isEmpty():  # no anchor's snippets meet in one group of any size: its windows are dealt by their bytes
        windows = materialise(snippets.join(heavy, "k").select("k", "n", "doc_id", "lo", "snippet").mapInPandas(_windows(width), "k long, doc_id long, lo long, snippet binary"), "windows")
        whole = whole.unionByName(windows.where("k is null").mapInPandas(_window_hashes(width), SPANS))
        snippets = snippets.join(heavy, "k", "left_anti").unionByName(windows.where("k is not null"))
    return whole.unionByName(snippets.repartition("k").sortWithinPartitions("k").mapInPandas(repeats(width), SPANS))


def without(text: bytes, spans) -> tuple[bytes, int]:
    """What is left of a text without those spans whose bytes it has, and the number of maximal runs removed."""
    own = [(x["lo"], x["lo"] + x["len"]) for x in spans if _is_at(text, x)] if spans is not None else []
    lo, hi = np.array(own, np.int64).reshape(-1, 2).T
    _, lo, hi = _merged(np.zeros(len(lo), np.int64), lo, hi)
    edges = [0, *np.stack([lo, hi], 1).ravel().tolist(), len(text)]
    return b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)), len(lo)


def _strip(texts: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, spans in zip(pdf["text"], pdf["_spans"], strict=True):
                b = (text or "").encode("utf-8", "surrogatepass")
                kept, n = without(b, spans)
                rows.append((len(b), len(b) - len(kept), n, kept.decode("utf-8", "ignore") if texts else hashlib.sha256(kept).hexdigest()))
            cols = ("n_bytes", "n_removed", "n_spans", "kept")
            yield pdf.drop(columns="_spans").assign(**dict(zip(cols, map(list, zip(*rows, strict=True)), strict=True)) if rows else dict.fromkeys(cols, []))

    return run


def remove_repeats(docs: DataFrame, width: int = 50, texts: bool = True, with_columns: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): what is left of every row's text, without bytes of characters cut in two; or, without ``texts``, the SHA-256 of the bytes left.

    ``with_columns`` keeps the columns of ``docs`` beside these. Rows that repeat a doc_id and text are one
    document, and of rows of one doc_id with other texts each loses what it itself repeats of smaller ids. Null text counts as empty; a row with null doc_id
    is kept whole and repeats nothing. Texts below ``width`` bytes stay. Empty tables give empty results.
    """
    spans = repeated_spans(docs, width).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "len", "s")).alias("_spans"))
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long")) if with_columns else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.join(spans, "doc_id", "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_spans") + ", n_bytes long, n_removed long, n_spans long, kept string"
    out = rows.mapInPandas(_strip(texts), schema)
    return out if with_columns else out.drop("text")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False).withColumnRenamed("kept", "kept_sha256")
