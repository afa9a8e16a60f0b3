"""Phrases against counting in dictionaries, and on awkward tables."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd

from riskloom.llm import phrases, pst

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, phrase string, n int"


def expected(rows, least=30, covered=80, shown=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    held = {k: c for k, c in f.items() if c >= least and len(k[1]) > 1}
    most = Counter()
    for (lang, w), c in held.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                most[lang, w[i : i + k]] = max(most[lang, w[i : i + k]], c)
    out = []
    for (lang, w), a in held.items():
        if 100 * most[lang, w] >= covered * a:
            continue
        s, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, -s, -a, " ".join(w).encode(), left, right, n[lang]))
    ranked, seen = [], Counter()
    for lang, s, a, w, left, right, size in sorted(out):
        seen[lang] += 1
        if seen[lang] <= shown:
            ranked.append((lang, seen[lang], w.decode(), -a, left, right, size, -s))
    return ranked


def mined(docs, shown=2000, **more):
    return sorted(tuple(r) for r in phrases.top(phrases.collocations(docs, **more), shown).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_same_as_dictionaries(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    assert mined(docs) == expected(rows) and mined(docs, 5, least=4, covered=50) == expected(rows, 4, 50, 5)


def test_awkward(spark):
    """Null columns, empty and very long texts and pieces, overlaps, ties, repeated rows, names of the result as columns."""
    r = random.Random(3)
    words = ["a", "B", "ß", "漢字", "Ä", "x'y", "-", "\xa0", "😀"]
    texts = [None, "", " \t ", ".,;", "a " * 5000, "na na na na. " * 40, "one two three four five\r" * 35, "Q\x0bW e " * 31] + ["".join(r.choice(words) + r.choice([" ", " ", "\t ", ". ", ",", "\n"]) for _ in range(r.randint(1, 300))) for _ in range(60)]
    rows = [(r.choice([None, "und", "", "en"]), t) for t in texts] + [("en", texts[5])] * 3
    docs = spark.createDataFrame([(None if i % 3 else i, t, lang, "p", 1) for i, (lang, t) in enumerate(rows)], SCHEMA)
    want = expected(rows)
    assert want and mined(docs) == want


def test_shards_and_windows(monkeypatch):
    """Small shards, windows of a long text and chunks give the counts of a plain search, none twice."""
    r, every = random.Random(5), np.full(1 << 21, ~np.uint64(0))
    texts = ["".join(r.choice(["a", "B", "ß", "cc"]) + r.choice([" ", " ", " ", "\t", ". "]) for _ in range(n)) for n in (3, 40, 700, 0, 1, 5, 90)]
    frame = pd.DataFrame({"lang": ["x", "y", "x", "x", "y", "z", "x"], "text": texts})
    monkeypatch.setattr(phrases, "SHARD", 64)
    monkeypatch.setattr(phrases, "CHUNK", 7)
    reader = phrases.Reader(0)
    for length in (2, 3, 4):
        want, got = Counter(), Counter()
        for lang, text in zip(frame["lang"], frame["text"], strict=True):
            for piece in text.lower().split("."):
                w = [int(reader.tokens(x.encode(), phrases.language(lang))[0][0]) for x in piece.split()]
                want.update(tuple(w[i : i + length]) for i in range(len(w) - length + 1))
        for pdf in phrases.count_phrases(0, type("B", (), {"value": [every] * (length - 1)}))(iter([frame])):
            for *w, n in pdf.itertuples(index=False):
                got[tuple(x % 2**64 for x in w)] += n
        assert got == want
    plain = Counter((lang, w) for lang, t in zip(frame["lang"], frame["text"], strict=True) for w in re.findall(r"[^ \t.]+", t.lower()))
    got = Counter()
    for pdf in phrases.count_words(0)(iter([frame])):
        for lang, word, n in zip(pdf["lang"], pdf["word"], pdf["n"], strict=True):
            got[lang, word] += n
    assert {k: n for k, n in got.items() if k[1]} == plain and got["x", ""] == sum(n for (lang, _), n in plain.items() if lang == "x")


def test_hash_clash_begins_anew(spark, monkeypatch):
    docs = spark.createDataFrame([("en", "one two " * 40), ("en", "three four. " * 40)], "lang string, text string")
    sums = phrases.count_words

    def clashing(seed):
        def run(frames):
            for pdf in sums(seed)(frames):
                yield pdf.assign(id=1) if seed == 0 else pdf
        return run

    monkeypatch.setattr(phrases, "count_words", clashing)
    assert phrases._words(docs, 30)[0] == 1


def test_large_counts_and_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert phrases.top(phrases.collocations(docs)).count() == 0
    assert phrases.top(phrases.collocations(spark.createDataFrame([(1, "a", "en", "p", 1)], SCHEMA))).count() == 0


def test_shards_are_read_and_counted_in_little_memory(monkeypatch):
    """Arrays of eight bytes for each byte of a shard, or for each pair of entries of its bitmaps, are never held whole; tokens are the same wherever a shard is cut."""
    r = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(60)])
    data = " ".join(words[r.integers(0, 60, 700_000)]).encode() + b".\n"
    every = np.full(1 << (pst.PREFIX - 6), np.uint64(2**64 - 1))
    tracemalloc.start()
    tokens, start, end = phrases.Reader(0).tokens(data, phrases.language("en"))
    read = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    found, n = phrases.Miner(tokens, [every, every]).run()
    counted = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert n.sum() == 700_000 - 2 and len(found) > 200_000 * 0.5
    assert read < 20 * len(data) and counted < 100 * len(tokens) + (60 << 20), (read / len(data), counted / len(tokens))
    monkeypatch.setattr(phrases, "PIECE", 1000)
    for a, b in zip(phrases.Reader(0).tokens(data, phrases.language("en")), (tokens, start, end), strict=True):
        assert np.array_equal(a, b)
    assert data[start[70] : end[70]] == data.split()[70]
