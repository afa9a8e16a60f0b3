"""The training-data operators against brute force, exact round trips, and tables of awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import tiktoken

from riskloom.llm import bpe, chat, decontam, mih, minhash, pst, quality, suffix, toxicity, warc

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i}" for i in range(3000))
AWKWARD = [(0, None), (1, ""), (2, "   \n"), (3, "one"), (4, LONG), (5, LONG), (5, LONG), (None, LONG), (6, LONG + " tail"), (7, "Größe 漢字 😀 " * 9), (8, "aaaa" * 60), (9, "aaaa" * 60 + "b")]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, "k", 1, "x") for i, t in AWKWARD], "doc_id long, text string, lang string, fp int, source string")


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def shingle_components(docs, n, percent):
    sets = {}
    for i, t in docs:
        w = WORDS.findall((t or "").encode().lower())
        sets[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


def without_repeats(docs, width=50):
    first = {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            first.setdefault(b[p : p + width], i)
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < i:
                gone[p : p + width] = b"\1" * width
        runs = sum(gone[j] and (not j or not gone[j - 1]) for j in range(len(b)))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_bpe_rows_leave_in_pieces():
    """Ids of a batch of long texts aren't held all at once."""
    text = "plain words of some length, and 12345 numbers. " * 6000
    pdf = pd.DataFrame({"k": range(40), "t": [text, None] * 20})
    frames = list(bpe.encoded(bpe.Encoder(*bpe.vocabulary_file()), iter([pdf, pdf.iloc[:0]]), True))
    assert len(frames) > 3 and max(f["ids"].str.len().sum() for f in frames) < 2 * bpe.PIECE
    rows = pd.concat(frames)
    assert list(rows["k"]) == list(range(40)) and set(rows["ids"].str.len()) == {0, rows["ids"].str.len().max()}


def test_bpe_is_exact(spark, awkward, empty):
    lines, pattern = bpe.vocabulary_file()
    encoder = bpe.Encoder(lines, pattern)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=encoder.vocabulary.ranks, special_tokens={})
    got = sorted(map(tuple, bpe.encode(awkward).select("doc_id", "n_tokens", "decoded_sha256", "ids").collect()), key=str)
    want = sorted(((i, len(e), hashlib.sha256((t or "").encode()).hexdigest(), e) for i, t in AWKWARD for e in [own.encode_ordinary(t or "")]), key=str)
    assert got == want
    assert bpe.encode(empty).count() == 0


def test_prefix_table_edits():
    lines, _ = bpe.vocabulary_file()
    v, r = bpe.Vocabulary(lines), random.Random(3)
    draw = lambda n: bytes(r.choice(b"ab the\xc3\xa9") for _ in range(r.randint(0, n)))
    for _ in range(200):
        text, new = draw(50), draw(9)
        a = r.randint(0, len(text))
        b = r.randint(a, len(text))
        t = bpe.PrefixTable(v, text).edit(a, b, new)
        assert t.text == text[:a] + new + text[b:] and t.last == bpe.PrefixTable(v, t.text).last
        assert bpe.PrefixTable(v, text).append(new).last == bpe.PrefixTable(v, text + new).last


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, n, percent):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, shingle=n, percent=percent).collect()}
    assert got == shingle_components(rows(docs), n, percent)


def test_near_duplicates_awkward(awkward, empty):
    got = sorted(map(tuple, minhash.near_duplicates(awkward).collect()), key=str)
    want = shingle_components([x for x in AWKWARD if x[0] is not None], 5, 80)
    assert [g for g in got if g[0] is not None] == sorted(((i, *want[i], want[i][1] == i) for i, _ in AWKWARD if i is not None), key=str)
    assert [g[2:] for g in got if g[0] is None] == [(None, True)]
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_in_a_large_group(spark):
    """A bucket of many near copies that the least member doesn't link to all."""
    r, base = random.Random(5), [f"w{i}" for i in range(200)]
    docs = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(2, 14)):
            w[r.randrange(200)] = f"x{r.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash.near_duplicates(df, shingle=3, percent=85).collect()}
    assert got == shingle_components(docs, 3, 85)


def test_odd_sketches_estimate_similarity():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 1000).astype(np.uint64)
    for kept in (950, 850):
        b = np.concatenate([a[:kept], r.integers(0, 1 << 63, 1000 - kept).astype(np.uint64)])
        j = kept / (2000 - kept)
        apart = np.bitwise_count((minhash.odd_sketch(minhash.signature(a)) ^ minhash.odd_sketch(minhash.signature(b))).view(np.uint64)).sum()
        assert minhash.most_differing_bits(j + 0.1, 256, 512) < apart < minhash.most_differing_bits(j - 0.12, 256, 512)


def test_repeats(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r[0]: tuple(r[1:]) for r in suffix.remove_repeats(docs, texts=False).collect()}
    assert got == without_repeats(rows(docs))


def test_repeats_awkward(awkward, empty, monkeypatch):
    want = without_repeats([x for x in AWKWARD if x[0] is not None])
    got = sorted(map(tuple, suffix.remove_repeats(awkward, texts=False).collect()), key=str)
    assert [g for g in got if g[0] is not None] == sorted(((i, *want[i]) for i, _ in AWKWARD if i is not None), key=str)
    assert [g[2] for g in got if g[0] is None] == [0]
    assert suffix.remove_repeats(empty).count() == 0
    monkeypatch.setattr(suffix, "GROUP", 1)  # the same by window hashes
    assert sorted(map(tuple, suffix.remove_repeats(awkward, texts=False).collect()), key=str) == got


def test_texts_of_one_id_lose_only_what_they_repeat(spark, monkeypatch):
    r = np.random.default_rng(3)
    a, b, c = ("".join(chr(97 + x) for x in r.integers(0, 26, n)) for n in (300, 40, 100))
    inner = c + a[100:170] + c[::-1]
    docs = spark.createDataFrame([(1, a), (2, a + b), (2, c), (2, inner), (2, inner)], "doc_id long, text string")
    want = sorted([(1, a), (2, b), (2, c), (2, c + c[::-1]), (2, c + c[::-1])])
    assert sorted((x["doc_id"], x["kept"]) for x in suffix.remove_repeats(docs).collect()) == want
    monkeypatch.setattr(suffix, "GROUP", 1)
    assert sorted((x["doc_id"], x["kept"]) for x in suffix.remove_repeats(docs.repartition(5)).collect()) == want


def test_suffix_tree_scores(spark, awkward, empty):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    train = docs.where(~pst.held_out(10, 0))
    got = {r["doc_id"]: r for r in pst.score_texts(docs, train).collect()}
    parsed = {i: [*WORDS.findall((t or "").encode().lower()), None] for i, t in rows(docs)}
    counts = Counter(w for i, ws in parsed.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in parsed.items():
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert got[i]["base_score"] == pytest.approx(base, rel=1e-9)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(ws), sum(w in counts for w in ws), n)
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())
    assert pst.score_texts(awkward, train).count() == len(AWKWARD)
    assert pst.score_texts(empty, empty).count() == 0


def suffix_tree(texts):
    """The tree as dictionaries: log10 probability of a word after the words before it, and the retained contexts."""
    read = [[None, *WORDS.findall((t or "").encode().lower()), "end"] for t in texts]
    root = Counter(w for ws in read for w in ws[1:])
    n, v = sum(root.values()), len(root)
    counts, states = {}, {}
    for ws in read:
        for d in (1, 2):
            for i in range(max(1, d), len(ws)):
                counts.setdefault(tuple(ws[i - d : i]), Counter())[ws[i]] += 1

    def p(before, w):
        for d in (2, 1):
            c = tuple(before[-d:])
            if len(c) == d and c in states:
                kept, of = states[c]
                return (kept.get(w, 0) + (of - sum(kept.values()) + pst.PRIOR) * p(c[1:], w)) / (of + pst.PRIOR)
        return (root[w] + 0.1) / (n + 0.1 * (v + 1))

    for c in sorted(counts, key=len):
        kept, of = {w: k for w, k in counts[c].items() if k >= pst.LEAST}, sum(counts[c].values())
        if not kept:
            continue
        left = of - sum(kept.values())
        back = (left + pst.PRIOR) / (of + pst.PRIOR)
        gain = sum(k * math.log((k / (of + pst.PRIOR) + back * p(c[1:], w)) / p(c[1:], w)) for w, k in kept.items()) + left * math.log(back)
        if gain >= pst.GAIN:
            states[c] = (kept, of)
    return p, states, root


@pytest.mark.parametrize("most", [1 << 18, 20])  # all and some of the words and grams broadcast
def test_suffix_tree_scores_as_brute_force(spark, monkeypatch, most):
    """Scores are those of the tree held in dictionaries, in which every state is a distribution, and states of one and of two words are retained."""
    monkeypatch.setattr(pst, "FREQUENT", most)
    monkeypatch.setattr(pst, "FREQUENT_GRAMS", most)
    some = [t for _, t in sorted(rows(spark.read.parquet(f"{DATA}/documents.parquet")))[:40]]
    texts = [*some, *some[:5], *["quixq zebra quixq lorem"] * 9, "quixq", None, "", " \n", LONG]
    p, states, root = suffix_tree(texts)
    assert {len(c) for c in states} == {1, 2} and (b"zebra", b"quixq") in states
    for c in random.Random(0).sample(sorted(states, key=str), 20):
        unseen = (1 - sum((root[w] + 0.1) / (sum(root.values()) + 0.1 * (len(root) + 1)) for w in root)) / p((), b"unseen anywhere")
        assert sum(p(c, w) for w in root) + unseen * p(c, b"unseen anywhere") == pytest.approx(1)
    train = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = train.unionByName(spark.createDataFrame([(1000, "quixq zebra w1 Unseen"), (1001, None), (1002, "lorem " * 30), (1003, "zebra quixq lorem")], "doc_id long, text string"))
    got = {r["doc_id"]: r["score"] for r in pst.score_texts(docs, train).collect()}
    for i, t in rows(docs):
        ws = [None, *WORDS.findall((t or "").encode().lower()), "end"]
        assert got[i] == pytest.approx(sum(math.log10(p(ws[max(0, k - 2) : k], ws[k])) for k in range(1, len(ws))), rel=1e-9)


def test_suffix_tree_packs_what_is_not_broadcast(spark, monkeypatch):
    """Words and grams of many texts travel together, a row for each range of hashes; scores are the same in many ranges, and large ids stay what they are beside null ones."""
    texts = [t for _, t in sorted(rows(spark.read.parquet(f"{DATA}/documents.parquet")))[:60]]
    docs = spark.createDataFrame([((1 << 60) + i if i % 3 else None, t) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string").coalesce(2)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["score"])
    want = sorted(pst.score_texts(docs, docs).collect(), key=key)
    assert {r["doc_id"] for r in want} == {None} | {(1 << 60) + i for i in range(62) if i % 3}
    for name, most in (("FREQUENT", 20), ("FREQUENT_GRAMS", 20), ("RANGE", 1000)):
        monkeypatch.setattr(pst, name, most)
    got = sorted(pst.score_texts(docs, docs).collect(), key=key)
    assert len(got) == len(want) == 62
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-12)
    none = (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    shared = type("B", (), {"value": (none, none[:2], np.full(1 << (pst.PREFIX - 6), np.uint64(2**64 - 1)))})
    frame = pd.DataFrame({"row": range(60), "doc_id": range(60), "has_id": True, "t": texts})
    packed = pd.concat(pst._score(shared, 1, 1, 0.0, 5)(iter([frame])))
    assert len(packed) == 11 and packed["of"][packed["kind"] == 1].map(len).sum() == 4 * sum(len(pst.canonical(t)) + 1 for t in texts)
    table = pd.DataFrame({"kind": [1, 2], "id": [pst.END, 5], "n": [61, 0], "v": [0.5, 0.25]})
    summed = pd.concat(pst._looked_up(part, table) for _, part in packed.groupby("range"))
    assert len(summed) == 6 and len(pst._added_up(summed)) == 60  # a row for each range, not for each text there


def test_suffix_tree_gains_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    test = pst.held_out(10, 0)
    base, score = pst.score_texts(docs.where(test), docs.where(~test)).agg(pst.F.sum("base_score"), pst.F.sum("score")).first()
    assert score > base


def test_chat_round_trip(spark):
    said = ["\\### Assistant: </turn> ok", "", "\\", "### user: x", " </turn>\n", "plain " * 900]
    table = [(c, k, ("system", "user", "assistant", "a: b")[k % 4], said[(c + k) % 6]) for c in range(4) for k in range(40)] + [(9, 0, None, None), (None, 0, "user", "x")]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.samples(df, 300, 100).mapInPandas(chat.digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").collect()}
    for c in {x[0] for x in table}:
        mine = sorted(((t, r or "", x or "") for cc, t, r, x in table if cc == c))
        learnt = "".join(x for _, r, x in mine if r == "assistant")
        assert got[c]["n_turns"] == len(mine)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat.samples(df, 300, 100).where("conv_id = 1").count() > 2
    assert chat.samples(df.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u\n1", "x" * 200), (2, None, "x" * 200), (3, "u3", "short"), (4, "u4", "short"), (5, "u5", None), (6, "ü", "é" * 90), (None, "n", "x" * 200)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.archive(pages, path)
    read = spark.read.format("warc").load(path)
    got = {r["record_id"]: (r["record_type"], r["refers_to"], r["target_uri"], None if r["payload"] is None else bytes(r["payload"]).decode()) for r in read.collect()}
    assert got == {"1": ("response", None, "u\n1", "x" * 200), "2": ("revisit", "1", None, None), "3": ("response", None, "u3", "short"), "4": ("response", None, "u4", "short"), "5": ("response", None, "u5", ""), "6": ("response", None, "ü", "é" * 90), None: ("response", None, "n", "x" * 200)}
    assert read.where("record_type = 'revisit'").count() == 1
    # a loaded table serves any number of queries, in any order and side by side
    assert [read.count(), read.where("record_type = 'response'").count(), read.where("record_type = 'revisit'").union(read).count(), read.count()] == [7, 6, 8, 7]
    some = warc.read(spark, path, record_type="response", record_id=["1", "2", "3"])
    assert [some.count(), some.where("record_id = '3'").count(), some.count()] == [2, 1, 2]
    assert sorted(r["target_uri"] for r in warc.read(spark, path, target_uri=[], payload_length=["200", "5"], payloads=False).where("payload is null").collect()) == ["n", "u\n1", "u3", "u4"]
    with pytest.raises(Exception, match="not header columns"):
        warc.read(spark, path, payload="x").count()
    reader = warc.WarcReader({"path": path, "pushdown": "true"})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload",), b"x")]))
    assert len(left) == 1 and reader.tests == [("record_type", ("revisit",))]
    assert [row[0] for part in reader.partitions() for row in reader.read(part)] == ["2"]
    assert spark.read.format("warc").option("payloads", "false").load(path).where("payload is not null").count() == 0


def test_warc_of_other_writers(spark, tmp_path):
    """Members without sizes, several records in one member, and overwriting."""
    import gzip

    text = lambda i, kind, block: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{i}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    big = bytes(range(256)) * 20_000
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(text("a", "warcinfo", b"") + text("b", "response", b"two\r\n\r\nlines")) + gzip.compress(text("c", "response", big)))
    warc.register(spark)
    read = lambda: spark.read.format("warc").load(f"file://{tmp_path}")  # noqa: E731  anew for each query
    got = {r["record_id"]: (r["record_type"], r["payload_length"], r["payload"] and bytes(r["payload"])) for r in read().collect()}
    assert got == {"urn:uuid:a": ("warcinfo", 0, None), "urn:uuid:b": ("response", 12, b"two\r\n\r\nlines"), "urn:uuid:c": ("response", len(big), big)}
    assert [r["record_id"] for r in read().where("record_id = 'urn:uuid:b'").collect()] == ["urn:uuid:b"]
    pages = spark.createDataFrame([(1, "u", "x", 0), (1, "u", "x", 0)], "page_id long, url string, html string, payload int")
    warc.archive(pages, f"file://{tmp_path}")
    assert read().count() == 5
    spark.read.format("warc").load(f"file://{tmp_path}").where("record_type = 'response' and record_id = '1'").write.format("warc").mode("overwrite").save(f"file://{tmp_path}/copy")
    read().limit(1).write.format("warc").mode("overwrite").save(f"file://{tmp_path}/copy")
    assert spark.read.format("warc").load(f"file://{tmp_path}/copy").count() == 1
    warc.archive(pages.limit(0), f"file://{tmp_path}/none")
    assert spark.read.format("warc").load(f"file://{tmp_path}/none").count() == 0


def test_nearest_among_many_copies(spark):
    """A third of the rows repeat one vector; the others' neighbours are found all the same, and extra columns do no harm."""
    r = np.random.default_rng(4)
    v = r.normal(size=(900, 16))
    v[::3] = v[0]
    df = spark.createDataFrame([(i, x.tolist(), "e") for i, x in enumerate(v)], "vec_id long, embedding array<double>, rank string")
    asked = [i for i in range(900) if i % 50 == 0 and i % 3]
    got = {}
    for x in mih.nearest(df, df.where("vec_id % 50 = 0"), 20).collect():
        got.setdefault(x["query_id"], []).append(x["vec_id"])
    hits = 0
    for q in asked:
        s = v @ v[q]
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(900), -s))[:20].tolist()) & set(got[q]))
    assert hits >= 0.9 * 20 * len(asked)


def test_nearest(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(600, 16)) * r.uniform(0.5, 2, (600, 1))
    v[10] = v[11]
    table = [(i, x.tolist()) for i, x in enumerate(v)] + [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    got = {}
    for x in mih.nearest(df, df.where("vec_id % 20 = 0"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append(x["vec_id"])
    hits = 0
    for q in range(0, 600, 20):
        s = v @ v[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(600), -s))[:10].tolist()
        assert len(got[q]) == 10
        hits += len(set(want) & set(got[q]))
    assert set(got) == set(range(0, 600, 20)) and hits >= 0.9 * 300
    assert mih.nearest(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id < 5")
    assert mih.nearest(few, few.where("vec_id = 0"), 20).count() == 4


def test_toxicity_gradients():
    net, r = toxicity.Network(1), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts = [[b"aa", b"bb", b"cc"], [b"dd"] * 60]
    slots, sizes, at, mask, owner = toxicity.batch([[t[a:b] for a, b in toxicity.windows(len(t))] for t in texts], toxicity.features_of({w for t in texts for w in t}))
    x, y = net.words(slots, sizes).astype(np.float64), np.array([1.0, 0.0])

    def loss():
        logit = net.forward(net.project(x), at, mask)
        top = np.array([logit[owner == i].max() for i in range(2)])
        return np.mean(np.log1p(np.exp(top)) - y * top)

    g, dx, _ = net.gradients(x, at, mask, owner, y)
    for k in ("Wf", "Ub", "bf", "A", "v", "o"):
        i = tuple(r.integers(0, s) for s in net.p[k].shape)
        old = net.p[k][i]
        net.p[k][i] = old + 1e-3
        up = loss()
        net.p[k][i] = old - 1e-3
        down = loss()
        net.p[k][i] = old
        assert g[k][i] == pytest.approx((up - down) / 2e-3, abs=2e-4)


def test_toxicity_slots():
    words = [b"", b"a", b"abcdef", b"abcdef", b"x" * 64]
    slots, sizes = toxicity.slots_of(words)
    assert sizes.tolist() == [1 + sum(max(0, len(w) + 2 - k + 1) for k in toxicity.NGRAMS) for w in words]
    parts = np.split(slots, np.cumsum(sizes)[:-1])
    assert (parts[2] == parts[3]).all() and all((p == toxicity.slots_of([w])[0]).all() for p, w in zip(parts, words))
    assert toxicity.tokens("y" * 200) == [b"y" * 64] * 3 + [b"y" * 8]


def test_toxicity_learns_and_keeps_rows(spark, awkward, empty):
    r = random.Random(1)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(30)) + (" vilewordx" if k % 2 else "") for k in range(160)]
    net = toxicity.train(texts, np.arange(160) % 2, steps=60)
    s = toxicity.score_batch(toxicity.Projected(net), ["a b vilewordy c " * 30, "a bb ccc", "", None])
    assert s[0] > 0.7 and s[1] < 0.3 and s[2] == s[3]
    assert toxicity.score(awkward, net).count() == len(AWKWARD)
    assert toxicity.keep_below(empty, net).count() == 0 and toxicity.score(awkward, None).where("score = 0").count() == len(AWKWARD)


def test_labelled_sample_takes_equal_texts_once(spark):
    docs = spark.range(600).selectExpr("id as doc_id", "case when id < 500 then 'copied text' else concat('text ', id) end as text")
    docs = docs.unionByName(docs.where("doc_id = 0"))
    labels = spark.range(600).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    got = toxicity.labelled_sample(docs, labels, "toxic", 51)
    assert got.groupby("y")["text"].nunique().to_dict() == {0: 51, 1: 51} and len(got) == 102


def test_leaks(spark, awkward):
    r = random.Random(4)
    items = [(k, " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(30))) for k in range(6)] + [(90, None), (91, ""), (92, "tiny one"), (93, "\u6f22")]
    docs, want = [], set()
    for k in range(60):
        filler = " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(60))
        i, t = items[k % 6]
        if k % 3 == 0:
            docs.append((k, filler))
            continue
        t = list(t)
        for _ in range(len(t) // 25 if k % 3 == 1 else 0):
            t[r.randrange(len(t))] = r.choice(["", "z", "zz"])
        docs.append((k, f"{filler} {''.join(t).upper()}\n{filler}"))
        want.add((k, i))
    docs += [(99, "x TINY  one y"), (98, "a \u6f22 b")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontam.leaks(df, bench).collect()}
    assert got == want | {(99, 92), (98, 93)}
    assert [r["item_id"] for r in decontam.leaks(awkward, bench).collect()] == [93] and decontam.leaks(df, bench.limit(0)).count() == 0


@pytest.mark.parametrize("size", [100, 150, 300, 600, 1200, 3000])
def test_leaks_at_the_full_bound(size):
    """Of items edited at random places by as many edits as the bound allows, the target share is found."""
    r = random.Random(size)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(r.choices(words, k=n))[:n].strip().encode()
    bench = [text(size) for _ in range(100)]
    items, found = decontam.Items(list(range(100)), bench, 0.1), 0
    for i, item in enumerate(bench):
        edited = bytearray(item)
        for _ in range(int(0.1 * len(item))):
            at, kind = r.randrange(len(edited)), r.randrange(3)
            edited[at : at + (kind != 1)] = b"" if kind == 0 else r.choice(b"abcdefghijklmnopqrstuvwxyz").to_bytes()
        assert decontam.edit_distance(item, bytes(edited))[0] <= int(0.1 * len(item))
        found += i in {x for _, x, _ in decontam.find(items, [(text(400) + b" " + bytes(edited) + b" " + text(400)).decode()])}
    assert found >= decontam.TARGET * 100


def test_edit_distance():
    assert decontam.edit_distance(b"kitten", b"my sitting cat")[0] == 2
    assert decontam.edit_distance(b"abc", b"")[0] == 3


def test_quality(spark, awkward):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    test = pst.held_out(3, 1)
    model = quality.fit(docs.where(~test), labels.where(~test))
    got = {r["doc_id"]: r["score"] >= 0.5 for r in quality.score(docs.where(test), model).collect()}
    truth = [(r["doc_id"], r["quality"]) for r in labels.where(test).collect()]
    assert np.mean([got[i] == (y == 1) for i, y in truth]) > 0.9
    assert quality.score(awkward, model).count() == len(AWKWARD)
    assert quality.score(awkward, None).where("score = 0.5").count() == len(AWKWARD)


def test_quality_learns_from_every_unlabelled_row(spark, awkward, empty):
    """Gradients of pseudo-labels are those of all rows; long and null texts and repeated rows are among them, and copies count once among the labelled."""
    words = [("good plain words of prose ", 1), ("BAD!!! 111 $$$ ", 0)]
    docs = spark.createDataFrame([(i, words[i % 2][0] * (1 + i % 7 + 2000 * (i == 4)) + str(i // 60), "en", "web") for i in range(200)] + [(None, None, None, None), (300, None, "en", "web"), (301, "same", "en", "web"), (301, "same", "en", "web")], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, words[i % 2][1]) for i in range(60)], "doc_id long, quality int")
    table = quality.features(docs, labels)
    assert (table.count(), table.where("y is null").count()) == (204, 144)
    views = quality.co_train(table)[:2]
    x = quality.unpacked(table.where("y is null").toPandas()["x"])
    for k, by_label in enumerate(quality.gradients(table.where("y is null"), views, views)):
        said, z = views[1 - k].raw(x[1 - k]), views[k].standard(x[k])
        p = 1 / (1 + np.exp(-np.clip(z @ views[k].w, -30, 30)))
        for label, (n, g) in enumerate(by_label):
            met = (said > quality.SURE) if label else (said < -quality.SURE)
            assert n == met.sum() and g == pytest.approx((p[met] - label) @ z[met], abs=1e-6)
    assert sum(n for n, _ in by_label) > 0
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.co_train(table)).collect()}
    assert np.mean([(got[i] >= 0.5) == words[i % 2][1] for i in range(60, 200)]) > 0.95
    assert quality.fit(empty, labels) is None
    assert quality.fit(awkward, labels.limit(0)) is None


def test_history_gives_way_within_the_budget():
    f, out = chat.Formatter(300, 100), []
    for n in (60, 60, 250, 20):
        out += list(f.add("user", " ".join(["w"] * n)))
    out.append(f.close())
    sizes = [sum(len(text.split()) + 2 for _, text in chat.turns(formatted)) for _, formatted, _, _ in out]
    assert max(sizes) <= 300 and sum(len(chat.turns(formatted)) - new for _, formatted, _, new in out) == 4


def test_archive_of_a_damaged_record_is_an_error():
    import io
    import struct
    import zlib

    def member(head):
        z = zlib.compressobj(9, zlib.DEFLATED, -15)
        body = z.compress(head) + z.flush()
        size = 24 + len(body) + 8
        return b"\x1f\x8b\x08\x04" + b"\0" * 6 + struct.pack("<H2sHII", 12, b"sl", 8, size, len(head)) + body + b"\0" * 8

    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(member(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\nabc")), lambda row: True, True))
    got = warc.parse_header(b"WARC/1.1\r\ncontent-length:3\r\nWARC-TYPE:  response")
    assert got["Content-Length"] == "3" and got["WARC-Type"] == "response"


@pytest.mark.parametrize("exact", [False, True])
def test_few_rows_are_scored_one_by_one(monkeypatch, exact):
    """Rows that can't be among a query's nearest aren't scored and ordered one by one; what is found is the same."""
    r = np.random.default_rng(8)
    v = r.normal(size=(3000, 16))
    v[40:60] = v[40]
    v[5] *= 1e120
    v[7] = v[5]
    ids, asked = np.arange(3000), np.arange(0, 3000, 20)
    codes = mih.Codes(v[100:], float(np.linalg.norm(v[8:], axis=1).max()), 10)
    scored, real = [], mih.inner
    monkeypatch.setattr(mih, "inner", lambda q, x: scored.append(len(x)) or real(q, x))
    monkeypatch.setattr(mih, "CHUNK", 1000)
    frames = (pd.DataFrame({"vec_id": ids[i : i + 500], "v": list(v[i : i + 500])}) for i in range(0, 3000, 500))
    got = pd.concat(mih._search(type("B", (), {"value": (codes, asked, v[asked])}), 10, 16, exact)(frames))
    assert sum(scored) < 0.5 * len(asked) * 3000  # all of the first thousand, beside a vector of 1e120, and few of the others
    index = mih.Index(codes.of(codes.lifted(v)), codes.radius)
    for a in asked:
        at = ids if exact else index.within(codes.of(codes.lifted(v[a : a + 1], query=True))[0])
        at = at[at != a]
        s = real(v[a], v[at])
        best = np.lexsort((at, -s))[:10]
        mine = got[got["query_id"] == a].sort_values(["score", "vec_id"], ascending=[False, True])[:10]
        assert mine["vec_id"].tolist() == at[best].tolist() and mine["score"].tolist() == s[best].tolist()
