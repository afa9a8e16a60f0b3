"""Repair of conversations against a plain table over all edits, and on awkward rows."""

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from riskloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string, seq int"
DATA = "/root/testdata/sf0.001"
GOOD = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        bare = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def expected(turns):
    """turns in order -> all columns but conv_id, by a table of the cheapest (cost, audit, turns left) at each place and grammar state."""
    key = lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(f"{t[1]}\n{t[2]}".encode()).hexdigest())
    turns = sorted(turns, key=key)
    marks = faults(turns)
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def inserted(states):
        for _ in range(3):
            for s, (cost, audit, left) in list(states.items()):
                to = after[s]
                new = (cost + 2, audit + "I", [*left, name[to] + ":"])
                if to not in states or new[:2] < states[to][:2]:
                    states[to] = new
        return states

    now = inserted({"": (0, "", [])})
    for (_, role, text), mark in zip(turns, marks):
        then = {}

        def put(to, *new):
            if to not in then or new[:2] < then[to][:2]:
                then[to] = new

        for s, (cost, audit, left) in now.items():
            put(s, cost + 3, audit + "D", left)
            if mark not in ("blank", "duplicate"):
                more = cost + (mark == "truncated")
                if role[:1] == after[s] or (role[:1] == "s" and s == ""):
                    put(role[:1], more, audit + "K", [*left, f"{role}:{text}"])
                put(after[s], more + 2, audit + "R", [*left, f"{name[after[s]]}:{text}"])
        now = inserted(then)
    cost, audit, left = min(now[s] for s in ("", "a") if s in now)
    known = [t for t, *_ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    first = [r[:1] for _, r, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    return gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()


def whole(rows):
    by = {}
    for conv, *turn in rows:
        by.setdefault(conv, []).append(tuple(turn))
    return {conv: expected(turns) for conv, turns in by.items()}


def repaired(df):
    return {r[0]: tuple(r[1:]) for r in repair.repair(df).collect()}


def test_least_of_all_edits():
    """Every way to edit up to three turns, with up to three inserts in each gap."""
    r = random.Random(1)
    for _ in range(60):
        turns = [(i, r.choice(["user", "assistant", "system", "tool"]), r.choice(["a.", "b", " ", "c!"])) for i in range(r.randint(0, 3))]
        marks, best = faults(turns), None
        for edits in itertools.product("KDUA", repeat=len(turns)):
            if any(e != "D" and m in ("blank", "duplicate") for e, m in zip(edits, marks)):
                continue
            for gaps in itertools.product(["", "u", "a", "ua", "au", "uau"], repeat=len(turns) + 1):
                roles, audit, cost = gaps[0], "I" * len(gaps[0]), 2 * sum(map(len, gaps))
                for (_, role, _), mark, e, gap in zip(turns, marks, edits, gaps[1:]):
                    cost += 3 if e == "D" else (0 if e == "K" else 2) + (mark == "truncated")
                    roles += {"K": role[0], "D": "", "U": "u", "A": "a"}[e] + gap
                    audit += {"K": "K", "D": "D"}.get(e, "R") + "I" * len(gap)
                if GOOD.fullmatch(roles) and (best is None or (cost, audit) < best):
                    best = cost, audit
        got = expected(turns)
        assert got[5:7] == best
        block = repair.Block(0, 0)
        for t in turns:
            block.add(*t, 1, t[1:] in [x[1:] for x in turns[: t[0]]])
        assert repair.search(block.items, 0, True)[3 if "K" in best[1] or "R" in best[1] or "I" in best[1] else 0][0] == best[0]


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in repair.op12_repair(spark, DATA).collect()}
    want = {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for conv, *_ in rows}
    assert got == want | whole(damaged(rows))
    some = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, repair.damage(some).collect())) == sorted(damaged(rows))


def test_awkward(spark):
    """Null columns, equal turns, repeated rows, roles of other names, long texts, a conversation of many blocks, names of the result as columns."""
    r = random.Random(7)
    texts = [None, "", " \t\n", "yes.", "no", "Größe 漢字!", "x " * 5000, "why? "]
    roles = [None, "", "user", "assistant", "user", "assistant", "system", "tool", "umpire"]
    rows = [(r.choice([None, 1, 2, 3, 4, 5, 6, 2**60 + 1]), r.choice([None, *range(-3, 9)]), r.choice(roles), r.choice(texts)) for _ in range(300)]
    rows += [(7, i, ("user", "assistant")[i % 2] if r.random() < 0.9 else "system", f"{i}." if r.random() < 0.8 else "again.") for i in range(1500)]
    rows += [(8, None, "user", "same.")] * 700 + [(9, i, "user", "same.") for i in range(700)] + [(10, 2**62, "user", "a."), (10, 0, "assistant", "b.")]
    docs = spark.createDataFrame([(*x, "mine", 1) for x in rows], SCHEMA).repartition(6)
    full = [(c, t, *(" " if x is None else x for x in more)) for c, t, *more in rows]
    assert repaired(docs) == whole(full)
    got = sorted(map(tuple, repair.damage(docs).collect()), key=str)
    assert got == sorted(damaged(rows), key=str)


def test_dropped_and_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert repair.repair(docs).count() == 0 and repair.damage(docs).count() == 0
    assert repaired(spark.createDataFrame([(1, 0, "user", "a.", "", 1)], SCHEMA)) == {1: (0, 0, 0, 0, 0, 2, "KI", hashlib.sha256(b"user:a.\nassistant:").hexdigest())}
    assert repair.damage(docs).where(F.col("turn") > 0).columns == ["conv_id", "turn", "role", "text"]
