"""Conversation structure repair: the cheapest edits that give turns an order of roles, by Dijkstra on an implicit lattice.

A node is (turns read, what the grammar has seen last); edges keep, rerole or delete the next turn or insert an empty one.
Nodes leave the queue by (cost, audit), the audit being the initials of the edits so far, and the first accepting end node
that does ends the search. No audit at a node is the beginning of another of the same cost there, since only inserts
read no turn and they aren't free; so the least audit of a node is part of the least audit beyond it.

Turns are sorted over all tasks, so a conversation of any size is spread over many of them and read in blocks of bounded
size. A conversation within a block is searched and finished there. Of a longer one each block gives the cheapest edits
from every grammar state to every other, a pass over these few numbers a block chooses among them, and the texts of the
chosen turns are joined back. Only the digest of a conversation is one stream, since it is sequential by definition.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

#: Costs of edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Grammar states: nothing yet, after system, after user, after assistant. A turn that is inserted or given another role leads from each to the one of AFTER.
STATES, AFTER, ENDS = 4, (2, 2, 3, 2), (0, 3)
ROLES = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\x0c\r"
#: Turns, and bytes of text, of a block; a turn is never split.
BLOCK, BYTES = 256, 4 << 20

#: A turn as the search sees it: initial of the role, fault ("" none, "t" truncated, "x" must go), number of equal turns in a row.
Item = tuple[str, str, int]


def kept_state(state: int, initial: str) -> int | None:
    """State after a turn that keeps its role, or None where it can't stand."""
    if initial == "s" and state == 0:
        return 1
    if initial == "u" and state != 2:
        return 2
    if initial == "a" and state == 2:
        return 3
    return None


def search(items: list[Item], entry: int, last: bool) -> dict[int, tuple[int, str]]:
    """State at the end -> (cost, audit) of the cheapest edits. With ``last`` the one accepting state popped first; otherwise all states, without inserts behind the last turn.

    Equal turns in a row that must go are one step and one initial here: an insert among them could as well follow them.
    """
    heap, done, out = [(0, "", 0, entry)], set(), {}
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        end = i == len(items)
        if end and not last:
            out[state] = (cost, audit)
            continue
        if end and state in ENDS:
            return {state: (cost, audit)}
        heapq.heappush(heap, (cost + INSERT, audit + "I", i, AFTER[state]))
        if end:
            continue
        initial, fault, n = items[i]
        heapq.heappush(heap, (cost + DELETE * n, audit + "D", i + 1, state))
        if fault == "x":
            continue
        stays = cost + TRUNCATED * (fault == "t")
        to = kept_state(state, initial)
        if to is not None:
            heapq.heappush(heap, (stays, audit + "K", i + 1, to))
        heapq.heappush(heap, (stays + REROLE, audit + "R", i + 1, AFTER[state]))
    return out


def replay(items: list[Item], turns: list[tuple[str, str]], entry: int, audit: str) -> tuple[str, list[tuple[str, str]]]:
    """The audit with an initial for each turn, and the roles and texts that its edits leave; inserts may follow the last turn."""
    state, i, out, full = entry, 0, [], []
    for edit in audit:
        if edit == "I":
            state = AFTER[state]
            out.append((ROLES[state], ""))
            full.append("I")
            continue
        if edit == "D":
            full.append("D" * items[i][2])
        else:
            role, text = turns[i]
            state = kept_state(state, items[i][0]) if edit == "K" else AFTER[state]
            out.append((role if edit == "K" else ROLES[state], text))
            full.append(edit)
        i += 1
    return "".join(full), out


class Digest:
    """SHA-256 of ``role:text`` lines, joined by line feeds."""

    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def add(self, turns: list[tuple[str, str]]) -> None:
        for role, text in turns:
            self.sha.update(("\n" * self.any + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.any = True


class Block:
    """Turns of one conversation in order, and what they count."""

    def __init__(self, conv: int | None, seq: int):
        self.conv, self.seq, self.items, self.turns, self.bytes = conv, seq, [], [], 0
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.places: list[int | None] = []

    def add(self, turn: int | None, role: str, text: str, n: int, later: bool) -> None:
        """A turn that comes ``n`` times in a row; ``later``: its role and text were there at an earlier turn."""
        bare = text.rstrip(SPACE)
        items: list[Item] = []
        if not bare:
            self.count["blank"] += n
            items.append((role[:1], "x", n))
        else:
            copies = n - 1 + later
            if not later:
                cut = bare[-1] not in ".!?"
                self.count["truncated"] += cut
                items.append((role[:1], "t" * cut, 1))
            if copies:
                self.count["duplicate"] += copies
                items.append((role[:1], "x", copies))
        if self.items:
            self.count["illegal"] += self.items[-1][0] + role[:1] not in LEGAL
        self.count["illegal"] += n - 1  # a role after itself
        self.items += items
        self.turns += [(role, text)] * len(items)
        self.bytes += len(text) + 50
        self.places.append(turn)

    @property
    def full(self) -> bool:
        return len(self.items) >= BLOCK or self.bytes >= BYTES

    def row(self, part: int, whole: bool) -> dict:
        known = [t for t in self.places if t is not None]
        out = {"conv_id": self.conv, "part": part, "seq": self.seq, "whole": whole, **self.count, "low": min(known, default=None), "high": max(known, default=None), "turns": len(set(known))}
        if whole:
            ((_, (cost, audit)),) = search(self.items, 0, True).items()
            audit, left = replay(self.items, self.turns, 0, audit)
            digest = Digest()
            digest.add(left)
            return out | {"cost": cost, "audit": audit, "repaired_sha256": digest.sha.hexdigest()}
        costs, edits = [], []
        for entry in range(STATES):
            found = search(self.items, entry, False)
            costs += [found[s][0] if s in found else None for s in range(STATES)]
            edits += [found[s][1] if s in found else None for s in range(STATES)]
        return out | {
            "initials": [i for i, *_ in self.items], "faults": [f for _, f, _ in self.items], "runs": [n for *_, n in self.items], "roles": [r for r, _ in self.turns], "texts": [t for _, t in self.turns],
            "first_turn": self.places[0], "last_turn": self.places[-1], "first": self.items[0][0], "last": self.items[-1][0], "costs": costs, "edits": edits,
        }


_KEY = [("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64())]
_COUNTS = [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "low", "high", "turns", "cost")]
_TEXTS = [(c, pa.list_(t)) for c, t in (("initials", pa.string()), ("faults", pa.string()), ("runs", pa.int64()), ("roles", pa.string()), ("texts", pa.string()))]
_EDGES = [("first_turn", pa.int64()), ("last_turn", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("edits", pa.list_(pa.string()))]
BLOCKS = pa.schema([*_KEY, ("whole", pa.bool_()), *_COUNTS, ("audit", pa.string()), ("repaired_sha256", pa.string()), *_TEXTS, *_EDGES])
CHOICES = pa.schema([*_KEY, *_COUNTS, ("entry", pa.int32()), ("chosen", pa.string()), ("tail", pa.string())])
DONE = pa.schema([("conv_id", pa.int64()), *_COUNTS, ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} array<{names[f.type.value_type]}>" if pa.types.is_list(f.type) else f"{f.name} {names[f.type]}" for f in schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _framed(rows: Iterator[dict], schema: pa.Schema, most: int = 1000, size=lambda row: 0) -> Iterator[pa.RecordBatch]:
    held, bytes_ = [], 0
    for row in rows:
        held.append(row)
        bytes_ += size(row)
        if len(held) >= most or bytes_ >= BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, bytes_ = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted turns (part, conv_id, turn, role, text, n, later). What lies within a partition and a block is repaired at once; a partition's first and last conversation may go on in others."""

    def run() -> Iterator[dict]:
        block, opened, part = None, True, 0
        for part, conv, turn, role, text, n, later in _rows(batches):  # noqa: B007
            if block is not None and (conv != block.conv or block.full):
                goes_on = conv == block.conv
                yield block.row(part, not opened and not goes_on)
                opened, block = goes_on, Block(conv, block.seq + 1)
            if block is None:
                block = Block(conv, 0)
            block.add(turn, role, text, n, later)
        if block is not None:
            yield block.row(part, False)

    return _framed(run(), BLOCKS, size=lambda row: sum(map(len, row.get("texts") or [""])))


def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cheapest way through the blocks of each conversation, sorted by part and seq; pairs and turns that meet at the border of two blocks are put right.

    At a border no state's audit is the beginning of another's, for all have read the same turns and end with one. So
    the states' audits are ranked once, and ranks and a block's own edits compare as whole audits do.
    """

    def ended(path: list, rows: list) -> Iterator[dict]:
        _, state, tail = min((c + extra, rank, s, tail) for s, (c, rank) in path[-1][0].items() for extra, tail in [{0: (0, ""), 1: (2 * INSERT, "II"), 2: (INSERT, "I"), 3: (0, "")}[s]])[1:]
        rows[-1]["cost"], rows[-1]["tail"] = len(tail) * INSERT, tail
        for (_, back), row in zip(reversed(path[1:]), reversed(rows), strict=True):
            entry, cost, edits = back[state]
            row.update(entry=entry, chosen=edits, cost=row.get("cost", 0) + cost)
            state = entry
        yield from rows

    def run() -> Iterator[dict]:
        now, path, rows, before = None, [], [], None
        for conv, part, seq, blank, duplicate, truncated, illegal, low, high, turns, first_turn, last_turn, first, last, costs, edits in _rows(batches):
            if not rows or conv != now:
                if rows:
                    yield from ended(path, rows)
                now, path, rows, before = conv, [({0: (0, 0)}, None)], [], None
            if before:
                illegal += before[0] + first not in LEGAL
                turns -= before[1] is not None and before[1] == first_turn
            before = (last, last_turn)
            best = {}
            for entry, (cost, rank) in path[-1][0].items():
                for state in range(STATES):
                    own = costs[entry * STATES + state]
                    if own is not None:
                        best[state] = min(best.get(state, (cost + own + 1,)), (cost + own, rank, edits[entry * STATES + state], entry, own))
            order = sorted(best, key=lambda s: best[s][1:3])
            path.append(({s: (best[s][0], order.index(s)) for s in best}, {s: (best[s][3], best[s][4], best[s][2]) for s in best}))
            path[-2] = (None, path[-2][1])
            rows.append({"conv_id": conv, "part": part, "seq": seq, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal, "low": low, "high": high, "turns": turns})
        if rows:
            yield from ended(path, rows)

    return _framed(run(), CHOICES)


def digest_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the chosen blocks of each conversation in order: its sums, audit and digest."""

    def run() -> Iterator[dict]:
        out, digest, audit = None, None, []
        for conv, blank, duplicate, truncated, illegal, low, high, turns, cost, *rest in _rows(batches):
            if out is None or conv != out["conv_id"]:
                if out:
                    yield out | {"audit": "".join(audit), "repaired_sha256": digest.sha.hexdigest()}
                out, digest, audit = {"conv_id": conv, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "low": None, "high": None, "turns": 0, "cost": 0}, Digest(), []
            for name, more in (("blank", blank), ("duplicate", duplicate), ("truncated", truncated), ("illegal", illegal), ("turns", turns), ("cost", cost)):
                out[name] += more
            out["low"] = min((x for x in (out["low"], low) if x is not None), default=None)
            out["high"] = max((x for x in (out["high"], high) if x is not None), default=None)
            initials, faults, runs, roles, texts, entry, chosen, tail = rest
            edits, left = replay(list(zip(initials, faults, runs, strict=True)), list(zip(roles, texts, strict=True)), entry, chosen + (tail or ""))
            audit.append(edits)
            digest.add(left)
        if out:
            yield out | {"audit": "".join(audit), "repaired_sha256": digest.sha.hexdigest()}

    return _framed(run(), DONE, size=lambda row: len(row["audit"]))


def _blocks(conversations: DataFrame) -> DataFrame:
    """Blocks of all turns. Equal turns are counted before they are sorted; a turn is marked whose role and text come at an earlier turn too."""
    blank_if_null = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank_if_null("role"), blank_if_null("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("said", F.sha2(F.concat("role", F.lit("\n"), "text"), 256))
    rows = materialise(rows, "turns")
    again = rows.groupBy("conv_id", "said").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("at")).where("at > 1").select(F.col("conv_id").alias("_c"), F.col("said").alias("_said"), "first")
    rows = rows.join(again, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("said") == F.col("_said")), "left")
    rows = rows.withColumn("later", F.coalesce(F.struct("turn") > F.col("first"), F.lit(False))).select("conv_id", "turn", "role", "text", "n", "later", "said")
    rows = materialise(rows, "marked")
    order = ["conv_id", "turn", "role", "said"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "conv_id", "turn", "role", "text", "n", "later")
    return materialise(rows.mapInArrow(to_blocks, _ddl(BLOCKS)), "blocks")


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    Turns are taken by turn, nulls first, then by role and a digest of the text; equal turns at one place follow each
    other. Null roles and texts are one space, so such a text is blank. Null conv_ids are a conversation. Other columns
    play no part. An empty table gives no rows. Costs, faults and the grammar are those of the module's constants.
    """
    blocks = _blocks(conversations)
    opened = blocks.where("not whole")
    steps = [f.name for f in BLOCKS if f.name in {n for n, _ in [*_KEY, *_COUNTS, *_EDGES]} and f.name != "cost"]
    chosen = opened.select(*steps).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(choose, _ddl(CHOICES))
    chosen = materialise(chosen, "chosen")
    texts = opened.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), F.col("seq").alias("_s"), *(n for n, _ in _TEXTS))
    both = chosen.join(texts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")) & (F.col("seq") == F.col("_s")))
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").select("conv_id", *(n for n, _ in _COUNTS), *(n for n, _ in _TEXTS), "entry", "chosen", "tail")
    done = blocks.where("whole").select(*DONE.names).unionByName(both.mapInArrow(digest_blocks, _ddl(DONE)))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    return done.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with faults that depend on conv_id and turn alone: of 20 turns one is dropped, emptied, stripped of its full stops, repeated, and given to the user each. Nulls are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20).alias("_h")).where("_h <> 0")
    said = F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("_h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("_h") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), times.alias("_t")).drop("_t")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    every = rows.select(F.col("conv_id").cast("long").alias("_id")).distinct()
    out = every.join(repair(damage(rows)), F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    zeros = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("_id").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
