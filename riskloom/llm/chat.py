"""Chat formatting: conversations as training samples within a token budget.

Prefix sums of turn tokens choose spans of whole turns. Each sample opens with the conversation's system turn, repeats
the last turns before its span as far as a smaller budget allows, and carries a loss mask on the assistant turns of the
span alone: those repeated from before are masked out, so each assistant text is learnt once.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUDGET, HISTORY = 1024, 256
OPEN, CLOSE = "### ", " </turn>\n"
#: A backslash before ``###``, ``</turn>`` or a backslash marks text that only looks like a control string.
CONTROL = re.compile(r"\\|###|</turn>")
ESCAPED = re.compile(r"\\(\\|###|</turn>)")


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


def turn(role: str, text: str) -> tuple[str, int, int]:
    """Formatted turn, and where its text lies in it. A role is escaped too, its colons as well."""
    head = f"{OPEN}{escape(role).replace(':', chr(92) + ':')}: "
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts read back from a formatted sample."""
    out, at = [], 0
    mark = re.compile(r"\\(?:\\|###|</turn>|:)|(: )|(" + re.escape(CLOSE) + ")", re.S)
    while at < len(formatted):
        at += len(OPEN)
        role = None
        start = at
        for m in mark.finditer(formatted, at):
            if m[1] and role is None:
                role, start = formatted[start : m.start()], m.end()
            elif m[2]:
                out.append((unescape(role.replace("\\:", ":")), unescape(formatted[start : m.start()])))
                at = m.end()
                break
        else:
            raise ValueError("a turn that isn't closed")
    return out


class Formatter:
    """Builds the samples of one conversation turn by turn; holds at most a sample and the history it may need."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system = None
        self.past: deque = deque()  # (prefix sum before it, tokens, role, text) of turns that may be repeated
        self.span: list = []
        self.total = self.began = self.samples = 0

    def add(self, role: str, text: str):
        tokens = len(text.split()) + 2
        fixed = self.system[0] if self.system else 0
        if self.span and fixed + self._repeated() + self.total + tokens - self.began > self.budget:
            yield self.close()
        if role == "system" and self.system is None and not self.samples and not self.span:
            self.system = (tokens, role, text)
        if not self.span:
            while self.past and fixed + self.total - self.past[0][0] + tokens > self.budget:
                self.past.popleft()  # history gives way to a turn that needs the room
            self.began = self.total
        self.span.append((self.total, tokens, role, text))
        self.total += tokens

    def _repeated(self) -> int:
        return self.began - self.past[0][0] if self.past else 0

    def close(self) -> tuple:
        """The sample of the span at hand; its turns become history."""
        parts, loss, size, new = [], [], 0, 0
        before = ([self.system] if self.system and self.samples else []) + [p[1:] for p in self.past]
        for k, (_, role, text) in enumerate([*before, *(x[1:] for x in self.span)]):
            piece, a, b = turn(role, text)
            if role == "assistant" and k >= len(before):
                loss.append({"start": size + a, "stop": size + b})
            parts.append(piece)
            size += len(piece)
        new = len(before)
        self.past.extend(self.span)
        while self.past and self.total - self.past[0][0] > self.history:
            self.past.popleft()
        self.past = deque(p for p in self.past if not (self.system and p[1:] == self.system))
        out = (self.samples, "".join(parts), loss, new)
        self.samples, self.span = self.samples + 1, []
        return out


def format_samples(budget: int, history: int):
    """mapInPandas function over (conv_id, turn, role, text) sorted so: samples in order, at most one conversation's open sample in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, f = None, None
        for pdf in batches:
            out = []
            for conv, role, text in zip(pdf["conv_id"].astype("Int64"), pdf["role"], pdf["text"], strict=True):
                conv = None if conv is pd.NA else int(conv)
                if f is None or conv != now:
                    if f:
                        out.append((now, *f.close()))
                    now, f = conv, Formatter(budget, history)
                out += [(conv, *s) for s in f.add(role or "", text or "")]
            yield _frame(out)
        if f:
            yield _frame([(now, *f.close())])

    return run


def _frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "sample", "formatted", "loss", "first_new"])
    return out.assign(conv_id=out["conv_id"].astype("Int64"))


def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From samples in order: what each conversation's samples say, read back from the formatted text and the loss mask; only running digests are held."""
    now, held = None, None

    def done():
        n, seen, chars, loss, size = held
        return (now, n, seen.hexdigest(), chars, loss.hexdigest(), size)

    def frame(rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        return out.assign(conv_id=out["conv_id"].astype("Int64"))

    for pdf in batches:
        out = []
        for conv, text, loss, new in zip(pdf["conv_id"].astype("Int64"), pdf["formatted"], pdf["loss"], pdf["first_new"], strict=True):
            conv = None if conv is pd.NA else int(conv)
            if held is None or conv != now:
                if held:
                    out.append(done())
                now, held = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in turns(text)[new:]:
                held[0] += 1
                held[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            for x in loss:
                said = unescape(text[x["start"] : x["stop"]])
                held[2] += len(said)
                held[3].update(said.encode("utf-8", "surrogatepass"))
            held[4] += len(text)
        yield frame(out)
    if held:
        yield frame([done()])


def samples(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, sample, formatted, loss, first_new) of all conversations; loss spans are places in ``formatted``, first_new the first turn that isn't repeated.

    Turns are ordered by turn, role and text. Null texts and roles are empty; rows with null conv_id form one
    conversation; a turn over the budget gets a sample of its own. One shuffle by conversation, then a stream: a
    conversation of any length is read through, never held.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInPandas(format_samples(budget, history), "conv_id long, sample long, formatted string, loss array<struct<start:int,stop:int>>, first_new int")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.sql("select -7L conv_id, 0L turn, 'user' role, :t text union all select -7L, 1L, 'assistant', :t", args={"t": said})
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    return samples(rows).mapInPandas(digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
