"""Byte-level BPE by prefix dynamic programming.

Every prefix of a piece has exactly one valid encoding, and that encoding ends in one token. The table keeps that
last token for each prefix: a token ending at byte ``i`` is the one if the pair it makes with the last token of the
prefix before it is one that merging would leave alone. Appending bytes therefore only adds entries, and an edit
keeps all entries before it and, once the entries after it agree with the old ones, all that follow.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back

NEVER = 1 << 40
#: Rows leave a task whenever their ids are so long as text, since ids of a whole batch take several times the memory of its texts.
PIECE = 1 << 20


class Vocabulary:
    """Ranks of byte strings; which single tokens and which neighbours merging leaves alone is learnt when asked."""

    def __init__(self, lines: bytes, bound: int = 200_000):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
        self.bytes = {i: b for b, i in self.ranks.items()}
        self.longest, self.bound = max(map(len, self.ranks)), bound
        self.pairs: dict[tuple[int, int], bool] = {}
        self._spines: dict[tuple[int, bool], list[tuple[bytes, int]]] = {}

    def spine(self, token: int, right: bool) -> list[tuple[bytes, int]]:
        """The parts at one edge of a token while merging builds it, each with the rank of the merge that ends it; empty if merging doesn't build it."""
        if (out := self._spines.get((token, right))) is None:
            whole = self.bytes[token]
            parts, edge, out = [whole[i : i + 1] for i in range(len(whole))], -1 if right else 0, []
            while len(parts) > 1:
                rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == NEVER:
                    break
                if at == (len(parts) - 2 if right else 0):
                    out.append((parts[edge], rank))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            out = self._spines[token, right] = [*out, (whole, NEVER)] if len(parts) == 1 else []
        return out

    def stands(self, token: int) -> bool:
        return bool(self.spine(token, True))

    def neighbours(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` together ends in just these two: no merge across them comes before those within them."""
        if (ok := self.pairs.get((a, b))) is None:
            left, right, i, j = self.spine(a, True), self.spine(b, False), 0, 0
            ok = bool(right)
            while ok:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                across = self.ranks.get(x + y, NEVER)
                if across < x_ends and across <= y_ends:  # at equal rank the merge further left comes first
                    ok = False
                elif x_ends == y_ends == NEVER:
                    break
                elif x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) > self.bound:
                self.pairs.clear()
            self.pairs[a, b] = ok
        return ok


class PrefixTable:
    """``last[i]``: the last token of the encoding of the first ``i + 1`` bytes."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.vocabulary, self.text, self.last = vocabulary, b"", []
        self.append(text)

    def _entry(self, end: int) -> int:
        v = self.vocabulary
        for start in range(max(0, end - v.longest), end):
            token = v.ranks.get(self.text[start:end])
            if token is not None and (v.neighbours(self.last[start - 1], token) if start else v.stands(token)):
                return token
        raise ValueError("a byte of the text is no token of the vocabulary")

    def append(self, more: bytes) -> PrefixTable:
        """Exact encoding of the longer text; entries so far stay as they are."""
        self.text += more
        for end in range(len(self.last) + 1, len(self.text) + 1):
            self.last.append(self._entry(end))
        return self

    def edit(self, start: int, stop: int, new: bytes) -> PrefixTable:
        """Replace bytes ``start:stop``. Entries are made anew from ``start`` until they agree with the old ones over a longest token's length past the edit."""
        old, shift = self.last, len(new) - (stop - start)
        self.text, self.last = self.text[:start] + new + self.text[stop:], old[:start]
        edge, agreed = start + len(new), 0
        for end in range(start + 1, len(self.text) + 1):
            self.last.append(self._entry(end))
            agreed = agreed + 1 if end > edge and self.last[-1] == old[end - 1 - shift] else 0
            if agreed > self.vocabulary.longest:
                self.last += old[end - shift :]
                break
        return self

    def ids(self) -> list[int]:
        out, end = [], len(self.text)
        while end:
            out.append(token := self.last[end - 1])
            end -= len(self.vocabulary.bytes[token])
        return out[::-1]


class Encoder(dict):
    """piece -> its ids as text, each id followed by a space; at most ``bound`` pieces are kept.

    Pieces share prefixes, so the table of last tokens is kept by prefix across pieces, with a bound of its own.
    """

    def __init__(self, lines: bytes, pattern: str, bound: int = 200_000, prefixes: int = 200_000):
        super().__init__()
        self.vocabulary, self.split, self.bound, self.prefixes = Vocabulary(lines), regex.compile(pattern).findall, bound, prefixes
        self.spelled = {str(i): b for i, b in self.vocabulary.bytes.items()}
        self.last: dict[bytes, int] = {}

    def piece(self, piece: bytes) -> list[int]:
        ranks, spelled = self.vocabulary.ranks, self.vocabulary.bytes
        if (whole := ranks.get(piece)) is not None:  # a piece that is itself a token is that token
            return [whole]
        if len(piece) > 64:
            return PrefixTable(self.vocabulary, piece).ids()
        out = []
        while piece:
            out.append(token := self.last_token(piece))
            piece = piece[: -len(spelled[token])]
        if len(self.last) > self.prefixes:
            self.last.clear()
        return out[::-1]

    def last_token(self, prefix: bytes) -> int:
        """The table entry of a prefix; entries are made when asked for, from those of shorter prefixes."""
        if (token := self.last.get(prefix)) is not None:
            return token
        ranks, pairs, vocabulary = self.vocabulary.ranks.get, self.vocabulary.pairs, self.vocabulary
        for start in range(len(prefix)):
            token = ranks(prefix[start:])
            if token is None:
                continue
            if not start:
                ok = vocabulary.stands(token)
            elif (ok := pairs.get(pair := (self.last_token(prefix[:start]), token))) is None:
                ok = vocabulary.neighbours(*pair)
            if ok:
                self.last[prefix] = token
                return token
        raise ValueError("a byte of the text is no token of the vocabulary")

    def __missing__(self, piece: str) -> str:
        ids = "".join([f"{i} " for i in self.piece(piece.encode("utf-8", "surrogatepass"))])
        if len(piece) <= 64:
            if len(self) >= self.bound:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> str:
        """Ids in decimal, joined by one space."""
        return "".join(map(self.__getitem__, self.split(text)))[:-1]

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids.split()))


def vocabulary_file(name: str = "byte_bpe_50k.tiktoken") -> tuple[bytes, str]:
    """Rank file and splitting pattern of the installed public tokenizer package; another path may be given to the operators instead."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def encoded(encoder: Encoder, batches: Iterator[pd.DataFrame], ids: bool) -> Iterator[pd.DataFrame]:
    """Rows (k, t) encoded, in frames of about PIECE characters of ids."""
    for pdf in batches:
        rows, first, size, keys = [], 0, 0, pdf["k"].to_numpy()
        for n, t in enumerate(pdf["t"], 1):
            line = encoder.encode(t or "")
            back = encoder.decode(line)
            row = (line.count(" ") + 1 if line else 0, hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(back).hexdigest())
            rows.append((*row, line) if ids else row)
            size += len(line)
            if size > PIECE or n == len(keys):
                yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]).assign(k=keys[first:n])
                rows, first, size = [], n, 0


def encode(docs: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: tuple[bytes, str] | None = None, ids: bool = True) -> DataFrame:
    """Encode every whole text; no shuffle, memory bounded by a batch of rows and the bounded caches.

    Null text counts as empty; empty text has no ids. Rows are independent: repeated rows and null keys come out as
    they went in. Returns the key, ``n_tokens``, the digests of ids and of the decoded bytes and, if asked, ``ids``.
    The rank file is broadcast: about 1 MB, whatever the data.
    """
    lines, pattern = vocabulary or vocabulary_file()
    shared = docs.sparkSession.sparkContext.broadcast(lines)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        yield from encoded(Encoder(shared.value, pattern), batches, ids)  # an encoder of this task: its caches go with it

    spark: SparkSession = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    picked = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = picked.mapInPandas(run, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string" * ids)
    names = [F.col("k").alias(key), "n_tokens", "ids_sha256", "decoded_sha256"]
    if ids:
        names.append(F.when(F.col("n_tokens") > 0, F.split("ids", " ").cast("array<int>")).otherwise(F.array().cast("array<int>")).alias("ids"))
    return out.select(*names)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), ids=False)
