"""WARC archives as a Python data source: batch reader with pushed filters, and writer.

Every record is a gzip member of its own whose header states the sizes of the member (the standard's ``sl`` extra
field), so a reader inflates the record's headers only and steps over a payload it doesn't want. Archives of other
writers, whose members lack the sizes, are inflated as a stream.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from .common import scratch_path

SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, payload_length long, refers_to string, payload binary"
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length", "refers_to": "WARC-Refers-To"}
#: A file is closed once it holds this much, and a read partition takes files up to it.
FILE_BYTES = 64 << 20


def member(header: bytes, block: bytes) -> bytes:
    """One gzip member with the ``sl`` field: compressed size of the member, size of its content."""
    raw = header + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(header) + z.flush(zlib.Z_FULL_FLUSH) + z.compress(block + b"\r\n\r\n") + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


#: Ids are page ids in a name space of ours; a null one gets a name of its own and is read back as null.
NAME, NO_NAME = "urn:x-page:", "urn:x-no-page:"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(name: str, value: str | None) -> str | None:
    if name in ("record_id", "refers_to"):
        value = f"<{NO_NAME}{uuid.uuid4()}>" if value is None and name == "record_id" else value if value is None else f"<{NAME}{_escaped(value)}>"
    elif value is not None:
        value = f"sha256:{value}" if name == "payload_digest" else _escaped(str(value))
    return None if value is None else f"{HEADERS[name]}: {value}"


def _escaped(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def record(row: dict) -> bytes:
    """A WARC/1.1 record; line breaks in header values become percent codes. Null payload: none."""
    block = bytes(row["payload"]) if row["payload"] is not None else b""
    lines = [h for k in HEADERS if (h := _header(k, row[k])) is not None]
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {IDENTICAL}")
    lines.append(f"WARC-Date: {datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}")
    head = "\r\n".join(["WARC/1.1", *lines, "Content-Type: application/octet-stream", f"Content-Length: {len(block)}"]) + "\r\n\r\n"
    return member(head.encode("utf-8", "surrogatepass"), block)


#: Header names as they are written here, by their lower-case forms, in which other writers' are compared.
NAMES = {name.lower(): name for name in (*HEADERS.values(), "Content-Length")}


def parse_header(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    said = (line.partition(":") for line in lines[1:] if ":" in line)
    return {NAMES.get(name.lower(), name): value.strip(" \t") for name, _, value in said}


def _value(name: str, value: str | None) -> str | None:
    if value is None:
        return None
    if name in ("record_id", "refers_to"):
        value = value.removeprefix("<").removesuffix(">").removeprefix(NAME)
        if value.startswith(NO_NAME):
            return None
    return value.removeprefix("sha256:").replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _row(head: bytes) -> tuple[dict, int]:
    """Columns of a record's headers, and the size of its block."""
    h = parse_header(head)
    row = {k: _value(k, h.get(v)) for k, v in HEADERS.items()}
    size = int(h["Content-Length"])
    row["payload_length"] = size if row["payload_length"] is None else int(row["payload_length"])
    return row, size


def stream_records(data, start: bytes, wanted, payloads: bool) -> Iterator[tuple]:
    """Records of members without sizes, inflated as one stream; of a payload that isn't wanted nothing is kept."""
    z, raw, held = zlib.decompressobj(31), start, b""

    def more() -> bytes:
        nonlocal z, raw
        while True:
            out = z.decompress(raw, 1 << 20)
            raw = z.unused_data if z.eof else z.unconsumed_tail
            if z.eof:
                z = zlib.decompressobj(31)
            if out:
                return out
            if not raw and not (raw := data.read(1 << 20)):
                return b""

    while True:
        held = held.lstrip(b"\r\n")
        while b"\r\n\r\n" not in held:
            if not (part := more()):
                if held.strip(b"\r\n"):
                    raise ValueError("a record that is cut off")
                return
            held = (held + part).lstrip(b"\r\n")
        head, held = held.split(b"\r\n\r\n", 1)
        row, size = _row(head)
        keep = wanted(row)
        parts, left = [], size
        while left:
            if not held and not (held := more()):
                raise ValueError("a record that is cut off")
            if keep and payloads:
                parts.append(held[:left])
            left, held = left - min(left, len(held)), held[left:]
        if keep:
            yield (*(row[k] for k in HEADERS), b"".join(parts) if payloads and row["record_type"] == "response" else None)


def records(data, wanted, payloads: bool) -> Iterator[tuple]:
    """Rows of an open archive. ``wanted`` judges the parsed headers; payloads of other records, or all without ``payloads``, are not inflated."""
    while fixed := data.read(24):
        if len(fixed) < 24 or fixed[:4] != b"\x1f\x8b\x08\x04" or struct.unpack("<H2s", fixed[10:14]) != (12, b"sl"):
            yield from stream_records(data, fixed, wanted, payloads)
            return
        _, _, _, size, _ = struct.unpack("<H2sHII", fixed[10:24])
        body, z = data.read(size - 24), zlib.decompressobj(-15)
        head, rest = b"", body
        while b"\r\n\r\n" not in head:
            part = z.decompress(rest, 1024)
            if not part and not z.unconsumed_tail:
                raise ValueError("a record whose headers don't end")
            head, rest = head + part, z.unconsumed_tail
        at = head.index(b"\r\n\r\n")
        row, length = _row(head[:at])
        if wanted(row):
            payload = None
            if payloads and row["record_type"] == "response":
                payload = (head[at + 4 :] + z.decompress(rest))[:length]
            yield (*(row[k] for k in HEADERS), payload)


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payloads = options["path"], options.get("payloads", "true").lower() == "true"
        self.once = options.get("pushdown", "false").lower() == "true"
        self.tests: list[tuple[str, tuple]] = [(k, tuple(v)) for k, v in json.loads(options.get("only", "{}")).items()]
        if unknown := [k for k, _ in self.tests if k not in HEADERS]:
            raise ValueError(f"not header columns: {unknown}")

    def pushFilters(self, filters: list[Filter]):
        """With ``pushdown``, equality, membership and presence of header columns are taken; all else is left to Spark."""
        for f in filters:
            if not self.once:
                yield f
                continue
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo):
                self.tests.append((name, (f.value,)))
            elif name in HEADERS and isinstance(f, In):
                self.tests.append((name, tuple(f.value)))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((name, ()))
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        out, size = [Files([])], 0
        for f in sorted((f for f in found if f.path.endswith(".warc.gz")), key=lambda f: f.path):
            if size and size + f.size > FILE_BYTES:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(f.path)
            size += f.size
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.path)

        def wanted(row: dict) -> bool:
            return all(row[k] is not None and (not values or row[k] in values or str(row[k]) in values) for k, values in self.tests)

        for path in partition.paths:
            with store.open_input_stream(path, compression=None, buffer_size=1 << 20) as data:
                yield from records(data, wanted, self.payloads)


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class WarcWriter(DataSourceWriter):
    """Each task attempt writes under a name of its own in ``_attempts``; only what a successful attempt wrote is moved beside it."""

    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, rows: Iterator) -> Written:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(f"{root}/_attempts", recursive=True)
        paths, out, size = [], None, 0
        try:
            for row in rows:
                if out is None or size >= FILE_BYTES:
                    if out:
                        out.close()
                    paths.append(f"{root}/_attempts/{uuid.uuid4().hex}.part")
                    out, size = store.open_output_stream(paths[-1], compression=None), 0
                data = record(row.asDict())
                out.write(data)
                size += len(data)
        finally:
            if out:
                out.close()
        return Written(paths)

    def commit(self, messages: list) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if f.path.endswith(".warc.gz"):
                    store.delete_file(f.path)
        for p in (p for m in messages if m for p in m.paths):
            store.move(p, f"{root}/{p.rsplit('/', 1)[1].removesuffix('.part')}.warc.gz")
        if store.get_file_info(f"{root}/_attempts").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_attempts")  # what failed attempts left

    def abort(self, messages: list) -> None:
        store, _ = fs.FileSystem.from_uri(self.path)
        for p in (p for m in messages if m for p in m.paths):
            store.delete_file(p)


class Warc(DataSource):
    """``spark.read.format("warc").load(uri)`` and ``df.write.format("warc").mode("append").save(uri)``; option ``payloads=false`` leaves payloads null.

    Spark keeps the reader of a loaded table, with the filters that a query pushed into it, for all queries of the table.
    So predicates reach the reader by option ``only`` (see ``read``), which belongs to the load; filters that Spark finds
    in a query are taken with ``pushdown=true`` alone, for a table that is loaded anew for each query.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, payloads: bool = True, **only: str | list[str]) -> DataFrame:
    """Records of the archives under ``path`` whose header columns have one of the values named, for instance ``record_type="response"``; an empty list asks that the header is there.

    The reader parses headers, judges them, and inflates the payloads of these records only. The table may serve any number of queries.
    """
    register(spark)
    tests = {k: [v] if isinstance(v, str) else [str(x) for x in v] for k, v in only.items()}
    return spark.read.format("warc").option("payloads", str(payloads).lower()).option("only", json.dumps(tests)).load(path)


def archive(pages: DataFrame, path: str, least: int = 100) -> None:
    """Write a record for each page: of equal payloads of ``least`` bytes or more, that of the smallest page_id is a response and the others revisit it.

    Null html is empty, a null url is left out; columns beside page_id, url and html are ignored, and an empty table
    makes an archive without records. Rows repeating the smallest page_id are responses all. A null page_id is never revisited and
    its row is a response without an id. Equal payloads are found by aggregation before the shuffle, and the join
    that follows is one whose hot keys Spark can split.
    """
    register(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("string").alias("record_id"), F.col("page_id").cast("long").alias("id"), F.col("url").cast("string").alias("target_uri"), F.coalesce(F.encode("html", "utf-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_length", F.octet_length("payload").cast("long"))
    first = rows.where((F.col("payload_length") >= least) & F.col("id").isNotNull()).groupBy("payload_digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(first, "payload_digest", "left")
    revisit = (F.col("first") != F.col("id")) & (F.col("payload_length") >= least)
    out = rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first").cast("string")))
    out = out.withColumn("payload", F.when(F.col("record_type") == "response", F.col("payload")))
    out.select("record_id", "record_type", "target_uri", "payload_digest", "payload_length", "refers_to", "payload").write.format("warc").mode("append").save(path)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    if "://" not in path and not path.startswith("file:"):
        path = f"file://{path}"
    archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    read = spark.read.format("warc").load(path)
    full = F.col("record_type") == "response"
    return read.select(
        F.col("record_id").cast("long").alias("page_id"), F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(full, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to FROM f"""
