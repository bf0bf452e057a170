"""WARC archives as a Spark source and sink.

The source plans partitions from the sizes of files, takes predicates on record types and other headers down to the files,
reads a record's headers first, and steps over the payloads of records that fail them or whose payload no column asks
for. The sink gives each task files of its own and, at the end, a manifest of those that count, so that what lost or
repeated tasks have left is not read. Identical payloads are written once and revisited by the other records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull,
    IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import copied, dealt, fresh_path, hot_keys, small_batches, stored

#: Bytes of archives for each partition, bytes after which a task begins its next file, bytes of payloads in a batch.
PARTITION_BYTES, FILE_BYTES, BATCH_BYTES = 128 << 20, 128 << 20, 4 << 20
#: Groups of equal payloads up to which each executor gets them all; beyond it rows and groups meet by a shuffle.
BROADCAST_GROUPS = 200_000

#: Columns that headers give, and, after them, those that need the block. payload_bytes of a revisit is that of the payload it revisits.
HEADER_COLUMNS = "record_id string, record_type string, record_date string, target_uri string, refers_to string, payload_digest string, content_type string, block_bytes bigint"
BLOCK_COLUMNS = "payload_bytes bigint, computed_digest string, http_headers string, payload binary"
SCHEMA = f"{HEADER_COLUMNS}, {BLOCK_COLUMNS}"
# Names of the format's headers by column, its version and the profile of revisits.
HEADERS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "record_date": "WARC-Date", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type", "block_bytes": "Content-Length",
}
VERSION = "WARC/1.1"
IDENTICAL_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPES = frozenset({"response", "revisit", "request"})
NO_DATE = "1970-01-01T00:00:00Z"


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match(r"file:/[^/]", path):
        path = path[5:]
    if "://" in path:
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def digest_column(payload: Column) -> Column:
    """SHA-1 in upper-case base32: each 40 bits of the hex digest are eight of its digits."""
    said = F.sha1(payload)
    eight = [F.lpad(F.conv(F.substring(said, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*eight), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


# Reading


class _Broken(ValueError):
    pass


class Archive:
    """Records of one open file: headers first; then `block` or, without it, a step over the block at the next `headers`."""

    def __init__(self, raw, name: str, compressed: bool):
        self.file = gzip.GzipFile(fileobj=raw) if compressed else io.BufferedReader(raw, 1 << 16)
        self.name, self.seeks, self.left, self.tail = name, not compressed, 0, False

    def _fail(self, what: str) -> _Broken:
        return _Broken(f"{self.name}: {what} near byte {self.file.tell()}")

    def _skip(self, n: int) -> None:
        if self.seeks:
            self.file.seek(n, 1)
            return
        while n:
            got = self.file.read(min(n, 1 << 20))
            if not got:
                raise self._fail("a record is cut off")
            n -= len(got)

    def _end_record(self) -> None:
        if self.tail:
            self._skip(self.left)
            if self.file.read(4) != b"\r\n\r\n":
                raise self._fail("a record doesn't end with two line ends")
        self.left, self.tail = 0, False

    def headers(self) -> dict[str, str] | None:
        """The next record's headers by lower-case name, None at the end."""
        self._end_record()
        line = self.file.readline()
        while line in (b"\r\n", b"\n"):
            line = self.file.readline()
        if not line:
            return None
        if not line.startswith(b"WARC/"):
            raise self._fail("no record begins")
        found: dict[str, str] = {}
        last = ""
        while (line := self.file.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise self._fail("headers are cut off")
            said = line.decode("utf-8", "replace").rstrip("\r\n")
            if said[:1] in (" ", "\t") and last:
                found[last] += " " + said.strip()
                continue
            name, colon, value = said.partition(":")
            if colon:
                last = name.strip().lower()
                found[last] = value.strip()
        if not found.get("content-length", "").isdigit():
            raise self._fail("a record has no length")
        self.left, self.tail = int(found["content-length"]), True
        return found

    def block(self, most: int | None = None) -> bytes:
        """The rest of the record's block, or its first `most` bytes."""
        want = self.left if most is None else min(most, self.left)
        parts, n = [], want
        while n:
            got = self.file.read(n)
            if not got:
                raise self._fail("a block is cut off")
            parts.append(got)
            n -= len(got)
        self.left -= want
        return b"".join(parts)

    def http_head(self) -> bytes:
        """The HTTP header block, up to and with its empty line."""
        held = b""
        while self.left and not held.endswith(b"\r\n\r\n"):
            line = self.file.readline(self.left)
            if not line:
                raise self._fail("a block is cut off")
            held += line
            self.left -= len(line)
        return held


def _columns(found: dict[str, str]) -> dict:
    row = {c: found.get(name.lower()) for c, name in HEADERS.items()}
    row["block_bytes"] = int(row["block_bytes"])
    for c in ("record_id", "refers_to"):
        row[c] = row[c][1:-1] if row[c] and row[c][0] == "<" and row[c][-1] == ">" else row[c]
    if row["payload_digest"]:
        row["payload_digest"] = row["payload_digest"].partition(":")[2] or row["payload_digest"]
    return row


_TESTS = {
    EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
    In: lambda x, v: x in v, StringContains: lambda x, v: v in x, StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v),
}


def passes(test: Filter, row: dict) -> bool | None:
    """A pushed predicate over a record's headers, null as SQL has it."""
    if isinstance(test, Not):
        inner = passes(test.child, row)
        return None if inner is None else not inner
    x = row[test.attribute[0]]
    if isinstance(test, IsNull):
        return x is None
    if isinstance(test, IsNotNull):
        return x is not None
    if isinstance(test, EqualNullSafe):
        return x == test.value
    if x is None or getattr(test, "value", x) is None:
        return None
    return _TESTS[type(test)](x, test.value)


def _of_headers(test: Filter) -> bool:
    if isinstance(test, Not):
        return _of_headers(test.child)
    known = type(test) in _TESTS or isinstance(test, (IsNull, IsNotNull, EqualNullSafe))
    return known and len(test.attribute) == 1 and test.attribute[0] in HEADERS


@dataclass
class Files(InputPartition):
    files: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path, self.tests = schema, options["path"], []
        self.partition_bytes = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for test in filters:
            if _of_headers(test):
                self.tests.append(test)
            else:
                yield test

    def partitions(self) -> list[Files]:
        """Files in order of name, several to a partition up to its bytes; a file is never cut, since only reading finds its records."""
        planned, held, size = [], [], 0
        for name, n in archive_files(self.path):
            if held and size + n > self.partition_bytes:
                planned.append(Files(tuple(held)))
                held, size = [], 0
            held.append(name)
            size += n
        return [*planned, Files(tuple(held))] if held else planned or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        wanted = self.schema.fieldNames()
        schema = to_arrow_schema(self.schema)
        store, _ = _store(self.path)
        in_block = [c for c in wanted if c not in HEADERS]
        rows: list[dict] = []
        size = 0
        for name in partition.files:
            with store.open_input_file(name) as raw:
                archive = Archive(raw, name, name.endswith(".gz"))
                while (found := archive.headers()) is not None:
                    row = _columns(found)
                    if not all(passes(test, row) for test in self.tests):
                        continue
                    if in_block:
                        size += _read_block(archive, row, in_block)
                    rows.append({c: row[c] for c in wanted})
                    size += 200
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def _read_block(archive: Archive, row: dict, wanted: list[str]) -> int:
    """Adds the wanted columns of a record's block; returns the bytes held for them."""
    http = archive.http_head() if row["record_type"] in HTTP_TYPES and (row["content_type"] or "").startswith("application/http") else b""
    row["http_headers"] = http.decode("iso-8859-1").rstrip("\r\n") or None
    if row["record_type"] == "revisit":
        length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        row |= {"payload_bytes": int(length[1]) if length else None, "computed_digest": None, "payload": None}
        return len(http)
    row["payload_bytes"] = archive.left
    payload = archive.block() if "payload" in wanted or "computed_digest" in wanted else b""
    row["computed_digest"] = digest(payload) if "computed_digest" in wanted else None
    row["payload"] = payload
    return len(http) + (len(payload) if "payload" in wanted else 0)


def archive_files(path: str) -> list[tuple[str, int]]:
    """Names and bytes of the archives under a path: those of its manifests, or without one all with a WARC's name; a path may be one file."""
    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(f"there is no archive at {path}")
    if info.type == pyarrow.fs.FileType.File:
        return [(info.path, info.size)]
    every = [f for f in store.get_file_info(pyarrow.fs.FileSelector(at, recursive=True)) if f.type == pyarrow.fs.FileType.File]
    manifests = [f.path for f in every if f.base_name.startswith("_manifest-")]
    if not manifests:
        return sorted((f.path, f.size) for f in every if re.search(r"\.warc(\.gz)?$", f.base_name))
    listed: list[tuple[str, int]] = []
    for m in manifests:
        with store.open_input_stream(m) as f:
            listed += [(f"{at.rstrip('/')}/{name}", n) for name, n in json.loads(f.read())]
    return sorted(listed)


# Writing


def _line(name: str, value) -> str:
    """A header; what would end it early is percent-encoded."""
    return f"{name}: {re.sub(r'[\x00-\x1f\x7f]', lambda m: f'%{ord(m[0]):02X}', str(value))}\r\n"


def record(row: dict) -> bytes:
    """A record's bytes from its columns: those of the source's schema; what is missing is left out, but for type, date and id."""
    kind, payload = row.get("record_type") or "resource", row.get("payload") or b""
    size = row["payload_bytes"] if row.get("payload_bytes") is not None else len(payload)
    content_type = row.get("content_type")
    block = b"" if kind == "revisit" else payload
    if kind in HTTP_TYPES and (content_type or "application/http").startswith("application/http"):
        content_type = content_type or f"application/http; msgtype={'request' if kind == 'request' else 'response'}"
        head = row.get("http_headers") or f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}"
        block = head.encode("iso-8859-1", "replace") + b"\r\n\r\n" + block
    said = f"{VERSION}\r\n" + _line("WARC-Type", kind) + _line("WARC-Record-ID", f"<{row.get('record_id') or uuid.uuid4().urn}>") + _line("WARC-Date", row.get("record_date") or NO_DATE)
    if row.get("target_uri") is not None:
        said += _line("WARC-Target-URI", row["target_uri"])
    if row.get("refers_to") is not None:
        said += _line("WARC-Refers-To", f"<{row['refers_to']}>")
    if row.get("payload_digest") is not None:
        said += _line("WARC-Payload-Digest", f"sha1:{row['payload_digest']}")
    if kind == "revisit":
        said += _line("WARC-Profile", IDENTICAL_PAYLOAD)
    if content_type is not None:
        said += _line("Content-Type", content_type)
    said += f"Content-Length: {len(block)}\r\n\r\n"
    return said.encode("utf-8", "replace") + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.compressed = options.get("compression", "none").lower() == "gzip"
        self.file_bytes = int(options.get("filebytes", options.get("fileBytes", FILE_BYTES)))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Writes this attempt's files, under names that no other attempt has."""
        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        done: list[tuple[str, int]] = []
        out, name, size = None, "", 0

        def close() -> None:
            if out is not None:
                out.close()
                done.append((name, size))

        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= self.file_bytes:
                    close()
                    name, size = f"{uuid.uuid4().hex}.warc{'.gz' if self.compressed else ''}", 0
                    out = store.open_output_stream(f"{at.rstrip('/')}/{name}", compression=None, buffer_size=1 << 20)
                said = record(row)
                said = gzip.compress(said, 6, mtime=0) if self.compressed else said  # a member for each record, as the format has it
                out.write(said)
                size += len(said)
        close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        before = [f.path for f in store.get_file_info(pyarrow.fs.FileSelector(at)) if f.base_name.startswith("_manifest-")] if self.overwrite else []
        listed = [f for m in messages if m is not None for f in m.files]
        with store.open_output_stream(f"{at.rstrip('/')}/_manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(listed).encode())
        for old in before:
            with store.open_input_stream(old) as f:
                gone = json.loads(f.read())
            store.delete_file(old)
            for name, _ in gone:
                store.delete_file(f"{at.rstrip('/')}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, at = _store(self.path)
        for name, _ in (f for m in messages if m is not None for f in m.files):
            store.delete_file(f"{at.rstrip('/')}/{name}")


class WarcSource(DataSource):
    """`format("warc")`: a folder of .warc or .warc.gz files, or one file.

    Reading takes columns of SCHEMA, fewer by `.schema(..)`: a payload that no column needs is never read. Writing takes
    the same columns by name, any of them absent, as mode append or overwrite; option compression: none or gzip.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known, and turns on the session's filter pushdown for Python sources: Spark refuses one with filters without it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    """The records of the archives at `path`, with the columns of a DDL string out of SCHEMA."""
    register(spark)
    return spark.read.format("warc").schema(columns).load(path)


def write(records: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode(mode).options(**options).save(path)


# Pages


def deduplicated(records: DataFrame, at_least: int = 0, most_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """Responses (record_id, record_key, payload, ..) with payload_bytes, payload_digest, record_type, refers_to: the
    record with the largest `record_key` of those with equal payloads keeps the payload, the others revisit it.

    Payloads under `at_least` bytes are all responses. A null key is the smallest; rows that share the largest key are
    all responses. Only groups of two rows or more meet the rows again: each executor gets them while there are at most
    `most_groups`, beyond it rows are shuffled by digest, those of a hot payload dealt over tasks. `records` must be a
    table or a cut.
    """
    rows = records.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": digest_column(F.col("payload"))})
    held = rows.where(F.col("payload_bytes") >= at_least).groupBy("payload_digest").agg(F.count("*").alias("count"), F.max(F.struct("record_key", "record_id")).alias("top"))
    groups = stored(held.where("count > 1").select("payload_digest", "count", F.col("top.record_key").alias("top_key"), F.col("top.record_id").alias("top_id")), "payloads")
    if groups.count() <= most_groups:
        rows = rows.join(F.broadcast(groups.drop("count")), "payload_digest", "left")
    else:
        hot = hot_keys(groups, "payload_digest", records.count())
        rows = dealt(rows, "payload_digest", hot).join(copied(groups.drop("count"), "payload_digest", hot), ["payload_digest", "salt"], "left").drop("salt")
    again = F.col("top_id").isNotNull() & (F.col("payload_bytes") >= at_least) & ~F.col("record_key").eqNullSafe(F.col("top_key"))
    return rows.withColumns({
        "record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("top_id")), "payload": F.when(~again, F.col("payload")),
    }).drop("top_key", "top_id", "record_key")


PAGE = "urn:x-page:"


def archived_pages(pages: DataFrame, path: str | None = None, at_least: int = 0, **options: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): `pages` (page_id, url, html) written as WARC records and read back.

    A null html is an empty payload, a null url has no target, a null page_id is the smallest and read back as null.
    Payloads of any length are written whole; digests are those of the payloads read back, a revisit's that of its header.
    Rows that share the largest page_id of equal payloads are all responses, other repeated rows revisits. Other columns
    are ignored, an empty table gives an empty one. Without `path` the archives are written to the shared folder.
    """
    spark = pages.sparkSession
    small_batches(spark)
    path = path or fresh_path(spark, "warc")
    key = F.col("page_id").cast("bigint")
    rows = pages.select(
        key.alias("record_key"), F.concat(F.lit(PAGE), F.coalesce(key.cast("string"), F.lit(""))).alias("record_id"),
        F.col("url").cast("string").alias("target_uri"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
    )
    write(deduplicated(rows, at_least), path, **options)
    columns = "record_id string, record_type string, refers_to string, payload_digest string, payload_bytes bigint, computed_digest string"
    back = read(spark, path, columns).where(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.expr(f"try_cast(substring({c}, {len(PAGE) + 1}) as bigint)")
    return back.select(page("record_id").alias("page_id"), "payload_bytes", F.coalesce("computed_digest", "payload_digest").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))
