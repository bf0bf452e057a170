"""The WARC source and sink: round trips, predicates, what is read and what is stepped over."""

import base64
import gzip
import hashlib
import io
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNull, Not, StringStartsWith

from corrweave.llm import warc

SCHEMA = "page_id bigint, url string, html string"


def sha1(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plain(rows, at_least=0):
    by = defaultdict(list)
    for i, _, html in rows:
        by[(html or "").encode()].append(-1 if i is None else i)
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        top = max(by[p])
        again = len(p) >= at_least and (-1 if i is None else i) != top
        out.append((i, len(p), sha1(p), "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


def found(df, **how):
    return sorted((tuple(r) for r in warc.archived_pages(df, **how).collect()), key=repr)


AWKWARD = [(1, "http://a/\r\nX: y", "<p>é☃𝔘</p>"), (2, None, None), (3, "http://b/", ""), (None, "http://c/", "<p>é☃𝔘</p>"), (4, "", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (5, "http://d/", "\r\n\r\n"), (6, "u", "x" * 3_000_000)]
AWKWARD += [(n, "http://copy/", "<p>é☃𝔘</p>") for n in range(10, 40)] + [(50, "t", "same"), (50, "t", "same"), (49, "t", "same"), (None, None, None)]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_pages_come_back(spark, compression):
    df = spark.createDataFrame(AWKWARD, SCHEMA).repartition(4).withColumns({"payload": F.lit(1), "record_type": F.lit("x"), "salt": F.lit(2)})
    df = spark.createDataFrame(df.toArrow())  # stable rows
    assert found(df, compression=compression) == plain(AWKWARD)
    assert found(df, compression=compression, at_least=10) == plain(AWKWARD, 10)
    assert found(df.limit(0), compression=compression) == []


def test_many_groups_meet_by_a_shuffle(spark):
    rows = [(i, None, f"text {i % 7}" if i % 3 else "hot") for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA).select(F.col("page_id").alias("record_key"), F.col("page_id").cast("string").alias("record_id"), F.col("html").cast("binary").alias("payload"))
    got = warc.deduplicated(df, most_groups=2).collect()
    assert sorted((int(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in got) == sorted(plain(rows))
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)


def test_all_columns_come_back(spark, tmp_path):
    rows = [("urn:x:1", "resource", "2026-01-02T03:04:05Z", "ftp://a", None, "AAAA", "text/plain", bytearray(b"\x00\xff\r\n")), ("urn:x:2", "metadata", None, None, "urn:x:1", None, None, bytearray())]
    df = spark.createDataFrame(rows, "record_id string, record_type string, record_date string, target_uri string, refers_to string, payload_digest string, content_type string, payload binary")
    warc.write(df, str(tmp_path / "a"))
    got = {r.record_id: r for r in warc.read(spark, str(tmp_path / "a")).collect()}
    assert [tuple(got[r[0]][c] for c in df.columns) for r in rows] == [rows[0], (*rows[1][:2], warc.NO_DATE, *rows[1][3:])]
    assert got["urn:x:1"].block_bytes == got["urn:x:1"].payload_bytes == 4 and got["urn:x:1"].computed_digest == sha1(b"\x00\xff\r\n")


def test_append_overwrite_and_what_lost_tasks_leave(spark, tmp_path):
    path = str(tmp_path / "a")
    df = spark.createDataFrame([("urn:x:1", "resource", bytearray(b"one"))], "record_id string, record_type string, payload binary")
    warc.write(df, path)
    warc.write(df, path)
    (tmp_path / "a" / "lost.warc").write_bytes(b"half a rec")
    assert warc.read(spark, path, "record_id string").count() == 2
    warc.write(df, path, "overwrite")
    assert [bytes(r.payload) for r in warc.read(spark, path, "payload binary").collect()] == [b"one"]
    assert sorted(p.suffix for p in (tmp_path / "a").iterdir() if not p.name.endswith(".crc")) == [".json", ".warc", ".warc"]


def test_files_are_rolled_and_planned(spark, tmp_path):
    path = str(tmp_path / "a")
    df = spark.range(40).select(F.concat(F.lit("urn:x:"), "id").alias("record_id"), F.lit("resource").alias("record_type"), F.lit("x" * 500).cast("binary").alias("payload")).coalesce(1)
    warc.write(df, path, fileBytes="2000")
    files = warc.archive_files(path)
    assert len(files) > 8 and all(n < 3000 for _, n in files)
    reader = warc.WarcReader(warc.WarcSource({}).schema() and spark.createDataFrame([], warc.SCHEMA).schema, {"path": path, "partitionBytes": "6000"})
    parts = reader.partitions()
    assert [f for p in parts for f in p.files] == [f for f, _ in files] and 1 < len(parts) < len(files)
    assert warc.read(spark, path).count() == 40


FOREIGN = (
    b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 6\r\n\r\na: b\r\n\r\n\r\n"
    b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a/\r\n folded\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: 32\r\n\r\n"
    b"HTTP/1.1 200 OK\r\nA: b\r\n\r\npayload\r\n\r\n"
    b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:2>\r\nContent-Type: text/plain\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
)


def test_foreign_archives(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "one.warc").write_bytes(FOREIGN)
    (tmp_path / "f" / "two.warc.gz").write_bytes(b"".join(map(gzip.compress, (FOREIGN[: FOREIGN.index(b"WARC/1.0\r\nwarc-type")], FOREIGN[FOREIGN.index(b"WARC/1.0\r\nwarc-type") :]))))
    (tmp_path / "f" / "notes.txt").write_text("no archive")
    rows = warc.read(spark, str(tmp_path / "f")).collect()
    assert Counter(r.record_type for r in rows) == {"warcinfo": 2, "response": 2, "resource": 2}
    for r in rows:
        if r.record_type == "response":
            assert (r.target_uri, bytes(r.payload), r.http_headers, r.payload_bytes) == ("http://a/ folded", b"payload", "HTTP/1.1 200 OK\r\nA: b", 7)
    assert warc.read(spark, str(tmp_path / "f" / "one.warc")).count() == 3
    for broken in (FOREIGN[:-3], FOREIGN[:150], FOREIGN.replace(b"Content-Length: 0", b"Content-Length: x"), b"no archive"):
        (tmp_path / "broken.warc").write_bytes(broken)
        with pytest.raises(Exception, match="broken.warc"):
            warc.read(spark, str(tmp_path / "broken.warc"), "record_type string").collect()
    with pytest.raises(Exception, match="no archive"):
        warc.read(spark, str(tmp_path / "absent")).collect()


def test_predicates_reach_the_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://{'ab'[i % 2]}/{i}", f"text {i % 6}") for i in range(60)], SCHEMA)
    warc.archived_pages(df, str(tmp_path / "p")).count()
    back = warc.read(spark, str(tmp_path / "p"))
    got = back.where((F.col("record_type") == "response") & F.col("target_uri").startswith("http://a/") & (F.col("block_bytes") > 10) & F.col("refers_to").isNull())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")
    assert got.count() == 3
    assert back.where(F.length("payload") == 6).count() == 6  # what headers don't say is Spark's to decide
    assert back.where("record_type in ('revisit', 'other') and not target_uri like 'http://a/%'").count() == 27


def test_null_predicates():
    row = {"record_type": "response", "refers_to": None}
    assert warc.passes(EqualTo(("record_type",), "response"), row) and not warc.passes(In(("record_type",), ("a", "b")), row)
    assert warc.passes(EqualTo(("refers_to",), "x"), row) is None and warc.passes(Not(EqualTo(("refers_to",), "x")), row) is None
    assert warc.passes(IsNull(("refers_to",)), row) and warc.passes(Not(StringStartsWith(("record_type",), "x")), row)


class Counting(io.BytesIO):
    taken = 0

    def readinto(self, b):
        n = super().readinto(b)
        Counting.taken += n
        return n


def test_payloads_are_stepped_over():
    said = b"".join(warc.record({"record_type": t, "record_id": f"urn:x:{t}", "payload": b"x" * 2_000_000}) for t in ("response", "resource", "response"))
    Counting.taken = 0
    archive = warc.Archive(Counting(said), "here", False)
    kinds = []
    while (found := archive.headers()) is not None:
        kinds.append(found["warc-type"])
    assert kinds == ["response", "resource", "response"] and Counting.taken < 500_000
