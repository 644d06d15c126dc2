"""Archives are read back as they were written, predicates give what Spark gives, and payloads are not read in vain."""

import base64
import gzip
import hashlib
import io
from pathlib import Path

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, Not

from codeloom.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string, payload string, headers int, `_n` int"
BASE = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, "http://a/9", "<p>same</p>"), (3, "http://a/3", "other ünï 🙂"),
    (4, None, ""), (5, "http://a/ 5\r\nX: y", None), (None, "http://a/n", "<p>same</p>"), (None, None, "alone"),
    (6, "http://b", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n"), (7, "http://c", "x" * 300_000), (8, "http://d", "twice"),
    (8, "http://d", "twice"), (10, "", "\x00\r\n"),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "t", "p", 1, 2) for r in rows], SCHEMA)


def brute(rows, least=0):
    body = lambda r: (r[2] or "").encode()
    keeper = {}
    for r in rows:
        keeper[body(r)] = max(keeper.get(body(r), -1 << 70), -1 << 70 if r[0] is None else r[0])
    out = []
    for r in rows:
        best = keeper[body(r)]
        best = None if best == -1 << 70 else best
        again = r[0] != best and len(body(r)) >= least
        out.append((r[0], len(body(r)), base64.b32encode(hashlib.sha1(body(r)).digest()).decode(),
                    "revisit" if again else "response", best if again else None))
    return sorted(out, key=str)


@pytest.fixture
def folder(spark, tmp_path):
    return str(tmp_path / "archive")


@pytest.mark.parametrize("compression", ["none", "gzip"])
@pytest.mark.parametrize("least", [0, 6])
def test_records_equal_brute_force(spark, folder, compression, least):
    rows = BASE + [(100 + k, f"http://many/{k % 3}", f"page {k % 7}") for k in range(200)]
    warc.archive(pages(spark, rows).repartition(5), folder, compression, least=least)
    told = warc.page_rows(warc.read_archive(spark, folder, payload=False))
    assert sorted(map(tuple, told.collect()), key=str) == brute(rows, least)
    full = warc.read_archive(spark, folder).filter("record_type = 'response'").collect()
    want = {(r[0], (r[2] or "").encode()) for r in rows}
    assert all((r.page_id and int(r.page_id), bytes(r.payload)) in want for r in full)
    assert all(warc.payload_digest(bytes(r.payload)) == r.payload_digest and len(r.payload) == r.payload_length for r in full)
    assert all(r.http_status == 200 for r in full)


def test_revisits_name_their_response_and_hold_no_payload(spark, folder):
    warc.archive(pages(spark, BASE), folder)
    rows = warc.read_archive(spark, folder).collect()
    ids = {r.record_id: r for r in rows if r.record_type == "response"}
    again = [r for r in rows if r.record_type == "revisit"]
    assert len(again) == 4 and all(r.payload is None for r in again)
    assert {(r.page_id, ids[r.refers_to].page_id) for r in again} == {("1", "9"), ("2", "9"), (None, "9"), ("4", "5")}
    assert {r.target_uri for r in rows if r.page_id == "5"} == {"http://a/%205%0D%0AX:%20y"}
    assert sum(r.record_type == "warcinfo" for r in rows) == len(list(Path(folder).glob("*.warc")))


def test_archives_are_what_the_format_asks_for(spark, folder):
    """Read by a few lines of plain Python: version, header block, length, two line ends."""
    warc.archive(pages(spark, BASE).coalesce(1), folder, "gzip")
    (path,) = Path(folder).glob("*.warc.gz")
    data, seen = path.read_bytes(), []
    while data:  # one gzip member per record
        member = gzip.zlib.decompressobj(31)
        text = member.decompress(data)
        data = member.unused_data
        head, body = text.split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        told = dict(line.split(": ", 1) for line in lines[1:])
        assert lines[0] == "WARC/1.1" and len(body) == int(told["Content-Length"]) + 4 and body.endswith(b"\r\n\r\n")
        seen.append(told["WARC-Type"])
    assert seen[0] == "warcinfo" and len(seen) == len(BASE) + 1


PREDICATES = [
    "record_type = 'response'", "record_type IN ('revisit', 'warcinfo')", "record_type <> 'response'", "page_id = '9'",
    "page_id IS NULL", "page_id IS NOT NULL AND content_length > 100", "NOT (page_id = '9')", "target_uri LIKE 'http://a/%'",
    "target_uri LIKE '%/1'", "target_uri LIKE '%a%'", "payload_length >= 20", "payload_length < 20 AND record_type = 'response'",
    "http_status = 200", "http_status IS NULL", "refers_to IS NOT NULL", "page_id <=> null", "target_uri NOT LIKE 'http://a%'",
    "page_id NOT IN ('1', '2')", "offset = 0", "payload IS NULL", "page_id = '9' OR payload_length = 0", "content_length <= payload_length",
]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_predicates_select_what_spark_selects(spark, folder, compression):
    warc.archive(pages(spark, BASE), folder, compression)
    plain = spark.createDataFrame(warc.read_archive(spark, folder).collect(), warc.read_archive(spark, folder).schema)
    for predicate in PREDICATES:
        got = warc.read_archive(spark, folder).filter(predicate).drop("file")
        want = plain.filter(predicate).drop("file")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), predicate


def test_pushed_predicates_leave_spark_nothing_to_filter(spark, folder):
    warc.archive(pages(spark, BASE), folder)
    plan = warc.read_archive(spark, folder).filter("record_type = 'response' AND page_id LIKE '1%'")._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan warc" in plan and "Filter " not in plan


class Counting(io.BytesIO):
    """Counts the bytes that are read, not those that are skipped."""

    taken = 0

    def readinto(self, b):
        n = super().readinto(b)
        self.taken += n
        return n


def test_unwanted_payloads_are_not_read(spark, folder):
    warc.archive(pages(spark, [(k, f"u{k}", f"{k} " * 200_000) for k in range(20)]).coalesce(1), folder)
    (path,) = Path(folder).glob("*.warc")

    def taken(filters, payload="true"):
        options = {"path": folder, "payload": payload, "fields": "Page-Id"}
        source = warc.WarcSource(options)
        schema = spark.createDataFrame([], source.schema()).schema
        reader = warc.WarcReader(options, schema)
        assert list(reader.pushFilters(filters)) == []
        raw = Counting(path.read_bytes())
        rows = list(reader._records(raw, path.name))
        return raw.taken, rows

    size = path.stat().st_size
    everything, rows = taken([])
    assert everything >= size and len(rows) == 21
    one, rows = taken([EqualTo(("page_id",), "7")])
    assert [r["page_id"] for r in rows] == ["7"] and one < size / 5
    none, rows = taken([In(("record_type",), ("response",)), Not(EqualTo(("page_id",), "3"))], payload="false")
    assert len(rows) == 19 and none < size / 5 and all(r["payload"] is None and r["payload_length"] >= 400_000 for r in rows)


def test_archives_roll_over_and_pack_into_partitions(spark, folder):
    records = warc.page_records(pages(spark, [(k, f"u{k}", f"{k} " * 5000) for k in range(60)]).coalesce(1))
    warc.register(spark)
    records.write.format("warc").mode("append").option("file_bytes", "50000").save(folder)
    files = list(Path(folder).glob("*.warc"))
    assert len(files) > 8
    one = spark.read.format("warc").load(folder)
    assert one.rdd.getNumPartitions() == 1 and one.filter("record_type = 'response'").count() == 60
    many = spark.read.format("warc").option("partition_bytes", "1").load(folder)
    assert many.rdd.getNumPartitions() == len(files) and many.filter("record_type = 'response'").count() == 60


def test_only_committed_archives_are_read(spark, folder):
    warc.archive(pages(spark, BASE[:3]), folder)
    Path(folder, "part-lost.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: resp")
    assert warc.page_rows(warc.read_archive(spark, folder)).count() == 3
    warc.archive(pages(spark, BASE[3:5]), folder)  # a second job adds
    assert warc.page_rows(warc.read_archive(spark, folder)).count() == 5
    warc.page_records(pages(spark, BASE[:1])).write.format("warc").mode("overwrite").save(folder)
    assert warc.page_rows(warc.read_archive(spark, folder)).count() == 1
    listed = warc._committed(pafs.LocalFileSystem(), folder)
    Path(folder, listed[1][0]).unlink()
    with pytest.raises(Exception, match="listed but gone"):
        warc.read_archive(spark, folder).count()


def test_foreign_archives_and_broken_ones(spark, tmp_path):
    body = b"HTTP/1.0 404 Not Found\nContent-Type: text/plain\n folded\n\nhello"
    text = (b"WARC/1.0\r\nwarc-type: response\r\nX-Own: v\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(body)
            + body + b"\r\n\r\nWARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    (tmp_path / "x.warc").write_bytes(text)
    (tmp_path / "notes.txt").write_bytes(b"no archive")
    rows = warc.read_archive(spark, str(tmp_path), fields="X-Own").orderBy("offset").collect()
    assert [(r.record_type, r.http_status, bytes(r.payload), r.x_own) for r in rows] == [("response", 404, b"hello", "v"), ("metadata", None, b"abc", None)]
    (tmp_path / "x.warc").write_bytes(text[:-9])
    with pytest.raises(Exception, match="ends early"):
        warc.read_archive(spark, str(tmp_path)).collect()
    (tmp_path / "x.warc").write_bytes(b"junk" + text)
    with pytest.raises(Exception, match="no record begins"):
        warc.read_archive(spark, str(tmp_path)).collect()


def test_empty_table(spark, folder):
    warc.archive(pages(spark, []), folder)
    assert warc.page_rows(warc.read_archive(spark, folder)).collect() == []
    renamed = pages(spark, BASE).select(F.col("page_id").alias("payload"), F.col("url").alias("_sha1"), F.col("html").alias("page"))
    other = folder + "-renamed"
    warc.archive(renamed, other, page_id="payload", url="_sha1", html="page")
    assert warc.page_rows(warc.read_archive(spark, other)).count() == len(BASE)
