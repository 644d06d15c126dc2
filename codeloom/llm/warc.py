"""WARC archives as a Spark data source: written by tasks, read back with predicates pushed to the headers.

`WarcSource` is a Python data source, `format("warc")`:

* Writing: every task streams its rows to archives of its own, at most about `file_bytes` long, each opened by a
  warcinfo record; with `compression=gzip` each record is a member of its own. The names of all finished archives are
  listed in one `_committed-` file when the job ends. Readers trust that list, so what lost or repeated attempts leave
  behind is never read.
* Planning a read: archives are listed once; each is read whole, small ones together up to `partition_bytes`.
* Predicates on record type and headers are taken over (`pushFilters`) and told from Spark's own. A record's header
  block is parsed first; only if these predicates hold is the HTTP head parsed; only if the rest holds, too, and the
  caller wants payloads (`payload`, true by default), are the payload's bytes read. All others are skipped: by a seek
  in plain archives; gzip members have to be inflated, but nothing of them is kept.
* `fields` names further header fields, each read as a string column (lower case, `-` as `_`) that takes predicates too.

`archive` turns pages into records: of equal payloads of at least `least` bytes, the page with the largest id is the
response and the others are revisits that name it and hold no payload; shorter payloads are all responses.

Defined cases: a null payload is empty; a null URL has no target, a null id no `Page-Id`; null ids count as smaller
than all others; rows that repeat the largest id of their payload are all responses; control characters and spaces in
a URL are percent-encoded; an empty table gives archives without such records; other columns are not read.
"""

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith,
    WriterCommitMessage)

from codeloom.session import written

VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES, PARTITION_BYTES, BATCH_BYTES = 256 << 20, 128 << 20, 4 << 20
#: columns read from the record's own header block: name, header field, type
_HEAD = [
    ("record_type", "warc-type", "string"), ("record_id", "warc-record-id", "string"), ("target_uri", "warc-target-uri", "string"),
    ("date", "warc-date", "string"), ("content_type", "content-type", "string"), ("content_length", "content-length", "long"),
    ("payload_digest", "warc-payload-digest", "string"), ("refers_to", "warc-refers-to", "string"),
]
_REST = "http_status int, payload_length long, payload binary"


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or plain path, in the driver and in tasks alike."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", uri):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
    return pafs.LocalFileSystem(), uri


# --- writing ---------------------------------------------------------------------------
def _shown(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _block(fields: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(row: dict) -> bytes:
    """One record; a revisit keeps the HTTP head, which tells the payload's length, and not the payload."""
    payload, revisit = row["payload"] or b"", row["record_type"] == "revisit"
    http = b"HTTP/1.1 200 OK\r\n" + _block([("Content-Type", row.get("mime") or "text/html; charset=utf-8"),
                                             ("Content-Length", str(len(payload)))]) + b"\r\n"
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["date"])]
    if row["target_uri"] is not None:
        fields.append(("WARC-Target-URI", _shown(row["target_uri"])))
    fields.append(("WARC-Payload-Digest", "sha1:" + payload_digest(payload)))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", row["refers_to"]), ("WARC-Truncated", "length")]
    fields += [(k, _shown(v)) for k, v in row["headers"] or [] if v is not None]
    body = http if revisit else http + payload
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    return b"".join([f"{VERSION}\r\n".encode(), _block(fields), b"\r\n", body, b"\r\n\r\n"])


def _info(date: str) -> bytes:
    body = b"software: codeloom\r\nformat: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date),
              ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(body)))]
    return b"".join([f"{VERSION}\r\n".encode(), _block(fields), b"\r\n", body, b"\r\n\r\n"])


@dataclass
class _Archives(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """rows(record_type, record_id, target_uri, date, payload, refers_to, headers map, mime if any) -> archives."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder = options["path"].rstrip("/")
        self.gzip = options.get("compression", "none") == "gzip"
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Archives:
        fs, folder = _place(self.folder)
        fs.create_dir(folder, recursive=True)
        names: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                for k in range(batch.num_rows):
                    row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                    if out is None or size >= self.file_bytes:
                        if out is not None:
                            out.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc" + (".gz" if self.gzip else ""))
                        # the name tells readers how to inflate; pyarrow must not compress by itself
                        out, size = fs.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                        size += self._put(out, _info(row["date"]))
                    size += self._put(out, record_bytes(row))
        finally:
            if out is not None:
                out.close()
        return _Archives(names)

    def _put(self, out, record: bytes) -> int:
        shown = gzip.compress(record, mtime=0) if self.gzip else record
        out.write(shown)
        return len(shown)

    def commit(self, messages: list) -> None:
        fs, folder = _place(self.folder)
        fs.create_dir(folder, recursive=True)
        old = _committed(fs, folder) if self.overwrite else None
        names = [n for m in messages if m is not None for n in m.names]
        with fs.open_output_stream(f"{folder}/_committed-{uuid.uuid4().hex}", compression=None) as out:
            out.write("\n".join(names).encode())
        for name in [*old[0], *old[1]] if old else []:
            fs.delete_file(f"{folder}/{name}")

    def abort(self, messages: list) -> None:
        fs, folder = _place(self.folder)
        for name in [n for m in messages if m is not None for n in m.names]:
            fs.delete_file(f"{folder}/{name}")


def _committed(fs: pafs.FileSystem, folder: str) -> tuple[list[str], list[str]] | None:
    """Names of the lists and of the archives they name; null where no list is."""
    found = [i.base_name for i in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if i.base_name.startswith("_committed-")]
    if not found:
        return None
    names: list[str] = []
    for name in found:
        with fs.open_input_stream(f"{folder}/{name}", compression=None) as held:
            names += [n for n in held.read().decode().split("\n") if n]
    return found, names


# --- reading -----------------------------------------------------------------------------
class WarcPartition(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


_ORDER = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b,
          LessThanOrEqual: lambda a, b: a <= b, EqualTo: lambda a, b: a == b, In: lambda a, b: a in b,
          StringStartsWith: lambda a, b: a.startswith(b), StringEndsWith: lambda a, b: a.endswith(b), StringContains: lambda a, b: b in a}


def column_of(f: Filter) -> str | None:
    """The one column that a predicate asks for, or null if it is none that can be taken over."""
    if isinstance(f, Not):
        return column_of(f.child)
    if isinstance(f, (IsNull, IsNotNull, EqualNullSafe, *_ORDER)) and len(f.attribute) == 1:
        return f.attribute[0]
    return None


def holds(f: Filter, row: dict) -> bool | None:
    """A predicate's value in SQL's three-valued logic."""
    if isinstance(f, Not):
        value = holds(f.child, row)
        return None if value is None else not value
    value = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return value is None
    if isinstance(f, IsNotNull):
        return value is not None
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if value is None or f.value is None:
        return None
    found = _ORDER[type(f)](value, f.value)
    return None if isinstance(f, In) and not found and None in f.value else found


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.folder = options["path"].rstrip("/")
        self.payload = options.get("payload", "true").lower() == "true"
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.head = _head_columns(options)
        self.arrow = pa.schema([pa.field(f.name, _ARROW[f.dataType.typeName()]) for f in schema.fields])
        self.on_head: list[Filter] = []
        self.on_http: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        early = {"file", "offset", *(name for name, _, _ in self.head)}
        for f in filters:
            column = column_of(f)
            if column in early:
                self.on_head.append(f)
            elif column in ("http_status", "payload_length"):
                self.on_http.append(f)
            else:
                yield f

    def partitions(self) -> list[WarcPartition]:
        fs, folder = _place(self.folder)
        held = _committed(fs, folder)
        infos = {i.base_name: i.size for i in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if i.type == pafs.FileType.File}
        names = held[1] if held else [n for n in infos if re.search(r"\.warc(\.gz)?$", n)]
        missing = [n for n in names if n not in infos]
        if missing:
            raise FileNotFoundError(f"{len(missing)} archives are listed but gone, such as {missing[0]}")
        parts: list[WarcPartition] = []
        room = 0
        for name in sorted(names):
            if room < infos[name] or not parts:
                parts.append(WarcPartition([]))
                room = self.partition_bytes
            parts[-1].files.append(name)
            room -= infos[name]
        return parts or [WarcPartition([])]

    def read(self, partition: WarcPartition) -> Iterator[pa.RecordBatch]:
        fs, folder = _place(self.folder)
        rows, size = [], 0
        for name in partition.files:
            with fs.open_input_file(f"{folder}/{name}") as raw:
                for row in self._records(raw, name):
                    rows.append(row)
                    size += 300 + len(row["payload"] or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, self.arrow)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, self.arrow)

    def _records(self, raw, name: str) -> Iterator[dict]:
        stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw, 1 << 16)
        while True:
            offset = stream.tell()  # in the inflated text, for gzip
            line = stream.readline()
            while line in (b"\r\n", b"\n"):
                offset, line = stream.tell(), stream.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{name}: no record begins at {offset}")
            told, _ = _fields(stream)
            length = int(told.get("content-length", "0"))
            row = {"file": name, "offset": offset, "http_status": None, "payload_length": None, "payload": None}
            for column, field, kind in self.head:
                value = told.get(field)
                row[column] = int(value) if kind == "long" and value is not None else value
            if row["payload_digest"] is not None:
                row["payload_digest"] = row["payload_digest"].split(":", 1)[-1]
            left = length
            wanted = all(holds(f, row) for f in self.on_head)
            if wanted and (told.get("content-type") or "").startswith("application/http"):
                left -= self._http(stream, row, left)
                wanted = all(holds(f, row) for f in self.on_http)
            elif wanted:
                row["payload_length"] = length
                wanted = all(holds(f, row) for f in self.on_http)
            if wanted and self.payload and row["record_type"] != "revisit":
                row["payload"] = stream.read(left)
                if len(row["payload"]) < left:
                    raise ValueError(f"{name}: the record at {offset} ends early")
            else:
                _skip(stream, left)
            if wanted:
                yield row

    def _http(self, stream, row: dict, length: int) -> int:
        """Parse the HTTP head; how many bytes it took."""
        first = stream.readline()
        status = re.match(rb"HTTP/\S+\s+(\d{3})", first)
        row["http_status"] = int(status[1]) if status else None
        told, size = _fields(stream)
        size += len(first)
        # a revisit holds the head alone, which tells the length of what it leaves out
        row["payload_length"] = int(told.get("content-length", 0)) if row["record_type"] == "revisit" else length - size
        return size


def _fields(stream) -> tuple[dict[str, str], int]:
    """Header fields up to the empty line, names in lower case, and the bytes they took; folded lines are joined."""
    told: dict[str, str] = {}
    size, last = 0, None
    while True:
        line = stream.readline()
        size += len(line)
        shown = line.rstrip(b"\r\n").decode("utf-8", "replace")
        if not shown:
            return told, size
        if shown[0] in " \t" and last is not None:
            told[last] += " " + shown.strip()
            continue
        last, _, value = shown.partition(":")
        last = last.strip().lower()
        told[last] = value.strip()


def _skip(stream: io.BufferedReader, size: int) -> None:
    if isinstance(stream.raw, gzip.GzipFile):
        while size > 0:
            size -= len(stream.read(min(size, 1 << 20))) or size
    else:
        stream.seek(size, io.SEEK_CUR)


_ARROW = {"string": pa.string(), "long": pa.int64(), "integer": pa.int32(), "binary": pa.binary()}


def _head_columns(options: dict) -> list[tuple[str, str, str]]:
    own = [f.strip() for f in options.get("fields", "").split(",") if f.strip()]
    return [*_HEAD, *[(f.lower().replace("-", "_"), f.lower(), "string") for f in own]]


class WarcSource(DataSource):
    """Options: path; read: payload, fields, partition_bytes; write: compression (none, gzip), file_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        head = ", ".join(f"{name} {kind}" for name, _, kind in _head_columns(self.options))
        return f"file string, offset long, {head}, {_REST}"

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Make `format("warc")` known to the session, with predicates pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark


# --- pages ---------------------------------------------------------------------------------
def page_records(pages: DataFrame, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html",
                 date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Records of the pages, as the writer takes them.

    Only (digest, id) of each page meets others, folded before the shuffle; what comes back is one row per payload that
    occurs more than once. These rows are written, so that the planner knows their size before it deals with the pages:
    the pages themselves are shuffled only where the rows are too many to broadcast.
    """
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page"), F.col(f"`{url}`").cast("string").alias("target_uri"),
                        payload.alias("payload"))
    # two hashes and the length: payloads made to share a SHA-1 still differ
    keys = ["_sha1", "_hash", "_bytes"]
    rows = rows.withColumns({"_sha1": F.sha1("payload"), "_hash": F.xxhash64("payload"), "_bytes": F.octet_length("payload")})
    repeated = written(rows.filter(F.col("_bytes") >= least).groupBy(*keys).agg(
        F.max("page").alias("_keeper"), F.count("*").alias("_n")).filter("_n > 1"))
    placed = rows.join(repeated, keys, "left")
    revisit = F.col("_n").isNotNull() & ~F.col("page").eqNullSafe(F.col("_keeper"))

    def urn(page: str) -> Column:
        name = F.md5(F.concat_ws(":", F.coalesce(F.col(page).cast("string"), F.lit("-")), "_sha1"))
        shown = F.regexp_replace(name, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-3$3-8$4-$5")
        return F.concat(F.lit("<urn:uuid:"), shown, F.lit(">"))

    return placed.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn("page").alias("record_id"),
        "target_uri", F.lit(date).alias("date"), "payload", F.when(revisit, urn("_keeper")).alias("refers_to"),
        F.create_map(F.lit("Page-Id"), F.col("page").cast("string"),
                     F.lit("Refers-To-Page-Id"), F.when(revisit, F.col("_keeper").cast("string"))).alias("headers"))


def archive(pages: DataFrame, folder: str, compression: str = "none", **names) -> None:
    """Write the pages as archives under `folder`, which driver and executors share."""
    register(pages.sparkSession)
    page_records(pages, **names).write.format("warc").mode("append").option("compression", compression).save(folder)


def read_archive(spark: SparkSession, folder: str, payload: bool = True, fields: str = "Page-Id,Refers-To-Page-Id") -> DataFrame:
    return register(spark).read.format("warc").option("payload", str(payload).lower()).option("fields", fields).load(folder)


def page_rows(records: DataFrame) -> DataFrame:
    """One row per page record: what its headers tell, without its payload."""
    return records.filter(F.col("record_type").isin("response", "revisit")).select(
        F.col("page_id").cast("long").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest",
        "record_type", F.col("refers_to_page_id").cast("long").alias("refers_to"))
