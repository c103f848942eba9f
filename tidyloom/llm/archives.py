"""Web archives: ARC files of versions 1 and 2, their conversion to WARC, and reading WARC back.

The converter parses each ARC header line by the version its file declares and takes as many bytes as the line says.
It then synthesises what WARC needs: identifiers, ISO timestamps, record types and digests.  Records
whose payload occurs in a later record become revisits of it.

Files are written by tasks under names of their own and count only once a written table lists them, so a
task that is run again leaves nothing behind that is read.  Payloads are never shuffled: what a record
becomes is decided on digests and brought to the task that converts its file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import text_parts, work_folder, written
from tidyloom.sources.files import open_filesystem

# The fields that a header line has in each version, and the line that names them.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
VERSION_BLOCK = {1: b"1 0 tidyloom", 2: b"2 0 tidyloom"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
PAGE_HEADER = "X-Page-Id"
FILE_SCHEMA = "path string, records bigint"


class ArcRecord(NamedTuple):
    """A record of an ARC file: its header's fields by name and its document, HTTP headers included."""

    number: int
    fields: dict[str, str]
    block: bytes


def arc_line(version: int, values: dict[str, str]) -> bytes:
    return (" ".join(values.get(name, "-") or "-" for name in ARC_FIELDS[version]) + "\n").encode("ascii")


def arc_head(version: int, name: str, date: str) -> bytes:
    """The version block that opens a file: the declared version and the names of the fields."""
    body = VERSION_BLOCK[version] + b"\n" + " ".join(ARC_FIELDS[version]).encode() + b"\n"
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Offset": "0", "Filename": name}
    return arc_line(version, values | {"Archive-length": str(len(body))}) + body + b"\n"


def exactly(stream: BinaryIO, size: int) -> bytes:
    data = stream.read(size)
    if len(data) != size:
        raise ValueError(f"the archive ends {size - len(data)} bytes before its declared length")
    return data


def next_line(stream: BinaryIO) -> bytes:
    """The next line that is not blank, or nothing at the end."""
    while line := stream.readline():
        if line.strip():
            return line
    return b""


def arc_records(stream: BinaryIO) -> Iterator[ArcRecord]:
    """All records after the version block.  A URL may hold blanks: the other fields are taken from the right."""
    line = next_line(stream)
    if not line:
        return
    if not line.startswith(b"filedesc://"):
        raise ValueError("an ARC file opens with filedesc://")
    body = exactly(stream, int(line.split()[-1]))
    version = int(body.split(None, 1)[0])
    if version not in ARC_FIELDS:
        raise ValueError(f"ARC version {version} is not known")
    fields = ARC_FIELDS[version]
    number = 0
    while line := next_line(stream):
        values = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(fields) - 1)
        if len(values) != len(fields):
            raise ValueError(f"record {number}: {len(values)} fields, version {version} has {len(fields)}")
        record = dict(zip(fields, values))
        yield ArcRecord(number, record, exactly(stream, int(record["Archive-length"])))
        number += 1


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """HTTP headers with the blank line that ends them, and the payload; no headers if the block has none."""
    end = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -1
    return (block[: end + 4], block[end + 4 :]) if end >= 0 else (b"", block)


def http_value(headers: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", headers)
    return found[1].decode("latin-1").strip() if found else None


def whole_number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d+", text) else None


def sha1_text(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_date(date: str) -> str:
    """An ARC date of 8 to 14 digits as WARC writes it; missing parts are 0."""
    d = re.sub(r"\D", "", date).ljust(8, "0")[:14].ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(path: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path.rsplit("/", 1)[-1]}#{number}')}>"


def warc_record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = {"WARC-Type": kind, **headers, "WARC-Block-Digest": sha1_text(block), "Content-Length": str(len(block))}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def converted(path: str, record: ArcRecord, revisit_of: dict[str, str] | None) -> bytes:
    """The WARC record that an ARC record becomes.

    A document with HTTP headers is a response, or a revisit without payload; any other one a resource.
    """
    http, payload = http_parts(record.block)
    headers = {
        "WARC-Record-ID": record_id(path, record.number),
        "WARC-Date": iso_date(record.fields["Archive-date"]),
        "WARC-Target-URI": record.fields["URL"],
        "WARC-Payload-Digest": sha1_text(payload),
    }
    if record.fields["IP-address"] not in ("-", "0.0.0.0"):
        headers["WARC-IP-Address"] = record.fields["IP-address"]
    if not http:
        return warc_record("resource", headers | {"Content-Type": record.fields["Content-type"]}, record.block)
    headers["Content-Type"] = "application/http; msgtype=response"
    if revisit_of:
        return warc_record("revisit", headers | {"WARC-Profile": REVISIT_PROFILE} | revisit_of, http)
    return warc_record("response", headers, record.block)


def warc_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record."""
    while line := next_line(stream):
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record opens with its version")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = exactly(stream, int(headers["content-length"]))
        if headers.get("warc-block-digest", sha1_text(block)) != sha1_text(block):
            raise ValueError(f"the block of {headers.get('warc-record-id')} does not match its digest")
        yield headers, block


class ArchiveFile:
    """An open archive of one gzip member for each record, under a name that no other attempt uses."""

    def __init__(self, folder: str, ending: str):
        task = TaskContext.get()
        self.name = f"{task.partitionId():06d}-{uuid.uuid4().hex}{ending}"
        self.path = f"{folder}/{self.name}"
        fs, inner = open_filesystem(self.path)
        fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        self.stream = fs.open_output_stream(inner, compression=None)
        self.records = self.size = 0

    def add(self, record: bytes) -> None:
        self.stream.write(gzip.compress(record, compresslevel=1, mtime=0))
        self.size += len(record)

    def close(self) -> pa.RecordBatch:
        self.stream.close()
        return pa.RecordBatch.from_arrays([pa.array([self.path]), pa.array([self.records], pa.int64())], names=["path", "records"])


def opened(path: str) -> BinaryIO:
    fs, inner = open_filesystem(path)
    return gzip.GzipFile(fileobj=fs.open_input_stream(inner, compression=None))


def task_count(files: DataFrame, most_tasks: int = 10_000) -> int:
    """A task for each listed file, up to ``most_tasks``."""
    return min(most_tasks, max(1, files.count()))


def one_by_one(files: DataFrame) -> DataFrame:
    """The listed files dealt out to as many tasks, whatever files the list itself is in."""
    return files.repartition(task_count(files))


def write_arc(pages: DataFrame, folder: str, date: str = "20000101000000", file_bytes: int = 64 << 20) -> DataFrame:
    """Write ``pages (page_id, url, html)`` as ARC files, ``path, records`` of which are returned.

    The payload is the html in UTF-8, empty for null; HTTP headers carry the page's id.  Odd files of a task
    are of version 2, even ones of version 1.  A file is closed after ``file_bytes``.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, count = None, TaskContext.get().partitionId()
        parts = (part for batch in batches for part in text_parts(batch, "html"))
        for part in parts:
            for page, url, html in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                if current is None:
                    version = 1 + count % 2
                    count += 1
                    current = ArchiveFile(folder, ".arc.gz")
                    current.add(arc_head(version, current.name, date))
                payload = (html or "").encode()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n"
                http += f"{PAGE_HEADER}: {page}\r\n\r\n" if page is not None else "\r\n"
                block = http.encode() + payload
                values = {
                    "URL": quote(url or "unknown:", safe="%:/?#[]@!$&'()*+,;=~"),
                    "IP-address": "0.0.0.0",
                    "Archive-date": date,
                    "Content-type": "text/html",
                    "Result-code": "200",
                    "Checksum": hashlib.md5(payload).hexdigest(),
                    "Offset": str(current.size),
                    "Filename": current.name,
                    "Archive-length": str(len(block)),
                }
                current.add(arc_line(version, values) + block + b"\n")
                current.records += 1
                if current.size >= file_bytes:
                    yield current.close()
                    current = None
        if current is not None:
            yield current.close()

    source = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return written(source.mapInArrow(write, FILE_SCHEMA), "arc-files")


def arc_index(files: DataFrame) -> DataFrame:
    """``path, number, page_id, record_id, url, date, payload_bytes, payload_digest`` of all ARC records."""
    schema = "path string, number bigint, page_id bigint, record_id string, url string, date string, payload_bytes bigint, payload_digest string"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64() if c.endswith("bigint") else pa.string() for c in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with opened(path) as stream:
                    for r in arc_records(stream):
                        http, payload = http_parts(r.block)
                        rows.append((path, r.number, whole_number(http_value(http, PAGE_HEADER)), record_id(path, r.number), r.fields["URL"], iso_date(r.fields["Archive-date"]), len(payload), hashlib.sha1(payload).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=names)

    return written(one_by_one(files).mapInArrow(read, schema), "arc-index")


def arc_to_warc(files: DataFrame, folder: str, least_bytes: int = 1000) -> DataFrame:
    """Convert ARC ``files (path, ...)`` to WARC files in ``folder``; returns their ``path, records``.

    Of records with equal payloads of at least ``least_bytes`` bytes, that with the largest page id (then path and
    number) is a response and the others revisit it.  Each ARC file gives one WARC file.
    """
    index = arc_index(files)
    latest = F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("page_id"), "path", "number", "record_id", "url", "date")).alias("kept")
    keys = ["payload_digest", "payload_bytes"]
    kept = index.filter(F.col("payload_bytes") >= least_bytes).groupBy(*keys).agg(latest, F.count("*").alias("copies")).filter("copies > 1").select(*keys, "kept")
    repeats = index.join(kept, keys).filter(F.col("record_id") != F.col("kept.record_id"))
    repeats = repeats.select("path", "number", "kept.record_id", "kept.url", "kept.date")

    def convert(files: pa.Table, repeats: pa.Table) -> pa.Table:
        rows = {r["number"]: r for r in repeats.to_pylist()}
        out = []
        for path in files.column("path").to_pylist():
            target = ArchiveFile(folder, ".warc.gz")
            target.add(warc_record("warcinfo", {"WARC-Record-ID": record_id(path, -1), "WARC-Date": iso_date("20000101"), "WARC-Filename": target.name, "Content-Type": "application/warc-fields"}, f"format: WARC File Format 1.0\r\nisPartOf: {path.rsplit('/', 1)[-1]}\r\n".encode()))
            with opened(path) as stream:
                for record in arc_records(stream):
                    repeat = rows.get(record.number)
                    target.add(converted(path, record, repeat and {"WARC-Refers-To": repeat["record_id"], "WARC-Refers-To-Target-URI": repeat["url"], "WARC-Refers-To-Date": repeat["date"]}))
                    target.records += 1
            out.append(target.close())
        return pa.Table.from_batches(out)

    # The shuffled rows are short and the files behind them long: a stated number of tasks is not merged by size.
    tasks = task_count(files)
    one_each, repeats = (df.repartition(tasks, "path").groupBy("path") for df in (files.select("path").distinct(), repeats))
    return written(one_each.cogroup(repeats).applyInArrow(convert, FILE_SCHEMA), "warc-files")


def read_warc(files: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, record_id, refers_id, url`` of all content records.

    A revisit's payload is that of the record it refers to: its length is the one its HTTP headers declare.
    """
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, record_id string, refers_id string, url string"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64() if c.endswith("bigint") else pa.string() for c in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with opened(path) as stream:
                    for headers, block in warc_records(stream):
                        kind = headers["warc-type"]
                        if kind not in ("response", "revisit", "resource"):
                            continue
                        http, payload = http_parts(block)
                        digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                        size = whole_number(http_value(http, "Content-Length")) if kind == "revisit" else len(payload)
                        if kind != "revisit" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"the payload of {headers['warc-record-id']} does not match its digest")
                        rows.append((whole_number(http_value(http, PAGE_HEADER)), size, digest, kind, headers["warc-record-id"], headers.get("warc-refers-to"), headers.get("warc-target-uri")))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=names)

    return one_by_one(files).mapInArrow(read, schema)


def archived_pages(pages: DataFrame, least_bytes: int = 1000, **settings) -> DataFrame:
    """Pages through ARC and WARC files and back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Null html is an empty payload, a null url ``unknown:``, a null page id stays null; rows that repeat an id are
    records of their own.  Other columns are not read.  The files stay below ``spark.checkpoint.dir``.
    """
    folder = work_folder(pages.sparkSession, "archives")
    files = arc_to_warc(write_arc(pages, f"{folder}/arc", **settings), f"{folder}/warc", least_bytes)
    records = written(read_warc(files), "warc-records")
    targets = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    # Most records refer to none: only revisits are shuffled to what they refer to.
    alone = records.filter("refers_id IS NULL").withColumn("refers_to", F.lit(None).cast("bigint")).select(*columns)
    return alone.unionAll(records.filter("refers_id IS NOT NULL").join(targets, "refers_id", "left").select(*columns))
