"""WARC archives: a writer, and a reader that splits files.

Each task writes one archive of gzip members, a record each, into the shared
folder, under a name of its attempt, and renames it when it is complete: a
repeated task replaces nothing half-written. Payloads equal to one with a smaller
page id are stored as revisits of it, without the payload.

The reader deals byte ranges of the archives to tasks. A task looks in its range
for the gzip magic, takes a candidate as a record only if its decompressed start
is a WARC header (and, where the writer left its offset in the member, only at
this offset), and owns the records that start inside its range, reading past the
end for the last one. What lies inside a record it has read is not searched. A
record is inflated in chunks.

Defined cases: a null html is an empty payload; equal empty payloads are
revisits like others; rows with equal ids and payloads each have a record, one of
the least URL being the response and the others revisiting it; an id may be null
and then comes last among equal payloads; an empty table gives no archives and no
records. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.scratch import Scratch, shared_folder
from tidegraph.llm.workers import ship_package

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 8 << 20
MOST_TASKS = 50_000  # of one read; beyond it a task reads several ranges
CHUNK = 1 << 20
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REVISIT_FROM = 0  # bytes; smaller payloads are never revisits
DATE = "2024-01-01T00:00:00Z"  # fixed, so that a repeated task writes the same bytes


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- records --------------------------------------------------------------


def _line(value) -> str:
    return re.sub(r"[\r\n]+", " ", str(value))


def record(page_id, url, payload: bytes | None, n_bytes: int, digest: str, kind: str, refers_to) -> bytes:
    """The bytes of a record; a revisit has no payload but its length and digest."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url} {digest} {kind}")
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "text/html; charset=utf-8"),
        ("X-Payload-Length", n_bytes),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", url))
    if page_id is not None:
        fields.append(("X-Page-ID", page_id))
    if kind == "revisit":
        fields.append(("WARC-Profile", PROFILE))
        if refers_to is not None:
            fields.append(("X-Refers-To-Page-ID", refers_to))
    block = payload or b""
    fields.append(("Content-Length", len(block)))
    head = "".join(f"{k}: {_line(v)}\r\n" for k, v in fields).encode("utf-8", "replace")
    return VERSION + head + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, offset: int) -> bytes:
    """A gzip member that names the offset it is written at in an extra field."""
    extra = b"tg" + struct.pack("<HQ", 8, offset)
    head = MAGIC + b"\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


# ---- writing --------------------------------------------------------------

DIGESTED = "page_id long, url string, html string, digest string, n_bytes long"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their payloads' digests and lengths."""
    for batch in batches:
        payloads = [(t or "").encode("utf-8", "replace") for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(map(digest_of, payloads), pa.string()),
             pa.array(map(len, payloads), pa.int64())],
            names=[f.split()[0] for f in DIGESTED.split(", ")])


MANIFEST = "archive string, bytes long, records long"


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    fs, root = _filesystem(folder)
    name = f"part-{context.partitionId():05d}.warc.gz"
    draft, out, offset, n = f"{root}/{name}.{context.taskAttemptId()}", None, 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            for row in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                page_id, url, html, *rest = row
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(draft)
                payload = None if html is None else html.encode("utf-8", "replace")
                data = member(record(page_id, url, payload, *rest), offset)
                out.write(data)
                offset += len(data)
                n += 1
    if out is not None:
        out.close()
        try:
            fs.move(draft, f"{root}/{name}")
        except OSError:
            # another attempt of this task has put the same bytes there
            if fs.get_file_info(f"{root}/{name}").type == pyarrow.fs.FileType.NotFound:
                raise
            fs.delete_file(draft)
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{name}"]), pa.array([offset], pa.int64()), pa.array([n], pa.int64())],
            names=[f.split()[0] for f in MANIFEST.split(", ")])


def write_archives(pages: DataFrame, folder: str, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Write ``pages(page_id, url, html)``; ``archive, bytes, records`` per file.

    Rows are known by what they hold and never by their place in a task, which may
    change between two scans: equal rows are counted once, without html, and written
    as often as counted. The response among equal payloads is the least of these rows,
    by id and URL. Only responses take part in the second scan; where equal rows share
    one, it is made distinct.
    """
    ship_package(pages.sparkSession)
    scratch = Scratch(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        _digested, DIGESTED)
    known = scratch.save(rows.groupBy("digest", "n_bytes", "page_id", "url").agg(F.count("*").alias("copies")))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    first = scratch.save(known.groupBy(F.col("digest").alias("same")).agg(F.min(order).alias("first")))
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))
    told = known.join(first, F.col("digest") == F.col("same")).select(
        "page_id", "url", "n_bytes", "digest", "copies", F.col("first.page_id").alias("refers_to"),
        F.when(F.col("n_bytes") < revisit_from, F.col("copies")).when(is_first, 1).otherwise(0)
        .cast("long").alias("responses"))
    told = scratch.save(told)
    revisits = told.where("copies > responses").select(
        "page_id", "url", F.lit(None).cast("string").alias("html"), "n_bytes", "digest",
        F.lit("revisit").alias("kind"), "refers_to",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies") - F.col("responses"))).alias("copy"))
    key = told.where("responses > 0").select(
        F.col("digest").alias("d"), F.col("page_id").alias("p"), F.col("url").alias("u"), "copies", "responses")
    same = (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("p")) & F.col("url").eqNullSafe(
        F.col("u"))
    found = rows.join(key, same).select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html"), "n_bytes", "digest", "copies", "responses")
    several = found.where("copies > 1").groupBy(
        "page_id", "url", "n_bytes", "digest", "copies", "responses").agg(F.first("html").alias("html"))
    responses = found.where("copies = 1").unionByName(several).select(
        "page_id", "url", "html", "n_bytes", "digest", F.lit("response").alias("kind"),
        F.lit(None).cast("long").alias("refers_to"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("responses"))).alias("copy"))
    chosen = responses.unionByName(revisits).drop("copy")
    return scratch.save(chosen.mapInArrow(lambda b: _write(b, folder), MANIFEST))


# ---- reading --------------------------------------------------------------


class _Range:
    """Bytes of a file, read forward in chunks from any place."""

    def __init__(self, file):
        self.file = file

    def chunks(self, at: int) -> Iterator[bytes]:
        self.file.seek(at)
        while data := self.file.read(CHUNK):
            yield data

    def find(self, what: bytes, at: int, before: int) -> int | None:
        """The first place in [at, before) where ``what`` begins."""
        keep = b""
        for data in self.chunks(at):
            data = keep + data
            found = data.find(what)
            if found >= 0:
                return at + found if at + found < before else None
            keep = data[-(len(what) - 1):]
            at += len(data) - len(keep)
            if at >= before:
                return None
        return None


def _own_offset(head: bytes) -> int | None:
    """The offset a member says it was written at, if it does."""
    if len(head) < 12 or not head[3] & 4:
        return None
    extra = head[12 : 12 + struct.unpack_from("<H", head, 10)[0]]
    while len(extra) >= 4:
        name, size = extra[:2], struct.unpack_from("<H", extra, 2)[0]
        if name == b"tg" and size == 8 and len(extra) >= 12:
            return struct.unpack_from("<Q", extra, 4)[0]
        extra = extra[4 + size :]
    return None


def _inflate(source: _Range, at: int) -> tuple[bytes, int] | None:
    """The content of the member at ``at`` and the place behind it; None if no WARC
    record begins there. A record that begins but breaks off is an error."""
    inflater, parts, size, used = zlib.decompressobj(31), [], 0, 0
    for data in source.chunks(at):
        if not used:
            said = _own_offset(data[:4096])
            if said is not None and said != at:
                return None
        used += len(data)
        try:
            parts.append(inflater.decompress(data))
        except zlib.error as error:
            if size >= 7:
                raise ValueError(f"record at {at} is damaged: {error}") from error
            return None
        size += len(parts[-1])
        if size >= 7 and not b"".join(parts[:8]).startswith(b"WARC/1."):
            return None
        if inflater.eof:
            content = b"".join(parts)
            return (content, at + used - len(inflater.unused_data)) if content.startswith(b"WARC/1.") else None
    if size >= 7:
        raise ValueError(f"record at {at} breaks off")
    return None


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def records_in(file, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """``offset, fields, block`` of the records that begin in [start, end)."""
    source, at = _Range(file), start
    while at < end:
        found = source.find(MAGIC, at, end)
        if found is None:
            return
        read = _inflate(source, found)
        if read is None:
            at = found + 1
            continue
        content, at = read
        yield found, *parse(content)


RECORDS = (
    "archive string, offset long, record_type string, page_id long, url string, "
    "payload_bytes long, payload_digest string, refers_to long, payload binary"
)


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    number = lambda v: None if v is None else int(v)
    names = [f.split()[0] for f in RECORDS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(),
             pa.int64(), pa.binary()]
    for batch in batches:
        for archive, start, end in zip(*(c.to_pylist() for c in batch.columns)):
            fs, path = _filesystem(archive)
            rows: list[tuple] = []
            size = 0
            with fs.open_input_file(path) as file:
                for offset, fields, block in records_in(file, start, end):
                    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and digest_of(block) != said:
                        raise ValueError(f"{archive} at {offset}: the payload does not match its digest")
                    response = fields["WARC-Type"] == "response"
                    rows.append((
                        archive, offset, fields["WARC-Type"], number(fields.get("X-Page-ID")),
                        fields.get("WARC-Target-URI"),
                        len(block) if response else int(fields["X-Payload-Length"]), said,
                        number(fields.get("X-Refers-To-Page-ID")),
                        block if response and with_payload else None))
                    size += len(block) if with_payload else 0
                    if len(rows) >= 4096 or size > CHUNK:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_archives(archives: DataFrame, split_bytes: int = SPLIT_BYTES,
                  with_payload: bool = True) -> DataFrame:
    """The records of ``archives(archive, bytes)``, by byte ranges; columns ``RECORDS``.

    For archives written elsewhere, list paths and lengths with Spark's
    ``binaryFile`` reader, which does not read contents it is not asked for.
    """
    ship_package(archives.sparkSession)
    ranges = archives.select("archive", "bytes", F.explode(F.sequence(
        F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"),
    )).alias("start")).select("archive", "start", F.least("bytes", F.col("start") + split_bytes).alias("end"))
    # a range is a tiny row but much work: by number, as adaptive execution would put all
    # ranges into one task by their size
    parts = F.ceil(F.greatest(F.col("bytes"), F.lit(1)) / split_bytes)
    n_ranges = archives.agg(F.sum(parts)).first()[0] or 1  # one row; a row per archive is read
    return ranges.repartition(min(int(n_ranges), MOST_TASKS)).mapInArrow(lambda b: _read(b, with_payload), RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read the records back."""
    folder = shared_folder(pages.sparkSession) + "/archives"
    return read_archives(write_archives(pages, folder), with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
