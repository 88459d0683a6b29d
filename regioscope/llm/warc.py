"""WARC archives, written and read through an index.

Writing: each task appends gzip members, one per record, to archives of its
own in a shared folder, and returns one index row per record: file, offset,
length, url and digest.  Archive names are new for each attempt, and only
the rows of finished tasks reach the index, so a task that is run again
leaves at worst an archive that no index row names.

Reading: the selected index rows are sorted by file and offset, and each task
reads neighbouring records with one byte range.

Payloads that occur several times are stored once: of equal payloads of at
least ``min_bytes`` bytes the row with the smallest page_id is a response,
the others are revisits of it.  A null html is an empty payload; a row without a page_id
revisits, or is a response where no equal payload has an id; rows that
repeat the smallest page_id are all responses.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regioscope.llm.scratch import folder, materialize

#: Bytes after which a task begins a new archive, that one read asks for at
#: most, and between two records that one read may skip.
ARCHIVE_BYTES, READ_BYTES, GAP_BYTES = 256 << 20, 4 << 20, 64 << 10
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = ("file string, offset long, length long, page_id long, url string, digest string, "
         "record_type string")


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}' if page_id is not None else f'url:{url}')}>"


def _field(value: str) -> str:
    """A header value: control characters and spaces are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None,
           revisit: bool, date: str) -> tuple[bytes, str]:
    """One uncompressed record and its payload digest."""
    digest = payload_digest(payload)
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {record_id(page_id, url)}", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_field(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page: {refers_to}",
                 f"WARC-Refers-To: {record_id(refers_to, None)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse(member: bytes) -> dict:
    """A record from its gzip member; the payload must fit its digest."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)^content-length: *(\d+)", http, re.M)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"damaged payload: {fields['WARC-Record-ID']}")
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
    return {"page_id": None if page is None else int(page), "url": fields.get("WARC-Target-URI"),
            "record_type": kind, "payload_bytes": size, "payload_digest": digest,
            "refers_to": None if refers is None else int(refers),
            "payload": payload if kind == "response" else None}


def write(pages: DataFrame, target: str, min_bytes: int = 0,
          date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) below the
    folder ``target`` and return the index (see ``INDEX``)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.sha1("html"))
    same = (rows.select("key", "page_id", F.octet_length("html").alias("size"))
            .where(F.col("size") >= min_bytes).groupBy("key")
            .agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1")
            .select("key", "first"))
    rows = rows.join(same, "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(target)
        fs.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            index = []
            for page_id, url, html, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(name, compression=None)
                revisit = first is not None and page_id != first
                raw, digest = record(page_id, url, html.encode(), first if revisit else None,
                                     revisit, date)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(raw) + packer.flush()
                out.write(member)
                index.append((name.removeprefix(base).lstrip("/"), at, len(member), page_id, url,
                              digest, "revisit" if revisit else "response"))
                at += len(member)
            columns = list(zip(*index)) or [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["file", "offset", "length", "page_id", "url", "digest", "record_type"])
        if out is not None:
            out.close()

    return materialize(rows.select("page_id", "url", "html", "first").mapInArrow(run, INDEX),
                       "warc-index")


def read(index: DataFrame, target: str) -> DataFrame:
    """The records that ``index`` rows name: page_id, url, record_type,
    payload_bytes, payload_digest, refers_to, payload (null for revisits)."""
    def ranges(rows: Iterator[tuple[str, int, int]]):
        """Neighbouring rows that one read serves."""
        held: list[tuple[str, int, int]] = []
        for row in rows:
            if held and (row[0] != held[0][0] or row[1] - held[-1][1] - held[-1][2] > GAP_BYTES
                         or row[1] + row[2] - held[0][1] > READ_BYTES):
                yield held
                held = []
            held.append(row)
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(target)
        name, source = None, None
        kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(),
                 "payload_bytes": pa.int64(), "payload_digest": pa.string(),
                 "refers_to": pa.int64(), "payload": pa.binary()}
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            for held in ranges(rows):
                if held[0][0] != name:
                    name = held[0][0]
                    source = fs.open_input_file(f"{base}/{name}")
                begin, end = held[0][1], held[-1][1] + held[-1][2]
                data = source.read_at(end - begin, begin)
                found = [parse(data[o - begin:o - begin + n]) for _, o, n in held]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[c] for r in found], k) for c, k in kinds.items()], list(kinds))

    return (index.select("file", "offset", "length").repartitionByRange("file", "offset")
            .sortWithinPartitions("file", "offset")
            .mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, "
                             "payload_digest string, refers_to long, payload binary"))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages, read every record back: page_id, payload_bytes,
    payload_digest, record_type, refers_to."""
    target = folder(pages.sparkSession, "warc")
    out = read(write(pages, target, min_bytes), target)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
