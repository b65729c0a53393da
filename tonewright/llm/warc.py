"""WARC archives: one gzip member for each record, written and read one record after the other.

The writer deduplicates payloads: of records with equal payloads of at least ``least`` bytes the one with
the smallest key is a response, the others are revisits that refer to it and carry no payload. Each task
writes its own files, under names that no other attempt uses; the list of files comes from the attempts
that succeeded, so a lost executor leaves no half-read file.

The reader takes a file as a stream of blocks of ``BLOCK`` bytes, decompresses step by step, frames each
record by its Content-Length and verifies block and payload digests. What is in memory is one record.
:func:`read_records` reads archives of other writers too: all record types and ids, digests of several algorithms or none,
bodies in chunks; it says where an archive is damaged and reads on.

Files are opened through the file system of their path (``file:`` or any store that Arrow knows).

Nulls and odd input: a null payload is empty; a null address is an empty address; line breaks in
addresses are percent-encoded; a null key stays null and is never referred to; rows with equal keys are
records of their own, and those with the smallest key of their payload are all responses; an empty table
gives no files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.llm.common import checkpoint, new_path

LEAST = 100
BLOCK = 1 << 16
ROLL_BYTES = 256 << 20

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"
DATE = "2000-01-01T00:00:00Z"
MEMBER = b"\x1f\x8b\x08"  # how a gzip member begins
ALGORITHMS = ("md5", "sha1", "sha256", "sha512")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def record_id(key: int | None) -> str:
    return f"<urn:x-page:{'' if key is None else key}>"


def key_of(record: str | None) -> int | None:
    digits = (record or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(digits) if digits else None


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    address = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(key)), ("WARC-Date", DATE), ("WARC-Target-URI", address),
        ("Content-Type", HTTP_TYPE),
        ("WARC-Block-Digest", f"sha256:{sha256(block)}"), ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    return warc_record(headers, block)


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


def mark_revisits(
    pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST
) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: null for a response."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    pages = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    pages = pages.withColumn("digest", F.sha2("payload", 256))
    # minima combine before the shuffle, so a payload of very many pages is no burden here
    firsts = (
        pages.where(F.octet_length("payload") >= least).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return pages.join(firsts, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(other, F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``page_id, url, payload, digest, refers_to`` and return ``path, records, bytes`` of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        out, name, count, size, done = None, "", 0, 0, []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"{folder}/{name}", count, size))
                out = None

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(5))):
                key, url, payload, digest, refers_to = (v.as_py() for v in row)
                if out is None:
                    name, count, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                    head = warc_record([
                        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                        ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"),
                    ], b"format: WARC File Format 1.1\r\n")
                    size += out.write(head)
                member = page_record(key, url, payload, digest, refers_to)
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= roll_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([
            pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()),
            pa.array([d[2] for d in done], pa.int64()),
        ], names=["path", "records", "bytes"])

    return checkpoint(records.mapInArrow(run, "path string, records long, bytes long"))


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    verified: bool | None = None  # whether its block has the digest that is told; null if none can be checked


class Damaged(ValueError):
    """An archive that doesn't hold what it says."""


def framed(stream, block: int = BLOCK) -> Iterator[tuple[int, bytes | Damaged]]:
    """Offset and content of each gzip member, decompressed step by step.

    Where a member can't be read, its place says why, and reading goes on at the next bytes that begin a readable one.
    """
    data, at, lost = b"", 0, False
    while data := data or stream.read(block):
        unpacker, parts, raw = zlib.decompressobj(31), [], []
        try:
            while not unpacker.eof:
                if not data:
                    data = stream.read(block)
                    if not data:
                        raise Damaged("the last member is cut off")
                raw.append(data)
                parts.append(unpacker.decompress(data))
                data = unpacker.unused_data
        except (zlib.error, Damaged) as error:
            if not lost:
                yield at, Damaged(str(error))
            lost, data = True, b"".join(raw)
            at, data = at + 1, data[1:]
            while (skip := data.find(MEMBER)) < 0:
                more = stream.read(block)
                if not more:
                    return
                kept = data[-len(MEMBER) + 1:]
                at, data = at + len(data) - len(kept), kept + more
            at, data = at + skip, data[skip:]
        else:
            yield at, b"".join(parts)
            lost, at = False, at + sum(map(len, raw)) - len(data)


def members(stream, block: int = BLOCK) -> Iterator[bytes]:
    """The content of each gzip member of an archive without damage."""
    for _, content in framed(stream, block):
        if isinstance(content, Damaged):
            raise content
        yield content


def parse_headers(raw: bytes) -> tuple[str, dict[str, str]]:
    """The first line, and values by name in small letters; a line that begins with a blank goes on with the one before."""
    first, *lines = re.split(r"\r?\n", re.sub(r"\r?\n[ \t]+", " ", raw.decode("utf-8", "replace")))
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def has_digest(said: str | None, *contents: bytes) -> bool | None:
    """Whether one of ``contents`` has the digest ``algorithm:value``, in hex or base32; None for an unknown algorithm."""
    algorithm, _, value = (said or "").partition(":")
    algorithm, value = algorithm.strip().lower().replace("-", ""), value.strip()
    if algorithm not in ALGORITHMS:
        return None
    digests = [hashlib.new(algorithm, content).digest() for content in contents]
    told = (value.lower(), value.upper().rstrip("="))
    return any(d.hex() == told[0] or base64.b32encode(d).decode().rstrip("=") == told[1] for d in digests)


def parse_record(member: bytes) -> Record:
    """Frame a member by its Content-Length and verify its block digest."""
    head, mark, rest = member.partition(b"\r\n\r\n")
    version, headers = parse_headers(head)
    if not mark or not version.startswith("WARC/"):
        raise Damaged("a member is no WARC record")
    if not headers.get("content-length", "").isdigit():
        raise Damaged("a record has no Content-Length")
    length = int(headers["content-length"])
    block, tail = rest[:length], rest[length:]
    if len(block) != length or tail != b"\r\n\r\n":
        raise Damaged("a record is longer or shorter than its Content-Length")
    verified = has_digest(headers.get("warc-block-digest"), block)
    if verified is False:
        raise Damaged("a block doesn't match its digest")
    return Record(headers, block, verified)


def joined_chunks(body: bytes) -> bytes:
    """A body sent in chunks; one that isn't (writers may have joined it, and left the header) stays as it is."""
    parts, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        digits = body[at:end].partition(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", digits):
            return body
        size, at = int(digits, 16), end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size:at + size + 2] != b"\r\n":
            return body
        parts.append(body[at:at + size])
        at += size + 2
    return body


def payload_of(record: Record) -> tuple[bytes | None, int | None, bool | None]:
    """Payload, its size, and whether it was verified. A revisit has no payload; its size is that of the HTTP header, if any.

    The payload is the body of an HTTP message, else the block. Digests of a body in chunks may be of either form.
    """
    headers = record.headers
    revisit = headers.get("warc-type") == "revisit"
    if not headers.get("content-type", "").lower().startswith("application/http"):
        http, bodies = {}, (record.block,)
    else:
        end = re.search(rb"\r?\n\r?\n", record.block)
        head, body = (record.block[:end.start()], record.block[end.end():]) if end else (record.block, b"")
        _, http = parse_headers(head)
        chunked = "chunked" in http.get("transfer-encoding", "").lower()
        bodies = (joined_chunks(body), body) if chunked else (body,)
    size = http.get("content-length", "")
    if revisit:
        return None, int(size) if size.isdigit() else None, record.verified
    verified = has_digest(headers.get("warc-payload-digest"), *bodies)
    if verified is False:
        raise Damaged("a payload doesn't match its digest")
    if verified is None and len(bodies) == 1 and size.isdigit() and int(size) != len(bodies[0]) and "warc-truncated" not in headers:
        raise Damaged("a payload is longer or shorter than its Content-Length")
    return bodies[0], len(bodies[0]), verified or record.verified


def parse_page(record: Record) -> tuple[int | None, str, bytes | None, int, str, str, int | None]:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to`` of a page record."""
    headers = record.headers
    payload, size, _ = payload_of(record)
    return (
        key_of(headers["warc-record-id"]), headers["warc-target-uri"], payload, size,
        headers["warc-payload-digest"].removeprefix("sha256:"), headers["warc-type"], key_of(headers.get("warc-refers-to")),
    )


def parse_any(path: str, offset: int, content: bytes | Damaged) -> tuple:
    """A row of :func:`read_records`."""
    headers: dict[str, str] = {}
    payload = size = verified = problem = None
    try:
        if isinstance(content, Damaged):
            raise content
        record = parse_record(content)
        headers = record.headers
        payload, size, verified = payload_of(record)
    except Damaged as damage:
        problem, verified = str(damage), False
    told = (headers.get(f"warc-{k}") for k in ("type", "record-id", "target-uri", "date"))
    return (path, offset, *told, payload, size, headers.get("warc-payload-digest"), verified,
            headers.get("warc-refers-to"), problem)


RECORDS = pa.schema([
    ("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
    ("url", pa.string()), ("date", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("verified", pa.bool_()), ("refers_to", pa.string()), ("problem", pa.string()),
])


def read_records(files: DataFrame) -> DataFrame:
    """Records of every type in the archives in ``path``, of any writer that gives each record a gzip member: ``path, offset,
    record_type, record_id, url, date, payload, payload_bytes, payload_digest, verified, refers_to, problem``.

    ``verified`` is null where no digest of a known algorithm is told. A damaged record is a row with its offset and a
    ``problem`` (what follows damage up to the next readable member is part of it); the others of its file are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(RECORDS.types)], schema=RECORDS)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = file_system(path)
                rows, size = [], 0
                with system.open_input_stream(name, compression=None, buffer_size=BLOCK) as stream:
                    for offset, content in framed(stream):
                        rows.append(parse_any(path, offset, content))
                        size += 0 if isinstance(content, Damaged) else len(content)
                        if size >= 4 << 20:
                            yield packed(rows)
                            rows, size = [], 0
                if rows:
                    yield packed(rows)

    schema = (
        "path string, offset long, record_type string, record_id string, url string, date string, payload binary, "
        "payload_bytes long, payload_digest string, verified boolean, refers_to string, problem string"
    )
    return files.select("path").mapInArrow(run, schema)


def read_archives(files: DataFrame) -> DataFrame:
    """Page records of the archives in ``path`` that :func:`write_archives` wrote: ``page_id, url, payload, payload_bytes,
    payload_digest, record_type, refers_to``. A revisit has no payload; its size and digest are those of the full
    one. Damage ends the job."""
    told = F.concat_ws(" ", "problem", F.lit("in"), "path", F.lit("at"), "offset")
    sound = F.when(F.col("problem").isNotNull(), F.raise_error(told).cast("string")).otherwise(F.col("record_type"))

    def key(name: str) -> Column:
        return F.nullif(F.regexp_extract(name, r"^<urn:x-page:(-?\d+)>$", 1), F.lit("")).cast("long").alias(name)

    pages = read_records(files).withColumn("record_type", sound).where(F.col("record_type").isin("response", "revisit"))
    return pages.select(
        key("record_id").alias("page_id"), "url", "payload", "payload_bytes",
        F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type", key("refers_to"))


def archive_folder(spark: SparkSession) -> str:
    return new_path(spark, "archives")
