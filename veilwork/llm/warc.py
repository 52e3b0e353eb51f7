"""WARC archives: one gzip member for each record, written in bounded archives and read sequentially.

A response record holds an HTTP response whose body is the page; a revisit holds its headers only, and refers to the
record whose payload it repeats. An archive is a run of records; archives are rows (name, content) of a table in the shared
folder, so any store that Spark writes to will do, and a lost executor only costs its own task. `read_archives` also reads
`binaryFile` rows of *.warc.gz files that others have written, whose members are inflated and checked in the same way.

Which pages are revisits is decided on digests and ids alone. The repeated digests are read back from the shared folder, so
Spark knows their size: it broadcasts them if they are few, and else shuffles, where a digest of very many pages is split.

Defined results: a null payload counts as empty; payloads under MIN_REVISIT bytes are never revisits; of equal payloads
the smallest id is the response, and every row with that id (repeated rows) is one; null ids come after all others, and
where all ids of a payload are null, each row is a response; other columns are not read; an empty table makes no archive and
no record. Of a record without a page id or a payload these are null; a digest is checked where it is SHA-256 or SHA-1.
BadRecord is raised where framing or a digest does not hold, or a mandatory header is missing.
"""

from __future__ import annotations

import base64
import binascii
import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.common import map_arrow, stash, table

MIN_REVISIT = 100
#: An archive is closed at so many compressed bytes.
ARCHIVE_BYTES = 4 << 20
_STEP = 1 << 16
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, archive string, position long"


class BadRecord(ValueError):
    """A record whose framing or digest does not hold."""


def _header_text(value: object) -> str:
    return " ".join(str(value).split())


def _record_id(kind: str, page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page_id}:{digest}')}>"


def encode_record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, payload: bytes, digest: str, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record as one gzip member. A revisit keeps the headers of its response, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(kind, page_id, digest)), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    fields += [(k, _header_text(v)) for k, v in (("WARC-Target-URI", url), ("X-Page-Id", page_id), ("X-Refers-To-Page", refers_to)) if v is not None]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id("response", refers_to, digest))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + squeeze.flush()


def _members(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Position and content of each gzip member, inflated in steps: what follows a member is never inflated with it."""
    at, view = 0, memoryview(content)
    while at < len(view):
        inflate, parts, place = zlib.decompressobj(31), [], at
        while not inflate.eof:
            if place >= len(view):
                raise BadRecord(f"member at {at} ends early")
            piece = view[place : place + _STEP]
            place += len(piece)
            try:
                parts.append(inflate.decompress(piece))
            except zlib.error as e:
                raise BadRecord(f"member at {at} is no gzip: {e}") from e
        yield at, b"".join(parts)
        at = place - len(inflate.unused_data)


def _fields(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with white space goes on with the last one."""
    fields: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (" ", "\t") and last is not None:
            fields[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if colon:
            last = name.strip().lower()
            fields[last] = value.strip()
    return fields


def _number(value: str | None) -> int | None:
    return int(value) if value is not None and value.lstrip("-").isascii() and value.lstrip("-").isdigit() else None


def _plain_digest(labelled: str | None) -> tuple[str, str] | None:
    """Algorithm and lower-case hex of a labelled digest in hex or base 32; null if neither SHA-256 nor SHA-1."""
    name, _, value = (labelled or "").partition(":")
    name = name.strip().lower().replace("-", "")
    size = {"sha256": 32, "sha1": 20}.get(name)
    if size is None:
        return None
    if len(value) == 2 * size:
        return name, value.lower()
    try:
        return name, base64.b32decode(value.upper() + "=" * (-len(value) % 8)).hex()
    except binascii.Error:
        return None


def read_records(content: bytes) -> Iterator[dict]:
    """The records of an archive in order; BadRecord where framing or digest does not hold or a header is missing."""
    for at, member in _members(content):
        head, gap, rest = member.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not gap or not lines[0].startswith("WARC/"):
            raise BadRecord(f"no record header at {at}")
        fields = _fields(lines[1:])
        length, kind = _number(fields.get("content-length")), fields.get("warc-type")
        if length is None or length < 0 or kind is None:
            raise BadRecord(f"record at {at} has no type or length")
        block, end = rest[:length], rest[length:]
        if len(block) != length or end != b"\r\n\r\n":
            raise BadRecord(f"record at {at} is not framed by its Content-Length")
        payload: bytes | None = block
        size: int | None = length
        if fields.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
            http, _, payload = block.partition(b"\r\n\r\n")
            size = len(payload)
            if kind == "revisit":
                size = _number(_fields(http.decode("latin-1").split("\r\n")[1:]).get("content-length"))
        told = _plain_digest(fields.get("warc-payload-digest"))
        if kind == "revisit":
            payload, digest = None, told[1] if told and told[0] == "sha256" else None
        else:
            digest = hashlib.sha256(payload).hexdigest()
            if told and told[1] != (digest if told[0] == "sha256" else hashlib.sha1(payload).hexdigest()):
                raise BadRecord(f"digest of the record at {at} does not hold")
        whole = _plain_digest(fields.get("warc-block-digest"))
        if whole and whole[1] != hashlib.new(whole[0], block).hexdigest():
            raise BadRecord(f"digest of the record at {at} does not hold")
        yield {"page_id": _number(fields.get("x-page-id")), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": _number(fields.get("x-refers-to-page")), "payload_bytes": size, "payload_digest": digest, "payload": payload, "position": at}


def _write(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    open_, size = [], 0
    schema = pa.schema([("name", pa.string()), ("content", pa.binary())])

    def closed() -> pa.RecordBatch:
        content = b"".join(open_)
        return pa.RecordBatch.from_arrays([pa.array([f"{hashlib.sha256(content).hexdigest()[:32]}.warc.gz"]), pa.array([content], pa.binary())], schema=schema)

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "record_type", "refers_to", "payload", "payload_digest")), strict=True):
            page, url, kind, refers, payload, digest = row
            record = encode_record(page, url, kind, refers, payload, digest, date)
            if open_ and size + len(record) > ARCHIVE_BYTES:
                yield closed()
                open_, size = [], 0
            open_.append(record)
            size += len(record)
    if open_:
        yield closed()


def plan_records(pages: DataFrame) -> DataFrame:
    """Each page with its payload, digest and record type. Pages too small to be revisits have a join key of their own."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= MIN_REVISIT
    firsts = rows.filter(large).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first_id is not null")
    firsts = stash(firsts.select(F.col("payload_digest").alias("key"), "first_id"), "repeated")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    keyed = rows.withColumn("key", F.when(large, F.col("payload_digest")).otherwise(F.concat(F.lit("#"), F.coalesce(F.col("page_id").cast("string"), F.col("url"), F.lit("")))))
    return keyed.join(firsts, "key", "left").select("page_id", "url", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"), "payload", "payload_digest")


def write_archives(pages: DataFrame, date: str | None = None) -> DataFrame:
    """The archives of all pages, as written to the shared folder: name, content. date: of the records; default now."""
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return stash(map_arrow(plan_records(pages), lambda batches: _write(batches, date), "name string, content binary"), "warc")


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("archive", pa.string()), ("position", pa.int64())])
    if not payloads:
        schema = schema.remove(schema.get_field_index("payload"))
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = []
            for record in read_records(content.as_py()):
                rows.append({**record, "archive": name} if payloads else {k: v for k, v in record.items() if k != "payload"} | {"archive": name})
                if len(rows) >= 256:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives (name, content), or of `binaryFile` rows (path, content); payload is null for revisits."""
    name = "name" if "name" in archives.columns else "path"
    schema = RECORDS if payloads else RECORDS.replace("payload binary, ", "")
    return map_arrow(archives.select(name, "content"), lambda batches: _read(batches, payloads), schema)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"))
    return read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM m
"""
