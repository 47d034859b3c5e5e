"""WARC archives: written by Spark, and read back by a reader that salvages what is intact.

Writing: a record is a gzip member of its own. Spark's text writer ends each row with a
separator; a member ends with a zero byte (its size is below 16 MiB, or an empty member
follows), so with that byte as separator the files are plain concatenations of members, and
they are committed as any Spark output is. Payloads that occur before are written as revisits;
only ids and hashes are joined for that, and copies of a payload are collapsed before they move.

Reading: a file is a run of gzip members or of bare records. Each is checked: the member's
checksum, version line, fields, length, end mark, digests of block and payload. Where a check
fails the reader searches for the next member or version line at which all checks hold, goes
on from there, and logs the bytes between as a quarantined gap. So one bad byte costs one
record, and records and gaps together account for every byte.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mimicry.llm.common import shared_dir, stored, table

REVISIT_FROM = 0  # bytes of a payload from which copies become revisits
ARCHIVE_RECORDS = 1 << 14  # in a file, at most
BATCH_BYTES = 8 << 20
LEVEL = 5
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_NO_RECORD = zlib.compress(b"", 1, wbits=31)
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_HTTP_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*\r\n", re.IGNORECASE)
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

RECORDS = (
    "type string, page_id long, url string, sha1 string, bytes long, payload binary, copy int, "
    "first_id long, first_url string"
)
ROWS = (
    "path string, offset long, length long, inner long, gap string, type string, record_id string, refers_to string, "
    "uri string, page_id long, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"
)


def _order(page_id: str, url: str) -> Column:
    """Rows by id, then by address, null last."""
    return F.struct(F.col(page_id).isNull().alias("a"), F.col(page_id).alias("id"), F.col(url).isNull().alias("b"), F.col(url).alias("url"))


def records(
    pages: DataFrame, *, page_id: str = "page_id", url: str = "url", payload: str = "html", revisit_from: int = REVISIT_FROM
) -> DataFrame:
    """The records of ``pages``, one a row: responses with their payloads, revisits without.

    Of rows with equal payloads of at least ``revisit_from`` bytes the one with the smallest id
    (then address, null last) is the response. Null payloads are empty. Rows equal in id,
    address and payload are numbered by ``copy``; other columns play no part.
    """
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), body.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("hash"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    large = F.col("bytes") >= revisit_from
    same = rows.filter(large).groupBy("hash", "sha1", "bytes", "page_id", "url").agg(F.count("*").cast("int").alias("copies"))
    same = stored(same, "warc-rows")
    firsts = same.groupBy("hash").agg(F.min(_order("page_id", "url")).alias("first"))
    first = (F.col("first.id"), F.col("first.url"))
    is_first = F.col("page_id").eqNullSafe(first[0]) & F.col("url").eqNullSafe(first[1])
    revisits = same.join(firsts, "hash").withColumn("_next", is_first.cast("int")).filter("copies > _next")
    revisits = revisits.select(
        F.lit("revisit").alias("type"), "page_id", "url", "sha1", "bytes", F.lit(None).cast("binary").alias("payload"),
        F.explode(F.sequence(F.col("_next"), F.col("copies") - 1)).alias("copy"), first[0].alias("first_id"), first[1].alias("first_url"),
    )
    none = (F.lit(None).cast("long").alias("first_id"), F.lit(None).cast("string").alias("first_url"))
    whole = rows.filter(large).groupBy("hash", "sha1", "bytes").agg(
        F.min(_order("page_id", "url")).alias("first"), F.first("payload").alias("payload")
    )
    whole = whole.select(
        F.lit("response").alias("type"), first[0].alias("page_id"), first[1].alias("url"), "sha1", "bytes", "payload", F.lit(0).alias("copy"), *none
    )
    small = rows.filter(~large).groupBy("hash", "sha1", "bytes", "page_id", "url").agg(
        F.count("*").cast("int").alias("copies"), F.first("payload").alias("payload")
    )
    numbered = F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")
    small = small.select(F.lit("response").alias("type"), "page_id", "url", "sha1", "bytes", "payload", numbered, *none)
    if revisit_from > 0:
        whole = whole.unionByName(small)
    return whole.unionByName(revisits)


def base32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def _address(url: str) -> str:
    """An address on one line: control characters and spaces as percent escapes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record_id(page_id: int | None, url: str | None, sha1: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, repr((page_id, url, sha1, copy)))}>"


def record_bytes(row: dict) -> bytes:
    """One record with its end mark."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    block = http + (row["payload"] or b"")
    fields = {
        "WARC-Type": row["type"],
        "WARC-Record-ID": record_id(row["page_id"], row["url"], row["sha1"], row["copy"]),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if row["url"] is None else _address(row["url"]),
        "WARC-Payload-Digest": f"sha1:{base32(row['sha1'])}",
        "WARC-Block-Digest": f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type": "application/http; msgtype=response",
        "Page-ID": row["page_id"],
    }
    if row["type"] == "revisit":
        fields["WARC-Profile"] = PROFILE
        fields["WARC-Refers-To"] = record_id(row["first_id"], row["first_url"], row["sha1"], 0)
    fields["Content-Length"] = len(block)
    head = "".join(f"{name}: {value}\r\n" for name, value in fields.items() if value is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """The record as a gzip member that ends with a zero byte, an empty one behind it if need be."""
    packed = zlib.compress(record, LEVEL, wbits=31)
    return packed if packed[-1] == 0 else packed + _NO_RECORD


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, size = [], 0
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            out.append(member(record_bytes(row))[:-1])
            size += len(out[-1])
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write_archives(rows: DataFrame, path: str, archive_records: int = ARCHIVE_RECORDS) -> None:
    """Write :func:`records` below ``path``, a member each, in files of at most so many."""
    members = rows.mapInArrow(_members, "value binary").select(F.col("value").cast("string"))
    members.write.option("lineSep", "\0").option("maxRecordsPerFile", archive_records).text(path)


class Damaged(Exception):
    """A check that failed."""


@dataclass
class Found:
    """A record, or a gap with its reason, at ``offset`` of the file and ``inner`` of its member."""

    offset: int
    length: int
    inner: int = 0
    gap: str | None = None
    fields: dict[str, str] = field(default_factory=dict)
    payload: bytes | None = None
    payload_bytes: int | None = None
    payload_digest: str | None = None


def _digest_differs(stated: str | None, data: bytes | memoryview) -> bool:
    """Whether a digest is stated, of a kind known here, and another one than the data's."""
    kind, _, value = (stated or "").partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in ("sha1", "sha256", "md5"):
        return False
    digest = hashlib.new(kind, data)
    value = value.strip()
    return value.upper().rstrip("=") != base64.b32encode(digest.digest()).decode().rstrip("=") and value.lower() != digest.hexdigest()


def _fields(head: bytes) -> dict[str, str]:
    """Named fields, names in lower case; folded lines are joined. A name's first value counts."""
    try:
        lines = re.sub(r"\r\n[ \t]+", " ", head.decode()).split("\r\n")
    except UnicodeDecodeError as error:
        raise Damaged("header is not UTF-8") from error
    fields: dict[str, str] = {}
    for line in filter(None, lines):
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"\S+", name):
            raise Damaged("malformed field")
        fields.setdefault(name.lower(), value.strip())
    return fields


def parse_record(data: bytes, start: int) -> tuple[Found, int]:
    """The record that begins at ``start``, and where it ends."""
    version = _VERSION.match(data, start)
    if not version:
        raise Damaged("no version line")
    head_end = data.find(b"\r\n\r\n", version.end() - 2)
    if head_end < 0:
        raise Damaged("header without end")
    fields = _fields(data[version.end() : head_end])
    missing = [name for name in REQUIRED if not fields.get(name)]
    if missing:
        raise Damaged(f"field {missing[0]} is missing")
    if not re.fullmatch("[0-9]{1,18}", fields["content-length"]):
        raise Damaged("content-length is no number")
    begin = head_end + 4
    end = begin + int(fields["content-length"])
    if end + 4 > len(data):
        raise Damaged("block is cut off")
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("no end mark behind the block")
    block = data[begin:end]
    if _digest_differs(fields.get("warc-block-digest"), block):
        raise Damaged("block digest differs")
    found = Found(start, end + 4 - start, fields=fields, payload_digest=(fields.get("warc-payload-digest") or "").partition(":")[2] or None)
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        http_end = block.find(b"\r\n\r\n")
        if http_end < 0:
            raise Damaged("HTTP header without end")
        length = _HTTP_LENGTH.search(block, 0, http_end + 2)
        found.payload_bytes = int(length[1]) if length else None
        payload = block[http_end + 4 :]
    if fields["warc-type"] != "revisit":  # a revisit states the digest of a payload it does not hold
        if _digest_differs(fields.get("warc-payload-digest"), payload):
            raise Damaged("payload digest differs")
        found.payload, found.payload_bytes = payload, len(payload)
        found.payload_digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return found, end + 4


def _inflated(data: bytes, start: int) -> tuple[bytes, int]:
    """The plain bytes of the member that begins at ``start``, and where it ends."""
    inflate = zlib.decompressobj(wbits=31)
    out, at = [], start
    try:
        while not inflate.eof:
            if at >= len(data):
                raise Damaged("member is cut off")
            piece = data[at : at + (1 << 20)]
            out.append(inflate.decompress(piece))
            at += len(piece)
    except zlib.error as error:
        raise Damaged(f"member: {str(error).rpartition(': ')[2]}") from error
    return b"".join(out), at - len(inflate.unused_data)


def _unit(data: bytes, start: int) -> tuple[list[Found], int]:
    """What the member or bare record at ``start`` holds, and where it ends.

    Damage inside a sound member is a gap of that member; one that holds no sound record at all
    is damaged as a whole.
    """
    if not data.startswith(_MAGIC, start):
        found, end = parse_record(data, start)
        return [found], end
    plain, end = _inflated(data, start)
    inside = list(_salvaged(plain, members=False))
    if inside and all(x.gap for x in inside):
        raise Damaged(inside[0].gap)
    for x in inside:
        x.inner, x.offset = x.offset, start
        if not x.gap:
            x.length = end - start
    return inside, end


def _salvaged(data: bytes, members: bool = True) -> Iterator[Found]:
    start, bad, reason = 0, None, ""
    while start < len(data):
        try:
            if not members and not _VERSION.match(data, start):
                raise Damaged("no version line")
            found, end = _unit(data, start)
        except Damaged as damaged:
            if bad is None:
                bad, reason = start, str(damaged)
            further = (_START if members else _VERSION).search(data, start + 1)
            start = further.start() if further else len(data)
            continue
        if bad is not None:
            yield Found(bad, start - bad, gap=reason)
            bad = None
        yield from found
        start = end
    if bad is not None:
        yield Found(bad, len(data) - bad, gap=reason)


def salvaged(data: bytes) -> Iterator[Found]:
    """Records and gaps of an archive's bytes, in order."""
    yield from _salvaged(data)


def _rows(path: str, found: list[Found], payloads: bool) -> pa.RecordBatch:
    def of(name: str) -> list[str | None]:
        return [x.fields.get(name) for x in found]

    ids = [int(v) if v and re.fullmatch(r"-?\d{1,19}", v) else None for v in of("page-id")]
    ids = [v if v is not None and -(1 << 63) <= v < 1 << 63 else None for v in ids]
    columns = {
        "path": pa.array([path] * len(found), pa.string()),
        "offset": pa.array([x.offset for x in found], pa.int64()),
        "length": pa.array([x.length for x in found], pa.int64()),
        "inner": pa.array([x.inner for x in found], pa.int64()),
        "gap": pa.array([x.gap for x in found], pa.string()),
        "type": pa.array(of("warc-type"), pa.string()),
        "record_id": pa.array(of("warc-record-id"), pa.string()),
        "refers_to": pa.array(of("warc-refers-to"), pa.string()),
        "uri": pa.array(of("warc-target-uri"), pa.string()),
        "page_id": pa.array(ids, pa.int64()),
        "payload_digest": pa.array([x.payload_digest for x in found], pa.string()),
        "payload_bytes": pa.array([x.payload_bytes for x in found], pa.int64()),
        "fields": pa.array([None if x.gap else list(x.fields.items()) for x in found], pa.map_(pa.string(), pa.string())),
        "payload": pa.array([x.payload if payloads else None for x in found], pa.binary()),
    }
    return pa.RecordBatch.from_pydict(columns)


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives below ``path``, gzipped or bare, told by their content.

    A row is a record, or, where ``gap`` says why, quarantined bytes: ``length`` of them from
    ``offset`` of the file, or from ``inner`` of the sound member that begins there. An empty
    file has no rows. One archive is held in memory by the task that reads it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                held, size = [], 0
                for found in salvaged(content.as_py()):
                    held.append(found)
                    size += (len(found.payload) if payloads and found.payload else 0) + 500
                    if not payloads:
                        found.payload = None
                    if size > BATCH_BYTES:
                        yield _rows(name.as_py(), held, payloads)
                        held, size = [], 0
                if held:
                    yield _rows(name.as_py(), held, payloads)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ROWS)


def op12_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(records(pages), path)
    read = stored(read_archives(spark, path, payloads=False).filter("gap IS NULL").drop("payload", "fields"), "warc-read")
    columns = ["page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type")]
    responses = read.filter("type = 'response'")
    target = responses.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("first_id"))
    revisits = read.filter("type = 'revisit'").join(target, "refers_to", "left").withColumnRenamed("first_id", "_first")
    return responses.select(*columns, F.lit(None).cast("long").alias("refers_to")).union(
        revisits.select(*columns, F.col("_first").alias("refers_to"))
    )


# The same result for an independent engine: SHA-1 in base 32 from its hexadecimal digits.
OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, coalesce(url, '') AS url, url IS NULL AS no_url FROM pages),
r AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex,
         row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST, no_url, url) AS place,
         first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST, no_url, url) AS first_id
  FROM p),
b AS (
  SELECT *, list_reduce(list_transform(string_split(hex, ''),
         lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']
                   [strpos('0123456789abcdef', c)]), lambda x, y: x || y) AS bits
  FROM r)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       list_reduce(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
         (1 + 16 * bits[(5 * i + 1)::INT]::INT + 8 * bits[(5 * i + 2)::INT]::INT + 4 * bits[(5 * i + 3)::INT]::INT
            + 2 * bits[(5 * i + 4)::INT]::INT + bits[(5 * i + 5)::INT]::INT)::INT]), lambda x, y: x || y) AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place = 1 THEN NULL ELSE first_id END AS refers_to
FROM b
"""
