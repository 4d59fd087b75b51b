"""WARC archives with revisit resolution.

A capture is a row with a key, a target URI, a date and a payload. Only its
header (key, URI, date, payload digest and length) is shuffled by digest; of
captures with equal payloads the one with the largest key keeps its payload as
a `response` record, the others become `revisit` records that refer to it.
Payloads move once, to meet the records that keep them, and all records are
written anew with fresh headers.

The archive is written by Spark's own text writer: a record is a string, and
the two line breaks that end it are the line separator. So a lost task or
executor leaves no torn record behind, and any store that Spark writes to will
do. Files are gzip streams of WARC/1.1 records. Reading takes one file a task
row (at most 2 GB compressed, of any number of gzip members), inflates it in
steps and holds one record at a time beside the file.

Defined results: a null payload is empty and null URIs are empty; a null key
is smaller than all others and its record carries no key field; captures that
tie for the largest key (rows that repeat it) are all responses, and rows that
repeat key, URI and payload share a record id; payloads under `least_bytes`
are all responses; line breaks in a URI are written as %0D and %0A; an empty
table gives an archive without records; columns beside the named ones are not
read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm.common import shared_dir, written
from kinloom.operators.components import with_keyed

CRLF = "\r\n"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Compressed bytes are inflated in steps of so many.
STEP = 1 << 20


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base 32: 160 bits are eight groups of 20 bits, each four digits."""
    digits = F.sha1(data)

    def group(g: Column) -> Column:
        bits = F.conv(F.substring(digits, 5 * g + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(ALPHABET), F.shiftright(bits, 15 - 5 * i).bitwiseAND(31) + 1, F.lit(1)) for i in range(4)])

    return F.concat(*[group(F.lit(g)) for g in range(8)])


def captures(rows: DataFrame, key: str, uri: str, payload: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(key, uri, date, payload): captures of a table of pages; the payload is the column's UTF-8."""
    clean = F.replace(F.replace(F.coalesce(F.col(uri), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return rows.select(F.col(key).cast("long").alias("key"), clean.alias("uri"), F.lit(date).alias("date"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))


def headers(found: DataFrame) -> DataFrame:
    """(key, uri, date, digest, bytes): what of a capture is shuffled."""
    return found.select("key", "uri", "date", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))


def record_id(key: Column, uri: Column, digest: Column) -> Column:
    """A name-based URN, the same for the same capture."""
    h = F.sha1(F.concat_ws("\n", key.cast("string"), uri, digest).cast("binary"))
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def resolved(spark: SparkSession, heads: DataFrame, least_bytes: int = 0) -> DataFrame:
    """heads with record_type, record_id, and for revisits the key, URI, date and record id of the response they refer to."""
    heads = written(spark, heads.withColumn("record_id", record_id(F.col("key"), F.col("uri"), F.col("digest"))), "headers")
    large = F.col("bytes") >= least_bytes
    last = F.max(F.struct("key", "uri", "date", "record_id"))
    original = written(spark, heads.where(large).groupBy("digest").agg(last.alias("o"), F.count("*").alias("copies")), "originals")
    shared = with_keyed(heads.where(large), original, ["digest"], "copies", heads.count())
    first = F.col("key").eqNullSafe(F.col("o.key"))
    refers = [F.when(~first, F.col(f"o.{c}")).alias(f"refers_{c}") for c in ("key", "uri", "date", "record_id")]
    kinds = {c.split("_", 1)[1]: c for c in ("refers_key", "refers_uri", "refers_date", "refers_record_id")}
    out = shared.select(*heads.columns, F.when(first, "response").otherwise("revisit").alias("record_type"), *refers)
    if least_bytes <= 0:
        return out
    alone = heads.where(~large).select(*heads.columns, F.lit("response").alias("record_type"), *[F.lit(None).cast(heads.schema[k].dataType).alias(c) for k, c in kinds.items()])
    return out.unionByName(alone)


def _fields(*named: tuple[str, Column]) -> Column:
    """Header lines; a field whose value is null is left out."""
    return F.concat_ws("", F.lit(VERSION + CRLF), *[F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)) for name, value in named], F.lit(CRLF))


def _http(bytes_: Column) -> Column:
    return F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), bytes_.cast("string"), F.lit(CRLF * 2))


def _common(kind: str, length: Column) -> list[tuple[str, Column]]:
    return [
        ("WARC-Type", F.lit(kind)),
        ("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        ("WARC-Date", F.col("date")),
        ("WARC-Target-URI", F.col("uri")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Capture-Key", F.col("key")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", length),
    ]


def responses(rows: DataFrame) -> DataFrame:
    """(record) of rows with all header columns and the payload."""
    http = _http(F.col("bytes"))
    head = _fields(*_common("response", F.octet_length(http) + F.col("bytes")))
    return rows.select(F.concat(head.cast("binary"), http.cast("binary"), F.col("payload")).alias("record"))


def revisits(rows: DataFrame) -> DataFrame:
    """(record) of revisits: the HTTP header alone, and what it refers to."""
    http = _http(F.col("bytes"))
    refers = [
        ("WARC-Profile", F.lit(PROFILE)),
        ("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_record_id"), F.lit(">"))),
        ("WARC-Refers-To-Target-URI", F.col("refers_uri")),
        ("WARC-Refers-To-Date", F.col("refers_date")),
    ]
    head = _fields(*refers, *_common("revisit", F.octet_length(http)))
    return rows.select(F.concat(head.cast("binary"), http.cast("binary")).alias("record"))


def write(records: DataFrame, path: str) -> str:
    """The records as gzip archives in a folder."""
    records.select(F.col("record").cast("string").alias("record")).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)
    return path


def deduplicate(spark: SparkSession, found: DataFrame, path: str, least_bytes: int = 0) -> str:
    """Writes captures (key, uri, date, payload) as archives in which equal payloads of at least `least_bytes` bytes stand once; found is read twice."""
    roles = written(spark, resolved(spark, headers(found), least_bytes), "roles")
    keep = roles.where("record_type = 'response'").select("key", "uri", "date", "digest", "bytes", "record_id").dropDuplicates()
    with_payload = found.withColumn("digest", base32_sha1(F.col("payload")))
    same = (F.coalesce(with_payload.key, F.lit(-1)) == F.coalesce(keep.key, F.lit(-1))) & (with_payload.digest == keep.digest) & with_payload.key.eqNullSafe(keep.key) & (with_payload.uri == keep.uri) & (with_payload.date == keep.date)
    full = with_payload.join(keep, same).select(*[keep[c] for c in keep.columns], with_payload.payload)
    return write(responses(full).unionByName(revisits(roles.where("record_type = 'revisit'"))), path)


# --- reading --------------------------------------------------------------------------------------


def _inflated(data: memoryview) -> Iterator[bytes]:
    """The bytes of a file: all members of a gzip stream, or the data as it is."""
    if bytes(data[:2]) != b"\x1f\x8b":
        for s in range(0, len(data), STEP):
            yield bytes(data[s : s + STEP])
        return
    tool, at, rest = zlib.decompressobj(31), 0, b""
    while rest or at < len(data):
        if not rest:
            rest, at = bytes(data[at : at + STEP]), at + STEP
        if tool.eof:
            tool = zlib.decompressobj(31)
        out = tool.decompress(rest, STEP)
        rest = tool.unused_data if tool.eof else tool.unconsumed_tail
        if out:
            yield out
    while not tool.eof and (out := tool.decompress(b"", STEP)):
        yield out


class _Stream:
    """Takes bytes from blocks."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.held = blocks, bytearray()

    def more(self) -> bool:
        block = next(self.blocks, None)
        if block is None:
            return False
        self.held += block
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the mark, which is taken too; None at the end."""
        seen = 0
        while (at := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                return None
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parsed(data: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of a file; a torn record at its end raises."""
    stream = _Stream(_inflated(data))
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").lstrip("\r\n").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record begins with {lines[0][:40]!r}")
        fields = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}
        n = int(fields["content-length"])
        block = stream.take(n)
        if len(block) < n:
            raise ValueError("a record ends before its length")
        yield fields, block
        stream.take(4)


RECORD = "key long, record_type string, record_id string, uri string, date string, payload_bytes long, payload_digest string, refers_record_id string"


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of all archives in a folder, with `payload` (binary) if asked for.

    Lengths and digests of responses are made anew from what was read; those
    of revisits are null until `linked` finds their response.
    """
    names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * payloads

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                for fields, block in parsed(memoryview(batch.column(0)[i].as_buffer())):
                    body = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
                    whole = fields["warc-type"] != "revisit"
                    key = fields.get("warc-capture-key")
                    row = [int(key) if key else None, fields["warc-type"], fields["warc-record-id"].strip("<>"), fields.get("warc-target-uri", ""), fields.get("warc-date"), len(body) if whole else None, base64.b32encode(hashlib.sha1(body).digest()).decode() if whole else None, fields.get("warc-refers-to", "").strip("<>") or None]
                    rows.append([*row, body] if payloads else row)
                    held += len(body) if payloads else 0
                    if len(rows) == 4096 or held > STEP:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), kinds[j]) for j, c in enumerate(zip(*rows, strict=True))], names)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, RECORD + ", payload binary" * payloads)


def linked(spark: SparkSession, records: DataFrame) -> DataFrame:
    """records with revisits joined to the responses they refer to: refers_key, and length and digest of the full payload."""
    records = written(spark, records, "records")
    again = records.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    copies = again.groupBy(F.col("refers_record_id").alias("record_id")).agg(F.count("*").alias("copies"))
    full = records.where("record_type = 'response'").select("record_id", "payload_bytes", "payload_digest", F.col("key").alias("refers_key")).dropDuplicates(["record_id"])
    asked = written(spark, full.join(copies, "record_id").withColumnRenamed("record_id", "refers_record_id"), "asked")
    back = with_keyed(again, asked, ["refers_record_id"], "copies", again.count())
    columns = [*records.columns, "refers_key"]
    return records.where("record_type <> 'revisit'").withColumn("refers_key", F.lit(None).cast("long")).select(columns).unionByName(back.select(columns))


def archived(spark: SparkSession, found: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Captures written as deduplicated archives in the shared folder and read back, revisits linked."""
    path = deduplicate(spark, found, f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}.warc", least_bytes)
    return linked(spark, read(spark, path))
