r"""WARC archives: write captures, read records back, assemble transactions.

``write`` makes three records a capture (request, response or revisit, metadata); the response and the metadata
name their request in WARC-Concurrent-To.  A record ends in two CRLFs, which is the line separator of Spark's own
text writer, so archives are written by the JVM, gzip-compressed, to any file system Spark knows, with task
commit; a lost executor's files are written again.  A file holds ``RECORDS`` records at most and is one gzip member.
``read`` takes archives from Spark's text reader, two CRLFs being the end of a line, so a task holds a few lines and one
record of an archive of any size; records are put together again by Content-Length, so text in a payload that looks like a
record does no harm.  ``assemble`` joins the records of a transaction through all their concurrent-to identifiers to one
nested row a capture: records that name the same one, and where records name several or one that names another in turn,
the connected components of these identifiers.

Equal payloads: the capture with the largest page_id is the response, all others revisit it and carry no payload.
Null payloads count as empty; empty payloads are equal to each other.  A null page_id counts as the smallest.
Rows that repeat the largest page_id with the same payload are responses each.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow, fresh_path, read_table, ship, written
from .components import components

CRLF = "\r\n"
CRLF2 = b"\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS = 30_000
DATE = "2024-01-01T00:00:00Z"

RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("concurrent_to", T.StringType()),
    T.StructField("refers_to", T.StringType()), T.StructField("target_uri", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("head", T.StringType()), T.StructField("payload", T.BinaryType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("actual_digest", T.StringType()), T.StructField("concurrent", T.ArrayType(T.StringType())),
])


def base32(digest: Column) -> Column:
    """Upper-case base32 of a hexadecimal SHA-1 (a plain column, it is used often): 20 bits are four characters."""
    letters = F.lit(BASE32)
    out = []
    for k in range(8):
        v = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substr(letters, F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _record(kind: str, fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the CRLFs after it; a header field that is null is left out."""
    head = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Date: {DATE}{CRLF}")]
    head += [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in fields]
    return F.concat(*head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _one_line(c: Column) -> Column:
    return F.regexp_replace(c, r"[\r\n]+", " ")


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Archives of ``pages`` in folder ``path``."""
    text = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), _one_line(F.col(url)).alias("url"), text.alias("html")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    roles = rows.groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    rows = rows.join(roles, "sha").withColumn("request", F.expr("uuid()"))
    rows = rows.withColumn("digest", _let(F.col("sha"), base32))
    uuid_of = lambda c: F.concat(F.lit("<urn:uuid:"), c, F.lit(">"))
    page_of = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(":"), F.col("digest"), F.lit(">"))
    size = F.octet_length("html").cast("string")
    path_of = F.coalesce(F.regexp_replace("url", r"^[a-z]+://[^/]*|#.*$", ""), F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), size, F.lit(CRLF * 2))
    host = F.coalesce(F.regexp_extract("url", r"^[a-z]+://([^/]*)", 1), F.lit(""))
    target = ("WARC-Target-URI", F.col("url"))
    hub = ("WARC-Concurrent-To", uuid_of(F.col("request")))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    http = ("Content-Type", F.lit("application/http; msgtype=response"))
    request = _record("request", [("WARC-Record-ID", uuid_of(F.col("request"))), target, ("Content-Type", F.lit("application/http; msgtype=request"))],
                      F.concat(F.lit("GET "), F.when(path_of == "", "/").otherwise(path_of), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2)))
    response = _record("response", [("WARC-Record-ID", page_of(F.col("page_id"))), hub, target, digest, http], F.concat(head, F.col("html")))
    revisit = _record("revisit", [("WARC-Record-ID", page_of(F.col("page_id"))), hub, target, digest, ("WARC-Refers-To", page_of(F.col("last"))),
                                  ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), http], head)
    metadata = _record("metadata", [("WARC-Record-ID", uuid_of(F.expr("uuid()"))), hub, target, ("Content-Type", F.lit("application/warc-fields"))],
                       F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(CRLF)))
    middle = F.when(F.col("page_id").eqNullSafe(F.col("last")), response).otherwise(revisit)
    rows.select(F.explode(F.array(request, middle, metadata)).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


# --- reading --------------------------------------------------------------------------------------------------


class _Archive:
    """The records of one archive, whose bytes come bit by bit."""

    def __init__(self):
        self.buffer, self.looked, self.fields, self.over = bytearray(), 0, None, False

    def add(self, part: bytes) -> Iterator[dict]:
        self.buffer += part
        while True:
            if self.fields is None:
                end = self.buffer.find(CRLF2, self.looked)
                if end == 0 and not self.over:  # the reader's end of the last line, where a block ends in CRLF
                    self.over = True
                    del self.buffer[: len(CRLF2)]
                    continue
                if end < 0:
                    self.looked = max(0, len(self.buffer) - len(CRLF2))
                    return
                self.fields, self.looked = _fields(b"" if self.over else bytes(self.buffer[:end])), 0
                del self.buffer[: end + len(CRLF2)]
            size = int(self.fields["content-length"][0])
            if len(self.buffer) < size + len(CRLF2):
                return
            if self.buffer[size : size + len(CRLF2)] != CRLF2:
                raise ValueError("a record doesn't end in two CRLFs")
            yield _parsed(self.fields, bytes(self.buffer[:size]))
            del self.buffer[: size + len(CRLF2)]
            self.fields = None

    def close(self) -> None:
        if self.fields is not None or self.buffer.strip(b"\r\n"):
            raise ValueError(f"the archive ends within a record: {bytes(self.buffer[:80])!r}")


def _fields(head: bytes) -> dict[str, list[str]]:
    lines = head.decode("utf-8", "replace").split(CRLF)
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
    fields: dict[str, list[str]] = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields.setdefault(name.strip().lower(), []).append(value.strip())
    return fields


def _parsed(fields: dict[str, list[str]], block: bytes) -> dict:
    first = lambda name: fields.get(name, [None])[0]
    http, payload = "", block
    if (first("content-type") or "").startswith("application/http"):
        top, _, payload = block.partition(CRLF2)
        http = top.decode("utf-8", "replace")
    said = re.search(r"(?im)^content-length:\s*(\d+)", http)
    kind = first("warc-type")
    return {
        "record_id": first("warc-record-id"), "type": kind, "concurrent_to": first("warc-concurrent-to"), "refers_to": first("warc-refers-to"),
        "target_uri": first("warc-target-uri"), "date": first("warc-date"), "payload_digest": first("warc-payload-digest"), "head": http, "payload": payload,
        "payload_bytes": int(said[1]) if kind == "revisit" and said else len(payload),
        "actual_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else None, "concurrent": fields.get("warc-concurrent-to"),
    }


def records_of(raw: bytes) -> Iterator[dict]:
    """The records of one archive, plain or gzip-compressed in any number of members."""
    archive = _Archive()
    yield from archive.add(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
    archive.close()


def _read(batches: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Rows (file, what stands before two CRLFs) in the order of the file."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(RECORD)
    now, archive, rows, size = None, _Archive(), [], 0
    for batch in batches:
        for file, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if file != now:
                archive.close()
                now, archive = file, _Archive()
            for r in archive.add(part.as_py() + CRLF2):
                rows.append(r)
                size += len(r["payload"]) + 500
                if size > most:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
    archive.close()
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the gzip-compressed archives in ``path``, which Spark doesn't split."""
    ship(spark)
    lines = spark.read.option("lineSep", CRLF * 2).option("pathGlobFilter", "*.gz").text(path)
    return arrow(lines.select(F.col("_metadata.file_path"), F.col("value").cast("binary")), _read, RECORD)


def _transactions(records: DataFrame) -> DataFrame:
    """``records`` with ``key``, equal for the records of a transaction."""
    names = records.where("concurrent IS NOT NULL").select("record_id", "concurrent")
    several = names.where(F.size("concurrent") > 1)
    chained = names.select(F.explode("concurrent").alias("record_id")).join(names, "record_id", "left_semi")
    if not several.take(1) and not chained.take(1):
        return records.withColumn("key", F.coalesce("concurrent_to", "record_id"))
    number = lambda c: F.xxhash64(c)
    roots = components(names.select(number("record_id").alias("a"), F.explode("concurrent").alias("c")).select("a", number("c").alias("b")))
    placed = records.withColumn("number", number("record_id")).join(roots.withColumnRenamed("v", "number"), "number", "left")
    return placed.withColumn("key", F.coalesce("root", "number"))


def assemble(records: DataFrame, fields: tuple[str, ...] = tuple(n for n in RECORD.names if n != "type")) -> DataFrame:
    """One nested row a capture: request, response (or revisit) and metadata joined through concurrent-to.

    ``transaction`` is the request's id, or the smallest of a transaction without one.  A record that names no other and is
    named by none is a transaction.  ``fields`` are those nested in each part; a caller that needs no payloads leaves them
    out, and they don't travel.
    """
    is_ = {"request": F.col("type") == "request", "response": F.col("type").isin("response", "revisit"), "metadata": F.col("type") == "metadata"}
    held = written(records.select(*dict.fromkeys(("record_id", "type", "concurrent_to", "concurrent", *fields))), "records")
    name = F.coalesce(F.max(F.when(is_["request"], F.col("record_id"))), F.min("record_id"))
    parts = _transactions(held).groupBy("key").agg(
        *[F.max(F.when(test, F.col(n))).alias(f"{part}_{n}") for part, test in is_.items() for n in fields], F.max(F.when(is_["response"], F.col("type"))).alias("response_type"), name.alias("transaction")
    )
    return parts.select(
        "transaction",
        *[F.struct(*[F.col(f"{part}_{n}").alias(n) for n in fields], *([F.col("response_type").alias("type")] if part == "response" else [])).alias(part) for part in is_],
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write(read_table(spark, sf_dir, "pages"), path)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+):", 1)
    got = assemble(read(spark, path), ("record_id", "refers_to", "payload_digest", "payload_bytes", "actual_digest")).select(
        page(F.col("response.record_id")).alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.type").alias("record_type"),
        F.coalesce("response.actual_digest", F.regexp_replace("response.payload_digest", "^sha1:", "")).alias("payload_digest"), page(F.col("response.refers_to")).alias("refers_to"),
    )
    number = lambda c: F.when(F.col(c) != "", F.col(c).cast("long"))
    return got.select(number("page_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", number("refers_to")).alias("refers_to"))


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT page_id, h, d, max(page_id) OVER (PARTITION BY d) AS last FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((list_sum([(instr('0123456789abcdef', substr(d, 5 * (i // 4) + j + 1, 1)) - 1) * (1 << (16 - 4 * j)) for j in range(0, 5)])::BIGINT >> (15 - 5 * (i % 4))) % 32), 1) for i in range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM m
"""
