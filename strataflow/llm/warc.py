"""Content-addressed web archive.

An archive is two tables: `payloads` holds each distinct payload once, under its SHA-256, which is computed
again and compared when it is read; `headers` holds the exact header block of every record with the digest
of its payload.  A join of the two gives back every original record.  Of records with equal payloads, the one
with the largest id is the response and the others are revisits that refer to it; payloads under
`revisit_from` bytes are always stored as responses.

Null html is an empty payload; null url an empty target; characters that a target can't have are percent-encoded.  A null id is the
smallest one and has an empty X-Page-ID.  Empty tables give empty archives.  Rows of the
same id and payload are separate records of that id.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

DATE = "2024-01-01T00:00:00Z"
_CRLF = "\r\n"


def base32(hex_: Column) -> Column:
    """Base32 of 20 bytes given as 40 hex digits: 5 bytes are 8 digits of base 32."""
    parts = [F.lpad(F.conv(F.substring(hex_, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(id_: Column) -> Column:
    """A name-based URN of a page's record."""
    h = F.md5(F.concat(F.lit("record:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ""))], F.lit(">"))


def _target(url: Column) -> Column:
    """Control characters and spaces, which would break a header, percent-encoded."""
    out = url
    for c in (*range(33), 127):
        out = F.replace(out, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7f]"), out).otherwise(url)


def _rows(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))


def write(pages: DataFrame, path: str, *, revisit_from: int = 0) -> str:
    """The archive of pages (page_id, url, html) below path."""
    spark = pages.sparkSession
    rows = _rows(pages)
    keyed = C.written(rows.select("page_id", "url", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"), F.length("payload").cast("long").alias("payload_bytes")), "keyed")
    # one row per payload and task reaches the shuffle
    first = keyed.groupBy("sha256").agg(F.max("page_id").alias("first_id"))
    # the payload of one record of each; keyed by the id too, so that copies of a payload are spread
    of = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    chosen = first.select("sha256", F.coalesce(F.col("first_id").cast("string"), F.lit("")).alias("_of"))
    held = rows.select("payload", F.sha2("payload", 256).alias("sha256"), of.alias("_of")).join(chosen, ["sha256", "_of"])
    held.dropDuplicates(["sha256", "_of"]).select("sha256", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")
    own = keyed.join(first, "sha256")
    again = (~F.col("page_id").eqNullSafe(F.col("first_id"))) & (F.col("payload_bytes") >= revisit_from)
    line = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x], F.lit(_CRLF))
    header = F.concat(
        line("WARC/1.1"),
        line("WARC-Type: ", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID: ", record_id(F.col("page_id"))),
        line("WARC-Date: ", DATE),
        line("WARC-Target-URI: ", _target(F.col("url"))),
        line("WARC-Payload-Digest: sha1:", base32(F.col("sha1"))),
        F.when(again, line("WARC-Refers-To: ", record_id(F.col("first_id")))).otherwise(""),
        F.when(again, line("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")).otherwise(""),
        line("X-Page-ID: ", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.when(again, line("X-Refers-To-Page-ID: ", F.coalesce(F.col("first_id").cast("string"), F.lit("")))).otherwise(""),
        line("Content-Type: text/html; charset=utf-8"),
        line("Content-Length: ", F.when(again, "0").otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(_CRLF),
    )
    own.select("page_id", "sha256", header.cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    return path


def _sound(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads; one that doesn't match its digest fails the read."""
    payloads = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    return payloads.where(F.when(F.sha2("payload", 256) == F.col("sha256"), True).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))).cast("boolean")))


def _headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("page_id long, sha256 string, header binary").parquet(f"{path}/headers")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per record: header, payload (of the response, for revisits), and record: the bytes as they stand in a WARC file."""
    full = _headers(spark, path).join(_sound(spark, path), "sha256", "left")
    body = F.when(F.col("header").cast("string").contains("WARC-Type: revisit" + _CRLF), F.lit(b"")).otherwise(F.col("payload"))
    return full.select("header", "payload", F.concat("header", body, F.lit((_CRLF * 2).encode())).alias("record"))


def fields(headers: DataFrame) -> DataFrame:
    """The columns of a table with header blocks, and the fields of each."""
    field = lambda name: F.nullif(F.regexp_extract(F.col("header").cast("string"), rf"(?m)^{name}: ?([^\r\n]*)\r?$", 1), F.lit(""))
    return headers.select(
        *[c for c in headers.columns if c != "page_id"],
        field("X-Page-ID").cast("long").alias("page_id"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Payload-Digest").alias("declared"),
        field("X-Refers-To-Page-ID").cast("long").alias("refers_to"),
        field("Content-Length").cast("long").alias("content_length"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), C.scratch(spark, "warc"))
    # a payload's length and digest are computed once, where it lies; records meet these
    stored = _sound(spark, path).select("sha256", F.length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"))
    x = fields(_headers(spark, path)).join(stored, "sha256", "left")
    block = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("payload_bytes"))
    sound = (F.concat(F.lit("sha1:"), F.col("payload_digest")) == F.col("declared")) & (block == F.col("content_length"))
    return x.select(
        "page_id",
        "payload_bytes",
        F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("")))).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


#: base32 of 20 bytes by their bits, 5 at a time; the engine beside has no function for it
OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT h, max(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(x || '00', CAST(1 + i * 5 // 4 AS INT), 2) AS INT) >> CAST(3 - (i * 5) % 4 AS INT)) & 31) AS INT), 1) FOR i IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN f USING (h)
"""
