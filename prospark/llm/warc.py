"""A content-addressed web archive.

`payloads` holds each distinct payload once, by its SHA-256, with its SHA-1 and length; `headers` holds the exact WARC
header of every record and the digest of its payload. Reading joins the two: a response is its header and the stored
payload, a revisit its header alone. Every stored payload is digested anew when it is read, and a record whose payload
does not have the digest and length that its header names fails the read.

Copies are combined inside the tasks before payloads are exchanged, so a payload with very many copies is sent once
per task; headers travel without payloads. All of it is DataFrame functions.

Defined cases: null html is the empty payload; of records with equal payloads of at least `least_bytes` bytes the one
with the largest page_id is the response and the others revisit it; rows that repeat this page_id are responses too; a
null page_id is smaller than all others and left out of the header; a null url is left out, line ends in urls are
percent-encoded; an empty table makes an empty archive; other columns are not stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_PAYLOADS = "digest string, sha1 string, n_bytes long, top long, payload binary"
_HEADERS = "digest string, header string"


def base32(hexadecimal: Column) -> Column:
    """Base 32 of 20 bytes given in hexadecimal: 40 bits make 8 letters."""
    letters = []
    for group in range(4):
        bits = F.conv(F.substring(hexadecimal, 10 * group + 1, 10), 16, 10).cast("long")
        for k in range(8):
            at = F.shiftright(bits, 35 - 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1
            letters.append(F.substring(F.lit(_ALPHABET), at, F.lit(1)))
    return F.concat(*letters)


def record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("-")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_END)), F.lit(""))


def write_archive(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", least_bytes: int = 0) -> None:
    """Stores a record of every page below `path`."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    once = rows.groupBy("digest").agg(F.max("page_id").alias("top"), F.first("payload").alias("payload"))
    once.select("digest", base32(F.sha1("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes"), "top", "payload").write.parquet(
        f"{path}/payloads"
    )
    stored = spark.read.schema(_PAYLOADS).parquet(f"{path}/payloads").select("digest", "sha1", "n_bytes", "top")
    known = rows.select("page_id", "url", "digest").join(stored, "digest")
    again = (F.col("n_bytes") >= least_bytes) & F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit(f"WARC/1.1{_END}"),
        _field("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        _field("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", url),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _field("WARC-Profile", F.when(again, F.lit(PROFILE))),
        _field("WARC-Refers-To", F.when(again, record_id(F.col("top"), F.col("digest")))),
        _field("Page-Id", F.col("page_id").cast("string")),
        _field("Refers-To-Page-Id", F.when(again, F.col("top").cast("string"))),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))),
        F.lit(_END),
    )
    known.select("digest", header.alias("header")).write.parquet(f"{path}/headers")


def _value(name: str) -> Column:
    got = F.regexp_extract("header", rf"(?:^|\r\n){name}: ([^\r\n]*)\r\n", 1)
    return F.when(got != "", got)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """All records: page_id, url, record_type, refers_to, payload_bytes, payload_digest (of the full payload), header,
    payload (null for revisits) and `record`, the exact bytes of the WARC record."""
    headers = spark.read.schema(_HEADERS).parquet(f"{path}/headers")
    # Digest and length are taken from the stored bytes; a reader that wants no payloads doesn't exchange them.
    payloads = spark.read.schema(_PAYLOADS).parquet(f"{path}/payloads").select(
        "digest",
        base32(F.sha1("payload")).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.col("payload").alias("stored"),
    )
    rows = headers.join(payloads, "digest", "left").withColumn("record_type", _value("WARC-Type"))
    response = F.col("record_type") == "response"
    sound = (_value("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))) & (
        ~response | (_value("Content-Length").cast("long") == F.col("payload_bytes"))
    )
    failed = F.raise_error(F.concat(F.lit("stored payload and header differ: "), F.col("header"))).cast("long")
    rows = rows.withColumn("payload_bytes", F.when(F.coalesce(sound, F.lit(False)), F.col("payload_bytes")).otherwise(failed))
    end = F.lit(_END + _END).cast("binary")
    return rows.select(
        _value("Page-Id").cast("long").alias("page_id"),
        _value("WARC-Target-URI").alias("url"),
        "record_type",
        _value("Refers-To-Page-Id").cast("long").alias("refers_to"),
        "payload_bytes",
        "payload_digest",
        "header",
        F.when(response, F.col("stored")).alias("payload"),
        F.concat(F.col("header").cast("binary"), F.when(response, F.col("stored")).otherwise(F.lit(b"")), end).alias("record"),
    )
