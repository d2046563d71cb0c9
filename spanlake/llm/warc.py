"""A content-addressed WARC archive.

``headers`` keeps the exact header bytes of every record, one row each; ``payloads`` keeps each distinct payload
once under its SHA-256. A record is put together again by joining the two, and every payload is verified against
its digest on the way. Of equal payloads of at least MIN_REVISIT bytes one record is a response and the others
are revisits of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, stored

MIN_REVISIT = 1000
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
URN = "urn:spanlake:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def header_text(value: Column) -> Column:
    """A value as one header line: percent signs and control characters are percent-encoded."""
    out = F.replace(F.coalesce(value, F.lit("")), F.lit("%"), F.lit("%25"))
    for c in (*range(32), 127):
        out = F.replace(out, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return out


def write_archive(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT) -> None:
    """Write one record for each row of ``pages`` under ``path``; the payload is the html in UTF-8, null as empty.

    Of equal payloads the row with the largest page_id is the response; of several such rows one is, and a null id
    is less than any other. Null ids and urls are written as empty header values. An empty table gives an empty
    archive. Other columns are ignored.
    """
    payload = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    # The row's number is fixed by writing it before anything depends on it.
    index = stored(rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1"), F.monotonically_increasing_id().alias("row")), "warc-index")
    rank = F.struct(F.col("page_id").isNotNull().alias("known"), F.col("page_id"), F.col("row"))
    owners = index.where(F.col("bytes") >= min_revisit).groupBy("digest").agg(F.max(rank).alias("owner"))
    owned = index.join(owners, "digest", "left").withColumn("refers_to", F.when(F.col("owner.row") != F.col("row"), F.col("owner.page_id")))
    revisit = F.col("owner").isNotNull() & (F.col("owner.row") != F.col("row"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes"), F.lit(CRLF * 2))
    block = F.when(revisit, F.octet_length(http)).otherwise(F.octet_length(http) + F.col("bytes"))
    key = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: <{URN}"), key, F.lit(":"), F.col("row"), F.lit(f">{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "), header_text(F.col("url")),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Refers-To: <{URN}"), F.coalesce(F.col("refers_to").cast("string"), F.lit("")), F.lit(":"), F.col("owner.row"), F.lit(f">{CRLF}WARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit(f"{CRLF}Content-Type: application/http;msgtype=response{CRLF}Content-Length: "), block, F.lit(CRLF * 2), http,
    )
    owned.select(F.encode(record, "UTF-8").alias("header"), "digest", revisit.alias("revisit")).write.parquet(f"{path}/headers")
    rows.select("digest", "payload").dropDuplicates(["digest"]).write.parquet(f"{path}/payloads")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``digest, payload`` of the stored payloads; fails if a payload does not have its digest."""
    payloads = spark.read.schema("digest binary, payload binary").parquet(f"{path}/payloads")
    sound = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    return payloads.select("digest", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not have its digest"))).alias("payload"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record again: ``header, record`` (WARC bytes as archived), ``payload`` (the full one, for revisits too)."""
    headers = spark.read.schema("header binary, digest binary, revisit boolean").parquet(f"{path}/headers")
    joined = headers.join(read_payloads(spark, path), "digest", "left")
    payload = F.coalesce("payload", F.raise_error(F.lit("a record's payload is missing")).cast("binary"))
    end = F.lit((CRLF * 2).encode())
    record = F.when(F.col("revisit"), F.concat("header", end)).otherwise(F.concat(F.col("header"), payload, end))
    return joined.select("header", record.alias("record"), payload.alias("payload"))


def header_value(header: Column, name: str) -> Column:
    """The value of a WARC header field; null if the record has none."""
    found = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.contains(header, F.lit(f"{CRLF}{name}: ")), found)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, url_header, record_bytes`` read from the archive."""
    records = read_records(spark, path).withColumn("text", F.decode("header", "UTF-8"))
    number = lambda name: F.regexp_extract(header_value(F.col("text"), name), rf"^<{URN}(-?\d*):\d+>$", 1)
    return records.select(
        number("WARC-Record-ID").try_cast("long").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        header_value(F.col("text"), "WARC-Type").alias("record_type"),
        number("WARC-Refers-To").try_cast("long").alias("refers_to"),
        header_value(F.col("text"), "WARC-Target-URI").alias("url_header"),
        F.octet_length("record").cast("long").alias("record_bytes"),
    )


def archive(pages: DataFrame, **names: str) -> tuple[str, DataFrame]:
    """Write an archive of ``pages`` to the shared folder; its path and its records, read back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archive(pages, path, **names)
    return path, page_records(spark, path)
