"""Content-addressed WARC archive: payloads once by verified digest, exact record headers apart, joined to read records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Date that headers carry, as the pages have none.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hexadecimal digits are four of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header(kind: Column, lines: list[Column]) -> Column:
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit(f"\r\nWARC-Date: {DATE}\r\n"), *lines, F.lit("\r\n"))


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Rows (record_id long, url, payload binary) as archive records (record_id, kind, refers_to, sha256, sha1, size, header, payload).

    Null payloads count as empty, null urls as an empty target. Of records with equal payloads of at least least_bytes
    the one with the smallest record_id is a response and the others revisit it; smaller ones are all responses.
    Payloads are equal when their SHA-256 and lengths are. Rows that repeat a record_id and payload share their outcome;
    a null record_id is a response only where no other has its payload. An empty table gives an empty result.
    """
    payload = F.coalesce("payload", F.lit("").cast("binary"))
    rows = pages.select(F.col("record_id").cast("long").alias("record_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha256", F.sha2("payload", 256)).withColumn("sha1", base32_sha1(F.col("payload"))).withColumn("size", F.octet_length("payload").cast("long"))
    # Copies of one payload are combined before they are shuffled, and the light join back is split by AQE.
    first = rows.groupBy("sha256", "size").agg(F.min("record_id").alias("first"))
    rows = rows.join(first, ["sha256", "size"])
    revisit = (F.col("size") >= least_bytes) & ~F.col("record_id").eqNullSafe(F.col("first"))
    rows = rows.withColumn("kind", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first")))
    name = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("none")), F.lit(">"))
    # Line ends in a target would break the header's lines.
    lines = [
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("record_id")), F.lit("\r\nWARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", ""), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"), F.lit("\r\n")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("first")), F.lit(f"\r\nWARC-Profile: {PROFILE}\r\n"))).otherwise(""),
        F.concat(F.lit("Content-Type: text/html\r\nContent-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string"), F.lit("\r\n")),
    ]
    return rows.withColumn("header", F.encode(_header(F.col("kind"), lines), "UTF-8")).select("record_id", "kind", "refers_to", "sha256", "sha1", "size", "header", "payload")


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write path/records (header, sha256, size: exact headers) and path/payloads (sha256, size, payload: each once)."""
    rows = records(pages, least_bytes)
    rows.select("header", "sha256", "size").write.mode("overwrite").parquet(f"{path}/records")
    unique = rows.where("kind = 'response'").groupBy("sha256", "size").agg(F.max("payload").alias("payload"))
    unique.write.mode("overwrite").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(header binary, payload binary, sha256, sha1, size) of every record; a payload that isn't what its digest says is an error."""
    heads = spark.read.schema("header binary, sha256 string, size long").parquet(f"{path}/records")
    stored = spark.read.schema("sha256 string, size long, payload binary").parquet(f"{path}/payloads")
    right = (F.sha2("payload", 256) == F.col("sha256")) & (F.octet_length("payload") == F.col("size"))
    stored = stored.withColumn("payload", F.when(right, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256")))))
    return heads.join(stored.withColumn("sha1", base32_sha1(F.col("payload"))), ["sha256", "size"])


def field(header: Column, name: str) -> Column:
    """A header field's value; null where it is absent."""
    return F.nullif(F.regexp_extract(header.cast("string"), rf"(?:^|\n){name}: ([^\r\n]*)", 1), F.lit(""))


def original_records(archive: DataFrame) -> DataFrame:
    """`record` binary: the exact bytes of each record, with its payload unless it is a revisit, and the two empty lines."""
    body = F.when(field(F.col("header"), "WARC-Type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    return archive.select("header", F.concat("header", body, F.lit("\r\n\r\n").cast("binary")).alias("record"))


def write_warc(archive: DataFrame, path: str) -> None:
    """Plain WARC files, one for each partition, with Spark's text writer, which leaves the bytes as they are."""
    text = F.concat("header", F.when(field(F.col("header"), "WARC-Type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary")))
    archive.select(text.cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\r\n\r\n").text(path)
