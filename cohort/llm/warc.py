"""Content-addressed WARC archive.

An archive is a folder with two Parquet tables.  ``payloads(digest, payload)`` holds each distinct payload once, under
its SHA-256; ``records(record_id, header, digest, ...)`` holds one row a record with its exact WARC/1.1
header block.  Of records with equal payloads of at least ``min_revisit_bytes``, the one with the smallest id is
the ``response`` and the others are ``revisit`` records that refer to it; shorter ones are all responses.
Reading joins both tables on the digest, checks every stored payload against its digest and its header's SHA-1,
and gives back the records' bytes.

A hot payload costs one row a map task while payloads are stored (partial aggregation) and a skewed join, which adaptive
execution splits, while records are labelled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, ref

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: Crawl time of archives written from tables that hold none.
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of binary ``payload``: 20 bits, five hex digits, give four characters."""
    digest, out = F.sha1(payload), []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substr(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null; line ends inside a value are percent-encoded."""
    clean = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(name + ": "), clean, F.lit(CRLF)), F.lit(""))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = DATE) -> None:
    """Write one record per row of ``pages``; the payload is the body in UTF-8, empty for null.

    Rows without id revisit a response that has one, and else are responses; repeated rows (same id and payload)
    are all what that id is.  Extra columns are ignored; an empty table gives an empty archive.
    """
    payload = F.encode(F.coalesce(ref(body_col), F.lit("")), "UTF-8")
    rows = pages.select(ref(id_col).cast("long").alias("page_id"), ref(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    # equal digests are equal payloads, so any of them is the one to store
    rows.groupBy("digest").agg(F.any_value("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")

    narrow = checkpointed(
        rows.select("page_id", "url", "digest", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    )
    heads = checkpointed(narrow.groupBy("digest").agg(F.min("page_id").alias("head")))
    original = F.col("head").isNull() | F.coalesce(F.col("page_id") == F.col("head"), F.lit(False)) | (F.col("bytes") < min_revisit_bytes)
    records = narrow.join(heads, "digest").withColumn("type", F.when(original, "response").otherwise("revisit"))
    refers = F.when(F.col("type") == "revisit", F.col("head"))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", F.col("type")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", _record_id(refers)),
        _line("WARC-Profile", F.when(refers.isNotNull(), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(refers.isNotNull(), F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(CRLF),
    )
    records.select(F.col("page_id").alias("record_id"), header.alias("header"), "digest", F.col("bytes").alias("payload_bytes")).write.option(
        "compression", "zstd"
    ).parquet(f"{path}/records")


def _field(name: str) -> Column:
    """A header field of its own line, null if absent."""
    found = F.regexp_extract("header", rf"(?:^|\r\n){name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def _verified(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads with length and SHA-1; a payload that does not have its digest stops the job."""
    stored = spark.read.parquet(f"{path}/payloads")
    sound = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    return stored.withColumn("payload", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.lit("stored payload does not match its digest"))))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, header, payload, record``: the full payload of every record, and the record's exact WARC bytes.

    Each record's header meets the stored payload it was written with, which is checked against its digest; a revisit's own block
    is empty, and its payload that of the response.  Records without id, repeated records and empty archives come back as written.
    """
    joined = spark.read.parquet(f"{path}/records").join(_verified(spark, path), "digest")
    block = F.when(_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    record = F.concat(F.encode("header", "UTF-8"), block, F.lit(b"\r\n\r\n"))
    return joined.select("record_id", "header", "payload", record.alias("record"))


def describe_records(records: DataFrame) -> DataFrame:
    """``page_id, target_uri, record_type, refers_to, payload_bytes, payload_digest`` of rebuilt records.

    Types and references are read from the record's own bytes, length and digest computed from its full payload; a record whose
    header names another payload, or whose block has not the length that it says, stops the job.
    """
    # the header ends at the first empty line; bytes that are no UTF-8 can only stand behind it
    cut = F.instr(F.decode(F.col("record"), "ISO-8859-1"), "\r\n\r\n")
    own = records.withColumn("header", F.decode(F.substring("record", F.lit(1), cut + 3), "UTF-8")).withColumn("block", F.octet_length("record") - cut - 3 - 4)
    digest = base32_sha1(F.col("payload"))
    agrees = (_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), digest)) & (_field("Content-Length").cast("long") == F.col("block"))
    return own.select(
        F.regexp_extract("header", r"\r\nWARC-Record-ID: <urn:page:(-?\d+)>", 1).try_cast("long").alias("page_id"),
        _field("WARC-Target-URI").alias("target_uri"),
        _field("WARC-Type").alias("record_type"),
        F.regexp_extract("header", r"\r\nWARC-Refers-To: <urn:page:(-?\d+)>", 1).try_cast("long").alias("refers_to"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(agrees, digest).otherwise(F.raise_error(F.lit("a record's header does not describe its payload"))).alias("payload_digest"),
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """What ``describe_records`` says of every record of an archive, rebuilt."""
    return describe_records(read_records(spark, path))
