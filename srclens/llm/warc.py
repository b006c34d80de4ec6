"""Operator 7, WARC as a content-addressed archive.

An archive is two tables in one folder. ``payloads`` holds the bytes of each different payload
once, under its SHA-256, with its length and SHA-1. ``records`` holds the exact header block
of each record and the key of its payload. Joins put the records together again.

Of the records with equal payloads the one with the largest id is the response and the
others are revisits that refer to it; payloads shorter than ``least_bytes`` are all responses.

The digest is verified twice: rows that meet under one SHA-256 must agree in length and SHA-1
when the archive is written, and the stored bytes must hash to their key when it is read. Either
failure is an error. Equal payloads are combined before the shuffle, so a payload that most
pages share is no large group, and joins against payload facts have one row per key, which the
skew join can split. Texts are shuffled once.

``op7_warc`` reads its result from the records put together again (``read_records``), not from
the stored facts: body after the header block, checked against Content-Length and the digest.

Defined results: a null payload counts as empty; a null url has no target header; line breaks in
a url are percent-encoded; rows that repeat the largest id are all responses; null ids
are smaller than all others and responses when no other row has the payload; an empty
table gives an empty archive. Only the id, url and payload columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.llm.common import table
from srclens.session import new_path

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2025-01-01T00:00:00Z"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a hexadecimal SHA-1: ten hexadecimal digits give eight letters."""
    letters = []
    for group in range(4):
        bits = F.conv(F.substring(hex_digest, 10 * group + 1, 10), 16, 10).cast("long")
        for i in range(8):
            place = F.shiftright(bits, 35 - 5 * i).bitwiseAND(F.lit(31)).cast("int")
            letters.append(F.substring(F.lit(ALPHABET), place + 1, F.lit(1)))
    return F.concat(*letters)


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = DATE) -> None:
    """Write ``payloads`` and ``records`` below ``path``, a folder that does not exist yet."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    sha1, same = F.sha1("payload"), F.lit("two payloads share a digest")
    (
        keyed.withColumn("sha1", sha1)
        .groupBy("digest")
        .agg(
            F.first("payload").alias("payload"),
            F.max("page_id").alias("largest_id"),
            F.struct(F.min("payload_bytes"), F.min("sha1")).alias("low"),
            F.struct(F.max("payload_bytes"), F.max("sha1")).alias("high"),
        )
        .select(
            F.when(F.hash("low") == F.hash("high"), F.col("digest")).otherwise(F.raise_error(same)).alias("digest"),
            "largest_id",
            F.col("low.col1").alias("payload_bytes"),
            base32(F.col("low.col2")).alias("sha1"),
            "payload",
        )
        .write.parquet(f"{path}/payloads")
    )
    facts = spark.read.parquet(f"{path}/payloads").select("digest", "largest_id", "payload_bytes", "sha1")
    response = (F.col("payload_bytes") < least_bytes) | F.col("largest_id").isNull() | F.coalesce(F.col("page_id") == F.col("largest_id"), F.lit(False))
    clean = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit(f"{VERSION}\r\n"),
        _line("WARC-Type", F.when(response, "response").otherwise("revisit")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", clean),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Profile", F.when(~response, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(~response, _record_id(F.col("largest_id")))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(response, F.col("payload_bytes")).otherwise(F.lit(0)).cast("string")),
        F.lit("\r\n"),
    )
    light = keyed.select("page_id", "url", "digest").join(facts, "digest")
    light.select(header.cast("binary").alias("header"), "digest").write.parquet(f"{path}/records")


def _field(name: str) -> Column:
    found = F.regexp_extract(F.col("head"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def _page(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, "^<urn:page:(-?[0-9]+)>$", 1), F.lit("")).cast("long")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """What the headers say: ``page_id, record_type, url, payload_digest, refers_to, content_length, digest``."""
    head = spark.read.schema("header binary, digest string").parquet(f"{path}/records").select(F.col("header").cast("string").alias("head"), "digest")
    return head.select(
        _page(_field("WARC-Record-ID")).alias("page_id"),
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Target-URI").alias("url"),
        F.replace(_field("WARC-Payload-Digest"), F.lit("sha1:"), F.lit("")).alias("payload_digest"),
        _page(_field("WARC-Refers-To")).alias("refers_to"),
        _field("Content-Length").cast("long").alias("content_length"),
        "digest",
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``digest, payload_bytes, sha1, payload``, verified: the bytes must hash to their key."""
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    sound = F.sha2("payload", 256) == F.col("digest")
    return stored.select(
        F.when(sound, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload is not that of "), F.col("digest")))).alias("digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32(F.sha1("payload")).alias("sha1"),
        "payload",
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``record binary``: each original record, header, body of its content length, and end mark."""
    stored = spark.read.schema("header binary, digest string").parquet(f"{path}/records")
    joined = stored.join(read_payloads(spark, path).select("digest", "payload"), "digest")
    revisit = F.col("header").cast("string").rlike("\r\nWARC-Type: revisit\r\n")
    body = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))
    return joined.select(F.concat("header", body, F.lit("\r\n\r\n").cast("binary")).alias("record"))


def record_facts(records: DataFrame) -> DataFrame:
    """``page_id, record_type, refers_to, payload_digest, payload_bytes`` read from whole records.

    The header block ends at the first empty line; the body is the next Content-Length bytes and the
    record ends with an empty line after it (else an error). A response's body must hash to the
    digest its header names (else an error). A revisit has no body: its payload facts are those of
    the response it refers to, met by that page id and the digest, which both records name.
    """
    head = F.substring_index(F.col("record").cast("string"), "\r\n\r\n", 1)
    read = records.select("record", F.concat(head, F.lit("\r\n")).alias("head"))
    parsed = read.select(
        _page(_field("WARC-Record-ID")).alias("page_id"),
        _field("WARC-Type").alias("record_type"),
        _page(_field("WARC-Refers-To")).alias("refers_to"),
        F.replace(_field("WARC-Payload-Digest"), F.lit("sha1:"), F.lit("")).alias("payload_digest"),
        _field("Content-Length").cast("long").alias("length"),
        (F.octet_length("head") + 2).alias("start"),
        "record",
    )
    body = F.expr("substring(record, start + 1, length)")
    whole = F.octet_length("record") == F.col("start") + F.col("length") + 4
    bodied = parsed.select(
        "*", F.when(whole, body).otherwise(F.raise_error(F.lit("a record is not as long as its header says"))).alias("body")
    ).drop("record")
    responses = bodied.filter(F.col("record_type") == "response").select(
        "page_id",
        "record_type",
        "refers_to",
        F.when(base32(F.sha1("body")) == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a body does not match its digest"))).alias("payload_digest"),
        F.octet_length("body").cast("long").alias("payload_bytes"),
    )
    revisits = bodied.filter(F.col("record_type") == "revisit").select("page_id", "record_type", "refers_to", "payload_digest")
    targets = responses.select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").dropDuplicates(["refers_to", "payload_digest"])
    return responses.unionByName(revisits.join(targets, ["refers_to", "payload_digest"], "left"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return record_facts(read_records(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages),
k AS (SELECT page_id, h, sha1(h) d, max(page_id) OVER (PARTITION BY h) top FROM p),
b AS (SELECT *, list_transform(range(0, 4), lambda g: CAST('0x' || d[10 * g + 1:10 * g + 10] AS BIGINT)) v FROM k)
SELECT page_id, CAST(strlen(h) AS BIGINT) payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: '{ALPHABET}'[1 + ((v[1 + i // 8] >> (35 - 5 * (i % 8))) & 31)]), 'string_agg', '') payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END record_type, CASE WHEN page_id <> top THEN top END refers_to
FROM b
"""
