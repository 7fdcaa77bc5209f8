"""Content-addressed web archive: payloads once by digest, record headers apart, records put together by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: each five of them make four letters."""
    letters = []
    for i in range(0, 40, 5):
        bits = F.conv(F.substring(digest, i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _uuid(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts]))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in cuts])


def _line(name: str, value: Column) -> Column:
    """A header line; none for null. Line ends and the like in a value are written as their codes."""
    safe = F.regexp_replace(F.regexp_replace(value.cast("string"), "\r", "%0D"), "\n", "%0A")
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), safe, F.lit(END)))


def write_archive(
    pages: DataFrame, folder: str, id_column: str = "page_id", url: str = "url", html: str = "html",
    least_bytes: int = 0, date: str = "2026-01-01T00:00:00Z",
) -> None:
    """Two tables below `folder`. `payloads`: digest (SHA-256), bytes. `records`: the exact header of each record, its
    digest and place.

    Each row is a record. Of records with equal payloads of at least `least_bytes`, the one with the smallest id (then
    url; nulls last) is the response, and the others revisit it; a repeated row is a record of its own, so one of them
    is the response. A null page is an empty payload. An empty table gives empty tables.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(id_column).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    # copies of a payload meet once in each map task and are alike, so any of them will do
    stored = rows.groupBy("digest").agg(F.first("payload").alias("payload"))
    stored.write.parquet(f"{folder}/payloads")
    named = rows.withColumn("size", F.octet_length("payload")).withColumn("sha1", F.sha1("payload"))
    same = named.groupBy("page_id", "url", "digest", "size").agg(
        F.count(F.lit(1)).alias("n"), F.first("sha1").alias("sha1")
    )
    order = F.struct(
        F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url"
    )
    same = same.withColumn("order", order)
    firsts = same.groupBy("digest").agg(F.min("order").alias("first"))
    records = same.join(firsts, "digest").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    original = (F.col("size") < least_bytes) | (F.col("order").eqNullSafe(F.col("first")) & (F.col("copy") == 1))
    records = records.withColumn("kind", F.when(original, "response").otherwise("revisit"))
    revisit = F.col("kind") == "revisit"
    own = _uuid(F.col("page_id"), F.col("url"), F.hex("digest"), F.col("copy"))
    other = _uuid(F.col("first.page_id"), F.col("first.url"), F.hex("digest"), F.lit(1))
    header = F.concat_ws(
        "",
        F.lit(f"WARC/1.1{END}"),
        _line("WARC-Type", F.col("kind")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), own, F.lit(">"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        _line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:uuid:"), other, F.lit(">")))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("X-Page-ID", F.col("page_id")),
        _line("X-Refers-To-Page", F.when(revisit, F.col("first.page_id"))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size"))),
        F.lit(END),
    )
    records.select(header.alias("header"), "digest").write.parquet(f"{folder}/records")


def _value(name: str) -> Column:
    found = F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.col("header").contains(f"\r\n{name}: "), found)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload, record) of each record. `payload` is the full one also for
    revisits, `record` the bytes of the WARC record. A payload that doesn't have the digest it is stored under fails
    the job."""
    records = spark.read.schema("header string, digest binary").parquet(f"{folder}/records")
    payloads = spark.read.schema("digest binary, payload binary").parquet(f"{folder}/payloads")
    wrong = F.raise_error(F.concat(F.lit("payload differs from its digest "), F.hex("digest")))
    right = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    payloads = payloads.select("digest", F.when(right, F.col("payload")).otherwise(wrong.cast("binary")).alias("payload"))
    rows = records.join(payloads, "digest")
    kind = _value("WARC-Type")
    block = F.when(kind == "response", F.col("payload")).otherwise(F.lit(b""))
    return rows.select(
        _value("X-Page-ID").cast("long").alias("page_id"),
        _value("WARC-Target-URI").alias("url"),
        kind.alias("record_type"),
        _value("X-Refers-To-Page").cast("long").alias("refers_to"),
        "payload",
        F.concat(F.encode("header", "UTF-8"), block, F.lit(b"\r\n\r\n")).alias("record"),
    )


def export_warc(records: DataFrame, path: str) -> None:
    """WARC files of records whose blocks are UTF-8: a text file whose lines end as records do."""
    body = F.expr("substring(record, 1, octet_length(record) - 4)").cast("string")
    records.select(body.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)
