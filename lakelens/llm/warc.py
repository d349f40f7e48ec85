"""Content-addressed web archive: payload bytes once by digest, exact record headers apart, records by join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm.base import query, shared_path
from lakelens.plans.session import lookup
from lakelens.sources.io import table

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"


def base32_of_hex(digest: Column, length: int = 40) -> Column:
    """Base32 of a hex digest of a multiple of 5 digits: five hex digits are four characters."""
    parts = []
    for i in range(0, length, 5):
        value = F.conv(F.substring(digest, i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _urn(key: Column) -> Column:
    h = F.md5(key)
    return F.concat(F.lit("<urn:uuid:"), *[x for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, i, n), F.lit("-" if i < 21 else ">"))])


def _clean(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), "[\\x00-\\x20\\x7F]", "_")


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """One WARC record per row of (page_id, url, html), stored as ``headers`` and ``payloads`` below ``path``.

    The payload is the html in UTF-8; null is empty. Of records with equal payloads (equal SHA-256, SHA-1
    and length) of at least ``min_bytes`` bytes, the one with the smallest page_id is a response and the
    others revisit it; smaller ones are all responses. Rows that repeat both page_id and payload are all
    responses. A null page_id is never the smallest, unless the payload has no other. Control characters
    and blanks of a URL become underscores, a null URL is empty. A payload that a third of all pages share
    is one row of ``payloads``; its digest goes to the pages by broadcast, the others by shuffle (``lookup``).
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    base = pages.select("page_id", "url", payload.alias("payload"))
    base = base.withColumns({"n": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    base = base.withColumn("address", F.concat_ws("-", F.sha2("payload", 256), "sha1", F.col("n").cast("string")))
    # copies are dropped in each task, so each payload moves about once; the smallest page brings the bytes
    smallest = F.struct(F.col("page_id").isNull(), "page_id")
    stored = base.groupBy("address").agg(F.min("page_id").alias("first_id"), F.count("*").alias("refs"), F.min_by("payload", smallest).alias("payload"))
    stored.write.parquet(f"{path}/payloads")
    firsts = pages.sparkSession.read.parquet(f"{path}/payloads").select("address", "first_id", F.col("refs").alias("weight"))
    rows = lookup(base.drop("payload"), firsts, "address", "weight", 0)
    own = F.col("page_id").eqNullSafe(F.col("first_id")) | (F.col("n") < min_bytes)
    rows = rows.withColumn("own", own)
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("own"), "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), _clean(F.col("url")), "address"))),
        F.concat(F.lit("WARC-Target-URI: "), _clean(F.col("url"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of_hex(F.col("sha1"))),
        F.concat(F.lit("X-Payload-Address: "), F.col("address")),
        F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string")),
        F.when(~F.col("own"), F.concat(F.lit("X-Refers-To-Page-Id: "), F.col("first_id").cast("string"))),
        F.when(~F.col("own"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.when(F.col("own"), F.col("n")).otherwise(F.lit(0)) + len(HTTP)).cast("string")),
    )
    kind = dict(pages.dtypes)["page_id"]
    headers = rows.select(F.concat(head, F.lit(END), F.lit(HTTP)).alias("header"))
    headers.write.parquet(f"{path}/headers")
    pages.sparkSession.createDataFrame([(kind,)], "page_id_type string").coalesce(1).write.parquet(f"{path}/about")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Fields of all records, parsed from their exact headers."""
    kind = spark.read.parquet(f"{path}/about").first()[0]
    field = lambda name: F.regexp_extract("header", f"\\r\\n{name}: ([^\\r]*)\\r\\n", 1)
    blank = lambda c: F.when(c != "", c)
    return spark.read.parquet(f"{path}/headers").select(
        "header",
        blank(field("X-Page-Id")).cast(kind).alias("page_id"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Target-URI").alias("url"),
        F.substring(field("WARC-Payload-Digest"), 6, 32).alias("header_digest"),
        field("X-Payload-Address").alias("address"),
        blank(field("X-Refers-To-Page-Id")).cast(kind).alias("refers_to"),
    )


def payload_facts(spark: SparkSession, path: str) -> DataFrame:
    """(address, refs, payload_bytes, payload_digest) of the stored payloads; bytes that do not match their address fail the job."""
    n, sha1 = F.octet_length("payload").cast("long"), F.sha1("payload")
    fits = F.concat_ws("-", F.sha2("payload", 256), sha1, n.cast("string")) == F.col("address")
    facts = spark.read.parquet(f"{path}/payloads").select("address", "refs", n.alias("payload_bytes"), base32_of_hex(sha1).alias("payload_digest"), fits.alias("fits"))
    checked = F.when(F.col("fits"), F.col("payload_bytes")).otherwise(F.raise_error(F.lit("payload does not match its digest")).cast("long"))
    return facts.withColumn("payload_bytes", checked).drop("fits")


def read_records(spark: SparkSession, path: str, rows_per_copy: int = 10_000) -> DataFrame:
    """(page_id, record_type, payload, record): the exact bytes of each WARC record, and the full payload also of revisits.

    A payload that many pages share is joined in several copies, one for each ``rows_per_copy`` of its records.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    copies = F.ceil(F.col("refs") / rows_per_copy)
    spread = stored.select("address", copies.alias("copies"), F.col("refs").alias("weight"))
    heads = lookup(read_headers(spark, path), spread, "address", "weight", 0)
    heads = heads.withColumn("copy", F.pmod(F.xxhash64("header"), F.col("copies")))
    stored = stored.select("address", "payload", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"))
    joined = heads.join(stored, ["address", "copy"])
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select("page_id", "record_type", "payload", F.concat(F.encode("header", "UTF-8"), block, F.encode(F.lit(END), "UTF-8")).alias("record"))


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), from the archive alone."""
    facts = payload_facts(spark, path).withColumn("weight", F.col("refs")).drop("refs")
    rows = lookup(read_headers(spark, path).drop("header"), facts, "address", "weight", 0)
    same = F.when(F.col("header_digest") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("header and payload digests differ")))
    return rows.select("page_id", "payload_bytes", same.alias("payload_digest"), "record_type", "refers_to")


@query("op9_warc")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_path(spark)
    write_archive(table(spark, folder, "pages"), path, min_bytes=0)
    return archive_index(spark, path)
