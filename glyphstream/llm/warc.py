"""Content-addressed WARC archive.

``write_archive`` stores two tables under a path: ``payloads`` has the bytes of each distinct
payload once, under its SHA-256; ``headers`` has the exact header bytes of each record with
the digest of its payload. ``read_archive`` joins them back to whole records and verifies, for
each payload read, that its bytes still have the digest they are stored under.

Of records whose payloads are equal and at least ``min_revisit_bytes`` long, that with the
largest key is a response, and the others are revisits that refer to it; records with smaller
payloads are all responses. A null payload counts as empty, a null url leaves its header
line out, line breaks in a url are percent-encoded. A null key sorts below all others; rows
that agree in key and payload get the same record, once for each row. Other columns stay
behind. Equal payloads are combined before they shuffle, and the joins by digest read written
tables only, so that Spark can split a digest that a third of the rows share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import input_bytes, materialise, scratch_path, table

DATE = "2026-01-01T00:00:00Z"
# Fixed values of the WARC 1.1 format and of RFC 4648.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """SHA-1 in base 32: every five hex digits are four digits of base 32."""
    digest = F.sha1(payload)
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]), BASE32HEX, BASE32)


def record_id(key: Column) -> Column:
    """A URN made from the key alone, so that a lost task writes the same again."""
    digest = F.md5(F.concat(F.lit("record:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


KEY, REFERS = "X-Record-Key", "X-Refers-To-Key"  # extension fields, left out for a null key


def header_bytes(key: Column, url: Column, size: Column, payload_digest: Column, refers_to: Column, revisit: Column) -> Column:
    """The WARC header and the HTTP head, up to the payload."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    target = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        record_id(key),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), target), F.lit("")),
        F.coalesce(F.concat(F.lit(f"\r\n{KEY}: "), key.cast("string")), F.lit("")),
        F.when(revisit, F.coalesce(F.concat(F.lit(f"\r\n{REFERS}: "), refers_to.cast("string")), F.lit(""))).otherwise(""),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha1:"),
        payload_digest,
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), record_id(refers_to))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http.cast("binary")) + F.when(revisit, F.lit(0).cast("long")).otherwise(size)).cast("string"),
        F.lit("\r\n\r\n"),
        http,
    ).cast("binary")


def write_archive(pages: DataFrame, path: str, *, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0) -> None:
    """Write the tables ``payloads`` and ``headers`` under path."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    records = pages.select(F.col(key_col).alias("key"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    hashed = records.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    hashed.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")

    sized = hashed.select("key", "url", "digest", F.octet_length("payload").cast("long").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest"))
    whole = F.col("payload_bytes") >= min_revisit_bytes
    last = materialise(sized.filter(whole).groupBy("digest").agg(F.max("key").alias("last")), "responses", input_bytes(pages))
    joined = sized.join(last, "digest", "left")
    revisit = F.coalesce(F.col("last").isNotNull() & ~F.col("key").eqNullSafe(F.col("last")), F.lit(False))
    joined.select(
        "key",
        "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("last")).alias("refers_to"),
        header_bytes(F.col("key"), F.col("url"), F.col("payload_bytes"), F.col("payload_digest"), F.col("last"), revisit).alias("header"),
    ).write.parquet(f"{path}/headers")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """digest, payload, payload_bytes, payload_digest; an error where bytes and digest differ."""
    stored = spark.read.parquet(f"{path}/payloads")
    sound = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    checked = F.when(sound, F.octet_length("payload").cast("long")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), F.hex("digest"))).cast("long"))
    return stored.select("digest", "payload", checked.alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record: key, record_type, refers_to, payload and its size and digest, record (its exact bytes).

    A revisit's record has the header only; its payload column has what it refers to.
    """
    headers = spark.read.parquet(f"{path}/headers")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    record = F.concat(F.col("header"), body, F.lit(b"\r\n\r\n"))
    return headers.join(read_payloads(spark, path), "digest").select("key", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest", record.alias("record"))


def read_records(spark: SparkSession, path: str, key_type: str = "bigint") -> DataFrame:
    """key, record_type, refers_to, payload_bytes and payload_digest, parsed out of each rebuilt record.

    Fields come from the record's own header. The block of a response must have the length and
    the digest that the header gives, else there is an error. Keys are read back as key_type.
    """
    # The two heads end at the second empty line; the block is what follows, up to the record's end.
    text = F.substring_index(F.col("record").cast("string"), "\r\n\r\n", 2)
    parsed = read_archive(spark, path).select("record", text.alias("head"))
    field = lambda name, value: F.regexp_extract("head", rf"\r\n{name}: {value}\r\n", 1)
    given = lambda name: F.when(F.col(name) != "", F.col(name)).cast(key_type)
    heads = F.octet_length("head") + 4
    parsed = parsed.select(
        field("WARC-Type", r"(\w+)").alias("record_type"),
        field("WARC-Payload-Digest", r"sha1:(\w+)").alias("payload_digest"),
        F.regexp_extract("head", r"(?s)\r\n\r\nHTTP/.*\r\nContent-Length: (\d+)", 1).cast("long").alias("payload_bytes"),
        field(KEY, r"([^\r\n]*)").alias("key"),
        field(REFERS, r"([^\r\n]*)").alias("refers_to"),
        F.substr("record", heads + 1, F.octet_length("record") - heads - 4).alias("payload"),
    )
    sound = (F.col("record_type") == "revisit") | ((F.octet_length("payload") == F.col("payload_bytes")) & (sha1_base32(F.col("payload")) == F.col("payload_digest")))
    checked = F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("a record's block differs from its header: "), "payload_digest")).cast("string"))
    return parsed.select(given("key").alias("key"), "record_type", given("refers_to").alias("refers_to"), "payload_bytes", checked.alias("payload_digest"))


def parse_records(blob: bytes) -> list[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record in WARC bytes."""
    out = []
    while blob:
        head, _, rest = blob.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        out.append((fields, rest[:size]))
        blob = rest[size + 4 :]
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: archive all pages, read the archive back."""
    path = scratch_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    back = read_records(spark, path)
    return back.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     m AS (SELECT page_id, html, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(h, CAST((k // 4) * 5 + 1 AS BIGINT), 5) AS INTEGER) >> CAST(5 * (3 - k % 4) AS INTEGER)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM m
"""
