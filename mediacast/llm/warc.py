"""WARC: a content-addressed archive (operator 5).

``write`` keeps two tables: ``payloads`` with each distinct payload's bytes once, filed under their
SHA-256, and ``headers`` with the exact header bytes of every record, WARC's and HTTP's. ``read``
joins them by digest into the records and into the original responses, and checks every payload
against its digest. Payloads of many records have copies in the join that the records are dealt to.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Records with a payload of fewer bytes are never revisits.
MIN_BYTES = 100
#: Records of one payload that a copy of it in the join serves, about.
SERVED = 1000
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page: Column, digest: Column) -> Column:
    """A URN that follows from the page's id and payload, so that a revisit can name its response."""
    h = F.md5(F.concat_ws("|", F.lit("record"), F.coalesce(page.cast("string"), F.lit("")), digest))
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def _http(n: Column) -> Column:
    """The response's own header, as it would have been sent with the payload."""
    return F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), n.cast("string"), F.lit(CRLF + CRLF))


def _header(page: Column, url: Column, digest: Column, n: Column, refers: Column, revisit: Column, date: str) -> Column:
    """The record's header. The url comes last, its line ends escaped; Page- fields are extensions that ``fields`` reads."""
    safe = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    # A revisit holds the response's header alone.
    length = F.octet_length(_http(n)) + F.when(revisit, F.lit(0)).otherwise(n)
    first = F.concat(F.lit(f"{CRLF}WARC-Refers-To: "), _record_id(refers, digest), F.lit(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}Page-Refers-To: "), text(refers))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "), _record_id(page, digest), F.lit(f"{CRLF}WARC-Date: {date}{CRLF}Page-ID: "), text(page),
        F.when(revisit, first).otherwise(""),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), digest,
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), length.cast("string"),
        F.lit(f"{CRLF}WARC-Target-URI: "), safe, F.lit(CRLF + CRLF),
    )


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: str | None = None) -> None:
    """Archive every row of ``pages`` (page_id, url, html) under ``path``; ``date`` (UTC, ISO 8601) is now unless given.

    Null html is an empty payload, a null url an empty one. Of records with equal payloads of at
    least ``min_bytes`` bytes, those with the smallest page_id are responses (more than one where
    that row repeats, with one record id) and the others revisit it; a null page_id is larger than
    all others. Other columns are not archived. An empty table gives empty tables.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    base = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    base = base.withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload")})
    # Only digest, length and id are dealt out by digest here, and copies meet in the partial aggregate.
    first = base.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    slim = base.select("page_id", "url", "digest", "n").join(first, "digest", "left")
    revisit = (F.col("n") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    header = _header(F.col("page_id"), F.col("url"), F.col("digest"), F.col("n"), F.col("first"), revisit, date)
    copies = F.ceil(F.coalesce("copies", F.lit(1)) / SERVED).cast("int")
    copy = F.pmod(F.xxhash64("page_id", "url"), copies).cast("int")
    headers = slim.select("digest", copy.alias("copy"), header.cast("binary").alias("header"), _http(F.col("n")).cast("binary").alias("http"), revisit.alias("revisit"))
    headers.write.option("compression", "zstd").parquet(f"{path}/headers")
    once = base.groupBy("digest").agg(F.first("payload").alias("payload"), F.ceil(F.count(F.lit(1)) / SERVED).cast("int").alias("copies"))
    once.write.option("compression", "zstd").parquet(f"{path}/payloads")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record: ``header``, the archived ``record`` whole, and ``original``, the response with its payload, of revisits too.

    ``payload_digest`` and ``payload_bytes`` are those of the payload in ``original``. One that isn't
    the header's fails the read.
    """
    stored = spark.read.schema("digest string, payload binary, copies int").parquet(f"{path}/payloads")
    stored = stored.select("digest", "payload", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    headers = spark.read.schema("digest string, copy int, header binary, http binary, revisit boolean").parquet(f"{path}/headers")
    joined = headers.join(stored, ["digest", "copy"], "left").withColumn("original", F.concat("http", "payload"))
    payload = F.substring("original", F.octet_length("http") + 1, F.octet_length("original"))
    found = F.sha2(payload, 256)
    whole = F.concat("header", F.when(F.col("revisit"), F.col("http")).otherwise(F.col("original")), F.lit(CRLF + CRLF).cast("binary"))
    return joined.select(
        "header", "original", whole.alias("record"), F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.when(found == F.col("digest"), found).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "digest"))).alias("payload_digest"),
    )


def fields(header: Column) -> dict[str, Column]:
    """What the query needs from a header's bytes."""
    text = F.decode(header, "UTF-8")
    get = lambda name, value: F.regexp_extract(text, rf"\r\n{name}: {value}\r\n", 1)
    page = lambda name: F.nullif(get(name, "(-?[0-9]*)"), F.lit("")).cast("long")
    return {"page_id": page("Page-ID"), "record_type": get("WARC-Type", "([a-z]+)"), "refers_to": page("Page-Refers-To")}
