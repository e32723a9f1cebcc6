"""WARC archives: write captures as transactions, read records, assemble transactions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hinterland.llm.scratch import Scratch

VERSION = "WARC/1.1"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed capture time: the tables hold none.
DATE = "2024-01-01T00:00:00Z"
LEAST_BYTES = 1000


def _start(border: str) -> str:
    return f"{VERSION}\r\nWARC-Border: {border}\r\n"


def _bytes(text: Column) -> Column:
    return F.octet_length(text).cast("string")


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n"))


def write_warc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least_bytes: int = LEAST_BYTES,
) -> str:
    """One transaction a row: a response or revisit record, its request, and its metadata.

    Of rows whose payloads are equal and have at least ``least_bytes`` bytes, the one with the
    largest id holds the payload and the others revisit it; rows that share that id all hold it.
    Request and metadata name the response in WARC-Concurrent-To; the metadata record carries
    the row's id. A NULL payload is empty, a NULL url or id is left out. Line ends in urls
    are percent-encoded, as a header line must not hold them. Other columns are ignored.

    Each record starts with a header field that holds a random border, which no payload can
    know; it is returned, and the reader splits files there. Spark's text sink writes the files,
    so a lost task leaves no half archive.
    """
    scratch = Scratch(pages.sparkSession)
    border = uuid.uuid4().hex
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"))
    # Kept apart, so that its size is known when the payloads meet it: only digests that occur
    # twice or more are in it.
    holders = scratch.keep(
        rows.where(F.octet_length("payload") >= least_bytes).select("id", "digest")
        .groupBy("digest").agg(F.max("id").alias("holder"), F.count("*").alias("n"))
        .where("n > 1").select("digest", "holder"), "holders")
    rows = rows.join(holders, "digest", "left").withColumns({
        "revisit": F.col("holder").isNotNull() & ~F.col("holder").eqNullSafe(F.col("id")),
        "rid": F.concat(F.lit("urn:uuid:"), F.uuid()),
    })
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    target = F.coalesce(_line("WARC-Target-URI", url), F.lit(""))
    digest = _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"))

    def record(kind: str, mark: str, media: str, headers: list[Column], body: Column) -> Column:
        rid = F.concat(F.lit("<"), "rid", F.lit(f"{mark}>"))
        return F.concat(
            F.lit(f"{_start(border)}WARC-Type: {kind}\r\nWARC-Date: {DATE}\r\n"),
            _line("WARC-Record-ID", rid), target, *headers, _line("Content-Type", media),
            _line("Content-Length", _bytes(body)), F.lit("\r\n"), body, F.lit(END))

    status = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n")
    message = F.concat(status, _line("Content-Length", _bytes(F.col("payload"))), F.lit("\r\n"))
    http = "application/http; msgtype="
    response = record("response", "", http + "response", [digest], F.concat(message, "payload"))
    revisit = record("revisit", "", http + "response",
                     [digest, _line("WARC-Profile", PROFILE)], message)
    concurrent = _line("WARC-Concurrent-To", F.concat(F.lit("<"), "rid", F.lit(">")))
    get = F.concat(F.lit("GET "), F.coalesce(url, F.lit("")), F.lit(" HTTP/1.1\r\n\r\n"))
    request = record("request", "#request", http + "request", [concurrent], get)
    fields = F.coalesce(_line("page-id", F.col("id").cast("string")), F.lit(""))
    metadata = record("metadata", "#metadata", "application/warc-fields", [concurrent], fields)
    whole = F.concat(F.when(F.col("revisit"), revisit).otherwise(response), request, metadata)
    # The sink itself writes the last byte.
    rows.select(F.left(whole, F.length(whole) - 1).alias("value")).write.option(
        "lineSep", "\n").text(path)
    scratch.drop(holders)
    return border


def _header(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r]*)", 1), F.lit(""))


def read_warc(spark: SparkSession, path: str, border: str) -> DataFrame:
    """One row a record: ``kind, record_id, concurrent_to, target, digest, head, body``.

    Files are split at record borders, so one large archive feeds many tasks. A record
    whose block is shorter or longer than its Content-Length says fails the read. The border is
    taken without the line ends before it: Hadoop's reader can miss a separator whose beginning
    repeats in the text before it.
    """
    rows = spark.read.option("lineSep", _start(border)).text(path).where("value <> ''")
    cut = F.instr("value", END)
    rows = rows.select(
        F.left("value", cut + 1).alias("head"),
        F.substring("value", cut + len(END), F.length("value")).alias("rest"))
    length = F.regexp_extract("head", r"(?im)^Content-Length:[ \t]*(\d+)", 1).cast("long")
    ends = F.endswith("rest", F.lit(END))
    rows = rows.withColumn("body", F.when(ends, F.left("rest", F.length("rest") - len(END))))
    return rows.select(
        _header("WARC-Type").alias("kind"), _header("WARC-Record-ID").alias("record_id"),
        _header("WARC-Concurrent-To").alias("concurrent_to"), _header("WARC-Target-URI").alias("target"),
        F.nullif(F.regexp_extract("head", r"(?im)^WARC-Payload-Digest:[ \t]*sha1:([^\r]*)", 1), F.lit(""))
        .alias("digest"), "head",
        F.when(F.coalesce(F.octet_length("body") == length, F.lit(False)), F.col("body")).otherwise(
            F.raise_error(F.concat(F.lit("WARC block length differs: "), "head"))).alias("body"))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: ``record_id, kind, target, response, requests, metadata``.

    ``response`` has the payload, its bytes and its digest: measured for responses, and as the
    headers say for revisits, which hold none. Requests and metadata are found by their
    concurrent-to identifiers and listed in the order of their record ids; a capture without
    them has empty lists, and records that name no capture here are left out.
    """
    split = F.instr("body", END)
    payload = F.substring("body", split + len(END), F.length("body"))
    # The message's own header ends at the first empty line.
    size = F.regexp_extract(F.left("body", split + 1), r"(?im)^Content-Length:[ \t]*(\d+)", 1).cast("long")
    held = F.col("kind") == "response"
    captures = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", "kind", "target", F.when(held, payload).alias("payload"),
        F.when(held, F.octet_length(payload).cast("long")).otherwise(size).alias("payload_bytes"),
        F.when(held, F.sha1(payload.cast("binary"))).otherwise(F.col("digest")).alias("payload_digest"))
    others = (
        records.where(F.col("kind").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
        .groupBy(F.col("concurrent_to").alias("record_id"))
        .agg(F.sort_array(F.collect_list(F.struct("record_id", "kind", "body"))).alias("others")))

    def pick(kind: str) -> Column:
        some = F.coalesce("others", F.array().cast("array<struct<record_id:string,kind:string,body:string>>"))
        return F.transform(F.filter(some, lambda o: o["kind"] == kind), lambda o: o["body"])

    # The nested row is built last and measures are taken before the join, so that payloads which
    # nobody reads are not shuffled. That holds while nothing stands between a field of the row and
    # who reads it that could fail: casts of other fields have to be lenient.
    response = F.struct("payload", "payload_bytes", "payload_digest").alias("response")
    return captures.join(others, "record_id", "left").select(
        "record_id", "kind", "target", response, pick("request").alias("requests"),
        pick("metadata").alias("metadata"))


def archived_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
) -> DataFrame:
    """Write ``pages`` to archives, read them back, and tell each row's record.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to, requests``.
    A revisit refers to the largest id among the responses with its digest. NULL payloads are
    empty, NULL ids stay NULL, and every repeated row gets a record of its own.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    path = scratch.path("archives")
    border = write_warc(pages, path, id_col, url_col, payload_col)
    page_id = F.regexp_extract(F.element_at("metadata", 1), r"(?m)^page-id: (-?\d+)", 1)
    rows = scratch.keep(assemble(read_warc(spark, path, border)).select(
        page_id.try_cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("kind").alias("record_type"), F.size("requests").alias("requests")), "captures")
    digests = rows.where("record_type = 'revisit'").select("payload_digest").distinct()
    held = scratch.keep(
        rows.where("record_type = 'response'").join(digests, "payload_digest", "left_semi")
        .groupBy("payload_digest").agg(F.max("page_id").alias("refers_to")), "held")
    return rows.where("record_type = 'revisit'").join(held, "payload_digest", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "requests"
    ).unionByName(rows.where("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type",
        F.lit(None).cast("long").alias("refers_to"), "requests"))


ORACLE = f"""
WITH sized AS (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
        sha1(coalesce(html, '')) AS payload_digest FROM pages),
held AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS holder,
        count(*) OVER (PARTITION BY payload_digest) AS n FROM sized)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id IS DISTINCT FROM holder AND holder IS NOT NULL
        THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id IS DISTINCT FROM holder THEN holder END AS refers_to,
    1 AS requests
FROM held"""
