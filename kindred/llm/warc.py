"""WARC derivatives: each response yields a metadata record and a plain-text conversion record.

Records are rows; builder and writer run in one pass without a shuffle.  Steps are column expressions,
but for character references, which one Arrow function resolves by the HTML standard's table (named,
decimal, hexadecimal; each once).  Both derived records refer to the response's WARC-Record-ID, target URI and date, keep its
HTTP headers and digests, and get identifiers (UUIDs of version 5's form, from a digest of the
response's identifier and the record's type), so a rerun makes the same records.

A null html or payload is an empty body; a null URI gives an empty one.  Responses without an
identifier are left out.  Repeated rows give repeated records.  Other columns are ignored.  A very long page
takes memory in proportion to its length, in batches of its own.
"""

from __future__ import annotations

import gzip
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import bounded

CRLF = "\r\n"
LINK = r"""(?i)<a[ \t\r\n\f](?:[^>]*?[ \t\r\n\f])?href[ \t\r\n\f]*=[ \t\r\n\f]*("[^"]*"|'[^']*'|[^ \t\r\n\f"'>]+)"""


def urn(*parts: Column) -> Column:
    """A UUID from a digest of the parts."""
    h = F.sha1(F.concat_ws("\n", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(text.cast("binary")))


def resolve(text: str) -> str:
    """``text`` with its character references resolved as the HTML standard says; numbers beyond Unicode are U+FFFD."""
    if "&" not in text:
        return text
    text = re.sub(r"(&#[xX]?)0+(?=[0-9a-fA-F])", r"\1", text)
    return html.unescape(re.sub(r"&#[0-9]{8,};?", "\ufffd", text))  # longer numbers than int() takes


def resolved(text: Column) -> Column:
    return F.arrow_udf(lambda a: pa.array([None if t is None else resolve(t) for t in a.to_pylist()], pa.string()), "string")(text)


def plain_text(page: Column) -> Column:
    """Text of a page: no scripts, styles, comments or tags; blocks end lines; references resolved; white space folded."""
    t = F.regexp_replace(page, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|blockquote|pre)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    t = F.regexp_replace(resolved(t), r"[ \t\r\f\u00a0]+", " ")
    return F.regexp_replace(F.regexp_replace(t, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def responses(pages: DataFrame, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Pages (page_id, url, html) as response records; a crawl that kept its HTTP headers has them instead."""
    page = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(page).cast("string"), F.lit(CRLF + CRLF))
    return pages.where("page_id is not null").select(
        "page_id", urn(F.lit("response"), F.col("page_id").cast("string"), F.coalesce("url", F.lit(""))).alias("record_id"), F.coalesce("url", F.lit("")).alias("target_uri"), F.lit(date).alias("date"), head.alias("http_headers"), page.alias("payload")
    )


def derive(resp: DataFrame, *keep: str) -> DataFrame:
    """Two rows for each response (record_id, target_uri, date, http_headers, payload), with the columns ``keep`` in front.

    record_type, record_id, refers_to, refers_to_target_uri, refers_to_date, content_type, source_headers,
    source_payload_digest, source_block_digest, block_digest, content_length, content.
    """
    bounded(resp.sparkSession)
    resp = resp.where("record_id is not null").withColumns({c: F.coalesce(c, F.lit("")) for c in ("target_uri", "date", "http_headers", "payload")})
    resp = resp.withColumns({"source_payload_digest": digest(F.col("payload")), "source_block_digest": digest(F.concat("http_headers", "payload")), "body": plain_text(F.col("payload"))})
    title = F.trim(F.regexp_replace(resolved(F.regexp_extract("payload", r"(?is)<title[^>]*>(.*?)</title>", 1)), r"[ \t\r\n\f\u00a0]+", " "))
    status = F.regexp_extract("http_headers", r"^HTTP/[0-9.]+ ([0-9]{3})", 1)
    # no page text holds NUL, so that it parts the values while their references are resolved
    hrefs = F.transform(F.regexp_extract_all("payload", F.lit(LINK), 1), lambda x: F.regexp_replace(F.replace(x, F.lit("\0"), F.lit("")), "^[\"']|[\"']$", ""))
    links = F.transform(F.split(resolved(F.array_join(hrefs, "\0")), "\0"), lambda x: F.concat(F.lit("outlink: "), F.regexp_replace(x, r"[\t\r\n]", ""), F.lit(CRLF)))
    links = F.when(F.size(hrefs) > 0, F.array_join(links, "")).otherwise("")
    fields = F.concat(
        F.lit("source-status: "), status, F.lit(f"{CRLF}source-payload-digest: "), F.col("source_payload_digest"), F.lit(f"{CRLF}source-content-length: "), F.octet_length("payload").cast("string"), F.lit(f"{CRLF}title: "), title, F.lit(CRLF), links
    )
    kinds = F.array(F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("content")), F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("body").alias("content")))
    rows = resp.select(*keep, F.col("record_id").alias("refers_to"), F.col("target_uri").alias("refers_to_target_uri"), F.col("date").alias("refers_to_date"), F.col("http_headers").alias("source_headers"), "source_payload_digest", "source_block_digest", F.explode(kinds).alias("k"))
    return rows.select(
        *keep, "k.record_type", urn(F.col("k.record_type"), F.col("refers_to")).alias("record_id"), "refers_to", "refers_to_target_uri", "refers_to_date", "k.content_type", "source_headers", "source_payload_digest", "source_block_digest", digest(F.col("k.content")).alias("block_digest"), F.octet_length("k.content").cast("long").alias("content_length"), "k.content"
    )


def serialised(records: DataFrame) -> DataFrame:
    """``warc``: each derived record in WARC/1.1 form. Source headers are kept, folded to one line, in WARC-Source-Headers."""
    head = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit(CRLF))
    one_line = F.regexp_replace(F.regexp_replace("source_headers", r"(\r?\n)+$", ""), r"\r?\n", " | ")
    return records.select(
        F.concat(
            F.lit(f"WARC/1.1{CRLF}"), head("WARC-Type", F.col("record_type")), head("WARC-Record-ID", F.col("record_id")), head("WARC-Date", F.col("refers_to_date")), head("WARC-Target-URI", F.col("refers_to_target_uri")), head("WARC-Refers-To", F.col("refers_to")),
            head("WARC-Refers-To-Target-URI", F.col("refers_to_target_uri")), head("WARC-Refers-To-Date", F.col("refers_to_date")), head("WARC-Block-Digest", F.col("block_digest")), head("WARC-Source-Payload-Digest", F.col("source_payload_digest")), head("WARC-Source-Block-Digest", F.col("source_block_digest")),
            head("WARC-Source-Headers", one_line), head("Content-Type", F.col("content_type")), head("Content-Length", F.col("content_length").cast("string")), F.lit(CRLF), F.col("content"), F.lit(CRLF + CRLF),
        ).alias("warc")
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Gzipped WARC files, one for each partition, through Spark's own writer (any file system it knows)."""
    serialised(records).select(F.expr("left(warc, length(warc) - 1)").alias("value")).write.mode("overwrite").option("compression", "gzip").option("lineSep", "\n").text(path)


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a WARC file, gzipped or not; lengths are trusted, not separators."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    at = raw.find(b"WARC/")
    while 0 <= at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8", "replace").split(CRLF)
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(head.get("content-length", 0))
        yield head, raw[end + 4 : end + 4 + size]
        at = raw.find(b"WARC/", end + 4 + size)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files (a file is read by one task): record_id, target_uri, date, http_headers, payload."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                rows = []
                for head, block in parse(raw.as_py()):
                    if head.get("warc-type") == "response":
                        http, _, body = block.partition(b"\r\n\r\n")
                        rows.append((head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"), http.decode("utf-8", "replace") + CRLF * 2, body.decode("utf-8", "replace")))
                yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], pa.string()) for i, c in enumerate(("record_id", "target_uri", "date", "http_headers", "payload"))})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(records, "record_id string, target_uri string, date string, http_headers string, payload string")


