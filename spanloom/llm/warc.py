"""Operator 5: WARC archives, written from pages and read back as one nested row per capture.

A page becomes a request, a response (or a revisit of the response with the same payload) and a metadata record; request and
metadata name the response or revisit by WARC-Concurrent-To. Archives are written by Spark's text writer to the shared folder, a
whole-file gzip each, and read by Spark's binaryFile reader; a worker inflates and parses them piece by piece, by Content-Length, so payloads
may hold anything and no archive is unpacked whole. Records are then joined through their concurrent-to identifiers.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import new_path, ship, stage, table
from spanloom.operators.joins import lookup_join

DATE = "2024-01-01T00:00:00Z"
#: Records of an archive, for payloads of up to LARGE bytes and for larger ones: binaryFile reads a packed archive whole.
RECORDS_PER_FILE, RECORDS_PER_LARGE_FILE, LARGE = 6000, 48, 1 << 16
#: Bytes inflated at a time, and about as many bytes of blocks are handed on together.
PIECE = 1 << 20
#: Repeated payloads of up to so many digests are found by a broadcast table (60 bytes each), of more by a shuffle.
FEW_DIGESTS = 100_000
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_SCHEMA = "record_id string, warc_type string, concurrent_to string, refers_to string, target_uri string, page_id long, payload_digest string, payload_bytes long, digest_ok boolean, block binary"


def _base32(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: four letters for every five hexadecimal digits."""
    h = F.sha1(payload.cast("binary"))
    part = lambda k: F.lpad(F.conv(F.substring(h, 5 * k + 1, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*map(part, range(8))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _LETTERS)


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without its last line end, which the writer adds. Null headers are left out."""
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <"), record_id, F.lit(">\r\n")]
    for name, value in headers:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n"))


def _urn(kind: str, page: Column, digest: Column, copy: Column) -> Column:
    """Identifier of a record of the copy-th row with this page_id and payload."""
    h = F.md5(F.concat_ws(" ", F.lit(kind), F.coalesce(page.cast("string"), F.lit("-")), digest, copy.cast("string")))
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def _with_first(marked: DataFrame) -> DataFrame:
    """marked (page_id, url, html, digest) with first (the smallest page_id of an equal payload) and copy (number of the row among those of
    its page_id and payload, from 1). Payloads are shuffled only where so many digests repeat that their table isn't small."""
    pairs = marked.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    per = pairs.groupBy("digest").agg(F.min("page_id").alias("first"), F.sum("n").alias("rows"), F.max("n").alias("most"))
    per = per.where("rows > 1").select("digest", "first", (F.col("most") > 1).alias("again"), "rows")
    repeated = stage(per, "repeated-payloads")
    n, again = repeated.agg(F.count(F.lit(1)), F.coalesce(F.bool_or("again"), F.lit(False))).first()
    if n <= FEW_DIGESTS:
        met = marked.join(F.broadcast(repeated.drop("rows")), "digest", "left")
    else:
        met = lookup_join(marked, repeated, "digest", "rows")
    met = met.withColumn("again", F.coalesce("again", F.lit(False)))
    met = met.withColumn("first", F.coalesce("first", "page_id"))
    once = met.where("NOT again").withColumn("copy", F.lit(1))
    if again:
        twice = met.where("again").withColumn("copy", F.row_number().over(W.partitionBy("digest", "page_id").orderBy("url")))
        once = once.unionByName(twice)
    return once.drop("again")


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write the records of pages (page_id, url, html) below path, for every row.

    A null html is an empty payload, a null url an empty address; line ends in an address are dropped. Of payloads that are equal and at least
    min_revisit_bytes long, that of the smallest page_id is the response, and a null page_id comes after all others. Rows that repeat a
    page_id with its payload have records of their own: all responses, or all revisits of the first row of the smallest page_id. One
    page_id with several payloads has records for each. Other columns are ignored; an empty table gives no archives.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "").alias("url")
    rows = _with_first(pages.select("page_id", url, html.alias("html")).withColumn("digest", _base32(F.col("html"))))
    rows = rows.withColumn("revisits", ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("html") >= min_revisit_bytes))
    page, n = F.col("page_id"), F.octet_length("html").cast("string")
    own = page, F.col("digest"), F.col("copy")
    capture = F.when(F.col("revisits"), _urn("revisit", *own)).otherwise(_urn("response", *own))
    uri, digest = ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n, F.lit("\r\n\r\n"))
    kind = ("Content-Type", F.lit("application/http; msgtype=response"))
    response = _record("response", capture, [uri, digest, kind], F.concat(http, "html"))
    profile = ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    target = _urn("response", F.col("first"), F.col("digest"), F.lit(1))
    refers = ("WARC-Refers-To", F.concat(F.lit("<"), target, F.lit(">")))
    revisit = _record("revisit", capture, [uri, digest, profile, refers, kind], http)
    concurrent = ("WARC-Concurrent-To", F.concat(F.lit("<"), capture, F.lit(">")))
    request = _record("request", _urn("request", *own), [uri, concurrent, ("Content-Type", F.lit("application/http; msgtype=request"))], F.lit("GET / HTTP/1.1\r\n\r\n"))
    fields = F.coalesce(F.concat(F.lit("page-id: "), page.cast("string"), F.lit("\r\n")), F.lit(""))
    metadata = _record("metadata", _urn("metadata", *own), [uri, concurrent, ("Content-Type", F.lit("application/warc-fields"))], fields)
    three = F.explode(F.array(request, F.when(F.col("revisits"), revisit).otherwise(response), metadata)).alias("value")
    large = F.octet_length("html") > LARGE
    for part, wanted, most in (("small", ~large, records_per_file), ("large", large, min(records_per_file, RECORDS_PER_LARGE_FILE))):
        if part == "large" and pages.where(large).isEmpty():
            continue
        records = rows.where(wanted).select(three)
        records.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(f"{path}/{part}")


def _inflated(packed: bytes) -> Iterator[bytes]:
    """The contents of a gzip file, piece by piece."""
    unzip, rest = zlib.decompressobj(wbits=31), packed
    while rest and not unzip.eof:
        piece = unzip.decompress(rest, PIECE)
        rest = unzip.unconsumed_tail
        if piece:
            yield piece


def _parse(data: bytes | Iterator[bytes], with_block: bool) -> Iterator[tuple]:
    """Records of an archive that is given whole or in pieces; only the record at hand is held."""
    pieces = iter([data] if isinstance(data, bytes) else data)
    held, at = bytearray(), 0

    def until(enough) -> bool:
        """Take pieces until there is enough."""
        while not enough():
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while until(lambda: len(held) > at):
        del held[:at]
        at = 0
        if not until(lambda: held.find(b"\r\n\r\n") >= 0):
            raise ValueError("a record ends within its head")
        head_end = held.find(b"\r\n\r\n")
        lines = held[:head_end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record where one should begin: {lines[0][:40]!r}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        if not until(lambda: len(held) >= head_end + 4 + size):
            raise ValueError("a record ends within its block")
        block = bytes(held[head_end + 4 : head_end + 4 + size])
        at = head_end + 4 + size + 4
        until(lambda: len(held) >= at)
        bare = lambda k, head=head: head[k].strip("<>") if k in head else None
        digest, payload_bytes, ok, page = head.get("warc-payload-digest", "").removeprefix("sha1:") or None, None, None, None
        if head["warc-type"] in ("response", "revisit"):
            http, _, payload = block.partition(b"\r\n\r\n")
            payload_bytes = int(http.lower().partition(b"content-length:")[2].split(b"\r\n")[0])
            if head["warc-type"] == "response":
                ok = len(payload) == payload_bytes and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
        elif head["warc-type"] == "metadata" and b"page-id:" in block:
            page = int(block.partition(b"page-id:")[2].split(b"\r\n")[0])
        yield bare("warc-record-id"), head["warc-type"], bare("warc-concurrent-to"), bare("warc-refers-to"), head.get("warc-target-uri", ""), page, digest, payload_bytes, ok, block if with_block else None


def read_records(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """One row per record of all archives below path."""
    ship(spark)
    names = [c.split()[0] for c in _SCHEMA.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "payload_bytes": "Int64", "digest_ok": "boolean"})

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for data in batch["content"]:
                for record in _parse(_inflated(data), with_block):
                    rows.append(record)
                    size += len(record[-1] or b"")
                    if len(rows) >= 2000 or size >= PIECE:
                        yield frame(rows)
                        rows, size = [], 0
        if rows:
            yield frame(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInPandas(parse, _SCHEMA)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, main (the response or revisit), requests and metadata (arrays, by record_id).

    A request or metadata record belongs to the record that it is concurrent to; a capture whose response is missing has a null main.
    Repeated records (same identifier) count once.
    """
    fields = F.struct(*(c.split()[0] for c in _SCHEMA.split(", ")))
    kept = lambda *kinds: F.array_sort(F.collect_set(F.when(F.col("warc_type").isin(*kinds), fields)))
    by_capture = records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id")).groupBy("capture_id")
    nested = by_capture.agg(kept("response", "revisit").alias("main"), kept("request").alias("requests"), kept("metadata").alias("metadata"))
    return nested.withColumn("main", F.try_element_at("main", F.lit(1)))


def op5_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    found = captures(read_records(spark, path, with_block=False))
    main = [F.col(f"main.{c}").alias(c) for c in ("warc_type", "payload_bytes", "payload_digest", "refers_to")]
    found = stage(found.select("capture_id", F.col("metadata")[0]["page_id"].alias("page_id"), *main), "captures")
    # A revisit names its response's record; the page of that record is the page it refers to.
    revisits = found.where("warc_type = 'revisit'").withColumnRenamed("refers_to", "response_id").drop("capture_id")
    wanted = revisits.groupBy("response_id").agg(F.count(F.lit(1)).alias("n"))
    target = found.where("warc_type = 'response'").select(F.col("capture_id").alias("response_id"), F.col("page_id").alias("refers_to"))
    met = lookup_join(revisits, stage(wanted.join(target, "response_id"), "responses"), "response_id", "n").drop("response_id")
    rest = found.where("NOT warc_type <=> 'revisit'").withColumn("refers_to", F.lit(None).cast("long")).drop("capture_id")
    both = met.unionByName(rest)  # responses, which refer to nothing, aren't joined
    return both.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (
  SELECT page_id, strlen(html) AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS first,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5))::BIGINT >> (15 - i % 4 * 5)::INT) & 31)::BIGINT + 1, 1)), '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM q
"""
