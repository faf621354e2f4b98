"""WARC archives: write captures, read them back and assemble each transaction.

Every page becomes three records: request and metadata name, by WARC-Concurrent-To, the response (or
revisit) of the same capture. Of records with equal payloads of at least min_bytes bytes that with the
smallest page_id is a response; the others are revisits that refer to it and store no payload. Archives
are gzip files written by Spark's own writer, so they reach any store that Spark does; a file holds the pages of one
class of sizes and so many of them that its bytes are bounded. They are read as whole files and parsed record by
record, by Content-Length.

A capture is known by page_id, payload digest, a hash of the url and, where rows agree in all of these, a copy number:
every row is a capture of its own, with its own url. Of rows that share the smallest page_id all are responses, and
revisits refer to the one with the least url hash. Null html is the empty payload, null url the empty target. Rows
without page_id come back without; they are responses unless a row that has one holds the same payload. An empty
table gives no records. Columns beyond page_id, url, html are ignored.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.llm.common import BATCH_CHARS, checkpoint, shared_dir, table
from quillspark.llm.components import lookup

END = "\r\n\r\n"
#: Archives by the bytes of a payload: (largest payload, pages per archive), so that a file holds 128 MB of payload at most, or one page.
CLASSES = ((64 << 10, 2000), (8 << 20, 16), (1 << 31, 1))
#: Copies of one row that a task writes at most.
COPIES = 1000
#: Groups of equal payloads that may be broadcast, some 100 bytes each; beyond, they are joined by a shuffle.
MOST_BROADCAST = 100_000
BASE32_HEX, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_length bigint, payload_digest string, page_id bigint, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: five bytes, or ten hexadecimal digits, give eight characters."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), BASE32_HEX, BASE32)


def capture_id(page: Column, digest: Column, url: Column, copy: Column) -> Column:
    """<urn:capture:PAGE:DIGEST:URL:COPY> of a page_id, a digest, a url's hash and the number of the copy."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(F.lit("<urn:capture:"), F.concat_ws(":", text(page), digest, F.lower(F.hex(url)), text(copy)), F.lit(">"))


def numbered(known: DataFrame, equal: DataFrame) -> DataFrame:
    """known with copy, 0 for all rows but those of equal (page_id, digest, url_hash, n): their n copies are put together, then dealt and numbered from 0."""
    names = ["page_id", "digest", "url_hash"]
    if equal.isEmpty():
        return known.withColumn("copy", F.lit(0).cast("long"))
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"e.{c}")) for c in names]
    single = known.alias("k").join(equal.alias("e"), same, "left_anti").withColumn("copy", F.lit(0).cast("long"))
    rest = [c for c in known.columns if c not in names]
    one = known.alias("k").join(equal.drop("n").alias("e"), same, "left_semi").groupBy(*names).agg(*[F.any_value(c).alias(c) for c in rest], F.count("*").alias("n"))
    blocks = one.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))).repartition("digest", "page_id", "url_hash", "block")
    low = F.col("block") * COPIES
    return single.unionByName(blocks.withColumn("copy", F.explode(F.sequence(low, F.least(low + COPIES, F.col("n")) - 1))).drop("n", "block"))


def _headers(*pairs: tuple[str, Column | str]) -> Column:
    """WARC/1.1 header lines; pairs whose value is null are left out."""
    lines = [F.concat(F.lit(f"{k}: "), v if isinstance(v, Column) else F.lit(v)) for k, v in pairs]
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines), F.lit(END))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, fetched_at: str = "2024-01-01T00:00:00Z") -> None:
    """Write the records of pages (page_id, url, html) below path, a folder for each class of sizes."""
    known = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A"), " ", "%20").alias("url"),
        F.coalesce("html", F.lit("")).alias("payload"),
    ).withColumns({"digest": base32_sha1(F.col("payload")), "url_hash": F.xxhash64("url")})
    # rows by identity, combined before the shuffle: what repeats, and the sizes there are
    seen = checkpoint(known.groupBy("digest", "page_id", "url_hash").agg(F.count("*").alias("n"), F.max(F.octet_length("payload")).alias("bytes")))
    copied = checkpoint(seen.filter("n > 1").drop("bytes"))
    least = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url_hash")
    equal = seen.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.sum("n").alias("n"), F.min(least).alias("least"))
    equal = checkpoint(equal.filter("n > 1").select("digest", "n", F.col("least.page_id").alias("first"), F.col("least.url_hash").alias("first_url")))
    rows = numbered(known, copied)
    if equal.count() <= MOST_BROADCAST:
        rows = rows.join(F.broadcast(equal.drop("n")), "digest", "left")
    else:
        rows = lookup(rows, "digest", equal, max(1, seen.agg(F.sum("n")).first()[0]), "page_id")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    size = F.octet_length("payload")
    own, length = capture_id(F.col("page_id"), F.col("digest"), F.col("url_hash"), F.col("copy")), size.cast("string")
    rows = rows.select(
        "*",
        size.alias("size"),
        revisit.alias("revisit"),
        own.alias("id"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length, F.lit(END)).alias("http"),
        F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\nHost: "), F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.lit(END)).alias("ask"),
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")).alias("fields"),
    )
    block = F.when(F.col("revisit"), F.col("http")).otherwise(F.concat("http", "payload"))
    common = (("WARC-Date", fetched_at), ("WARC-Target-URI", F.col("url")))
    named = lambda kind: F.concat(F.lit("<urn:"), F.lit(kind), F.substring("id", 6, 1 << 20))
    sized = lambda c: F.octet_length(c).cast("string")
    refers = capture_id(F.col("first"), F.col("digest"), F.col("first_url"), F.lit(0))
    records = [
        F.concat(_headers(("WARC-Type", "request"), ("WARC-Record-ID", named("request-")), *common, ("WARC-Concurrent-To", F.col("id")), ("Content-Type", "application/http;msgtype=request"), ("Content-Length", sized("ask"))), F.col("ask")),
        F.concat(
            _headers(
                ("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), ("WARC-Record-ID", F.col("id")), *common, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
                ("WARC-Profile", F.when(F.col("revisit"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", F.when(F.col("revisit"), refers)),
                ("Content-Type", "application/http;msgtype=response"), ("Content-Length", sized(block)),
            ),
            block,
        ),
        F.concat(_headers(("WARC-Type", "metadata"), ("WARC-Record-ID", named("metadata-")), *common, ("WARC-Concurrent-To", F.col("id")), ("Content-Type", "application/warc-fields"), ("Content-Length", sized("fields"))), F.col("fields")),
    ]
    # the writer ends each row by the record terminator, so the last record of a row has its own
    ready, low = rows.select("size", F.concat_ws(END, *records).alias("value")), -1
    largest = seen.agg(F.max("bytes")).first()[0]
    for i, (high, per_file) in enumerate(CLASSES):
        if i == 0 or (largest or 0) > low:
            ready.filter((F.col("size") > low) & (F.col("size") <= high)).select("value").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).mode("overwrite").text(f"{path}/class-{i}")
        low = high


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(size := int(headers["content-length"]))
        if len(block) != size:
            raise ValueError("a record is cut short")
        yield headers, block


def record_row(headers: dict[str, str], block: bytes) -> tuple:
    kind, payload, length, page = headers.get("warc-type"), None, None, None
    if kind in ("response", "revisit"):
        head, _, body = block.partition(b"\r\n\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
        length = int(fields.get(b"content-length", b"0"))
        payload = body if kind == "response" else None
    elif kind == "metadata":
        page = next((x[9:] for x in block.decode("utf-8").split("\r\n") if x.startswith("page-id: ")), "")
    digest = headers.get("warc-payload-digest")
    return (
        kind, headers.get("warc-record-id"), headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"),
        length, digest.partition(":")[2] if digest else None, int(page) if page else None, payload,
    )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; payload_length and payload_digest of a response are those of the bytes read, of a revisit those it states."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
            rows.clear()
            return out

        for batch in batches:
            for i in range(batch.num_rows):
                with gzip.GzipFile(fileobj=io.BytesIO(batch.column(0)[i].as_py())) as stream:
                    for headers, block in parse_records(stream):
                        rows.append(record_row(headers, block))
                        held += len(block)
                        if held > BATCH_CHARS or len(rows) >= 10_000:
                            yield flush()
                            held = 0
        if rows:
            yield flush()

    read = files.mapInArrow(run, RECORD)
    there = F.col("payload").isNotNull()
    return read.withColumns({"payload_length": F.when(there, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")), "payload_digest": F.when(there, base32_sha1(F.col("payload"))).otherwise(F.col("payload_digest"))})


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its request, response (or revisit) and metadata, joined by concurrent-to identifiers.

    The three share a group, so one aggregation joins them, mostly before the shuffle; columns that nobody reads are pruned from it.
    """
    part = {
        "request": ["record_id", "target_uri"],
        "response": ["record_type", "record_id", "refers_to", "target_uri", "payload_length", "payload_digest", "payload"],
        "metadata": ["record_id", "page_id"],
    }
    kinds = {"request": ["request"], "response": ["response", "revisit"], "metadata": ["metadata"]}
    picked = [F.any_value(F.when(F.col("record_type").isin(kinds[p]), F.col(c)), F.lit(True)).alias(f"{p}_{c}") for p, cols in part.items() for c in cols]
    one = records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(*picked, F.count("*").alias("n"))
    # a filter that keeps all: without one the structures below move into the aggregation, and their unread columns through the shuffle
    one = one.filter("n > 0")
    nested = [F.struct(*[F.col(f"{p}_{c}").alias(c) for c in cols]).alias(p) for p, cols in part.items()]
    return one.select("capture_id", *nested)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    got = assemble(read_archives(spark, path))
    return got.select(
        F.col("metadata.page_id").alias("page_id"),
        F.col("response.payload_length").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.regexp_extract("response.refers_to", "^<urn:capture:([0-9-]+):", 1).cast("long").alias("refers_to"),
    )


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), d AS (
  SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS h FROM p
), b AS (
  SELECT page_id, payload_bytes, translate(
    to_base(CAST('0x' || substr(h, 1, 10) AS BIGINT), 32, 8) || to_base(CAST('0x' || substr(h, 11, 10) AS BIGINT), 32, 8) ||
    to_base(CAST('0x' || substr(h, 21, 10) AS BIGINT), 32, 8) || to_base(CAST('0x' || substr(h, 31, 10) AS BIGINT), 32, 8),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
  FROM d
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM b
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""
