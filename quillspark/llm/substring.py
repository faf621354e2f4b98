"""Substring deduplication by content-defined chunking with a gear rolling hash.

A text's UTF-8 bytes are cut where the gear hash of the last 32 bytes has CUT_BITS zero bits, at least
MIN_BYTES after the last cut, at code point boundaries; so an insertion moves only the cuts beside it. Where
FALLBACK bytes have no such hash, as in periodic text, a place whose hash is the least of them is cut too.

Chunks with equal digests (XXH3, 128 bits) are copies: the first row (smallest doc_id) keeps them, later ones lose
them, and within a text the first place keeps them. A run of copied chunks is extended to both sides as far as its text
equals its owners', at most REACH characters a side, and counts from min_run characters on; with min_run 1 every copied
chunk does. A passage that holds no whole chunk is not found.

Chunks are dealt by digest once. Digests that hold a large share of all rows are told by the size of their bucket, are
aggregated to their first row before any shuffle and joined back by broadcast.

Every row is a text of its own, also where rows share a doc_id (they stand by a hash of their text) or have none (they
come last); a row is cut by its own spans only. Null text is the empty text: no chunks. Empty tables give empty ones.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillspark.llm.common import bound_batches, checkpoint, hot_keys, python_stage, remove, row_keys, table
from quillspark.llm.components import lookup

CUT_BITS = 5
MIN_BYTES = 16
MAX_BYTES = 512
MIN_RUN = 100
#: Bytes without a cut after which the least hash of as many is one.
FALLBACK = 64
#: A run is extended from one of the NEAR chunks at its edge, of those with the smallest owner the outermost,
#: over at most REACH characters. Chunks of equal texts meet again within a few cuts, so more is seldom equal.
NEAR, REACH = 3, 400
#: Buckets of digests by whose size hot ones are told.
BUCKETS = 1 << 16
#: Texts are chunked in stretches of so many bytes, which bounds memory; cuts don't depend on it.
STRETCH = 1 << 22


def gear_table(seed: int = 20240101) -> np.ndarray:
    """A fixed random number for each byte value, from a linear congruential rule."""
    out, x = np.empty(256, np.uint32), seed
    for i in range(256):
        for _ in range(3):
            x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out[i] = x >> 32
    return out


GEAR = gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the gear hash of the 32 bytes that end there: the sum of GEAR[byte j back] << j, doubled up in five steps."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        moved = h.copy()
        moved[step:] += h[:-step] << np.uint32(step)
        h = moved
    return h


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of data (uint8), the last one its length."""
    places = []
    for at in range(0, len(data), STRETCH):
        low = max(0, at - 31 - FALLBACK)
        hashes = gear_hashes(data[low : at + STRETCH])
        least = hashes.copy()
        for step in (1, 2, 4, 8, 16, 32):
            least[step:] = np.minimum(least[step:], least[:-step].copy())
        wanted = hashes == least
        wanted[: 31 + FALLBACK] = False  # no full window yet; in later stretches these lie before it
        wanted |= (hashes >> np.uint32(32 - CUT_BITS)) == 0
        places.append(np.nonzero(wanted[at - low :])[0] + at + 1)
    wanted = np.concatenate(places) if places else np.zeros(0, np.int64)
    if len(wanted):
        # a cut inside a code point moves to its end
        for _ in range(3):
            inner = (wanted < len(data)) & ((data[np.minimum(wanted, len(data) - 1)] & 0xC0) == 0x80)
            wanted = wanted + inner
    out, last, n = [], 0, len(data)
    for w in [*wanted.tolist(), n]:
        while w - last > MAX_BYTES:
            end = last + MAX_BYTES
            while end < n and data[end] & 0xC0 == 0x80:
                end += 1
            out.append(end)
            last = end
        if w - last >= MIN_BYTES or (w == n and w > last):
            out.append(w)
            last = w
    return out


def chunk_text(text: str | None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(digests, starts, ends) of the chunks of a text; places in code points, digests of 16 bytes."""
    import xxhash

    raw = (text or "").encode("utf-8", "replace")
    data = np.frombuffer(raw, np.uint8)
    ends = cuts(data)
    starts = [0, *ends[:-1]] if ends else []
    digests = [xxhash.xxh3_128_digest(raw[s:e]) for s, e in zip(starts, ends, strict=True)]
    points = np.cumsum((data & 0xC0) != 0x80)
    ends_at = points[np.array(ends, np.int64) - 1] if ends else np.zeros(0, np.int64)
    return digests, np.concatenate([[0], ends_at[:-1]]).astype(np.int64) if ends else ends_at, ends_at.astype(np.int64)


def halves(digests: list[bytes]) -> np.ndarray:
    """Digests as rows of two signed integers."""
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def chunks(rows: DataFrame) -> DataFrame:
    """(row, ix, d1, d2, again) of every chunk of rows (row, text); d1 and d2 are its digest, again says that the text held it before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "ix", "d1", "d2", "again"]
        for batch in batches:
            parts: list[tuple] = []
            n_rows = 0

            def flush(parts: list[tuple]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in parts])) for i in range(5)], names=names)

            for i in range(batch.num_rows):
                digests = chunk_text(batch.column(1)[i].as_py())[0]
                n, seen = len(digests), set()
                if n:
                    again = np.fromiter((d in seen or seen.add(d) is not None for d in digests), bool, n)
                    both = halves(digests)
                    parts.append((np.full(n, batch.column(0)[i].as_py(), np.int64), np.arange(n, dtype=np.int32), both[:, 0], both[:, 1], again))
                    n_rows += n
                if n_rows > 100_000:
                    yield flush(parts)
                    parts, n_rows = [], 0
            if parts:
                yield flush(parts)

    bound_batches(rows.sparkSession)
    return rows.select("row", "text").mapInArrow(run, "row bigint, ix int, d1 bigint, d2 bigint, again boolean")


def hot_digests(every: DataFrame) -> DataFrame:
    """(d1, d2, first) of the digests that hold over HOT_SHARE of all chunks, fewer than 1 / HOT_SHARE of them; first is the first row that has it.

    The size of a digest's bucket tells where to look, so that few digests are counted; as few buckets can be large.
    """
    total = max(1, every.count())
    bucket = F.pmod("d1", F.lit(BUCKETS)).cast("int")
    large = [r["bucket"] for r in hot_keys(every.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")), total).select("bucket").collect()]
    counts = every.filter(bucket.isin(large)).groupBy("d1", "d2").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    return checkpoint(hot_keys(counts, total).select("d1", "d2", "first"))


def copies(every: DataFrame) -> DataFrame:
    """(row, ix, digest, owner) of the chunks that an earlier place holds; owner is the first row that does.

    Chunks are dealt by digest once, those of hot digests, whose first row is known, by their rows as well.
    """
    marked = every.join(F.broadcast(hot_digests(every)), ["d1", "d2"], "left")
    salt = F.when(F.col("first").isNotNull(), F.pmod(F.xxhash64("row"), F.lit(1 << 20))).otherwise(0)
    alike = Window.partitionBy("d1", "d2", "salt")
    owned = marked.withColumn("salt", salt).withColumn("owner", F.coalesce("first", F.min("row").over(alike)))
    return owned.filter("again or owner < row").select("row", "ix", F.struct("d1", "d2").alias("digest"), "owner")


def common(a: str | None, b: str | None, side: int) -> int:
    """Characters that a and b share at their beginnings (side 1) or ends (side 0)."""
    if not a or not b:
        return 0
    return len(os.path.commonprefix([a, b] if side else [a[::-1], b[::-1]]))


def beside(text: str | None, runs: list, asked: list) -> tuple[list[tuple], list[tuple]]:
    """Of runs (run, low, high, first, last), given by chunk numbers, (run, start, end, left_at, left, right_at, right):
    their places and the text beside their chunks first and last. Of asked chunks (digest, side) the first in text:
    (digest, side, end, text beside it)."""
    digests, start, end = chunk_text(text)
    before = lambda i: text[max(0, start[i] - REACH) : start[i]]
    after = lambda i: text[end[i] : end[i] + REACH]
    places = [(r["run"], int(start[r["low"]]), int(end[r["high"]]), int(start[r["first"]]), before(r["first"]), int(end[r["last"]]), after(r["last"])) for r in runs or ()]
    if not asked:
        return places, []
    first = dict(zip(digests[::-1], range(len(digests) - 1, -1, -1), strict=True))
    parts = []
    for a in asked:
        i = first[halves_to_bytes(a["digest"])]
        parts.append((a["digest"], a["side"], int(end[i]), after(i) if a["side"] else before(i)))
    return places, parts


def halves_to_bytes(digest: dict) -> bytes:
    return np.array([digest["d1"], digest["d2"]], "<i8").tobytes()


def grown(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, start, end, owners) of runs (row, run, low, high, first, last, owners), extended to both sides as far as their text equals the owners'."""
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("first").alias("x")), F.struct(F.lit(1).alias("side"), F.col("last").alias("x"))))
    asks = runs.select("row", "run", sides.alias("s")).select("row", "run", "s.side", F.struct(F.col("s.x.owner").alias("row"), F.col("s.x.digest").alias("digest"), F.col("s.side").alias("side")).alias("theirs"))
    owners = checkpoint(asks.groupBy("theirs").agg(F.count("*").alias("n")))
    # what many runs ask of one owner is asked once, and every text is read once for all that is asked of it
    mine = runs.select("row", F.struct("run", "low", "high", F.col("first.ix").alias("first"), F.abs("last.ix").alias("last")).alias("mine"))
    told = owners.select("theirs.row", F.struct("theirs.digest", "theirs.side").alias("asked"))
    asked = mine.unionByName(told, allowMissingColumns=True).groupBy("row").agg(F.collect_list("mine").alias("runs"), F.collect_list("asked").alias("asked"))
    shape = "places array<struct<run:int,start:int,end:int,left_at:int,left:string,right_at:int,right:string>>, parts array<struct<digest:struct<d1:bigint,d2:bigint>,side:int,end:int,part:string>>"
    read = checkpoint(python_stage(rows.join(asked, "row"), ["text", "runs", "asked"], shape, beside).select("row", "places", "parts"))
    parts = read.select("row", F.explode("parts").alias("p")).select(F.struct("row", "p.digest", "p.side").alias("theirs"), F.struct("p.end", "p.part").alias("other"))
    theirs = owners.join(parts, "theirs")
    at = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("p.left").alias("part")), F.struct(F.lit(1).alias("side"), F.col("p.right").alias("part"))))
    own = read.select("row", F.explode("places").alias("p")).select("row", "p.run", at.alias("s")).select("row", "run", "s.side", "s.part")
    both = lookup(asks.join(own, ["row", "run", "side"]), "theirs", theirs, max(1, 2 * runs.count()), "row")
    more = python_stage(both.select("row", "run", "side", F.col("other.end").alias("from_end"), "part", F.col("other.part").alias("other")), ["part", "other", "side"], "more int", lambda a, b, side: (common(a, b, side),))
    left = F.col("side") == 0
    by_run = more.groupBy("row", "run").agg(F.max(F.when(left, F.col("more"))).alias("left"), F.max(F.when(~left, F.col("more"))).alias("right"), F.max(F.when(left, F.col("from_end"))).alias("from_end"))
    places = read.select("row", F.explode("places").alias("p")).select("row", "p.run", "p.start", "p.end", "p.left_at", "p.right_at")
    out = runs.join(places, ["row", "run"]).join(by_run, ["row", "run"])
    start = F.least("start", F.col("left_at") - F.col("left"))
    # a repeat inside a text leaves its first place whole
    start = F.when(F.col("first.owner") == F.col("row"), F.least("start", F.greatest(start, "from_end"))).otherwise(start)
    return out.select("row", start.alias("start"), F.greatest("end", F.col("right_at") + F.col("right")).alias("end"), "owners")


def discard(df: DataFrame) -> None:
    """Delete the files of a checkpoint that nothing reads any more."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        remove(df.sparkSession, file.get())


def row_spans(rows: DataFrame, min_run: int) -> DataFrame:
    """(row, start, end, owners): stretches of rows (row, text) that an earlier place holds."""
    every = checkpoint(chunks(rows))
    copied = copies(every)
    runs = copied.withColumn("run", F.col("ix") - F.row_number().over(Window.partitionBy("row").orderBy("ix")))
    whole = Window.partitionBy("row", "run")
    runs = runs.withColumns({"low": F.min("ix").over(whole), "high": F.max("ix").over(whole)})
    first = F.min(F.when(F.col("ix") - F.col("low") < NEAR, F.struct("owner", "ix", "digest"))).alias("first")
    last = F.min(F.when(F.col("high") - F.col("ix") < NEAR, F.struct("owner", (-F.col("ix")).alias("ix"), "digest"))).alias("last")
    runs = checkpoint(runs.groupBy("row", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"), first, last, F.array_sort(F.collect_set("owner")).alias("owners")))
    discard(every)
    # extended runs may meet
    by_start = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    joined = grown(runs, rows).withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        joined.groupBy("row", "span")
        .agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("owners")))).alias("owners"))
        .filter(F.col("end") - F.col("start") >= min_run)
        .select("row", "start", "end", "owners")
    )


def repeated_spans(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, start, end, first_doc_ids): stretches of docs (doc_id, text) that an earlier place holds; places in
    code points, end exclusive, length at least min_run of them; first_doc_ids are the distinct documents that keep them."""
    keyed, plain = row_keys(docs.select("doc_id", "text"))
    spans = row_spans(keyed.select(F.col("__row").alias("row"), "__whole.text"), min_run)
    if plain:
        return spans.select(F.col("row").alias("doc_id"), "start", "end", F.col("owners").alias("first_doc_ids"))
    ids = keyed.select(F.col("__row").alias("row"), F.col("__whole.doc_id").cast("long").alias("doc_id"))
    spans = checkpoint(spans)
    named = spans.select("row", "start", "end", F.explode("owners").alias("owner")).join(ids.select(F.col("row").alias("owner"), F.struct("doc_id").alias("first")), "owner")
    named = named.groupBy("row", "start", "end").agg(F.array_sort(F.collect_set("first")).alias("first"))
    return named.join(ids, "row").select("doc_id", "start", "end", F.transform("first", lambda x: x["doc_id"]).alias("first_doc_ids"))


def without(text: str | None, spans: list | None) -> str | None:
    """text without its spans (start, end)."""
    if not spans:
        return text
    out, at = [], 0
    for s in sorted(spans, key=lambda s: s["start"]):
        out.append(text[at : s["start"]])
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """docs with each row's text less what an earlier place holds. A null text stays null, a text that is a copy as a whole
    becomes empty; of rows that agree in doc_id and text the first as numbered keeps it. Columns stay, whatever their names."""
    keyed, _ = row_keys(docs)
    rows = keyed.select(F.col("__row").alias("row"), F.col("__whole.text").alias("text"), "__whole")
    spans = row_spans(rows.select("row", "text"), min_run).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    cut = python_stage(rows.join(spans, "row", "left"), ["text", "spans"], "text string", lambda t, s: (without(t, s),))
    return cut.select(*[F.col("text") if c == "text" else F.col(f"__whole.`{c}`").alias(c) for c in docs.columns])


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per removed stretch: the document that loses it and those that keep it."""
    return repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("n_chars", F.col("end") - F.col("start"))
