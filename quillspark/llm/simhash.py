"""SimHash near-duplicates by an inverted index on byte positions with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits agree in at least 5 of their 8 bytes, and so in
at least 4 of the first 7: each distinct fingerprint is posted under the 35 choices of 4 of those positions
together with the bytes there. Within a posting the positional bytes that a pair shares are tallied, pairs under
the guaranteed minimum of 5 go, and only the others are verified bit by bit. Copies cost nothing, since fingerprints are distinct.

Postings are counted before they are dealt. One of more than BLOCK fingerprints is posted again, finer: its
free bits are cut into 4 equal parts, of which 3 differing bits leave at least one alike (at first the 4 other
bytes, where the shared byte is the fifth of the tally). So it splits into ever smaller ones, with 4 times the rows
at a step, until 13 or 14 bits are free and at most 16384 fingerprints can share a posting. A posting yields a
spanning forest of its links, never all pairs.

Null text is the empty text. Texts of no words have fingerprint zero and link like any other. Each row is a
node by its own text, also where rows share a doc_id; rows without one link, but never name a component that
has a doc_id. An empty table gives an empty one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.common import checkpoint, count, python_stage, row_keys, table
from quillspark.llm.components import connected_components, lookup
from quillspark.llm.grouped import attached, links_of_groups
from quillspark.llm.similar import signatures, similar_links

MAX_BITS = 3
#: 8 bytes less one for each differing bit.
MIN_BYTES = 8 - MAX_BITS
#: Positions per posting; any pair with MIN_BYTES matches shares POSTED of the first 8 - MIN_BYTES + POSTED positions.
POSTED = 4
BLOCK = 2048
#: Free bits at which postings are no longer made finer.
LEAST_FREE = 14


def fingerprint(text: str | None, words: int = 3) -> int:
    """A bit is 1 if set in over half of the XXH64 (seed 42) hashes of the text's word shingles, repeats included."""
    import xxhash

    tokens = (text or "").encode("utf-8", "replace").lower().split()  # on bytes: A-Z and ASCII white space alone
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(tokens) < words:
        return digest(b" ".join(tokens), 42)
    ones, n = np.zeros(64, np.int64), len(tokens) - words + 1
    for at in range(0, n, 1 << 15):
        part = tokens[at : min(n, at + (1 << 15)) + words - 1]
        hashes = np.array([digest(s, 42) for s in map(b" ".join, zip(*[part[i:] for i in range(words)], strict=False))], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positional bytes that fingerprints share, given as rows of 8 bytes."""
    return (a == b).sum(axis=1)


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of fingerprints as rows of 8 bytes, which share MIN_BYTES bytes or more and, of those, differ in at most MAX_BITS bits."""
    ok = tally(a, b) >= MIN_BYTES
    at = np.nonzero(ok)[0]
    if len(at):
        other = b[at] if len(b) > 1 else b
        x = np.ascontiguousarray(a[at]).view(np.uint64)[:, 0] ^ np.ascontiguousarray(other).view(np.uint64)[:, 0]
        ok[at] = np.bitwise_count(x) <= MAX_BITS
    return ok


def position_masks() -> list[int]:
    """The bits of each choice of POSTED of the first MAX_BITS + POSTED byte positions."""
    return [signed(sum(255 << 8 * p for p in places)) for places in combinations(range(MAX_BITS + POSTED), POSTED)]


def finer(mask: int) -> list[int]:
    """mask with each of the 4 parts of its free bits: two fingerprints that agree in mask and differ in MAX_BITS bits agree in one of these."""
    free = [i for i in range(64) if not mask >> i & 1]
    at = [len(free) * k // (MAX_BITS + 1) for k in range(MAX_BITS + 2)]
    return [signed((mask | sum(1 << i for i in free[s:e])) % (1 << 64)) for s, e in zip(at, at[1:], strict=False)]


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp bigint) that connect all that lie within MAX_BITS bits."""
    spark, masks = prints.sparkSession, position_masks()
    rows, found = prints.select(F.explode(F.lit(masks)).alias("mask"), F.col("fp").alias("node")), None
    while True:
        rows = rows.withColumn("key", F.xxhash64("mask", F.col("node").bitwiseAND(F.col("mask"))))
        last = min(64 - (m % (1 << 64)).bit_count() for m in masks) <= LEAST_FREE
        large = checkpoint(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > (1 << 62 if last else block)).withColumn("over", F.lit(True)))
        marked = attached(rows, large)
        here = links_of_groups(marked.filter("over is null").select("key", "node", F.col("node").alias("data")), near, 8)
        found = here if found is None else found.union(here)
        if large.isEmpty():
            return found.distinct()
        steps = spark.createDataFrame([(m, f) for m in masks for f in finer(m)], "mask bigint, finer bigint")  # at most 35 x 4 x 4 x 4 of them
        rows = checkpoint(marked.filter("over").select("mask", "node").join(F.broadcast(steps), "mask").select(F.col("finer").alias("mask"), "node").distinct())
        masks = sorted({f for m in masks for f in finer(m)})


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = 3) -> DataFrame:
    """docs with fp (bigint): the SimHash of its word shingles."""
    return python_stage(docs, [text_col], "fp bigint", lambda t: (signed(fingerprint(t, words)),))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, similar: bool = False) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest id reachable over links.

    Links are those of fingerprints and, on request, those of documents whose five-word shingles are alike by 0.8 or more.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = fingerprints(named, "text", words)
    if similar:
        prints = signatures(prints)
    prints = checkpoint(prints.drop("text"))
    total = count(prints)
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    edges = links(distinct.select("fp"))
    if similar:
        edges = edges.union(similar_links(prints, named)).distinct()
    # representatives are integers of their own, so components are those of fingerprints and the least id is taken after
    label = connected_components(edges).withColumnsRenamed({"node": "fp", "component": "label"})
    labelled = distinct.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    joint = label.select("label").distinct()
    least = labelled.join(joint, "label", "left_semi").groupBy("label").agg(F.min("rep").alias("least"), F.count("*").alias("n"))
    grouped = lookup(labelled, "label", least, max(1, total), "fp").select("fp", "n", F.coalesce("least", "rep").alias("component_id"))
    return lookup(prints.select("doc_id", "fp"), "fp", grouped, total, "doc_id").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 3, similar: bool = True) -> DataFrame:
    """docs without the rows whose component has an earlier row, in the order of doc_id.

    Rows are told apart by numbers of their own: a row goes only if its own text is a near copy of an earlier one's,
    whatever its identifier. Rows without one come last, rows that share one stand by a hash of their text.
    """
    keyed, _ = row_keys(docs)
    found = near_duplicates(keyed.select("__row", F.col("__whole.text").alias("text")), id_col="__row", words=words, similar=similar)
    gone = found.filter("component_id < doc_id").select(F.col("doc_id").alias("__row"))
    return keyed.join(gone, "__row", "left_anti").select("__whole.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
