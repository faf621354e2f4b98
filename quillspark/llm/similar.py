"""Similar documents by the Jaccard similarity of their five-word shingles, for what SimHash can't reach.

Fingerprints of 64 bits that differ in 3 mark documents alike by well over 0.95; at 0.8 they differ in
some ten bits, and no index of byte positions guarantees a match. So candidates are found by MinHash
bands (a pair at the threshold shares one of 24 with probability over 0.998) and pruned by the share of
equal values among 256 MinHash values of 8 bits, with five standard errors of slack. What these candidates
connect is brought together, each with its shingles, and links are verified by the shingles two sets share
exactly (as 64-bit hashes). Copies of one shingle set count once.

Words are separated by ASCII white space, A-Z in lower case; a text of fewer than five words is one shingle, and
of no words none, which is similar to nothing. Null texts are empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import checkpoint, count, python_stage
from quillspark.llm.components import connected_components, lookup
from quillspark.llm.grouped import attached, links_in_groups

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS, VALUES = 24, 6, 256
#: Five standard errors of the share, below the threshold: the estimate only prunes.
SLACK = 0.125
_RNG = np.random.default_rng(20240501)
_MUL = _RNG.integers(1, 1 << 63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, VALUES, np.uint64)


def shingle_hashes(text: str | None) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, in order."""
    import xxhash

    tokens = (text or "").encode("utf-8", "replace").lower().split()
    n = max(1, len(tokens) - WORDS + 1) if tokens else 0
    return np.unique(np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens[i : i + WORDS])) for i in range(n)], np.uint64))


def signature(text: str | None) -> tuple[int | None, list[int], bytes]:
    """(identifier of the shingle set, band hashes, MinHash values) of a text; no identifier without words."""
    import xxhash

    hashes = shingle_hashes(text)
    if not len(hashes):
        return None, [], b""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        mixed = hashes[at : at + 512, None] * _MUL + _ADD
        mixed ^= mixed >> np.uint64(29)  # the low bits of a product are weak
        least = np.minimum(least, (mixed * np.uint64(0x9E3779B97F4A7C15)).min(axis=0))
    bands = [xxhash.xxh3_64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    # least values begin with zeros, so eight bits of each must come from all of it
    kept = (((least ^ (least >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(56)).astype(np.uint8)
    return set_of(hashes), [as_long(b) for b in bands], kept.tobytes()


def as_long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def set_of(hashes: np.ndarray) -> int | None:
    """The identifier of a shingle set."""
    import xxhash

    return as_long(xxhash.xxh3_64_intdigest(hashes.tobytes())) if len(hashes) else None


def overlapping(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of shingle sets (byte strings of sorted hashes), whether their Jaccard similarity is SIMILARITY or more."""
    out = np.zeros(len(a), bool)
    for i, x in enumerate(a):
        y = b[i if len(b) > 1 else 0]
        if min(len(x), len(y)) >= SIMILARITY * max(len(x), len(y)) - 1e-6:
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out[i] = both >= SIMILARITY * (len(x) + len(y) - both) - 1e-9
    return out


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1) >= SIMILARITY - SLACK


def signatures(docs: DataFrame) -> DataFrame:
    """docs (text, ...) with set_id, bands and data."""
    return python_stage(docs, ["text"], "set_id bigint, bands array<bigint>, data binary", signature)


def similar_links(rows: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(a, b): links between the fp of rows (doc_id, fp, set_id, bands, data) that connect similar documents and those of equal shingle sets; docs (doc_id, text), rows by default, has their texts."""
    sets = checkpoint(rows.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.min("fp").alias("low"), F.count("*").alias("n")))
    # one row stands for each set: copies are never banded
    reps = rows.withColumnRenamed("doc_id", "rep").join(sets.select("set_id", "rep"), ["set_id", "rep"], "left_semi")
    # bands travel without their data: a key that two sets share is rare, and only its rows are given theirs
    banded = reps.select("set_id", F.explode("bands").alias("key"))
    met = checkpoint(banded.groupBy("key").agg(F.min("set_id").alias("least"), F.max("set_id").alias("most"), F.count("*").alias("n")).filter("least < most").select("key", "n", F.lit(True).alias("met")))
    members = attached(banded.withColumnRenamed("set_id", "node"), met).filter("met").select("key", "node")
    known = checkpoint(members.join(reps.select(F.col("set_id").alias("node"), "data"), "node").distinct())
    found = links_in_groups(known, near, VALUES, 1024)
    # each set comes once to what candidates connect, with its shingles: links there connect just what exact pairs do
    joint = connected_components(found).join(sets.select(F.col("set_id").alias("node"), F.col("rep").alias("doc_id")), "node")
    texts = (rows if docs is None else docs).select("doc_id", "text").join(joint, "doc_id")
    exact = python_stage(texts, ["text"], "own bigint, data binary", lambda t: (set_of(h := shingle_hashes(t)), h.tobytes())).filter("own = node")
    found = links_in_groups(checkpoint(exact.select(F.col("component").alias("key"), "node", "data")), overlapping, 0, 1024)
    low = lambda end, name: sets.select(F.col("set_id").alias(end), F.col("low").alias(name))
    alike = found.join(low("a", "x"), "a").join(low("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    first = sets.filter("n > 1").select("set_id", "n", "low")
    equal = lookup(rows.filter("set_id is not null").select("set_id", "fp", "doc_id"), "set_id", first, max(1, count(rows)), "doc_id").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    return alike.union(equal.filter("a <> b").distinct())
