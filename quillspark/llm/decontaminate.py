"""Benchmark decontamination by size-partitioned MinHash containment search, in SQL functions alone.

An item is a set of word shingles; a document contains it if it holds at least threshold of them. Items are
partitioned by the size of that set, in powers of two, and each partition sets how many of an item's least hashes
make its sketch and how many of those a document must hold: with the sketch 2 m + 1 long, where m shingles of the
largest item of the partition may be missing, m + 1 of them at least. Shorter items are sketched whole. So a
document that holds threshold of an item can't be missed, and one that merely shares a phrase seldom passes.

Documents, however long, are never sketched: the hash of each of their shingles probes the sketches, so a short
item is found in a long text. Only candidates, pairs that share enough of a sketch, have their shingles read as
text, and these verify a pair exactly.

Words are runs of letters and digits in lower case; an item of fewer words than a shingle is one shingle
of all its words, and one of no words is contained nowhere. Null texts are empty. In contained(), items or documents
that share an identifier count as one each and a null identifier matches nothing; decontaminate() checks each
row on its own, also those without one. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.llm.common import checkpoint, row_keys, table
from quillspark.llm.tokens import let, span, tokens

WORDS = 5
THRESHOLD = 0.8
#: Bytes of sketches, candidates or items that may be broadcast; beyond, they are joined by a shuffle.
MOST_BROADCAST = 16 << 20
#: Ways in which the rows of a probe key are dealt where sketches are joined by a shuffle; a key may hold a third of all rows.
SALTS = 32


def _windows(t: Column, words: int, make) -> Column:
    """make(words of each window) for the windows of t; an empty array where t is shorter."""
    return F.transform(span(F.size(t) - (words - 1)), lambda i: make([F.get(t, i + j) for j in range(words)]))


def shingles(text: Column, words: int = WORDS) -> Column:
    """The distinct word shingles of a text, words joined by spaces; of fewer words, one shingle of all."""
    joined = lambda w: F.concat_ws(" ", *w)
    cut = lambda t: F.when(F.size(t) >= words, F.array_distinct(_windows(t, words, joined))).when(F.size(t) > 0, F.array(F.array_join(t, " "))).otherwise(F.array().cast("array<string>"))
    return let(tokens(text), cut)


def probes(text: Column, lengths: list[int], hashed: bool) -> Column:
    """The distinct shingles of a text of each of those lengths in words, or only their hashes."""
    make = (lambda w: F.xxhash64(*w)) if hashed else (lambda w: F.concat_ws(" ", *w))
    return let(tokens(text), lambda t: F.array_distinct(F.concat(*[_windows(t, n, make) for n in lengths])))


def index(items: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, size, shingle, hash, sketched, least) of every shingle of items (item_id, text); least: the sketch hashes that a candidate must hold."""
    rows = items.filter("item_id is not null").select("item_id", F.explode(shingles(F.col("text"), words)).alias("shingle")).distinct()
    w = F.split("shingle", " ")  # a probe hashes the words of a window one after the other
    hashed = F.coalesce(*[F.when(F.size(w) == n, F.xxhash64(*[F.get(w, F.lit(j)) for j in range(n)])) for n in range(1, words + 1)])
    rows = rows.withColumn("hash", hashed)
    sets = rows.groupBy("item_id").agg(F.array_sort(F.collect_set("hash")).alias("hashes"), F.count("*").alias("size"))
    part = F.floor(F.log2(F.col("size") + 0.5))  # sizes from 2^part to 2^(part + 1) - 1
    missing = lambda size: F.floor(F.lit(1 - threshold + 1e-9) * size).cast("int")
    longest = F.least(F.size("hashes"), 2 * missing(F.pow(F.lit(2), part + 1) - 1) + 1)
    sketch = sets.select("item_id", "size", F.element_at("hashes", longest).alias("largest"), (longest - missing(F.col("size"))).alias("least"))
    return rows.join(sketch, "item_id").select("item_id", "size", "shingle", "hash", (F.col("hash") <= F.col("largest")).alias("sketched"), "least")


def _few(df: DataFrame, row_bytes: int) -> bool:
    return df.count() * row_bytes <= MOST_BROADCAST


def candidates(docs: DataFrame, known: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, item_id) of the documents that hold enough of an item's sketch."""
    sketch = known.filter("sketched").select("hash", "item_id", "least")
    probe = docs.select("doc_id", F.explode(probes(F.col("text"), lengths, True)).alias("hash"))
    if _few(sketch, 40):
        hits = probe.join(F.broadcast(sketch), "hash")
    else:
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        spread = sketch.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = probe.withColumn("salt", salt).join(spread.hint("shuffle_hash"), ["hash", "salt"])
    # rows that share a doc_id count as one document, so hashes are counted once each
    once = hits.select("doc_id", "item_id", "hash", "least").distinct()
    return once.groupBy("doc_id", "item_id").agg(F.count("*").alias("held"), F.max("least").alias("least")).filter("held >= least").select("doc_id", "item_id")


def contained(docs: DataFrame, items: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, matched, size, containment) of every pair at or above threshold."""
    docs, known = docs.filter("doc_id is not null").select("doc_id", "text"), checkpoint(index(items, words, threshold))
    short = [r[0] for r in known.select(F.size(F.split("shingle", " ")).alias("n")).filter(F.col("n") < words).distinct().collect()]  # fewer than words of them
    lengths = [*sorted(short), words]
    pairs = checkpoint(candidates(docs, known, lengths))
    ids = pairs.select("doc_id").distinct()
    texts = docs.join(F.broadcast(ids) if _few(ids, 16) else ids, "doc_id", "left_semi")
    said = texts.select("doc_id", F.explode(probes(F.col("text"), lengths, False)).alias("shingle"))
    # what a document says that no item does is dropped before any shuffle if the items are few
    all_shingles = known.select("shingle").distinct()
    if _few(all_shingles, 100):
        said = said.join(F.broadcast(all_shingles), "shingle", "left_semi")
    said = said.distinct()
    # each candidate pair looks up the item's shingles among the document's own, so shingles that many items share cost no more than their pairs
    shown = known.select("item_id", "shingle", "size")
    asked = pairs.join(F.broadcast(shown) if _few(shown, 120) else shown, "item_id")
    met = asked.join(said, ["doc_id", "shingle"]).groupBy("doc_id", "item_id", "size").agg(F.count("*").alias("matched"))
    return met.filter(F.col("matched") >= F.lit(threshold - 1e-9) * F.col("size")).select("doc_id", "item_id", "matched", "size", (F.col("matched") / F.col("size")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text contains an item."""
    keyed, _ = row_keys(docs)
    hit = contained(keyed.select(F.col("__row").alias("doc_id"), F.col("__whole.text").alias("text")), items, words, threshold)
    return keyed.join(hit.select(F.col("doc_id").alias("__row")).distinct(), "__row", "left_anti").select("__whole.*")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
_LEADS = lambda n: " || ' ' || ".join(["t", *[f"lead(t, {j}) OVER o" for j in range(1, n)]])
ORACLE = f"""
WITH dw AS (SELECT doc_id, row_id, unnest(w) AS t, generate_subscripts(w, 1) AS k FROM (SELECT doc_id, row_number() OVER () AS row_id, {_TOKENS} AS w FROM documents)),
b AS (SELECT item_id, row_number() OVER () AS row_id, {_TOKENS} AS w FROM benchmark), bw AS (SELECT item_id, row_id, unnest(w) AS t, generate_subscripts(w, 1) AS k FROM b),
i AS (
  SELECT DISTINCT item_id, s FROM (
    SELECT item_id, {_LEADS(WORDS)} AS s FROM bw WINDOW o AS (PARTITION BY row_id ORDER BY k)
    UNION ALL SELECT item_id, array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND {WORDS - 1}
  ) WHERE s IS NOT NULL
), n AS (SELECT item_id, count(*) AS size FROM i GROUP BY item_id),
y AS (
  SELECT DISTINCT doc_id, unnest([{", ".join(_LEADS(j) for j in range(1, WORDS + 1))}]) AS s FROM dw WINDOW o AS (PARTITION BY row_id ORDER BY k)
)
SELECT y.doc_id, i.item_id, count(*) AS matched, n.size, count(*) / CAST(n.size AS DOUBLE) AS containment
FROM y JOIN i USING (s) JOIN n USING (item_id) GROUP BY y.doc_id, i.item_id, n.size HAVING count(*) >= {THRESHOLD} * n.size - 1e-9
"""
