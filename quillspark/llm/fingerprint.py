"""Document fingerprints by winnowing, in SQL functions alone.

A text's tokens are hashed in k-grams that roll along the text: a k-gram's hash is a polynomial in its tokens' own
hashes, modulo a prime, and windows of w tokens give those of 2 w and w + 1 in one step for the whole text. Of each
window of consecutive k-grams the least hash is kept, of ties the rightmost, with its place; fewer k-grams than a
window are one window. Any run of window + k - 1 tokens that two texts share thus gives them a common hash, and none
shorter than k tokens does, but for chance. A text of fewer than k tokens has one k-gram of all its tokens, one of no
tokens a k-gram of its trimmed characters; so equal texts, and they, always have equal fingerprints. Null text is the
empty text.

Likeness is 2 |A and B| / (|A| + |B|) over the distinct hashes of two fingerprints, 1 for two empty ones.

next_document() hands each document its successor by descending doc_id without gathering the table: the
documents are cut at quantiles of their row numbers, one shuffle deals them to those stretches, and the document at
each cut, of which there are at most MAX_STRETCHES, is handed to the stretch before as well. Rows that
share a doc_id follow each other by a hash of their text; rows of null doc_id come before all others, so after the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quillspark.llm.common import row_keys, table
from quillspark.llm.tokens import let, span, tokens

#: Tokens are words in pieces of at most PIECE characters, so that short texts have k-grams and edits inside a word stay local.
PIECE = 3
K = 5
WINDOW = 8
#: The rolling hash is a polynomial in BASE modulo a prime, so that no product exceeds 62 bits.
PRIME, BASE = (1 << 31) - 1, 1_000_003
#: Documents in a stretch, and the most stretches; their bounds are all the driver holds. A stretch is sorted and read in order, so beyond that it may spill.
STRETCH, MAX_STRETCHES = 128, 1 << 16
#: Low bits of an entry that hold its place, from the right; the bits above hold the hash. No array is longer.
PLACE_BITS = 31
LAST = (1 << PLACE_BITS) - 1


def _rolled(h: Column, k: int) -> Column:
    """The polynomial hash of each k consecutive values of h."""

    def wider(g: Column, w: int, bits: str) -> Column:
        if not bits:
            return g
        twice = F.transform(span(F.size(g) - w), lambda i: (F.get(g, i) * F.lit(pow(BASE, w, PRIME)) + F.get(g, i + w)) % PRIME)
        if bits[0] == "0":
            return let(twice, lambda x: wider(x, 2 * w, bits[1:]))
        more = lambda x: F.transform(span(F.size(x) - 1), lambda i: (F.get(x, i) * F.lit(BASE) + F.get(h, i + 2 * w)) % PRIME)
        return let(twice, lambda x: let(more(x), lambda y: wider(y, 2 * w + 1, bits[1:])))

    return wider(h, 1, f"{k:b}"[1:])


def kgram_hashes(text: Column, k: int = K) -> Column:
    """Hashes of the k-grams of a text's tokens, from 0 to PRIME - 1."""
    small = lambda c: F.pmod(c, F.lit(PRIME))

    def grams(h: Column) -> Column:
        short = F.array(small(F.xxhash64(F.concat_ws(" ", F.transform(h, lambda x: x.cast("string"))))))
        bare = F.trim(F.coalesce(text, F.lit("")))
        return F.when(F.size(h) >= k, _rolled(h, k)).when(F.size(h) > 0, short).when(F.length(bare) > 0, F.array(small(F.xxhash64(bare)))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(tokens(text, PIECE), lambda t: small(F.xxhash64(t))), grams)


def winnow(hashes: Column, window: int = WINDOW) -> Column:
    """The distinct minima of all windows of hashes (below 2^31) as entries: hash bits above, place from the right below,
    so that the least entry of a window is that of its least hash and, of ties, of the rightmost. window is a power of two."""
    entries = F.transform(hashes, lambda h, i: F.shiftleft(h, PLACE_BITS).bitwiseOR((F.lit(LAST) - i).cast("long")))
    return let(entries, lambda e: _minima(e, window))


def _minima(entries: Column, window: int) -> Column:
    """The distinct least entries of all windows; fewer entries than a window are one window."""

    def halved(e: Column, width: int) -> Column:
        if width == window:
            return F.array_distinct(e)
        halves = let(e, lambda m: F.transform(span(F.size(m) - width), lambda i: F.least(F.get(m, i), F.get(m, i + width))))
        return halved(halves, 2 * width)

    return F.when(F.size(entries) >= window, halved(entries, 1)).when(F.size(entries) > 0, F.array(F.array_min(entries))).otherwise(entries)


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    return winnow(kgram_hashes(text, k), window)


def hashes_of(print_: Column) -> Column:
    """The distinct hashes of a fingerprint's entries."""
    return F.array_distinct(F.transform(print_, lambda e: F.shiftright(e, PLACE_BITS)))


def written(print_: Column) -> Column:
    """hash@place of each entry, by place: eight hexadecimal digits and the number of the k-gram."""
    one = lambda e: F.concat(F.lpad(F.lower(F.hex(F.shiftright(e, PLACE_BITS))), 8, "0"), F.lit("@"), (F.lit(LAST) - e.bitwiseAND(F.lit(LAST).cast("long"))).cast("string"))
    return F.array_join(F.transform(print_, one), ",")


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of distinct hashes, from 0 (none shared) to 1 (equal, or both empty); null if either is."""
    both, total = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.when(total > 0, 2.0 * both / total).otherwise(1.0))


def next_document(rows: DataFrame, carried: list[str]) -> DataFrame:
    """rows (__row, unique, and more) with __next, the structure of the carried columns of the next row by descending __row; the last row's is the first row.

    Rows with __guest = 1 are there for the sake of the row before; __at is the stretch.
    """
    spark = rows.sparkSession
    stretches = max(1, min(MAX_STRETCHES, rows.count() // STRETCH))
    shares = [i / stretches for i in range(1, stretches + 1)]
    got = rows.agg(F.percentile_approx("__row", shares, 10 * stretches + 1000).alias("bounds")).first()[0]
    bounds = sorted(set(got or [])) or [0]
    # the last bound is the largest number; a stretch holds the numbers up to its bound
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    array = F.from_json(F.lit(str(list(map(int, bounds)))), "array<bigint>")
    own = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.try_element_at(array, at + s) < F.col("__row")), at + s).otherwise(at))
    # the first of stretch i, its bound, also ends stretch i + 1, and the first of all ends the lowest stretch
    ends = [(int(b), (i + 1) % len(bounds)) for i, b in enumerate(bounds)]
    extra = spark.createDataFrame(ends, "__bound bigint, __to int")
    led = rows.join(F.broadcast(extra), F.col("__row") == F.col("__bound"), "left").withColumn("__own", own)
    at = lambda c, guest: F.struct(F.col(c).alias("at"), F.lit(guest).alias("guest"))
    places = F.when(F.col("__to").isNull(), F.array(at("__own", 0))).otherwise(F.array(at("__own", 0), at("__to", 1)))
    dealt = led.withColumn("__place", F.explode(places)).withColumns({"__at": F.col("__place.at"), "__guest": F.col("__place.guest")})
    order = Window.partitionBy("__at").orderBy("__guest", F.desc("__row"))
    return dealt.withColumn("__next", F.lead(F.struct(*carried)).over(order)).drop("__bound", "__to", "__own", "__place")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed, _ = row_keys(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    led = next_document(keyed.select("__row", "__whole.*"), ["text"])
    n = F.length("text")
    change = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - change), F.substring(F.col("__next.text"), F.lit(1), change))
    prints = led.select("__row", "doc_id", "__at", "__guest", n.cast("long").alias("n_chars"), edited.alias("edited"), fingerprint(F.col("text")).alias("own"))
    prints = prints.withColumns({"hashes": hashes_of(F.col("own")), "other": F.when(F.col("__guest") == 0, fingerprint(F.col("edited")))})
    # the same stretches in the same order: no further shuffle
    order = Window.partitionBy("__at").orderBy("__guest", F.desc("__row"))
    both = prints.withColumn("next_hashes", F.lead("hashes").over(order)).filter("__guest = 0")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("own")).alias("fingerprint"),
        written(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), hashes_of(F.col("other"))).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
