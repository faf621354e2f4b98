"""Connected components by alternating large-star and small-star steps; labels are the smallest reachable node."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import checkpoint, hot_keys, totals


def lookup(rows: DataFrame, key: str, values: DataFrame, total: int, spread: str) -> DataFrame:
    """rows left-joined to values (key, n, ...) on key, where n counts the rows of each key among total rows.

    Keys that hold over HOT_SHARE of the rows are few by proof and go by broadcast; their rows are
    dealt by the column spread in the shuffled join of the rest, so that no key lands in one task.
    """
    names = [c for c in values.columns if c not in (key, "n")]
    hot = hot_keys(values, total).select(key, *[F.col(c).alias(f"__hot_{c}") for c in names], F.lit(True).alias("__hot"))
    # always 0, but no constant: the optimizer would take a constant out of the join's keys, and hot rows would meet again
    rest = values.select(F.col(key).alias("__key"), *names, F.pmod(F.xxhash64(key), F.lit(1)).cast("int").alias("__salt_of"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("__salt", F.when(F.col("__hot"), 1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int")).otherwise(0))
    out = dealt.join(rest, (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__salt_of")), "left")
    return out.select(*rows.columns, *[F.coalesce(F.col(f"__hot_{c}"), F.col(c)).alias(c) for c in names])


def _star(edges: DataFrame, large: bool, most: int) -> DataFrame:
    """One large-star or small-star step on edges (a > b), of which there are about most."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    joined = lookup(near, "u", least, most * (1 + large), "v")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges (a, b: bigint); component is the smallest node reachable.

    Nulls, loops and repeated edges are ignored. Each round is checkpointed, so a lost executor costs one round.
    """
    now = edges.dropna().filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = checkpoint(now), None
    for _ in range(max_rounds):
        state = totals(now, F.count("*"), F.bit_xor(F.xxhash64("a", "b")))
        if state[0] == 0 or state == before:
            break
        before = state
        now = checkpoint(_star(_star(now, True, state[0]), False, state[0]))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
