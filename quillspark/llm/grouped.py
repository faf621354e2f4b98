"""Links within groups of rows that share a key, as spanning forests, for groups of any size.

Groups are counted first, combined before the shuffle, so that no large one ever meets in one task. A group of up
to block nodes (and BYTES of data) is linked where it lies. Of a larger one every row is held against the group's
hub, its least node; rows near the hub are connected by that alone. What is left, the far rows, is dealt against all
rows of the group in pairs of blocks: each pair of nodes of which one is far meets in a task of at most two blocks,
so a group of copies costs one comparison a row. A group yields at most one link a node and task, never all its pairs.

Keys, nodes and data are never null. Rows that repeat a (key, node) count once, with the data of one of them, which
callers keep equal; of nodes equally near the order is that of their numbers. No rows give no links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import checkpoint, count, totals
from quillspark.llm.components import lookup

#: near(data, other): for rows of bytes (n, width), or n byte strings where width is 0, whether each is near the row of other, which has n rows or one.
Near = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Bytes of data in a group, or in a block of one, that a task may hold.
BYTES = 64 << 20
#: Bytes of keys (some 50 each) or hubs that may be broadcast; beyond, they are joined by a shuffle.
MOST_BROADCAST = 16 << 20
FLUSH = 50_000


def forest(nodes: np.ndarray, data: np.ndarray, near: Near) -> list[tuple[int, int]]:
    """Links that connect just what all near pairs connect; equal nodes count once."""
    nodes, first = np.unique(nodes, return_index=True)
    rest, out = data[first], []
    while len(nodes) > 1:
        stack = [(nodes[0], rest[:1])]
        nodes, rest = nodes[1:], rest[1:]
        while stack and len(nodes):
            top, row = stack.pop()
            hit = near(rest, row)
            if hit.any():
                out += [(int(top), int(f)) for f in nodes[hit]]
                stack += [(nodes[i], rest[i : i + 1]) for i in np.nonzero(hit)[0]]
                nodes, rest = nodes[~hit], rest[~hit]
    return out


def as_bytes(column: pa.Array, width: int) -> np.ndarray:
    """Values of one width as rows of bytes; of width 0 as they are."""
    if not width:
        out = np.empty(len(column), object)
        out[:] = column.to_pylist()
        return out
    if pa.types.is_int64(column.type):
        return np.ascontiguousarray(column.to_numpy()).view(np.uint8).reshape(-1, width)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _scan(batches: Iterator[pa.RecordBatch], n_keys: int, width: int, near: Near) -> Iterator[pa.RecordBatch]:
    """Of rows (keys, node, data) sorted by key: a row (a, b) for each link."""
    links: list[tuple[int, int]] = []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])
        links.clear()
        return out

    held_key: tuple | None = None
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def close() -> None:
        if sum(len(h[0]) for h in held) > 1:
            links.extend(forest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), near))
        held.clear()

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = [batch.column(i).to_numpy() for i in range(n_keys)]
        nodes, data = batch.column(n_keys).to_numpy(), as_bytes(batch.column(n_keys + 1), width)
        new = np.zeros(n, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        starts = np.concatenate([[0], np.nonzero(new)[0]])
        ends = np.append(starts[1:], n)
        edge = (starts == 0) | (ends == n)  # may go on in another batch
        at = starts[(ends - starts == 2) & ~edge]  # most groups are pairs: all at once
        if len(at):
            good = at[near(data[at], data[at + 1]) & (nodes[at] != nodes[at + 1])]
            links.extend(zip(nodes[good].tolist(), nodes[good + 1].tolist(), strict=True))
        for s, e in zip(*(x[edge | (ends - starts > 2)].tolist() for x in (starts, ends)), strict=True):
            key = tuple(int(k[s]) for k in keys)
            if key != held_key:
                close()
                held_key = key
            held.append((nodes[s:e], data[s:e]))
            if len(links) > FLUSH:
                yield flush()
    close()
    if links:
        yield flush()


def _near_hub(batches: Iterator[pa.RecordBatch], width: int, near: Near) -> Iterator[pa.RecordBatch]:
    """(key, node, data, n_all, size, hub, hub_data) with far, whether the row isn't near its hub, in place of hub_data."""
    for batch in batches:
        if batch.num_rows:
            close = near(as_bytes(batch.column(2), width), as_bytes(batch.column(6), width))
            far = ~close & (batch.column(1).to_numpy() != batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(far)], names=["key", "node", "data", "n_all", "size", "hub", "far"])


def attached(rows: DataFrame, values: DataFrame, value_bytes: int = 50) -> DataFrame:
    """rows (key, node, ...) left-joined to values (key, n, ...), where n counts the rows of a key: by broadcast where values are few, else by a skew-safe shuffle."""
    if count(values) * value_bytes <= MOST_BROADCAST:
        return rows.join(F.broadcast(values.drop("n")), "key", "left")
    return lookup(rows, "key", values, max(1, count(rows)), "node")


def links_of_groups(rows: DataFrame, near: Near, width: int) -> DataFrame:
    """(a, b): links within groups that are known to fit a task."""
    dealt = rows.select("key", "node", "data").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda it: _scan(it, 1, width, near), "a bigint, b bigint")


def links_in_groups(rows: DataFrame, near: Near, width: int, block: int = 2048) -> DataFrame:
    """(a, b): links between the nodes of rows (key bigint, node bigint, data: bigint or binary of width bytes, 0 for any).

    rows is read several times: give a table or a checkpoint where it is costly.
    """
    rows = rows.select("key", "node", "data")
    kind = dict(rows.dtypes)["data"]
    length = lambda c: F.lit(width).cast("long") if width else F.octet_length(c).cast("long")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(length("data")).alias("size"))
    large = checkpoint(sizes.filter((F.col("n") > 1) & ((F.col("n") > block) | (F.col("size") > BYTES))))
    marked = attached(rows, large.withColumn("n_all", F.col("n")))
    found = links_of_groups(marked.filter("n_all is null"), near, width)
    if large.isEmpty():
        return found.distinct()
    heavy = marked.filter("n_all is not null").select("key", "node", "data", "n_all", "size")
    hubs = checkpoint(heavy.groupBy("key").agg(F.min(F.struct("node", "data")).alias("h"), F.count("*").alias("n")).select("key", "n", F.col("h.node").alias("hub"), F.col("h.data").alias("hub_data")))
    largest = totals(hubs, F.max(length("hub_data")))[0]
    held = attached(heavy, hubs, 50 + largest).select("key", "node", "data", "n_all", "size", "hub", "hub_data")
    told = checkpoint(held.mapInArrow(lambda it: _near_hub(it, width, near), f"key bigint, node bigint, data {kind}, n_all bigint, size bigint, hub bigint, far boolean"))
    found = found.union(told.filter("not far and node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")))
    far = checkpoint(told.groupBy("key").agg(F.count("*").alias("n"), F.count_if("far").alias("n_far")).filter("n_far > 0"))
    if far.isEmpty():
        return found.distinct()
    # blocks of about block nodes and BYTES at most
    blocks = F.greatest(F.ceil(F.col("n_all") / block), F.ceil(F.col("size") / BYTES)).cast("long")
    rest = attached(told, far).filter("n_far is not null").withColumn("blocks", blocks)
    rest = rest.withColumns({"far_blocks": F.ceil(F.col("n_far") * F.col("blocks") / F.col("n_all")).cast("long"), "spread": F.xxhash64("node")})
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    as_row = rest.select("key", F.pmod("spread", "blocks").alias("i"), every("far_blocks").alias("j"), "node", "data")
    as_far = rest.filter("far").select("key", every("blocks").alias("i"), F.pmod(F.shiftright("spread", 20), F.col("far_blocks")).alias("j"), "node", "data")
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = as_row.union(as_far).repartition(n_parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return found.union(dealt.mapInArrow(lambda it: _scan(it, 3, width, near), "a bigint, b bigint")).distinct()
