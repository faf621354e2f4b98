"""Multi-party perspective rotation of dialogues.

For each participant of a conversation, the dialogue is rendered with that speaker as assistant, the
others as named users and context roles (system) as they are; only the assistant's contents are trained
on. A conversation is dealt in parts of max_turns turn numbers, so that no dialogue, however long, meets in
one row: its parts, in order, are the whole, and each carries the conversation's first context message beside it. A part
of over 4 max_turns messages, as of rows without a turn, is dealt further in pieces of max_turns messages at most.

Messages stand by turn, then speaker, then text; a null turn comes first (as -1), a null role is the
speaker "unknown", a null text is empty. Repeated rows are repeated messages. A conversation of context
roles only has no participants and gives no rows. Rows without conv_id form a conversation of their own, which
an empty conv_id doesn't join. Names stay apart in tags: their delimiters are percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.llm.common import checkpoint, table
from quillspark.llm.components import lookup

MAX_TURNS = 256
CONTEXT = ("system",)
END = "<|end|>\n"


#: Characters of a name that a tag can't hold, with what stands for them; the first makes the rest reversible.
ENCODED = (("%", "%25"), ("|", "%7C"), ("<", "%3C"), (">", "%3E"), ("\r", "%0D"), ("\n", "%0A"))


def _clean(name: Column) -> Column:
    """A speaker's name inside a tag."""
    for plain, code in ENCODED:
        name = F.replace(name, F.lit(plain), F.lit(code))
    return name


def _pieces(said: DataFrame, max_turns: int) -> DataFrame:
    """said (key, part, turn, name, content) with piece: 0, but in parts of over 4 max_turns messages a number that rises with each max_turns of them or fewer."""
    large = checkpoint(said.groupBy("key", "part").agg(F.count("*").alias("n")).filter(F.col("n") > 4 * max_turns))
    if large.isEmpty():
        return said.withColumn("piece", F.lit(0).cast("long"))
    marked = said.withColumn("whole", F.struct("key", "part"))
    marked = lookup(marked, "whole", large.select(F.struct("key", "part").alias("whole"), "n", F.lit(True).alias("large")), max(1, said.count()), "content").drop("whole")
    order = ["key", "part", "turn", "name", "content", "salt"]
    # in order over all partitions, and written, so that a place never changes
    placed = marked.filter("large").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16)))
    n_parts = int(said.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpoint(placed.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    small = marked.filter("large is null").withColumn("piece", F.lit(0).cast("long"))
    # a partition's places are consecutive, and each has 2^33 of its own
    return small.drop("large").unionByName(placed.withColumn("piece", F.floor(F.col("place") / max_turns)).drop("large", "salt", "place"))


def rotate(conversations: DataFrame, max_turns: int = MAX_TURNS, context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """(conv_id, perspective, part, piece, context, messages, rendered, spans): messages are (turn, role, name, content, mask);
    spans are the code points of rendered, end exclusive, that count for the loss; context is the first message of a context role."""
    said = conversations.select(
        F.struct("conv_id").alias("key"),  # equal where conv_id is, nulls too
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("name"),
        F.coalesce("text", F.lit("")).alias("content"),
    ).withColumn("part", F.floor(F.col("turn") / max_turns))
    is_context = F.col("name").isin(*context)
    speakers = said.groupBy("key").agg(F.array_sort(F.collect_set(F.when(~is_context, F.col("name")))).alias("speakers"), F.min(F.when(is_context, F.struct("turn", "name", "content"))).alias("first"), F.count("*").alias("n"))
    parts = _pieces(said, max_turns).groupBy("key", "part", "piece").agg(F.array_sort(F.collect_list(F.struct("turn", "name", "content"))).alias("said"))
    every = lookup(parts, "key", speakers, max(1, said.count()), "part").withColumns({"perspective": F.explode("speakers"), "conv_id": F.col("key.conv_id"), "context": F.col("first.content")})
    me = F.col("perspective")
    role = lambda m: F.when(m["name"].isin(*context), m["name"]).when(m["name"] == me, F.lit("assistant")).otherwise(F.lit("user"))
    messages = F.transform("said", lambda m: F.struct(m["turn"].alias("turn"), role(m).alias("role"), m["name"].alias("name"), m["content"].alias("content"), ((m["name"] == me) & ~m["name"].isin(*context)).cast("int").alias("mask")))
    head = lambda m: F.when(m["role"] == "user", F.concat(F.lit("<|user name="), _clean(m["name"]), F.lit("|>\n"))).otherwise(F.concat(F.lit("<|"), m["role"], F.lit("|>\n")))
    every = every.select("conv_id", "perspective", "part", "piece", "context", messages.alias("messages")).withColumn("heads", F.transform("messages", head))
    pieces = F.zip_with("heads", "messages", lambda h, m: F.concat(h, m["content"], F.lit(END)))
    sizes = F.zip_with("heads", "messages", lambda h, m: F.struct(F.length(h).alias("h"), F.length(m["content"]).alias("c"), m["mask"].alias("mask")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    step = lambda acc, x: F.struct(
        (acc["at"] + x["h"] + x["c"] + len(END)).alias("at"),
        F.when(x["mask"] == 1, F.concat(acc["out"], F.array(F.struct((acc["at"] + x["h"]).alias("start"), (acc["at"] + x["h"] + x["c"]).alias("end"))))).otherwise(acc["out"]).alias("out"),
    )
    return every.select("conv_id", "perspective", "part", "piece", "context", "messages", F.array_join(pieces, "").alias("rendered"), F.aggregate(sizes, begin, step, lambda acc: acc["out"]).alias("spans"))


def op2_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rotate(table(spark, sf_dir, "conversations"))
    return got.select(
        "conv_id",
        "perspective",
        "part",
        "piece",
        "context",
        F.size("messages").cast("long").alias("n_messages"),
        F.array_join(F.transform("messages", lambda m: m["mask"].cast("string")), "").alias("mask"),
        "rendered",
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"),
    )


def _sql_clean(name: str) -> str:
    for plain, code in ENCODED:
        name = f"replace({name}, chr({ord(plain)}), '{code}')"
    return name


ORACLE = f"""
WITH m AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS name, coalesce(text, '') AS content,
         CAST(floor(coalesce(turn, -1) / {MAX_TURNS}.0) AS BIGINT) AS part
  FROM conversations
), p AS (
  SELECT DISTINCT conv_id, name AS perspective FROM m WHERE name <> 'system'
), first AS (
  SELECT DISTINCT ON (conv_id) conv_id, content AS context FROM m WHERE name = 'system' ORDER BY conv_id, turn, content
), r AS (
  SELECT m.conv_id, p.perspective, m.part, m.turn, m.name, m.content, CASE WHEN m.name = p.perspective THEN 1 ELSE 0 END AS mask,
         CASE WHEN m.name = 'system' THEN '<|system|>' || chr(10) WHEN m.name = p.perspective THEN '<|assistant|>' || chr(10)
              ELSE '<|user name=' || {_sql_clean("m.name")} || '|>' || chr(10) END AS head
  FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, length(head) AS h, length(content) AS c, row_number() OVER w AS ix,
         coalesce(sum(length(head) + length(content) + {len(END)}) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn, name, content ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM r WINDOW w AS (PARTITION BY conv_id, perspective, part ORDER BY turn, name, content)
)
SELECT o.conv_id, perspective, part, CAST(0 AS BIGINT) AS piece, any_value(context) AS context, count(*) AS n_messages, string_agg(CAST(mask AS VARCHAR), '' ORDER BY ix) AS mask,
       string_agg(head || content || '<|end|>' || chr(10), '' ORDER BY ix) AS rendered,
       coalesce(string_agg(CAST(CAST(pos + h AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(pos + h + c AS BIGINT) AS VARCHAR), ',' ORDER BY ix) FILTER (WHERE mask = 1), '') AS spans
FROM o LEFT JOIN first ON o.conv_id IS NOT DISTINCT FROM first.conv_id GROUP BY o.conv_id, perspective, part
"""
