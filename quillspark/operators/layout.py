"""Reading order of positioned text: orientation vote, line clustering and assembly, per document.

boxes: doc_id, item_ix, label, text, l, t, r, b (the last four null without a place). Ties are always
settled by item_ix, so results don't depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from quillspark.functions.geometry import HORIZONTAL, VERTICAL, effective_orientation, measures, orientation
from quillspark.functions.text import ellipsis, strip

#: Greatest distance of a box from its line's mean, of a row's boxes from the one before, and where columns split.
LINE_DISTANCE = 25.0
ROW_GAP = 30.0
COLUMN_SHARE = 0.55


def vote(rows: DataFrame, shape: Column) -> DataFrame:
    """(doc_id, n_horizontal, n_vertical, orientation): the majority of shapes; ties and no votes are horizontal."""
    counts = rows.groupBy("doc_id").agg(F.count_if(shape == HORIZONTAL).alias("n_horizontal"), F.count_if(shape == VERTICAL).alias("n_vertical"))
    return counts.withColumn("orientation", F.when(F.col("n_horizontal") >= F.col("n_vertical"), HORIZONTAL).otherwise(VERTICAL))


def dominant_orientation(boxes: DataFrame) -> DataFrame:
    """One vote per item, by its first place; tables vote by their own shape."""
    return vote(boxes, orientation())


def provenance_vote(boxes: DataFrame) -> DataFrame:
    """One vote per place, of items with an array prov of places."""
    places = boxes.select("doc_id", F.explode_outer("prov").alias("p"))
    return vote(places, orientation("p.l", "p.t", "p.r", "p.b"))


def marked_boxes(boxes: DataFrame, choice: str = "auto") -> DataFrame:
    """Boxes with measures, their effective orientation and selected, that of their document."""
    if choice not in ("auto", HORIZONTAL, VERTICAL):
        raise ValueError(f"orientation must be auto, horizontal or vertical, not {choice!r}")
    marked = boxes.withColumns(measures()).withColumns({"text": strip(chosen_text(boxes)), "effective": effective_orientation(), "shape": orientation()})
    if choice == "auto":
        # the vote is a window over the partitioning that clustering needs anyway: one shuffle in all
        per_doc = Window.partitionBy("doc_id")
        h, v = (F.count_if(F.col("shape") == s).over(per_doc) for s in (HORIZONTAL, VERTICAL))
        return marked.withColumn("selected", F.when(h >= v, HORIZONTAL).otherwise(VERTICAL))
    return marked.withColumn("selected", F.lit(choice))


def chosen_text(boxes: DataFrame) -> Column:
    """A table's own Markdown where boxes have that column and the item has it, else the item's text."""
    if "markdown" not in boxes.columns:
        return F.col("text")
    return F.when((F.col("label") == "table") & F.col("markdown").isNotNull(), F.col("markdown")).otherwise(F.col("text"))


def _shown(marked: DataFrame) -> DataFrame:
    return marked.filter((F.col("effective") == F.col("selected")) & (F.length("text") > 0)).drop("effective", "shape")


def selected_boxes(boxes: DataFrame, choice: str = "auto") -> DataFrame:
    """Boxes with text, in their document's chosen orientation, with measures and column selected."""
    return _shown(marked_boxes(boxes, choice))


def number_lines(doc: np.ndarray, at: np.ndarray, state: tuple) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(lines, ranks, state) of boxes sorted by document and place; state (doc, sum, n, line, rank) carries over from batch to batch."""
    lines, ranks = np.empty(len(at), np.int32), np.empty(len(at), np.int32)
    last, total, n, line, rank = state
    for i, (d, x) in enumerate(zip(doc.tolist(), at.tolist(), strict=True)):
        if d != last:
            last, total, n, line, rank = d, 0.0, 0, 0, -1
        if n == 0 or abs(x - total / n) > LINE_DISTANCE:
            total, n, line = 0.0, 0, line + 1
        total, n, rank = total + x, n + 1, rank + 1
        lines[i], ranks[i] = line, rank
    return lines, ranks, (last, total, n, line, rank)


def cluster_lines(selected: DataFrame) -> DataFrame:
    """(doc_id, selected, line_no, rank, item_ix, text, left, center_y) of selected boxes.

    Boxes go down the page (vertical text: from left to right); one opens a line when it is over
    LINE_DISTANCE from the running mean of the last line. Sorted input makes the last line the nearest. Documents
    are dealt and sorted by Spark, which may spill; numbering them keeps nothing but the last line's mean.
    """
    at = F.when(F.col("selected") == HORIZONTAL, -F.col("center_y")).otherwise(F.col("center_x"))
    cols = ["doc_id", "selected", "item_ix", "text", "left", "center_y"]
    dealt = selected.select(*cols, at.alias("at")).repartition("doc_id").sortWithinPartitions("doc_id", "at", "item_ix", "text", "left", "center_y")
    schema = T.StructType([*dealt.select(*cols).schema.fields, T.StructField("line_no", T.IntegerType()), T.StructField("rank", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: tuple = (object(), 0.0, 0, 0, -1)
        for b in batches:
            lines, ranks, state = number_lines(b.column(0).to_numpy(zero_copy_only=False), b.column(6).to_numpy(zero_copy_only=False), state)
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(lines), pa.array(ranks)], names=schema.names)

    return dealt.mapInArrow(run, schema).select("doc_id", "selected", "line_no", "rank", "item_ix", "text", "left", "center_y")


def fallback(selected: Column | str) -> Column:
    # Fixed value: the line that stands for a document without text in the chosen orientation.
    return F.concat(F.lit("No se encontraron textos en orientación "), F.col(selected) if isinstance(selected, str) else selected, F.lit("."))


def assemble(lines: DataFrame) -> DataFrame:
    """(doc_id, text): a line's boxes joined by " | ", lines by newlines; vertical lines are read downwards."""
    order = F.when(F.col("selected") == HORIZONTAL, F.col("left")).otherwise(-F.col("center_y"))
    rows = lines.groupBy("doc_id", "line_no").agg(F.array_sort(F.collect_list(F.struct(order.alias("at"), "rank", "text"))).alias("boxes"))
    told = rows.select("doc_id", "line_no", F.array_join(F.transform("boxes", lambda x: x["text"]), " | ").alias("line"))
    return told.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines")).select("doc_id", F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def reading_order(boxes: DataFrame, choice: str = "auto") -> DataFrame:
    """(doc_id, orientation, text) of every document of boxes."""
    marked = marked_boxes(boxes, choice)
    # the vote is that of the window: its rows are dealt by document already
    docs = marked.groupBy("doc_id").agg(F.first("selected").alias("orientation"))
    text = assemble(cluster_lines(_shown(marked)))
    return docs.join(text, "doc_id", "left").select("doc_id", "orientation", F.coalesce("text", F.concat(fallback("orientation"), F.lit("\n"))).alias("text"))


def flat_text(boxes: DataFrame) -> DataFrame:
    """(doc_id, orientation, text): items with text in the dominant orientation, in document order, a line each; tables have none of their own."""
    docs = dominant_orientation(boxes).select("doc_id", "orientation")
    shown = boxes.filter(F.col("text").isNotNull() & ~F.col("label").eqNullSafe("table")).withColumns({"shape": orientation(), "text": strip("text")}).filter(F.length("text") > 0)
    lines = shown.join(docs, "doc_id").filter("shape = orientation").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("item_ix", "text"))).alias("x"))
    text = lines.select("doc_id", F.array_join(F.transform("x", lambda v: v["text"]), "\n").alias("said"))
    return docs.join(text, "doc_id", "left").select("doc_id", "orientation", F.coalesce("said", fallback("orientation")).alias("text"))


def raw_text(boxes: DataFrame) -> DataFrame:
    """(doc_id, text): all text of a document in item order, a paragraph each; a table's Markdown where there is one."""
    said = boxes.select("doc_id", "item_ix", chosen_text(boxes).alias("text")).groupBy("doc_id")
    kept = F.filter(F.array_sort(F.collect_list(F.struct("item_ix", "text"))), lambda x: F.length(x["text"]) > 0)
    return said.agg(F.array_join(F.transform(kept, lambda x: x["text"]), "\n\n").alias("text"))


def report_lines(boxes: DataFrame) -> DataFrame:
    """boxes with label in upper case, text of 80 characters at most and coordinates of one decimal."""
    coords = [F.format_string("%.1f", F.round(c, 1)).alias(c) for c in ("l", "t", "r", "b")]
    return boxes.select("doc_id", "item_ix", F.upper("label").alias("label"), ellipsis("text").alias("text"), *coords)


def box_report(boxes: DataFrame) -> DataFrame:
    """(doc_id, text): the votes of a document's places and a line for each of its boxes that has one."""
    votes = dominant_orientation(boxes)
    line = F.concat_ws(" ", F.lit("-"), F.concat(F.lit("["), F.col("label"), F.lit("]")), "text", F.concat(F.lit("("), F.concat_ws(", ", "l", "t", "r", "b"), F.lit(")")))
    lines = report_lines(boxes.filter("l is not null")).select("doc_id", F.struct("item_ix", line.alias("line")).alias("x")).groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    head = F.concat(F.lit("horizontal "), F.col("n_horizontal").cast("string"), F.lit(", vertical "), F.col("n_vertical").cast("string"), F.lit(": "), F.col("orientation"))
    return votes.join(lines, "doc_id", "left").select("doc_id", F.concat_ws("\n", head, F.array_join(F.transform("x", lambda v: v["line"]), "\n")).alias("text"))


def gap_rows(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, item_ix, x, y, text) with row_no: a block stays in its row while it is within ROW_GAP of the one before."""
    down = Window.partitionBy("doc_id").orderBy("y", "x", "item_ix")
    opens = F.coalesce((F.abs(F.col("y") - F.lag("y").over(down)) > ROW_GAP).cast("int"), F.lit(0))
    return blocks.withColumn("opens", opens).withColumn("row_no", 1 + F.sum("opens").over(down.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def ticket_columns(rows: DataFrame) -> DataFrame:
    """(doc_id, row_no, left_text, right_text): blocks left of COLUMN_SHARE of the greatest x, and the others, each by x."""
    split = COLUMN_SHARE * F.max("x").over(Window.partitionBy("doc_id"))
    sided = rows.withColumn("is_left", F.col("x") < split)
    order = F.struct("x", "y", "item_ix", "text")
    both = sided.groupBy("doc_id", "row_no").agg(*[F.array_sort(F.collect_list(F.when(F.col("is_left") == is_left, order))).alias(n) for n, is_left in (("a", True), ("b", False))])
    return both.select("doc_id", "row_no", *[F.array_join(F.transform(c, lambda v: v["text"]), " ").alias(n) for c, n in (("a", "left_text"), ("b", "right_text"))])


def ticket_lines(columns: DataFrame) -> DataFrame:
    """(doc_id, row_no, line): the columns as printed, the left one padded to 60, a lone right one to 25."""
    l, r = F.col("left_text"), F.col("right_text")  # noqa: E741
    pad = lambda c, n: F.concat(c, F.repeat(F.lit(" "), F.greatest(F.lit(0), n - F.length(c))))
    line = F.when((l != "") & (r != ""), F.concat(pad(l, 60), F.lit(" "), r)).when(l != "", l).otherwise(F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), 25 - F.length(r))), r))
    return columns.filter((l != "") | (r != "")).select("doc_id", "row_no", line.alias("line"))
