"""Layout queries over boxes that are derived from events, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions import geometry
from quillspark.operators import layout
from quillspark.plans.util import columns

BOXES = """
SELECT user_id AS doc_id, event_id AS item_ix, value AS l,
       value + 5 + (event_id * 37) % (CASE WHEN user_id % 5 = 0 THEN 30 ELSE 120 END) AS r,
       CAST((event_id * 53) % 800 + 100 AS DOUBLE) AS t,
       CAST((event_id * 53) % 800 + 100 - (event_id * 29) % 90 AS DOUBLE) AS b,
       CASE event_type WHEN 'purchase' THEN 'table' WHEN 'error' THEN 'picture' ELSE 'text' END AS label,
       concat(event_type, ':', CAST(event_id AS VARCHAR)) AS text
FROM events
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr(*columns(BOXES.split("SELECT", 1)[1].rsplit("FROM", 1)[0]))


_SHAPE = "CASE WHEN abs(r - l) >= abs(t - b) THEN 'horizontal' ELSE 'vertical' END"
_WITH = f"""WITH RECURSIVE boxes AS ({BOXES}),
docs AS (
  SELECT doc_id, count(*) FILTER (WHERE {_SHAPE} = 'horizontal') AS n_horizontal, count(*) FILTER (WHERE {_SHAPE} = 'vertical') AS n_vertical
  FROM boxes GROUP BY doc_id
), votes AS (SELECT *, CASE WHEN n_horizontal >= n_vertical THEN 'horizontal' ELSE 'vertical' END AS orientation FROM docs),
picked AS (
  SELECT b.doc_id, v.orientation AS selected, item_ix, trim(text) AS text, least(l, r) AS "left", (l + r) / 2 AS center_x, (t + b) / 2 AS center_y
  FROM boxes b JOIN votes v USING (doc_id)
  WHERE (CASE WHEN label = 'table' THEN 'horizontal' ELSE {_SHAPE} END) = v.orientation AND length(trim(text)) > 0
), ordered AS (
  SELECT *, CASE WHEN selected = 'horizontal' THEN -center_y ELSE center_x END AS pos,
         row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN selected = 'horizontal' THEN -center_y ELSE center_x END, item_ix) - 1 AS rank
  FROM picked
), fold AS (
  SELECT doc_id, rank, pos AS total, 1 AS n, 1 AS line_no FROM ordered WHERE rank = 0
  UNION ALL
  SELECT o.doc_id, o.rank, CASE WHEN abs(o.pos - f.total / f.n) > 25.0 THEN o.pos ELSE f.total + o.pos END,
         CASE WHEN abs(o.pos - f.total / f.n) > 25.0 THEN 1 ELSE f.n + 1 END, f.line_no + CASE WHEN abs(o.pos - f.total / f.n) > 25.0 THEN 1 ELSE 0 END
  FROM fold f JOIN ordered o ON o.doc_id = f.doc_id AND o.rank = f.rank + 1
), lines AS (SELECT o.*, f.line_no FROM ordered o JOIN fold f USING (doc_id, rank))
"""


def box_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = boxes(spark, sf_dir).withColumns({"orientation": geometry.orientation(), "effective": geometry.effective_orientation(), **geometry.measures()})
    return got.select("doc_id", "item_ix", "label", "orientation", "effective", "left", "center_x", "center_y")


def dominant_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.dominant_orientation(boxes(spark, sf_dir))


def provenance_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = lambda grow: F.struct("l", "t", (F.col("r") + grow).alias("r"), "b")
    items = boxes(spark, sf_dir).withColumn("prov", F.when(F.col("item_ix") % 7 == 0, F.array(place(0), place(40))).when(F.col("item_ix") % 11 != 0, F.array(place(0))))
    return layout.provenance_vote(items)


def line_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.cluster_lines(layout.selected_boxes(boxes(spark, sf_dir))).select("doc_id", "selected", "line_no", "rank", "item_ix")


def reading_order_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(boxes(spark, sf_dir))


def flat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.flat_text(boxes(spark, sf_dir))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw reader tuples: polygons of four points with text, as centres."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    raw = boxes(spark, sf_dir).withColumn("poly", F.array(corner("l", "t"), corner("r", "t"), corner("r", "b"), corner("l", "b")))
    x, y = geometry.polygon_centre("poly")
    return raw.select("doc_id", "item_ix", "text", x.alias("x"), y.alias("y"))


def polygon_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir)


_BLOCKS = f"""WITH boxes AS ({BOXES}), blocks AS (
  SELECT doc_id, item_ix, text, (((0.0 + l) + r) + r + l) / 4 AS x, (((0.0 + t) + t) + b + b) / 4 AS y FROM boxes
), gaps AS (
  SELECT *, CASE WHEN abs(y - lag(y) OVER (PARTITION BY doc_id ORDER BY y, x, item_ix)) > 30 THEN 1 ELSE 0 END AS opens FROM blocks
), rows_ AS (
  SELECT *, 1 + CAST(sum(opens) OVER (PARTITION BY doc_id ORDER BY y, x, item_ix ROWS UNBOUNDED PRECEDING) AS BIGINT) AS row_no, max(x) OVER (PARTITION BY doc_id) AS max_x FROM gaps
), cols AS (
  SELECT doc_id, row_no, coalesce(string_agg(text, ' ' ORDER BY x, y, item_ix) FILTER (WHERE x < 0.55 * max_x), '') AS left_text,
         coalesce(string_agg(text, ' ' ORDER BY x, y, item_ix) FILTER (WHERE NOT x < 0.55 * max_x), '') AS right_text
  FROM rows_ GROUP BY doc_id, row_no
)
"""


def gap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.gap_rows(blocks(spark, sf_dir)).select("doc_id", "item_ix", "row_no")


def ticket_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.ticket_columns(layout.gap_rows(blocks(spark, sf_dir)))


def ticket_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.ticket_lines(ticket_columns(spark, sf_dir))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of documents, numbered per document before those without a place go; the number keeps counting."""
    shown = boxes(spark, sf_dir).filter("label = 'picture'").withColumns({"img_w": F.lit(100), "img_h": F.lit(850), "placed": F.col("item_ix") % 13 != 0})
    per_doc = shown.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("item_ix", "l", "t", "r", "b", "img_w", "img_h", "placed"))).alias("pics"))
    return per_doc.select("doc_id", F.posexplode("pics").alias("pic_ix", "p")).select("doc_id", "pic_ix", "p.*").filter("placed")


_PICTURES = f"""WITH boxes AS ({BOXES}), pics AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY item_ix) - 1 AS INTEGER) AS pic_ix, 100 AS img_w, 850 AS img_h FROM boxes WHERE label = 'picture'
), placed AS (SELECT * FROM pics WHERE item_ix % 13 <> 0),
crops AS (
  SELECT doc_id, pic_ix, greatest(0, CAST(trunc(l) AS INTEGER)) AS crop_left, greatest(0, CAST(trunc(img_h - t) AS INTEGER)) AS crop_top,
         least(img_w, CAST(trunc(r) AS INTEGER)) AS crop_right, least(img_h, CAST(trunc(img_h - b) AS INTEGER)) AS crop_bottom FROM placed
)
"""


def picture_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pictures(spark, sf_dir).select("doc_id", "pic_ix", "item_ix")


def crop_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops of at least one pixel, with the names of their files."""
    crops = pictures(spark, sf_dir).withColumns(geometry.crop_rectangle("img_w", "img_h")).filter("crop_right > crop_left AND crop_bottom > crop_top")
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("_detected_"), F.col("pic_ix").cast("string"), F.lit(".png"))
    return crops.select("doc_id", "pic_ix", "crop_left", "crop_top", "crop_right", "crop_bottom", name.alias("file_name"))


def box_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line per box: label, text of at most 80 characters, coordinates with one decimal."""
    got = boxes(spark, sf_dir).withColumn("text", F.repeat("text", (F.col("item_ix") % 9 + 1).cast("int")))
    return layout.report_lines(got)


def top_class_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures: pictures whose best class is signature with confidence of at least 0.6, numbered per document."""
    vec = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    kind = F.when(F.col("label") % 2 == 0, "signature").otherwise("logo")
    first, second = F.round(F.abs(F.col("embedding")[0].cast("double")) * 4, 1), F.round(F.abs(F.col("embedding")[1].cast("double")), 1)
    classes = F.array(F.struct(kind.alias("class_name"), first.alias("confidence")), F.struct(F.lit("other").alias("class_name"), second.alias("confidence")))
    pics = vec.select((F.col("vec_id") % 50).alias("doc_id"), "vec_id", classes.alias("classes"))
    return accepted_signatures(pics)


def accepted_signatures(pics: DataFrame, least: float = 0.6) -> DataFrame:
    """pics (doc_id, vec_id, classes: best first) whose first class is signature; file names count accepted ones from 1."""
    from pyspark.sql import Window

    top = F.get("classes", F.lit(0))
    kept = pics.filter((top["class_name"] == "signature") & (top["confidence"] >= least)).withColumn("confidence", top["confidence"])
    kept = kept.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("vec_id")))
    return kept.select("doc_id", "vec_id", "confidence", "n", F.format_string("firma_%02d_conf%.2f.png", "n", "confidence").alias("file_name"))


QUERIES = {
    "box_orientation": box_orientation,
    "dominant_orientation": dominant_orientation,
    "provenance_vote": provenance_vote,
    "line_clusters": line_clusters,
    "reading_order_text": reading_order_text,
    "flat_text": flat_text,
    "polygon_centres": polygon_centres,
    "gap_rows": gap_rows,
    "ticket_columns": ticket_columns,
    "ticket_lines": ticket_lines,
    "picture_scan": picture_scan,
    "crop_rects": crop_rects,
    "box_report": box_report,
    "top_class_filter": top_class_filter,
}

ORACLE_SQL = {
    "box_orientation": f"""WITH boxes AS ({BOXES}) SELECT doc_id, item_ix, label, {_SHAPE} AS orientation, CASE WHEN label = 'table' THEN 'horizontal' ELSE {_SHAPE} END AS effective,
        least(l, r) AS "left", (l + r) / 2 AS center_x, (t + b) / 2 AS center_y FROM boxes""",
    "dominant_orientation": f"{_WITH} SELECT doc_id, n_horizontal, n_vertical, orientation FROM votes",
    "provenance_vote": f"""WITH boxes AS ({BOXES}), prov AS (
        SELECT doc_id, l, t, r, b FROM boxes WHERE item_ix % 7 = 0 OR item_ix % 11 <> 0 UNION ALL SELECT doc_id, l, t, r + 40, b FROM boxes WHERE item_ix % 7 = 0
      ), counted AS (SELECT doc_id, count(*) FILTER (WHERE {_SHAPE} = 'horizontal') AS h, count(*) FILTER (WHERE {_SHAPE} = 'vertical') AS v FROM prov GROUP BY doc_id)
      SELECT d.doc_id, coalesce(h, 0) AS n_horizontal, coalesce(v, 0) AS n_vertical, CASE WHEN coalesce(h, 0) >= coalesce(v, 0) THEN 'horizontal' ELSE 'vertical' END AS orientation
      FROM (SELECT DISTINCT doc_id FROM boxes) d LEFT JOIN counted USING (doc_id)""",
    "line_clusters": f"{_WITH} SELECT doc_id, selected, line_no, CAST(rank AS INTEGER) AS rank, item_ix FROM lines",
    "reading_order_text": f"""{_WITH}, told AS (
        SELECT doc_id, line_no, string_agg(text, ' | ' ORDER BY CASE WHEN selected = 'horizontal' THEN "left" ELSE -center_y END, rank) AS line FROM lines GROUP BY doc_id, line_no
      ), texts AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) || chr(10) AS text FROM told GROUP BY doc_id)
      SELECT doc_id, orientation, coalesce(text, 'No se encontraron textos en orientación ' || orientation || '.' || chr(10)) AS text FROM votes LEFT JOIN texts USING (doc_id)""",
    "flat_text": f"""{_WITH}, shown AS (SELECT b.doc_id, item_ix, trim(text) AS text FROM boxes b JOIN votes v USING (doc_id) WHERE label <> 'table' AND {_SHAPE} = orientation AND length(trim(text)) > 0),
      texts AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY item_ix) AS text FROM shown GROUP BY doc_id)
      SELECT doc_id, orientation, coalesce(text, 'No se encontraron textos en orientación ' || orientation || '.') AS text FROM votes LEFT JOIN texts USING (doc_id)""",
    "polygon_centres": f"{_BLOCKS} SELECT doc_id, item_ix, text, x, y FROM blocks",
    "gap_rows": f"{_BLOCKS} SELECT doc_id, item_ix, row_no FROM rows_",
    "ticket_columns": f"{_BLOCKS} SELECT doc_id, row_no, left_text, right_text FROM cols",
    "ticket_lines": f"""{_BLOCKS} SELECT doc_id, row_no, CASE WHEN left_text <> '' AND right_text <> '' THEN left_text || repeat(' ', greatest(0, 60 - length(left_text))) || ' ' || right_text
        WHEN left_text <> '' THEN left_text ELSE repeat(' ', greatest(0, 25 - length(right_text))) || right_text END AS line FROM cols WHERE left_text <> '' OR right_text <> ''""",
    "picture_scan": f"{_PICTURES} SELECT doc_id, pic_ix, item_ix FROM placed",
    "crop_rects": f"""{_PICTURES} SELECT doc_id, pic_ix, crop_left, crop_top, crop_right, crop_bottom, concat('doc', doc_id, '_detected_', pic_ix, '.png') AS file_name
        FROM crops WHERE crop_right > crop_left AND crop_bottom > crop_top""",
    "box_report": f"""WITH boxes AS ({BOXES}), long AS (SELECT * REPLACE (repeat(text, CAST(item_ix % 9 + 1 AS INTEGER)) AS text) FROM boxes)
      SELECT doc_id, item_ix, upper(label) AS label, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS text,
        printf('%.1f', round(l, 1)) AS l, printf('%.1f', round(t, 1)) AS t, printf('%.1f', round(r, 1)) AS r, printf('%.1f', round(b, 1)) AS b FROM long""",
    "top_class_filter": """WITH pics AS (
        SELECT vec_id % 50 AS doc_id, vec_id, CASE WHEN label % 2 = 0 THEN 'signature' ELSE 'logo' END AS class_name, round(abs(CAST(embedding[1] AS DOUBLE)) * 4, 1) AS confidence FROM embeddings
      ), kept AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY vec_id) AS INTEGER) AS n FROM pics WHERE class_name = 'signature' AND confidence >= 0.6)
      SELECT doc_id, vec_id, confidence, n, printf('firma_%02d_conf%.2f.png', n, confidence) AS file_name FROM kept""",
}
