"""Text, routing and run-state queries, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions import jsonx, text
from quillspark.operators import models, state
from quillspark.plans.util import columns
from quillspark.sources.files import IMAGE_SUFFIXES, MODES, SOURCE_SUFFIXES, is_image


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TAX = "concat('20-', lpad(CAST(c_custkey AS VARCHAR), 8, '0'), '-', CAST(c_custkey % 10 AS VARCHAR))"
TEXTS = f"""c_custkey AS doc_id, concat('  ', c_name, chr(9)) AS padded, concat(CASE WHEN c_custkey % 2 = 0 THEN {TAX} ELSE 'Ing. ' END, ' Ing, Brutos') AS tax,
       concat('ROSARI0 ', CAST(c_custkey AS VARCHAR), ' C0RD0BA 100, ', CASE c_custkey % 6 WHEN 0 THEN 'CC0007 rosari0' WHEN 1 THEN 'MC01-A0 N0' WHEN 2 THEN '20-0100 $ 1.200' WHEN 3 THEN 'C000 A00B0C' WHEN 4 THEN '0RO 0rO x0' ELSE 'ÑAND0 É0Í0Ó' END) AS place,
       concat(lpad(CAST(c_custkey % 100 AS VARCHAR), 5, '0'), CASE WHEN c_custkey % 3 = 0 THEN ' - ' ELSE '-' END, lpad(CAST(c_custkey AS VARCHAR), 8, '0')) AS number,
       CASE c_custkey % 4 WHEN 0 THEN concat(lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0'), '/0', CAST(c_custkey % 9 + 1 AS VARCHAR), '/2024') WHEN 1 THEN concat('2024-0', CAST(c_custkey % 9 + 1 AS VARCHAR), '-15') WHEN 2 THEN concat('20240', CAST(c_custkey % 9 + 1 AS VARCHAR), '07') ELSE '31/02/2024' END AS day,
       CASE c_custkey % 11 WHEN 0 THEN concat('$ 1.', lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0'), ',5') WHEN 1 THEN concat('U$S ', CAST(c_custkey AS VARCHAR), '.25') WHEN 2 THEN concat('1,', lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0'), '.75 EUR')
         WHEN 3 THEN concat('$ 1.', lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0')) WHEN 4 THEN concat('1.234.', lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0')) WHEN 5 THEN '12,345,678' WHEN 6 THEN concat('0.', lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0'))
         WHEN 7 THEN '-1.234,50' WHEN 8 THEN '1234,5' WHEN 9 THEN 'US$ 1234.567' ELSE 'sin monto' END AS money,
       concat('Alicuota ', CAST(c_custkey % 30 AS VARCHAR), '% (', c_mktsegment, ')') AS label,
       CASE c_custkey % 7 WHEN 0 THEN 'FACTURA  B 0001' WHEN 1 THEN 'COMPROBANTE C' WHEN 2 THEN 'NOTA DE CREDITO A' WHEN 3 THEN 'Nota de débito' WHEN 4 THEN 'NC 12' WHEN 5 THEN 'Nota de crédito, FACTURA E' ELSE 'N. DEBITO / ANC' END AS header,
       concat({TAX}, ' y ', {TAX}, '1 ', {TAX}) AS ids"""


def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").selectExpr(*columns(TEXTS))
    point, number = text.invoice_number("number")
    return rows.select(
        "doc_id",
        text.strip("padded").alias("name"),
        text.ellipsis(F.repeat("label", 4)).alias("short"),
        text.tax_id("tax").alias("tax_id"),
        text.full_tax_id(text.tax_id("tax")).alias("tax_id_full"),
        text.repair_zero("place").alias("place"),
        point.alias("point_of_sale"),
        number.alias("number"),
        text.compact_date("day").alias("compact_day"),
        F.date_format(text.iso_date("day"), "yyyy-MM-dd").alias("iso_day"),
        text.amount("money").alias("amount"),
        text.currency("money").alias("currency"),
        text.snake_key("label").alias("key"),
        text.header_letter("header").alias("letter"),
        text.document_kind("header").alias("kind"),
        text.count_tax_ids("ids").cast("long").alias("n_tax_ids"),
    )


def product_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each order as one text."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    item = F.struct(
        "l_linenumber", "l_partkey", F.concat("p_brand", F.lit("|x")).alias("desc"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_quantity").cast("int")).alias("qty"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price")
    )
    per = lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return per.select("doc_id", text.product_list("items").alias("products"))


REPLIES = r"""CASE event_id % 8 WHEN 0 THEN concat('Sure: ', props, ' Done.') WHEN 1 THEN concat('x', chr(10), '{"a": "b" v"', chr(10), '}') WHEN 2 THEN concat(props, ' and ', props) WHEN 3 THEN 'none'
       WHEN 4 THEN concat('{"a": "x{', CAST(event_id AS VARCHAR), '}y"}') WHEN 5 THEN '[1, {"a": 2}, 3]' WHEN 6 THEN '{"a": "open' ELSE props END"""


def json_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects recovered from replies with text around them, a stray token, two objects, an array, a broken one or none."""
    raw = read(spark, sf_dir, "events").selectExpr("event_id", REPLIES.replace("VARCHAR", "STRING").replace("chr(10)", "char(10)") + " AS raw")
    # the last brace bounds the object, so a second object makes the block invalid
    got = raw.select("event_id", jsonx.recover("raw").alias("got"))
    return got.select("event_id", F.get_json_object("got.value", "$.k").cast("int").alias("k"), F.get_json_object("got.value", "$.a").alias("a"), F.col("got.value").isNotNull().alias("ok"), F.col("got.error").alias("error"))


TEMPLATE = "Proveedor {{proveedor}}, monto {{monto}}: {{documento}} {{otro}}"


def template_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in a template. Sequential filling: a document that holds a later key's place is itself filled. Single-pass filling leaves it."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" {{monto}}")).alias("documento"), F.col("source").alias("proveedor"), F.col("n_chars").cast("string").alias("monto"))
    values = {k: F.col(k) for k in ("documento", "proveedor", "monto")}
    return docs.select("doc_id", text.fill(TEMPLATE, values).alias("filled"), text.fill_once(TEMPLATE, values).alias("filled_once"))


def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = models.history_before(read(spark, sf_dir, "conversations"))
    said = F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n")
    return got.select("conv_id", "turn", F.size("history").cast("long").alias("n_before"), said.alias("history"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("page_id") % 9 == 0, ".Jpg").when(F.col("page_id") % 4 == 0, ".pdf").when(F.col("page_id") % 4 == 1, ".PNG").when(F.col("page_id") % 4 == 2, ".md").otherwise("")
    return read(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", r"^[a-z]+://|[?#].*$", ""), kind).alias("path"))


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct source files in path order, component by component; suffixes in one case only."""
    from pyspark.sql import Window

    allowed = [f".{c}" for s in SOURCE_SUFFIXES for c in (s, s.upper())]
    files = paths(spark, sf_dir).select("path").distinct().filter(text.suffix("path").isin(allowed))
    # positions count within a folder's top level: one window for all files would be one task
    top = F.element_at(F.split("path", "/"), 1)
    order = Window.partitionBy(top).orderBy(F.split("path", "/"))
    return files.select("path", text.suffix("path").alias("suffix"), text.stem("path").alias("stem"), F.row_number().over(order).alias("position"), is_image("path").alias("is_image"))


def sidecar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths(spark, sf_dir).select("path").distinct()
    return p.select("path", text.with_suffix("path", ".md").alias("markdown"), *[text.with_suffix("path", f"_{k}.json").alias(k) for k in ("classification", "extraction", "pipeline")], text.with_suffix("path", ".raw.md").alias("raw_markdown"))


def modality_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with both vision prompts go to the vision path with no text; everything else goes by its text."""
    p = paths(spark, sf_dir).withColumns({"is_image": is_image("path"), "system_vlm": F.when(F.col("page_id") % 2 == 0, "look"), "user_vlm": F.when(F.col("page_id") % 3 > 0, "see {{documento}}")})
    vision = F.col("is_image") & F.col("system_vlm").isNotNull() & F.col("user_vlm").isNotNull()
    user = text.fill(F.when(vision, F.col("user_vlm")).otherwise("read {{documento}}"), {"documento": F.when(vision, "").otherwise(F.col("path"))})
    return p.select("page_id", F.when(vision, "vision").otherwise("text").alias("route"), F.concat(F.lit("base\n\n"), F.when(vision, F.col("system_vlm")).otherwise("llm")).alias("system"), user.alias("user"), F.when(vision, 8192).alias("context"))


def mode_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by mode with the prompt they mean; unknown modes have none."""
    wanted = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.element_at(F.array(*[F.lit(m) for m, _ in MODES], F.lit("xx")), (F.col("c_custkey") % 10 + 1).cast("int")).alias("mode"))
    known = F.broadcast(spark.createDataFrame(list(MODES), "mode string, prompt_id string"))
    return wanted.join(known, "mode", "left").select("doc_id", "mode", "prompt_id")


REQUEST = """o_orderkey AS doc_id, CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE 20000000000 + o_custkey END AS cuit_emisor, CASE o_orderkey % 6 WHEN 0 THEN 'a' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN '51' WHEN 4 THEN 'Z' ELSE 'A' END AS tipo,
    CASE WHEN o_orderkey % 4 = 0 THEN 'sin numero' ELSE concat(lpad(CAST(o_custkey % 100 AS VARCHAR), 5, '0'), '-', lpad(CAST(o_orderkey AS VARCHAR), 8, '0')) END AS nro, CASE WHEN o_orderkey % 8 = 0 THEN CAST(7 AS INTEGER) END AS pto_given, CASE WHEN o_orderkey % 8 = 0 THEN CAST(o_orderkey AS INTEGER) END AS nro_given,
    CASE WHEN o_orderkey % 2 = 0 THEN '05/03/2024' WHEN o_orderkey % 7 = 0 THEN '2024-03-05' ELSE '20240305' END AS fecha, CASE WHEN o_orderkey % 17 = 0 THEN 0.0 ELSE o_totalprice END AS importe, CASE WHEN o_orderkey % 19 <> 0 THEN '71234567890123' END AS cae"""


def tax_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voucher checks as requests: required fields (zero counts as missing), type by letter or number, numbers given or parsed, compact date."""
    return tax_requests(read(spark, sf_dir, "orders").selectExpr(*columns(REQUEST))).select("doc_id", "error", *[F.col(f"request.{c}").alias(c) for c in ("CuitEmisor", "PtoVta", "CbteTipo", "CbteNro", "CbteFch", "ImpTotal", "CodAutorizacion")])


def tax_requests(rows: DataFrame) -> DataFrame:
    given = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    missing = ~(given("cuit_emisor") & (F.col("cuit_emisor") != 0) & given("fecha") & given("importe") & (F.col("importe") != 0) & given("tipo") & given("cae"))
    # Numbers of the voucher types A, B and C.
    kind = F.coalesce(F.create_map(*[F.lit(x) for p in (("A", 1), ("B", 6), ("C", 11)) for x in p])[F.upper("tipo")], F.col("tipo").try_cast("int"))
    point, number = text.invoice_number("nro")
    both = F.col("pto_given").isNotNull() & F.col("nro_given").isNotNull()
    day = text.compact_date("fecha").try_cast("int")
    rows = rows.withColumns({"kind": kind, "point": F.when(both, F.col("pto_given").cast("bigint")).otherwise(point), "number": F.when(both, F.col("nro_given").cast("bigint")).otherwise(number), "day": day})
    error = F.when(missing, "faltan datos").when(F.col("kind").isNull(), "tipo invalido").when(F.col("point").isNull() | F.col("number").isNull(), "numero invalido").when(F.col("day").isNull(), "fecha invalida")
    request = F.struct(F.col("cuit_emisor").alias("CuitEmisor"), F.col("point").alias("PtoVta"), F.col("kind").alias("CbteTipo"), F.col("number").alias("CbteNro"), F.col("day").alias("CbteFch"), F.col("importe").alias("ImpTotal"), F.col("cae").alias("CodAutorizacion"))
    return rows.withColumn("error", error).withColumn("request", F.when(F.col("error").isNull(), request))


STEPS = ("10_extraccion_generica", "11_extraccion_factura")


def _steps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in STEPS], "step string")


def step_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.fan_out(read(spark, sf_dir, "documents").select("doc_id", "lang"), _steps(spark))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of two runs for labelled documents: quality 1 succeeds at once, the rest on the second run if not toxic."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.explode(F.array(F.lit(1), F.lit(2))).alias("run"))
    rows = state.fan_out(labels, _steps(spark))
    ok = ((F.col("quality") == 1) & (F.col("run") == 1)) | ((F.col("toxic") == 0) & (F.col("run") == 2) & (F.col("step") == STEPS[0]))
    return rows.select("doc_id", F.lit("extraction").alias("family"), "step", F.when(ok, F.concat(F.lit("r"), F.col("run").cast("string"))).alias("response"), F.when(~ok, F.concat(F.lit("e"), F.col("run").cast("string"))).alias("error"), F.col("run").cast("long").alias("run_id"))


def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.pending(step_fanout(spark, sf_dir), results(spark, sf_dir)).select("doc_id", "step")


def current_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.current(results(spark, sf_dir))


def step_prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = read(spark, sf_dir, "documents").select("doc_id")
    return state.gated(wanted, results(spark, sf_dir), STEPS[1])


def error_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = state.error_maps(results(spark, sf_dir))
    entries = F.array_sort(F.map_entries("errors"))
    return got.select("doc_id", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("errors"))


def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "skipped").otherwise("success")
    return state.status_summary(read(spark, sf_dir, "events").withColumn("status", status), ["user_id"])


def result_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object per document, steps in order, with errors only where there are some."""
    said = F.concat(F.lit('say "'), F.coalesce("response", "error"), F.lit('" \\ ñ\n'))
    rows = state.current(results(spark, sf_dir)).withColumns({"response": F.when(F.col("response").isNotNull(), said), "error": F.when(F.col("error").isNotNull(), said)})
    return state.export_objects(rows).select("doc_id", "json")


def map_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved state over defaults, key by key."""
    c = read(spark, sf_dir, "customer")
    default = F.create_map(F.lit("moneda"), F.lit("ARS"), F.lit("segmento"), F.col("c_mktsegment"))
    saved = F.when(F.col("c_custkey") % 3 > 0, F.create_map(F.lit("moneda"), F.lit("USD"), F.lit("nota"), F.col("c_custkey").cast("string")))
    entries = F.array_sort(F.map_entries(state.overlay(saved, default)))
    return c.select(F.col("c_custkey").alias("doc_id"), F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("state"), state.input_hash("c_name", "c_mktsegment").alias("input_hash"))


QUERIES = {f.__name__: f for f in (text_normalise, product_lists, json_recovery, template_fill, chat_history, file_listing, sidecar_names, modality_routing, mode_prompts, tax_request, step_fanout, resume_antijoin, current_results, step_prerequisites, error_maps, status_summary, result_export, map_overlay)}

_PATHS = """WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') ||
    CASE WHEN page_id % 9 = 0 THEN '.Jpg' WHEN page_id % 4 = 0 THEN '.pdf' WHEN page_id % 4 = 1 THEN '.PNG' WHEN page_id % 4 = 2 THEN '.md' ELSE '' END AS path FROM pages),
  s AS (SELECT *, regexp_extract(path, '[^/](\\.[^./]+)$', 1) AS suffix FROM p)
"""
_IMAGE = f"lower(suffix) IN {IMAGE_SUFFIXES}"
_ALLOWED = ", ".join(f"'.{c}'" for s in SOURCE_SUFFIXES for c in (s, s.upper()))
_RESULTS = f"""WITH r AS (
  SELECT doc_id, step, run, (quality = 1 AND run = 1) OR (toxic = 0 AND run = 2 AND step = '{STEPS[0]}') AS ok
  FROM labels, (VALUES (1), (2)) AS x(run), (VALUES ('{STEPS[0]}'), ('{STEPS[1]}')) AS y(step)
), c AS (
  SELECT doc_id, 'extraction' AS family, step, CASE WHEN bool_or(ok) THEN 'r' || min(run) FILTER (WHERE ok) END AS response, CASE WHEN NOT bool_or(ok) THEN 'e' || max(run) END AS error FROM r GROUP BY doc_id, step
)
"""

ORACLE_SQL = {
    "text_normalise": f"""WITH t AS (SELECT {TEXTS} FROM customer), n AS (
        SELECT *, repeat(label, 4) AS long, nullif(regexp_extract(tax, '^[0-9-]+'), '') AS tid, string_split(day, '/') AS d, regexp_replace(money, '[^0-9.,-]', '', 'g') AS bare, regexp_extract_all(place, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') AS words,
          upper(translate(header, 'áéíóúÁÉÍÓÚ', 'aeiouAEIOU')) AS head FROM t
      ), m AS (
        SELECT *, regexp_extract(bare, '([.,])[^.,]*$', 1) AS mark, length(bare) - length(replace(bare, '.', '')) AS points, length(bare) - length(replace(bare, ',', '')) AS commas, regexp_replace(bare, '[.,]', '', 'g') AS digits, regexp_extract(bare, '([^.,]*)$', 1) AS tail FROM n
      )
      SELECT doc_id, trim(padded, ' ' || chr(9)) AS name, CASE WHEN length(long) > 80 THEN substr(long, 1, 80) || '...' ELSE long END AS short, tid AS tax_id, coalesce(regexp_full_match(tid, '[0-9]{{2}}-[0-9]{{8}}-[0-9]'), false) AS tax_id_full,
        array_to_string(list_transform(words, lambda w: CASE WHEN regexp_full_match(w, '[\\p{{L}}0]+') AND length(replace(w, '0', '')) >= 3 THEN replace(w, '0', CASE WHEN w = upper(w) THEN 'O' ELSE 'o' END) ELSE w END), '') AS place,
        CAST(trim(split_part(number, '-', 1)) AS BIGINT) AS point_of_sale, CAST(trim(split_part(number, '-', 2)) AS BIGINT) AS number,
        CASE WHEN contains(day, '/') THEN d[3] || d[2] || d[1] ELSE day END AS compact_day,
        strftime(coalesce(try_strptime(day, '%d/%m/%Y'), try_strptime(day, '%Y-%m-%d'), try_strptime(day, '%Y%m%d')), '%Y-%m-%d') AS iso_day,
        TRY_CAST(CASE WHEN mark = '' OR (mark = ',' AND commas > 1) OR (mark = '.' AND points > 1) OR (points + commas = 1 AND regexp_full_match(bare, '-?[1-9][0-9]{{0,2}}[.,][0-9]{{3}}')) THEN digits
                 ELSE substr(digits, 1, length(digits) - length(tail)) || '.' || tail END AS DECIMAL(18,2)) AS amount,
        CASE WHEN regexp_matches(upper(money), 'U\\$S|US\\$|USD') THEN 'USD' WHEN regexp_matches(upper(money), '€|EUR') THEN 'EUR' ELSE 'ARS' END AS currency, trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_') AS key,
        coalesce(nullif(regexp_extract(header, 'FACTURA\\s+([A-CME])', 1), ''), nullif(regexp_extract(header, 'COMPROBANTE\\s+([A-CME])', 1), '')) AS letter,
        CASE WHEN regexp_matches(head, 'NOTA DE CREDITO|N\\. CREDITO|\\bNC\\b') THEN 'Nota de Crédito' WHEN regexp_matches(head, 'NOTA DE DEBITO|N\\. DEBITO|\\bND\\b') THEN 'Nota de Débito' ELSE 'Factura' END AS kind,
        CAST(len(regexp_extract_all(ids, '\\b[0-9]{{2}}-[0-9]{{8}}-[0-9]\\b')) AS BIGINT) AS n_tax_ids FROM m""",
    "product_lists": """SELECT l_orderkey AS doc_id, string_agg(replace(p_brand || '|x', '|', '/') || CASE WHEN l_linenumber % 3 > 0 THEN ' x' || CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR) ELSE '' END || ' - ' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), '|'
        ORDER BY l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 > 0 THEN trunc(l_quantity) END NULLS FIRST, CAST(l_extendedprice AS DECIMAL(18,2))) AS products FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
    "json_recovery": f"""WITH r AS (SELECT event_id, {REPLIES} AS raw FROM events), b AS (SELECT *, nullif(regexp_extract(raw, '(?s)\\{{.*\\}}'), '') AS block FROM r),
      f AS (SELECT *, regexp_replace(block, '"\\s*v"(\\s*\\n\\s*\\}})', '"\\1', 'g') AS fixed FROM b), o AS (SELECT *, CASE WHEN json_valid(fixed) THEN CAST(fixed AS JSON) END AS j FROM f)
      SELECT event_id, CAST(json_extract_string(j, '$.k') AS INTEGER) AS k, json_extract_string(j, '$.a') AS a, j IS NOT NULL AS ok,
        CASE WHEN block IS NULL THEN 'no JSON object in reply: ' || raw WHEN j IS NULL THEN 'invalid JSON object in reply' END AS error FROM o""",
    "template_fill": f"""WITH d AS (SELECT doc_id, coalesce(text, '') || ' {{{{monto}}}}' AS document, source, CAST(n_chars AS VARCHAR) AS n FROM documents)
      SELECT doc_id, replace(replace(replace('{TEMPLATE}', '{{{{documento}}}}', document), '{{{{proveedor}}}}', source), '{{{{monto}}}}', n) AS filled, 'Proveedor ' || source || ', monto ' || n || ': ' || document || ' {{{{otro}}}}' AS filled_once FROM d""",
    "chat_history": """SELECT conv_id, turn, count(*) OVER w AS n_before, coalesce(string_agg(role || ': ' || text, chr(10)) OVER w, '') AS history FROM conversations
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "file_listing": _PATHS + f""", f AS (SELECT DISTINCT path, suffix FROM s WHERE suffix IN ({_ALLOWED}))
      SELECT path, suffix, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]+$', '') AS stem, CAST(row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY string_split(path, '/')) AS INTEGER) AS position, {_IMAGE} AS is_image FROM f""",
    "sidecar_names": _PATHS + ", b AS (SELECT DISTINCT path, substr(path, 1, length(path) - length(suffix)) AS base FROM s) SELECT path, base || '.md' AS markdown, base || '_classification.json' AS classification, base || '_extraction.json' AS extraction, base || '_pipeline.json' AS pipeline, base || '.raw.md' AS raw_markdown FROM b",
    "modality_routing": _PATHS + f""", v AS (SELECT *, {_IMAGE} AND page_id % 2 = 0 AND page_id % 3 > 0 AS vision FROM s)
      SELECT page_id, CASE WHEN vision THEN 'vision' ELSE 'text' END AS route, 'base' || chr(10) || chr(10) || CASE WHEN vision THEN 'look' ELSE 'llm' END AS system, CASE WHEN vision THEN 'see ' ELSE 'read ' || path END AS "user", CASE WHEN vision THEN 8192 END AS context FROM v""",
    "mode_prompts": "WITH m(mode, prompt_id) AS (VALUES " + ", ".join(f"('{m}', '{p}')" for m, p in MODES) + "), w AS (SELECT c_custkey AS doc_id, [" + ", ".join(f"'{m}'" for m, _ in MODES) + ", 'xx'][c_custkey % 10 + 1] AS mode FROM customer) SELECT doc_id, mode, prompt_id FROM w LEFT JOIN m USING (mode)",
    "tax_request": f"""WITH r AS (SELECT {REQUEST} FROM orders), k AS (SELECT *, CASE upper(tipo) WHEN 'A' THEN 1 WHEN 'B' THEN 6 WHEN 'C' THEN 11 ELSE TRY_CAST(tipo AS INTEGER) END AS kind,
        CASE WHEN pto_given IS NOT NULL THEN CAST(pto_given AS BIGINT) ELSE TRY_CAST(split_part(nro, '-', 1) AS BIGINT) END AS point, CASE WHEN nro_given IS NOT NULL THEN CAST(nro_given AS BIGINT) ELSE TRY_CAST(nullif(split_part(nro, '-', 2), '') AS BIGINT) END AS number,
        CASE fecha WHEN '05/03/2024' THEN 20240305 WHEN '20240305' THEN 20240305 END AS day FROM r),
      e AS (SELECT *, CASE WHEN cuit_emisor = 0 OR importe = 0 OR cae IS NULL THEN 'faltan datos' WHEN kind IS NULL THEN 'tipo invalido' WHEN point IS NULL OR number IS NULL THEN 'numero invalido' WHEN day IS NULL THEN 'fecha invalida' END AS error FROM k)
      SELECT doc_id, error, CASE WHEN error IS NULL THEN cuit_emisor END AS "CuitEmisor", CASE WHEN error IS NULL THEN point END AS "PtoVta", CASE WHEN error IS NULL THEN kind END AS "CbteTipo", CASE WHEN error IS NULL THEN number END AS "CbteNro",
        CASE WHEN error IS NULL THEN day END AS "CbteFch", CASE WHEN error IS NULL THEN importe END AS "ImpTotal", CASE WHEN error IS NULL THEN cae END AS "CodAutorizacion" FROM e""",
    "map_overlay": """SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 > 0 THEN 'moneda=USD;nota=' || c_custkey || ';segmento=' || c_mktsegment ELSE 'moneda=ARS;segmento=' || c_mktsegment END AS state,
        sha256(c_name || chr(31) || c_mktsegment) AS input_hash FROM customer""",
    "step_fanout": f"SELECT doc_id, lang, step FROM documents, (VALUES ('{STEPS[0]}'), ('{STEPS[1]}')) AS y(step)",
    "resume_antijoin": _RESULTS + f"SELECT d.doc_id, y.step FROM documents d, (VALUES ('{STEPS[0]}'), ('{STEPS[1]}')) AS y(step) WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = d.doc_id AND r.step = y.step AND ok)",
    "current_results": _RESULTS + "SELECT doc_id, family, step, response, error FROM c",
    "step_prerequisites": _RESULTS + f"SELECT doc_id, response AS prior_response FROM c JOIN documents USING (doc_id) WHERE step = '{STEPS[1]}' AND error IS NULL",
    "error_maps": _RESULTS + "SELECT doc_id, string_agg(step || '=' || error, ';' ORDER BY step) FILTER (WHERE error IS NOT NULL) AS errors FROM c GROUP BY doc_id",
    "status_summary": """SELECT user_id, count(*) FILTER (WHERE event_type NOT IN ('error', 'view')) AS success, count(*) FILTER (WHERE event_type = 'view') AS skipped, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) AS total FROM events GROUP BY user_id""",
    "result_export": _RESULTS + """, s AS (SELECT doc_id, step, error IS NULL AS good, CAST(to_json(step) AS VARCHAR) || ':' || CAST(to_json('say "' || coalesce(response, error) || '" \\ ñ' || chr(10)) AS VARCHAR) AS entry FROM c)
      SELECT doc_id, '{"archivo":"' || doc_id || '.md","extracciones":{' || coalesce(string_agg(entry, ',' ORDER BY step) FILTER (WHERE good), '') || '}' || coalesce(',"errores":{' || string_agg(entry, ',' ORDER BY step) FILTER (WHERE NOT good) || '}', '') || '}' AS json
      FROM s GROUP BY doc_id""",
}
