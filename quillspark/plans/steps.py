"""Queries of model steps, conversion, sources and rule-based answers, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions import geometry, jsonx
from quillspark.operators import answers, catalogs, layout, models, rules
from quillspark.plans import documents, documents_text, pipelines
from quillspark.plans.util import columns
from quillspark.sources import converter, files

read = documents_text.read

EXPENSES = """c_custkey AS doc_id, CASE c_custkey % 17 WHEN 0 THEN 'Patentamiento 0 km' WHEN 1 THEN 'Reacondicionamiento de usados, taller' WHEN 2 THEN 'Rectificación de MOTOR' WHEN 3 THEN 'Repuestos y neumáticos' WHEN 4 THEN 'Servicio de grúa'
         WHEN 5 THEN 'Almuerzo y peajes' WHEN 6 THEN 'Semillas de soja' WHEN 7 THEN 'Chapa y pintura' WHEN 8 THEN 'Póliza de seguro' WHEN 9 THEN 'Publicidad en vía pública' WHEN 10 THEN 'Honorarios de escribanía' WHEN 11 THEN 'Resmas y librería'
         WHEN 12 THEN 'Comisión tarjetas' WHEN 13 THEN 'Varios' WHEN 14 THEN 'Service del tractor, repuestos, motor' WHEN 15 THEN 'Tasa municipal y sellado' END AS descripcion,
       CASE c_custkey % 5 WHEN 0 THEN 'Taller Norte' WHEN 1 THEN 'AgroSur SA' WHEN 2 THEN 'Estación de servicio Ñandú' WHEN 3 THEN 'Telefónica' END AS proveedor, CASE c_custkey % 3 WHEN 0 THEN 'CC0007' WHEN 1 THEN 'CC0006' END AS centro_costo"""


def _options(spark: SparkSession, sf_dir: str, made, names: tuple[str, ...]) -> DataFrame:
    rows = read(spark, sf_dir, "customer").selectExpr(*columns(EXPENSES))
    got = rows.select("doc_id", F.posexplode(made()).alias("at", "o"))
    return got.select("doc_id", (F.col("at") + 1).alias("rank"), *[F.col(f"o.{c}").alias(c) for c in names])


def center_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _options(spark, sf_dir, rules.center_options, ("codigo_centro_costo", "centro", "confianza", "senal_usada"))


def macro_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _options(spark, sf_dir, rules.macro_options, ("macro_categoria", "nombre", "confianza", "criterio_inferido", "justificacion"))


GENERIC = """c_custkey AS doc_id, CASE c_custkey % 6 WHEN 0 THEN concat('{"tipo_documento": "ticket", "resumen": "x", "proveedor": "', CAST(c_custkey AS VARCHAR), '", "monto": 12.5}') WHEN 1 THEN '{"tipo_documento": {"a": 1}, "monto": "$ 3", "fecha_emision": "05/03/2024"}'
    WHEN 2 THEN '{"resumen": [1], "proveedor": null, "cuit_emisor": "20-1x", "monto_neto": "1.234,5"}' WHEN 3 THEN '{"tipo_documento": "a", "resumen": "b", "proveedor": "c", "monto": "-7", "fecha": "2024-03-05", "cuil": "20-1"}' WHEN 4 THEN '{}' END AS response"""


def generic_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").selectExpr(*columns(GENERIC)).withColumn("response", F.coalesce("response", F.lit("no object")))
    return rows.select("doc_id", F.array_join(F.array_sort(answers.generic_faults(F.col("response"))), ",").alias("faults"))


NESTED = """o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN concat('{"emisor": {"razon_social": "s', CAST(o_custkey AS VARCHAR), '"}, "financiero": {"importe_total_facturado": ', CAST(o_custkey AS VARCHAR), '.5, "monto_no_gravado": 2, "impuestos": {"iva_21": 1.25}}, "datos_especificos_rubro": {"cantidad_comensales_personas": 3}}')
    WHEN 1 THEN '{"financiero": {"importe_total_facturado": 7, "monto_total_transaccion_final": 9.5}, "datos_especificos_rubro": {"cantidad_litros_combustible": 4.5}}' WHEN 2 THEN '{"emisor": {}, "financiero": {"importe_total_facturado": 3}}' ELSE 'none' END AS response"""


def nested_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").selectExpr(*columns(NESTED)).select("doc_id", answers.nested(F.col("response")).alias("a"))
    money, special = "a.financiero", "a.datos_especificos_rubro"
    return rows.select(
        "doc_id", F.col("a.emisor.razon_social").alias("razon_social"), F.col(f"{money}.impuestos.iva_21").alias("iva_21"), F.col(f"{money}.monto_total_transaccion_final").alias("final"),
        F.col(f"{special}.cantidad_comensales_personas").alias("personas"), F.col(f"{special}.cantidad_litros_combustible").alias("litros"),
    )


GIVEN = """o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 20123 WHEN 1 THEN 0 END AS cuit_emisor, CASE o_orderkey % 3 WHEN 0 THEN '20240305' WHEN 1 THEN '' END AS fecha_emision, CASE o_orderkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 7.5 END AS importe_total_facturado,
    CASE WHEN o_orderkey % 7 > 0 THEN concat('{"cuit_emisor": 30999, "fecha_emision": "20231231", "importe_total_facturado": ', CAST(o_custkey AS VARCHAR), '}') END AS defaults"""


def request_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request fields as given, else from a JSON object; a given zero stands for the amount alone."""
    rows = read(spark, sf_dir, "orders").selectExpr(*columns(GIVEN))
    names = ("cuit_emisor", "fecha_emision", "importe_total_facturado")
    got = answers.with_defaults({n: F.col(n) for n in names}, F.col("defaults"), ("importe_total_facturado",))
    return rows.select("doc_id", got["cuit_emisor"].alias("cuit_emisor"), got["fecha_emision"].alias("fecha_emision"), got["importe_total_facturado"].cast("double").alias("importe"))


def prompt_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt over whole documents, answered by the deterministic stand-in."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    got = models.execute_prompt(docs, {"system": "s", "user": "{{proveedor}} {{documento}}"}, {"proveedor": F.col("source"), "documento": F.col("text")}, models.echo_backend, "10")
    value = lambda k: F.get_json_object("response", f"$.{k}")
    return got.select("doc_id", value("n_messages").cast("int").alias("n_messages"), value("n_chars").cast("long").alias("n_chars"), value("first_word").alias("first_word"), "error")


QUESTIONS = (("emisor", "Quien emite?"), ("total", "Cuanto es el total del comprobante?"), ("moneda", "Moneda?"))


def question_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A form of questions about each document, each asked with all before it; the stand-in answers by the question."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    got = models.question_form(docs, list(QUESTIONS), models.echo_backend)
    return got.select("doc_id", *[F.element_at("answers", k).alias(k) for k, _ in QUESTIONS])


def image_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a vision request carries: the bytes in base64."""
    made = models.messages(F.lit("s"), F.lit("u"), F.col("html").cast("binary"))
    pages = read(spark, sf_dir, "pages").select("page_id", made.alias("m"))
    sent = F.col("m")[1]["images"][0]
    return pages.select("page_id", F.length(sent).cast("long").alias("n_chars"), F.md5(sent).alias("payload_md5"))


SCANS = """page_id, concat('d', CAST(page_id % 7 AS VARCHAR), '/p', CAST(page_id AS VARCHAR), CASE page_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.PDF' WHEN 2 THEN '.md' ELSE '.zip' END) AS path,
    CASE WHEN page_id % 5 = 0 THEN 'broken' ELSE concat('[["text", "', CAST(page_id AS VARCHAR), '", 1, 0, 10, 50, 0], ["table", "t", 1, 60, 10, 99, 0]]') END AS content"""


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").selectExpr(*columns(SCANS)).select("page_id", "path", F.col("content").cast("binary").alias("content"))


def folder_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder, of which a third have their text already: skipped, converted or failed."""
    rows = scans(spark, sf_dir)
    return pipelines.process_folder(rows.select("path", "content"), rows.filter("page_id % 3 = 0").select("path"), converter.json_converter).select("path", "orientation", "markdown", "status", F.col("error").isNotNull().alias("failed"))


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by what they are: text as it is, convertible ones converted, others refused."""
    got = files.load_text(scans(spark, sf_dir).select("path", "content"), converter.json_converter)
    return got.select("path", "text", F.when(F.col("error").startswith("unsupported"), F.col("error")).when(F.col("error").isNotNull(), "failed").alias("error"))


def path_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.in_path_order(scans(spark, sf_dir).select("path", "content"))


def converted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading-order text by way of the converter: a file of positioned items for each document."""
    item = F.concat(F.lit("["), F.concat_ws(", ", jsonx.json_string("label"), jsonx.json_string("text"), F.lit("1"), *[F.col(c).cast("string") for c in "ltrb"]), F.lit("]"))
    rows = documents.boxes(spark, sf_dir).select("doc_id", "item_ix", item.alias("item")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("item_ix", "item"))).alias("x"))
    found = rows.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"), F.concat(F.lit("["), F.array_join(F.transform("x", lambda v: v["item"]), ", "), F.lit("]")).cast("binary").alias("content"))
    return pipelines.convert_documents(found, converter.json_converter)


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = documents.boxes(spark, sf_dir).withColumn("markdown", F.when(F.col("label") == "table", F.concat(F.lit("| "), F.col("text"), F.lit(" |"))))
    return layout.raw_text(boxes)


def image_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.box_report(documents.boxes(spark, sf_dir))


def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width and height by the headers of images: PNG, JPEG with a comment before its frame, BMP, and no image."""
    w, h = F.col("w"), F.col("h")
    wide = lambda c: F.lpad(F.hex(c), 8, "0")
    short = lambda c: F.lpad(F.hex(c), 4, "0")
    little = lambda c: F.concat(*[F.substring(wide(c), i, 2) for i in (7, 5, 3, 1)])
    made = (
        F.when(F.col("k") == 0, F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), wide(w), wide(h), F.lit("08060000")))
        .when(F.col("k") == 1, F.concat(F.lit("FFD8FFFE00040101FFC0001108"), short(h), short(w), F.lit("0301")))
        .when(F.col("k") == 2, F.concat(F.lit("424D00000000000000003600000028000000"), little(w), little(h), F.lit("0100")))
    )
    pages = read(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 4).alias("k"), (F.col("page_id") % 900 + 10).alias("w"), (F.col("page_id") % 700 + 20).alias("h"))
    return pages.select("page_id", files.image_size(F.unhex(F.coalesce(made, F.lit("00FF")))).alias("size")).select("page_id", "size.width", "size.height")


def raw_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons, texts and scores of a raw reader, with the polygons' centres."""
    b = documents.boxes(spark, sf_dir)
    corner = lambda x, y: F.concat(F.lit("["), F.col(x).cast("string"), F.lit(", "), F.col(y).cast("string"), F.lit("]"))
    item = F.concat(F.lit("[["), F.concat_ws(", ", corner("l", "t"), corner("r", "t"), corner("r", "b"), corner("l", "b")), F.lit("], "), jsonx.json_string("text"), F.lit(", 0."), (F.col("item_ix") % 90 + 10).cast("string"), F.lit("]"))
    rows = b.select("doc_id", "item_ix", item.alias("item")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("item_ix", "item"))).alias("x"))
    content = F.when(F.col("doc_id") % 11 == 0, F.lit("[[1]]")).otherwise(F.concat(F.lit("["), F.array_join(F.transform("x", lambda v: v["item"]), ", "), F.lit("]")))
    got = converter.read_tuples(rows.select(F.col("doc_id").cast("string").alias("path"), content.cast("binary").alias("content")))
    x, y = geometry.polygon_centre("poly")
    return got.select("path", "item_ix", "text", "score", x.alias("x"), y.alias("y"), F.col("error").isNotNull().alias("failed"))


QUERIES = {f.__name__: f for f in (image_sizes, raw_reader, center_rules, macro_rules, generic_answers, nested_answers, request_defaults, prompt_answers, question_answers, image_payloads, folder_conversion, document_texts, path_positions, converted_text, raw_text, image_report)}

_FOLD = "translate(lower(coalesce({c}, '')), 'áéíóúüñ', 'aeiouun')"


def _ranked(signals: str, names: str, agro: str, last: str) -> str:
    """Signals of every expense, ranked."""
    found = catalogs.values_sql(catalogs.signal_rows(signals), "code, wanted, unwanted")
    return f"""WITH e AS (SELECT {EXPENSES} FROM customer), d AS (SELECT doc_id, centro_costo, {_FOLD.format(c="descripcion")} AS de, {_FOLD.format(c="proveedor")} AS pr FROM e),
      m AS (SELECT doc_id, code, regexp_matches(de, wanted) AS inside, regexp_matches(pr, wanted) AS beside, coalesce(regexp_matches(de, unwanted) OR regexp_matches(pr, unwanted), false) AS against FROM d, {found} s WHERE {agro}),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY against, code = '{last}', CASE WHEN inside AND beside THEN 0 WHEN inside THEN 1 ELSE 2 END, code) AS INTEGER) AS rank,
              CASE WHEN against THEN 'baja' WHEN inside THEN 'alta' ELSE 'media' END AS confianza, CASE WHEN inside AND beside THEN 'proveedor+descripcion' WHEN inside THEN 'descripcion' ELSE 'proveedor' END AS senal FROM m WHERE inside OR beside),
      n AS (SELECT * FROM {catalogs.values_sql(catalogs._pairs(names), "code, name")}), o AS (SELECT * FROM d WHERE doc_id NOT IN (SELECT doc_id FROM r))
    """


_BARE = "CASE WHEN page_id % 5 = 0 THEN NULL ELSE page_id || ' | t' || chr(10) END"

ORACLE_SQL = {
    "center_rules": _ranked(catalogs.CENTER_SIGNALS, catalogs.COST_CENTERS, "true", catalogs.DEFAULT_CENTER) + f"""SELECT doc_id, rank, code AS codigo_centro_costo, name AS centro, confianza, senal AS senal_usada FROM r JOIN n USING (code) WHERE rank <= 3
      UNION ALL SELECT doc_id, 1, code, name, 'baja', 'ninguna' FROM o, n WHERE code = '{catalogs.DEFAULT_CENTER}'""",
    "macro_rules": _ranked(catalogs.MACRO_SIGNALS, catalogs.MACRO_CATEGORIES, f"code <> '{catalogs.AGRO_MACRO}' OR coalesce(centro_costo = '{catalogs.AGRO_CENTER}', false)", "") + f"""SELECT doc_id, rank, code AS macro_categoria, name AS nombre, confianza, false AS criterio_inferido, 'señal en ' || senal AS justificacion FROM r JOIN n USING (code) WHERE rank <= 3
      UNION ALL SELECT doc_id, 1, code, name, 'baja', true, 'sin señal específica' FROM o, n WHERE code = CASE WHEN regexp_matches(de, '(^|[^a-z0-9])servic') OR regexp_matches(pr, '(^|[^a-z0-9])servic') THEN '{catalogs.SERVICE_MACRO}' ELSE '{catalogs.OTHER_MACRO}' END""",
    "generic_answers": f"""WITH g AS (SELECT {GENERIC} FROM customer), j AS (SELECT doc_id, CASE WHEN json_valid(response) THEN CAST(response AS JSON) END AS a FROM g),
      k AS (SELECT doc_id, a, unnest(json_keys(a)) AS key FROM j), v AS (SELECT doc_id, key, json_extract_string(a, '$.' || key) AS value FROM k),
      f AS (
        SELECT doc_id, 'falta:' || need AS fault FROM j, (VALUES ('tipo_documento'), ('resumen'), ('proveedor'), ('monto')) AS n(need) WHERE a IS NULL OR NOT list_contains(json_keys(a), need)
        UNION ALL SELECT doc_id, 'anidado:' || key FROM v WHERE regexp_matches(value, '^\\s*[\\[{{]') UNION ALL SELECT doc_id, 'fecha:' || key FROM v WHERE key LIKE 'fecha%' AND NOT regexp_full_match(value, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
        UNION ALL SELECT doc_id, 'id:' || key FROM v WHERE regexp_matches(key, '^(cuit|cuil)') AND NOT regexp_full_match(value, '[0-9-]+') UNION ALL SELECT doc_id, 'monto:' || key FROM v WHERE key LIKE 'monto%' AND NOT regexp_full_match(value, '-?[0-9]+(\\.[0-9]+)?')
      ) SELECT j.doc_id, coalesce(string_agg(fault, ',' ORDER BY fault), '') AS faults FROM j LEFT JOIN f ON j.doc_id = f.doc_id GROUP BY j.doc_id""",
    "nested_answers": f"""WITH n AS (SELECT {NESTED} FROM orders), j AS (SELECT doc_id, CASE WHEN json_valid(response) THEN CAST(response AS JSON) END AS a FROM n),
      m AS (SELECT *, CAST(json_extract_string(a, '$.financiero.importe_total_facturado') AS DECIMAL(18,2)) AS total, CAST(json_extract_string(a, '$.financiero.monto_no_gravado') AS DECIMAL(18,2)) AS more FROM j)
      SELECT doc_id, json_extract_string(a, '$.emisor.razon_social') AS razon_social, CAST(json_extract_string(a, '$.financiero.impuestos.iva_21') AS DECIMAL(18,2)) AS iva_21,
        CAST(coalesce(CAST(json_extract_string(a, '$.financiero.monto_total_transaccion_final') AS DECIMAL(18,2)), total + coalesce(more, 0)) AS DECIMAL(18,2)) AS final,
        CASE WHEN a IS NOT NULL THEN coalesce(CAST(json_extract_string(a, '$.datos_especificos_rubro.cantidad_comensales_personas') AS INTEGER), 1) END AS personas,
        CASE WHEN a IS NOT NULL THEN CAST(coalesce(json_extract_string(a, '$.datos_especificos_rubro.cantidad_litros_combustible'), '0') AS DECIMAL(18,2)) END AS litros FROM m""",
    "request_defaults": f"""WITH g AS (SELECT {GIVEN} FROM orders) SELECT doc_id, CASE WHEN cuit_emisor <> 0 THEN CAST(cuit_emisor AS VARCHAR) ELSE json_extract_string(defaults, '$.cuit_emisor') END AS cuit_emisor,
        CASE WHEN fecha_emision <> '' THEN fecha_emision ELSE json_extract_string(defaults, '$.fecha_emision') END AS fecha_emision, CAST(coalesce(CAST(importe_total_facturado AS VARCHAR), json_extract_string(defaults, '$.importe_total_facturado')) AS DOUBLE) AS importe FROM g""",
    "prompt_answers": "SELECT doc_id, 2 AS n_messages, CAST(length(source || ' ' || coalesce(text, '')) AS BIGINT) AS n_chars, source AS first_word, CAST(NULL AS VARCHAR) AS error FROM documents",
    "question_answers": "SELECT doc_id, " + ", ".join(f"split_part('{q}', ' ', 1) || ' ' || length('{q}') AS {k}" for k, q in QUESTIONS) + " FROM documents",
    "image_payloads": "SELECT page_id, CAST(length(base64(encode(html))) AS BIGINT) AS n_chars, md5(base64(encode(html))) AS payload_md5 FROM pages",
    "image_sizes": "SELECT page_id, CASE WHEN page_id % 4 < 3 THEN CAST(page_id % 900 + 10 AS INTEGER) END AS width, CASE WHEN page_id % 4 < 3 THEN CAST(page_id % 700 + 20 AS INTEGER) END AS height FROM pages",
    "raw_reader": f"""WITH boxes AS ({documents.BOXES}), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY item_ix) - 1 AS INTEGER) AS ix FROM boxes)
      SELECT CAST(doc_id AS VARCHAR) AS path, ix AS item_ix, text, CAST('0.' || (item_ix % 90 + 10) AS DOUBLE) AS score, (((0.0 + l) + r) + r + l) / 4 AS x, (((0.0 + t) + t) + b + b) / 4 AS y, false AS failed FROM n WHERE doc_id % 11 <> 0
      UNION ALL SELECT DISTINCT CAST(doc_id AS VARCHAR), CAST(NULL AS INTEGER), NULL, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), true FROM boxes WHERE doc_id % 11 = 0""",
    "folder_conversion": f"""WITH s AS (SELECT {SCANS} FROM pages) SELECT path, CASE WHEN page_id % 3 > 0 AND page_id % 5 > 0 THEN 'horizontal' END AS orientation, CASE WHEN page_id % 3 > 0 THEN {_BARE} END AS markdown,
        CASE WHEN page_id % 3 = 0 THEN 'skipped' WHEN page_id % 5 = 0 THEN 'error' ELSE 'success' END AS status, page_id % 3 > 0 AND page_id % 5 = 0 AS failed FROM s""",
    "document_texts": f"""WITH s AS (SELECT {SCANS} FROM pages) SELECT path, CASE WHEN page_id % 4 = 2 THEN content WHEN page_id % 4 < 2 THEN {_BARE} END AS text,
        CASE WHEN page_id % 4 = 3 THEN 'unsupported file type: .zip' WHEN page_id % 4 < 2 AND page_id % 5 = 0 THEN 'failed' END AS error FROM s""",
    "path_positions": f"WITH s AS (SELECT {SCANS} FROM pages) SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS position FROM s",
    "converted_text": "SELECT 'doc' || doc_id || '.png' AS path, orientation, text AS markdown, 'success' AS status, CAST(NULL AS VARCHAR) AS error FROM (" + documents.ORACLE_SQL["reading_order_text"] + ")",
    "raw_text": f"WITH boxes AS ({documents.BOXES}) SELECT doc_id, string_agg(CASE WHEN label = 'table' THEN '| ' || text || ' |' ELSE text END, chr(10) || chr(10) ORDER BY item_ix) AS text FROM boxes GROUP BY doc_id",
    "image_report": f"""{documents._WITH}, said AS (SELECT doc_id, string_agg('- [' || upper(label) || '] ' || CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END || printf(' (%.1f, %.1f, %.1f, %.1f)', round(l, 1), round(t, 1), round(r, 1), round(b, 1)), chr(10) ORDER BY item_ix) AS x FROM boxes GROUP BY doc_id)
      SELECT doc_id, 'horizontal ' || n_horizontal || ', vertical ' || n_vertical || ': ' || orientation || chr(10) || x AS text FROM votes JOIN said USING (doc_id)""",
}
