"""Accounting queries over orders, customers and lines, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.operators import answers, catalogs, rules
from quillspark.plans.util import columns

CONCEPT = "concat('CT', lpad(CAST(o_orderkey % 39 + 1 AS VARCHAR), 3, '0'))"
CONDITION = "CASE o_custkey % 6 WHEN 0 THEN '21' WHEN 1 THEN '10_5' WHEN 2 THEN '27' WHEN 3 THEN '2_5' WHEN 4 THEN 'exento_no_gravado' ELSE 'no informada' END"
PERSON = "CASE {k} % 4 WHEN 0 THEN 'Responsable Inscripto' WHEN 1 THEN 'Monotributo' WHEN 2 THEN 'Exento' ELSE 'Consumidor Final' END"
FACTS = f"""o_orderkey AS doc_id, {PERSON.format(k="(o_orderkey + 1)")} AS emitter, {PERSON.format(k="o_custkey")} AS receiver, c_nationkey = 2 AS exported,
       CASE o_orderkey % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'M' WHEN 4 THEN 'A' WHEN 5 THEN 'E' END AS detected,
       o_custkey % 3 <> 0 AS two_ids, o_orderkey % 2 = 0 AS itemised_vat"""
DRAFT = f"""o_orderkey AS doc_id, {PERSON.format(k="(o_orderkey + 1)")} AS emitter, {PERSON.format(k="o_custkey")} AS receiver, {PERSON.format(k="(o_orderkey + 1)")} AS registry,
       {PERSON.format(k="o_custkey")} AS receiver_text, CASE WHEN c_nationkey = 2 THEN 'Chile' ELSE 'Argentina' END AS receiver_country, CASE WHEN c_nationkey = 2 THEN 'Chile' ELSE 'Argentina' END AS country_text,
       o_orderkey % 3 AS id_count, o_orderkey % 2 = 0 AS mentions_vat, o_orderkey % 4 = 0 AS itemised_vat, CASE WHEN o_custkey % 5 = 0 THEN 'USD' ELSE 'ARS' END AS currency, o_custkey % 5 = 0 AS states_rate,
       CASE o_orderkey % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END AS detected, CASE o_orderkey % 11 WHEN 3 THEN 'M' WHEN 4 THEN 'A' END AS header_letter,
       CASE WHEN o_orderkey % 2 = 0 THEN 'discriminado' ELSE 'subtotal_unico' END AS totals, concat('30-', lpad(CAST(o_custkey AS VARCHAR), 8, '0'), '-1') AS receiver_id"""
AUDITED = "30-00000011-1"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def with_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey"))


def final_code_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = orders(spark, sf_dir).selectExpr("o_orderkey AS doc_id", *columns(f"{CONCEPT} AS concept, {CONDITION} AS tax_condition"))
    got = rules.final_codes(docs)
    return got.select("doc_id", "concept", "tax_condition", "macro_category", "concept_name", "account", "final_code", F.array_join("candidates", ",").alias("candidates"), "needs_review")


def catalog_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of the code matrix with what a document of it gets."""
    cells = catalogs.code_cells(spark).select("concept", "tax_condition")
    return rules.final_codes(cells).select("concept", "tax_condition", "macro_category", "account", "final_code", F.array_join("candidates", ",").alias("candidates"), "needs_review")


def voucher_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = with_customer(spark, sf_dir).selectExpr(*columns(FACTS))
    return facts.select("doc_id", "emitter", "receiver", *[c.alias(n) for n, c in rules.voucher_letter().items()]).withColumn("rules", F.array_join("rules", ","))


def voucher_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = with_customer(spark, sf_dir).selectExpr(*columns(DRAFT))
    return facts.select("doc_id", *[c.alias(n) for n, c in rules.draft_voucher_letter(AUDITED).items()]).withColumns({c: F.array_join(c, ",") for c in ("rules", "remaining")})


#: Money is decimal from the start: doubles would round differently from engine to engine.
_PARTS = "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"
NET = f"CAST(round({_PARTS}, 2) AS DECIMAL(18,2))"
VAT = f"CAST(round({_PARTS} * CAST(l_tax AS DECIMAL(4,2)), 2) AS DECIMAL(18,2))"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def dominant_tax_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rules.dominant_rates(lines(spark, sf_dir).selectExpr("l_orderkey AS doc_id", "l_linenumber AS ord", "l_tax AS rate", f"{NET} AS net"))
    # lines repeat (order, number): of rates that appear together the smaller comes first
    return got.select("doc_id", "dominant_rate", F.array_join(F.transform("rates", lambda r: F.format_string("%.2f", r)), "|").alias("rates"))


def invoice_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_line = lines(spark, sf_dir).selectExpr("l_orderkey AS doc_id", f"{NET} AS net", f"{VAT} AS vat")
    sums = per_line.groupBy("doc_id").agg(F.sum("net").cast("decimal(18,2)").alias("net"), F.sum("vat").cast("decimal(18,2)").alias("vat"))
    letter = F.when(F.col("doc_id") % 3 == 0, "A").when(F.col("doc_id") % 3 == 1, "B").otherwise("C")
    off = F.when(F.col("doc_id") % 10 == 0, F.lit(1)).otherwise(0)
    docs = sums.withColumns({"letter": letter, "total": (F.col("net") + F.col("vat") + off).cast("decimal(18,2)"), "non_taxed": (F.col("doc_id") % 5).cast("decimal(18,2)")})
    return rules.invoice_totals(docs).select("doc_id", "letter", "subtotal", "iva", "total", "final", "mismatch")


def item_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = lines(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_type", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    items = items.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ord"), F.substring_index("p_type", " ", 1).alias("rubric"), F.col("p_name").alias("text"), F.col("l_extendedprice").alias("amount"))
    return rules.description(items)


KEYWORDS = [("CC0001", "the"), ("CC0002", "and"), ("CC0003", "ou"), ("CC0004", "thst"), ("CC0005", "ation"), ("CC0007", "ment"), ("CC0008", "keit")]


def option_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offline scorer: how often each centre's keyword stands in a document, best three; none gives the default centre."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = F.array(*[F.struct(F.lit(c).alias("code"), F.regexp_count("low", F.lit(k)).cast("long").alias("score")) for c, k in KEYWORDS])
    scored = docs.select("doc_id", F.lower("text").alias("low")).select("doc_id", F.filter(counts, lambda x: x["score"] > 0).alias("s"))
    # at most seven options a document: sorted in its row, so nothing is shuffled
    best = F.slice(F.array_sort("s", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["code"] < b["code"], -1).otherwise(1)), 1, 3)
    default = F.array(F.struct(F.lit("CC0006").alias("code"), F.lit(0).cast("long").alias("score")))
    shown = scored.select("doc_id", F.posexplode(F.when(F.size("s") > 0, best).otherwise(default)).alias("rank", "o"))
    return shown.select("doc_id", (F.col("rank") + 1).alias("rank"), F.col("o.code").alias("code"), F.col("o.score").alias("score"))


def answer_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked answers with planted faults, each with the first fault found and the primary code."""
    code = "concat('CC000', CAST({n} % 9 + 1 AS STRING))"
    one = "named_struct('codigo', {c}, 'confianza', {f})"
    n = [code.format(n=f"(o_orderkey + {i})") for i in (0, 1, 3)]
    conf = "CASE WHEN o_orderkey % 17 = 0 THEN 'segura' ELSE 'alta' END"
    three = f"array({one.format(c=n[0], f=conf)}, {one.format(c=n[1], f=repr('media'))}, {one.format(c=n[2], f=repr('baja'))})"
    options = f"CASE o_orderkey % 5 WHEN 0 THEN {three} WHEN 1 THEN slice({three}, 1, 1) WHEN 2 THEN slice({three}, 1, 0) WHEN 3 THEN concat({three}, {three}) ELSE array_append(slice({three}, 1, 2), {three}[0]) END"
    docs = orders(spark, sf_dir).selectExpr("o_orderkey AS doc_id", "concat('MC', lpad(CAST(o_custkey % 15 + 1 AS STRING), 2, '0')) AS macro", f"{options} AS options")
    centers = tuple(c for c, _ in catalogs._pairs(catalogs.COST_CENTERS))
    center = rules.primary(F.col("options"), "codigo")
    return docs.select("doc_id", rules.option_check(F.col("options"), centers, "codigo").alias("fault"), center.alias("center"), "macro", rules.macro_allowed(F.col("macro"), center).alias("macro_allowed"))


def invoice_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice answers with planted faults: rules broken, keys missing and keys that no one asked for."""
    given = """named_struct('comprobante_valido', o_orderkey % 4 > 0, 'tipo_comprobante', CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE '090' END, 'cuit_emisor', CASE WHEN o_orderkey % 5 = 0 THEN '20-1 Ing' ELSE '20-1' END,
        'subtotal', CAST(o_custkey AS INT), 'iva', CAST(o_orderkey % 2 AS INT), 'importe_total_facturado', CAST(o_custkey + o_orderkey % 2 AS INT), 'condicion_impositiva_dominante', CASE WHEN o_orderkey % 6 < 2 THEN '21' END,
        'categoria_gasto', CASE o_custkey % 3 WHEN 0 THEN 'Restaurante' WHEN 1 THEN 'Combustible' END, 'cantidad_comensales_personas', CASE WHEN o_orderkey % 7 = 0 THEN 4 END, 'cantidad_litros', CASE WHEN o_orderkey % 8 = 0 THEN 9.5D END,
        'centro_de_costo', CASE WHEN o_orderkey % 9 = 0 THEN 'CC0001' END, 'raro', CASE WHEN o_orderkey % 10 = 0 THEN 'x' END)"""
    docs = orders(spark, sf_dir).selectExpr("o_orderkey AS doc_id", f"CASE WHEN o_orderkey % 50 = 49 THEN 'no object' ELSE to_json({given}) END AS response")
    got = answers.check_invoices(docs)
    return got.select("doc_id", F.size("missing").cast("long").alias("n_missing"), F.array_join("extra", ",").alias("extra"), F.array_join("faults", ",").alias("faults"), F.col("answer.subtotal").alias("subtotal"))


QUERIES = {
    "invoice_answers": invoice_answers,
    "final_code_lookup": final_code_lookup,
    "catalog_cells": catalog_cells,
    "voucher_letter": voucher_letter,
    "voucher_draft": voucher_draft,
    "dominant_tax_rate": dominant_tax_rate,
    "invoice_totals": invoice_totals,
    "item_description": item_description,
    "option_ranking": option_ranking,
    "answer_validation": answer_validation,
}

_KNOWN = catalogs.values_sql([r[:4] for r in catalogs.concept_rows()], "macro_category, concept, concept_name, account")
_CELLS = catalogs.values_sql(catalogs.cell_rows(), "concept, tax_condition, cell")
_CODE = """split_part(cell, '/', 1) AS final_code, CASE WHEN cell LIKE '%/%' THEN replace(cell, '/', ',') ELSE '' END AS candidates, (cell IS NULL OR cell LIKE '%/%') AS needs_review"""
_EXPECTED = """CASE WHEN {m} exported THEN 'E' WHEN emitter IN ('Monotributo', 'Exento') THEN 'C' WHEN emitter = 'Responsable Inscripto' AND receiver = 'Responsable Inscripto' THEN 'A'
        WHEN emitter = 'Responsable Inscripto' AND receiver IN ('Monotributo', 'Exento', 'Consumidor Final') THEN 'B' END"""
_COUNTS = ", ".join(f"('{c}', '{k}')" for c, k in KEYWORDS)

ORACLE_SQL = {
    "invoice_answers": """WITH a AS (SELECT o_orderkey AS k, o_orderkey % 50 = 49 AS none, o_orderkey % 3 = 0 AS is_a, o_orderkey % 2 AS vat, o_orderkey % 6 < 2 AS rate, o_custkey % 3 AS c, o_custkey FROM orders),
      f AS (SELECT *, list_filter([CASE WHEN NOT is_a AND vat <> 0 THEN 'subtotal' END, CASE WHEN NOT is_a AND vat <> 0 THEN 'iva' END, CASE WHEN NOT is_a AND rate THEN 'condicion_impositiva' END, CASE WHEN rate THEN 'alicuotas' END,
          CASE WHEN k % 7 = 0 AND c <> 0 THEN 'personas' END, CASE WHEN k % 8 = 0 AND c <> 1 THEN 'litros' END, CASE WHEN k % 9 = 0 THEN 'centro_de_costo' END, CASE WHEN k % 4 = 0 THEN 'motivo_rechazo' END, CASE WHEN k % 5 = 0 THEN 'cuit' END], lambda x: x IS NOT NULL) AS broken FROM a)
      SELECT k AS doc_id, CASE WHEN none THEN 23 ELSE CAST(23 - 6 - CAST(rate AS INT) - CAST(c < 2 AS INT) - CAST(k % 7 = 0 AS INT) - CAST(k % 8 = 0 AS INT) - CAST(k % 9 = 0 AS INT) AS BIGINT) END AS n_missing,
        CASE WHEN k % 10 = 0 AND NOT none THEN 'raro' ELSE '' END AS extra, CASE WHEN NOT none THEN coalesce(array_to_string(broken, ','), '') END AS faults, CASE WHEN NOT none THEN CAST(o_custkey AS DECIMAL(18,2)) END AS subtotal FROM f""",
    "final_code_lookup": f"""WITH d AS (SELECT o_orderkey AS doc_id, {CONCEPT} AS concept, {CONDITION} AS tax_condition FROM orders)
      SELECT doc_id, concept, tax_condition, macro_category, concept_name, account, {_CODE} FROM d LEFT JOIN {_KNOWN} k USING (concept) LEFT JOIN {_CELLS} c USING (concept, tax_condition)""",
    "catalog_cells": f"SELECT concept, tax_condition, macro_category, account, {_CODE} FROM {_CELLS} c JOIN {_KNOWN} k USING (concept)",
    "voucher_letter": f"""WITH f AS (SELECT {FACTS} FROM orders JOIN customer ON o_custkey = c_custkey),
      e AS (SELECT *, {_EXPECTED.format(m="detected = 'M' THEN 'M' WHEN")} AS expected_letter FROM f),
      r AS (SELECT *, list_filter([CASE WHEN detected = 'A' AND NOT (two_ids AND itemised_vat) THEN 'A_DEBIL' END, CASE WHEN detected = 'B' AND itemised_vat THEN 'B_CON_IVA' END,
          CASE WHEN detected = 'C' AND emitter = 'Responsable Inscripto' THEN 'C_CON_RI' END, CASE WHEN detected <> expected_letter THEN 'CONFLICTO' END], lambda x: x IS NOT NULL) AS fired,
          coalesce(detected = expected_letter, false) AS agrees FROM e)
      SELECT doc_id, emitter, receiver, expected_letter, coalesce(detected, expected_letter) AS letter, coalesce(array_to_string(fired, ','), '') AS rules, agrees, len(fired) > 0 AS alert,
        CASE WHEN len(fired) > 0 THEN 'baja' WHEN agrees THEN 'alta' ELSE 'media' END AS confidence FROM r""",
    "voucher_draft": f"""WITH f AS (SELECT {DRAFT} FROM orders JOIN customer ON o_custkey = c_custkey),
      e AS (SELECT *, receiver_country <> 'Argentina' AS exported, [CASE WHEN id_count < 2 THEN 'DA1' END, CASE WHEN NOT mentions_vat THEN 'DA2' END,
          CASE WHEN receiver_text IN ('Consumidor Final', 'Exento', 'Monotributo') THEN 'DA3' END, CASE WHEN itemised_vat THEN 'DB1' END, CASE WHEN registry IN ('Monotributo', 'Exento') THEN 'DB2' END,
          CASE WHEN mentions_vat THEN 'DC1' END, CASE WHEN registry = 'Responsable Inscripto' THEN 'DC2' END, CASE WHEN country_text = 'Argentina' THEN 'DE1' END, CASE WHEN currency = 'ARS' AND NOT states_rate THEN 'DE2' END] AS all_rules FROM f),
      g AS (SELECT *, {_EXPECTED.format(m="")} AS expected_letter, list_filter(all_rules, lambda x: x IS NOT NULL) AS fired,
          coalesce(detected, header_letter, CASE WHEN totals = 'discriminado' THEN 'A' WHEN emitter IN ('Monotributo', 'Exento') THEN 'C' ELSE 'B' END) AS detected_letter FROM e),
      h AS (SELECT *, list_filter(['A', 'B', 'C', 'M', 'E'], lambda x: NOT list_contains(list_transform(fired, lambda r: r[2]), x)) AS left_ FROM g),
      a AS (SELECT *, coalesce(list_contains(left_, expected_letter), false) AS sound FROM h),
      z AS (SELECT *, coalesce(expected_letter = detected_letter, false) AND sound AS agrees FROM a)
      SELECT doc_id, coalesce(array_to_string(fired, ','), '') AS rules, coalesce(array_to_string(left_, ','), '') AS remaining, expected_letter, detected_letter, coalesce(expected_letter, detected_letter) AS letter, agrees,
        NOT agrees OR coalesce(emitter = 'Responsable Inscripto' AND receiver_id = '{AUDITED}' AND detected_letter = 'B', false) AS alert,
        CASE WHEN agrees THEN 'alta' WHEN sound THEN 'media' ELSE 'baja' END AS confidence FROM z""",
    "dominant_tax_rate": f"""WITH s AS (SELECT l_orderkey AS doc_id, l_tax AS rate, sum({NET}) AS net, min(l_linenumber) AS ord FROM lineitem WHERE {NET} > 0 GROUP BY 1, 2)
      SELECT doc_id, first(rate ORDER BY net DESC, rate) AS dominant_rate, string_agg(printf('%.2f', rate), '|' ORDER BY ord, rate) AS rates FROM s GROUP BY doc_id""",
    "invoice_totals": f"""WITH s AS (SELECT l_orderkey AS doc_id, CAST(sum({NET}) AS DECIMAL(18,2)) AS net, CAST(sum({VAT}) AS DECIMAL(18,2)) AS vat FROM lineitem GROUP BY 1),
      d AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS letter, CAST(net + vat + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS total, CAST(doc_id % 5 AS DECIMAL(18,2)) AS non_taxed FROM s),
      p AS (SELECT *, CASE WHEN letter = 'A' THEN net ELSE total END AS subtotal, CAST(CASE WHEN letter = 'A' THEN vat ELSE 0 END AS DECIMAL(18,2)) AS iva FROM d)
      SELECT doc_id, letter, subtotal, iva, total, CAST(total + non_taxed AS DECIMAL(18,2)) AS final, abs(subtotal + iva - total) > 0.01 AS mismatch FROM p""",
    "item_description": """WITH i AS (SELECT l_orderkey AS doc_id, l_linenumber * 1000000 + l_partkey AS ord, split_part(p_type, ' ', 1) AS rubric, p_name AS text, l_extendedprice AS amount FROM lineitem JOIN part ON l_partkey = p_partkey),
      c AS (SELECT doc_id, rubric, count(*) AS n FROM i GROUP BY 1, 2), m AS (SELECT doc_id, first(rubric ORDER BY n DESC, rubric DESC) AS rubric, max(n) AS most, sum(n) AS total FROM c GROUP BY 1),
      l AS (SELECT doc_id, first(text ORDER BY amount DESC, ord) AS text FROM i GROUP BY 1)
      SELECT doc_id, CASE WHEN 2 * most > total THEN rubric ELSE text END AS description FROM m JOIN l USING (doc_id)""",
    "option_ranking": f"""WITH k(code, word) AS (VALUES {_COUNTS}),
      s AS (SELECT doc_id, code, CAST((length(lower(text)) - length(replace(lower(text), word, ''))) / length(word) AS BIGINT) AS score FROM documents, k),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, code) AS INTEGER) AS rank FROM s WHERE score > 0)
      SELECT doc_id, rank, code, score FROM r WHERE rank <= 3 UNION ALL SELECT doc_id, 1, 'CC0006', 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM r)""",
    "answer_validation": """WITH d AS (SELECT o_orderkey AS doc_id, o_orderkey % 5 AS kind, concat('MC', lpad(CAST(o_custkey % 15 + 1 AS VARCHAR), 2, '0')) AS macro, concat('CC000', (o_orderkey + 0) % 9 + 1) AS c0,
        concat('CC000', (o_orderkey + 1) % 9 + 1) AS c1, concat('CC000', (o_orderkey + 3) % 9 + 1) AS c2, o_orderkey % 17 = 0 AS odd FROM orders),
      e AS (SELECT *, CASE kind WHEN 0 THEN [c0, c1, c2] WHEN 1 THEN [c0] WHEN 2 THEN [] WHEN 3 THEN [c0, c1, c2, c0, c1, c2] ELSE [c0, c1, c0] END AS codes FROM d)
      SELECT doc_id, CASE WHEN len(codes) = 0 THEN 'sin_opciones' WHEN len(codes) > 3 THEN 'mas_de_tres' WHEN len(list_distinct(codes)) < len(codes) THEN 'codigo_repetido'
        WHEN list_contains(codes, 'CC0009') THEN 'codigo_desconocido' WHEN odd THEN 'confianza_desconocida' END AS fault,
        codes[1] AS center, macro, coalesce(macro <> 'MC15' OR codes[1] = 'CC0007', false) AS macro_allowed FROM e""",
}
