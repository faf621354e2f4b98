"""Accounting decisions as column rules: code lookup, voucher letters, answer checks, totals and rankings.

Catalogs are constant tables of at most 185 rows, so joining them by broadcast is safe at any input size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.operators import catalogs

REGISTERED, MONOTRIBUTO, EXEMPT, CONSUMER = "Responsable Inscripto", "Monotributo", "Exento", "Consumidor Final"
LETTERS = ("A", "B", "C", "M", "E")


def final_codes(docs: DataFrame) -> DataFrame:
    """docs (concept, tax_condition, ...) with macro, account, final_code, candidates and needs_review.

    One code: that code, no candidates. Several: the first, all as candidates, review. None, or an
    unknown concept or condition: null and review. A macro category that isn't the concept's is replaced.
    """
    spark = docs.sparkSession
    known = F.broadcast(catalogs.concepts(spark))
    cells = F.broadcast(catalogs.code_cells(spark))
    got = docs.join(known, "concept", "left").join(cells, ["concept", "tax_condition"], "left")
    codes = F.split("cell", "/")
    return got.withColumns({
        "final_code": F.try_element_at(codes, F.lit(1)),
        "candidates": F.when(F.size(codes) > 1, codes).otherwise(F.array().cast("array<string>")),
        "needs_review": F.col("cell").isNull() | (F.size(codes) > 1),
    }).drop("cell")


def voucher_letter() -> dict[str, Column]:
    """Live policy over columns emitter, receiver, exported, detected, two_ids, itemised_vat: on conflict the detected letter stays."""
    emitter, receiver, detected = F.col("emitter"), F.col("receiver"), F.col("detected")
    expected = (
        F.when(detected == "M", "M")
        .when(F.col("exported"), "E")
        .when(emitter.isin(MONOTRIBUTO, EXEMPT), "C")
        .when((emitter == REGISTERED) & (receiver == REGISTERED), "A")
        .when((emitter == REGISTERED) & receiver.isin(MONOTRIBUTO, EXEMPT, CONSUMER), "B")
    )
    rules = F.array_compact(F.array(
        F.when((detected == "A") & ~(F.col("two_ids") & F.col("itemised_vat")), "A_DEBIL"),
        F.when((detected == "B") & F.col("itemised_vat"), "B_CON_IVA"),
        F.when((detected == "C") & (emitter == REGISTERED), "C_CON_RI"),
        F.when(detected.isNotNull() & expected.isNotNull() & (detected != expected), "CONFLICTO"),
    ))
    agrees = F.coalesce(detected == expected, F.lit(False))
    return {
        "expected_letter": expected,
        "letter": F.coalesce(detected, expected),
        "rules": rules,
        "agrees": agrees,
        "alert": F.size(rules) > 0,
        "confidence": F.when(F.size(rules) > 0, "baja").when(agrees, "alta").otherwise("media"),
    }


def draft_voucher_letter(audited_id: str | None = None) -> dict[str, Column]:
    """Draft policy: cheap discards first, export before the emitter's and receiver's condition, then the letter read;
    on conflict the expected letter wins unless it was discarded. audited_id names the receiver of the alert on B."""
    c = F.col
    fired = {
        "DA1": ("A", c("id_count") < 2),
        "DA2": ("A", ~c("mentions_vat")),
        "DA3": ("A", c("receiver_text").isin(CONSUMER, EXEMPT, MONOTRIBUTO)),
        "DB1": ("B", c("itemised_vat")),
        "DB2": ("B", c("registry").isin(MONOTRIBUTO, EXEMPT)),
        "DC1": ("C", c("mentions_vat")),
        "DC2": ("C", c("registry") == REGISTERED),
        "DE1": ("E", c("country_text") == "Argentina"),
        "DE2": ("E", (c("currency") == "ARS") & ~c("states_rate")),
    }
    rules = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), k) for k, (_, test) in fired.items()]))
    gone = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), letter) for letter, test in fired.values()]))
    left = F.array_except(F.array(*map(F.lit, LETTERS)), gone)
    exported = F.coalesce(c("receiver_country") != "Argentina", F.lit(False))
    expected = (
        F.when(exported, "E")
        .when(c("emitter").isin(MONOTRIBUTO, EXEMPT), "C")
        .when((c("emitter") == REGISTERED) & (c("receiver") == REGISTERED), "A")
        .when((c("emitter") == REGISTERED) & c("receiver").isin(MONOTRIBUTO, EXEMPT, CONSUMER), "B")
    )
    detected = F.coalesce(c("detected"), c("header_letter"), F.when(c("totals") == "discriminado", "A").when(c("totals") == "subtotal_unico", F.when(c("emitter").isin(MONOTRIBUTO, EXEMPT), "C").otherwise("B")))
    sound = lambda x: F.coalesce(F.array_contains(left, x), F.lit(False))
    agrees = F.coalesce(expected == detected, F.lit(False)) & sound(expected)
    audit = F.lit(False) if audited_id is None else F.coalesce((c("emitter") == REGISTERED) & (c("receiver_id") == audited_id) & (detected == "B"), F.lit(False))
    return {
        "rules": rules,
        "remaining": left,
        "expected_letter": expected,
        "detected_letter": detected,
        "letter": F.coalesce(expected, detected),
        "agrees": agrees,
        "alert": ~agrees | audit,
        "confidence": F.when(agrees, "alta").when(sound(expected), "media").otherwise("baja"),
    }


def option_check(options: Column, catalog: tuple[str, ...], code: str) -> Column:
    """The first fault of a ranked answer, null if there is none: 1 to 3 options, known and distinct codes, a confidence of the scale."""
    codes = F.transform(options, lambda o: o[code])
    return (
        F.when(options.isNull() | (F.size(options) == 0), "sin_opciones")
        .when(F.size(options) > 3, "mas_de_tres")
        .when(F.size(F.array_distinct(codes)) < F.size(codes), "codigo_repetido")
        .when(~F.forall(codes, lambda x: F.coalesce(x.isin(*catalog), F.lit(False))), "codigo_desconocido")
        .when(~F.forall(options, lambda o: F.coalesce(o["confianza"].isin("alta", "media", "baja"), F.lit(False))), "confianza_desconocida")
    )


def macro_allowed(macro: Column, center: Column) -> Column:
    """Agriculture goes with the agricultural centre only."""
    return F.coalesce((macro != "MC15") | (center == "CC0007"), F.lit(False))


def plain(c: Column | str) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), "áéíóúüñ", "aeiouun")


def _ranked_signals(options: list[tuple[Column, Column, Column, Column]], fields: str, names: dict[str, str], most: int = 3) -> Column:
    """The best of (code, rank key, confidence, signal) as an array of fields; options whose signal is null don't count."""
    rows = [F.when(signal.isNotNull(), F.struct(key.alias("key"), code.alias("code"), confidence.alias("confianza"), signal.alias("senal"))) for code, key, confidence, signal in options]
    best = F.slice(F.array_sort(F.array_compact(F.array(*rows))), 1, most)
    name = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    made = {"code": lambda o: o["code"], "name": lambda o: name[o["code"]], "confianza": lambda o: o["confianza"], "senal_usada": lambda o: o["senal"], "criterio_inferido": lambda o: F.lit(False), "justificacion": lambda o: F.concat(F.lit("señal en "), o["senal"])}
    parts = [f.split(":") for f in fields.split()]
    return F.transform(best, lambda o: F.struct(*[made[source](o).alias(out) for out, source in parts]))


def _signals(rows: list[tuple[str, str, str | None]], allowed: dict[str, Column], last: str | None) -> list[tuple[Column, Column, Column, Column]]:
    """Of each code its place, confidence and signal: found in the description, then in the provider; what speaks against it comes later and with low confidence."""
    described, provider = plain("descripcion"), plain("proveedor")
    out = []
    for code, wanted, unwanted in rows:
        inside, beside = described.rlike(wanted), provider.rlike(wanted)
        against = (described.rlike(unwanted) | provider.rlike(unwanted)) if unwanted else F.lit(False)
        signal = F.when(inside & beside, "proveedor+descripcion").when(inside, "descripcion").when(beside, "proveedor")
        if code in allowed:
            signal = F.when(allowed[code], signal)
        key = F.struct(against.cast("int").alias("against"), F.lit(int(code == last)).alias("last"), F.when(inside & beside, 0).when(inside, 1).otherwise(2).alias("place"), F.lit(code).alias("code"))
        out.append((F.lit(code), key, F.when(against, "baja").when(inside, "alta").otherwise("media"), signal))
    return out


def center_options() -> Column:
    """Ranked cost centres of columns descripcion and proveedor, three at most; the default one with low confidence where nothing speaks for any."""
    names = dict(catalogs._pairs(catalogs.COST_CENTERS))
    fields = "codigo_centro_costo:code centro:name confianza:confianza senal_usada:senal_usada justificacion:justificacion"
    got = _ranked_signals(_signals(catalogs.signal_rows(catalogs.CENTER_SIGNALS), {}, catalogs.DEFAULT_CENTER), fields, names)
    default = F.array(F.struct(F.lit(catalogs.DEFAULT_CENTER).alias("codigo_centro_costo"), F.lit(names[catalogs.DEFAULT_CENTER]).alias("centro"), F.lit("baja").alias("confianza"), F.lit("ninguna").alias("senal_usada"), F.lit("sin señal específica").alias("justificacion")))
    return F.when(F.size(got) > 0, got).otherwise(default)


def macro_options() -> Column:
    """Ranked macro categories of columns descripcion, proveedor and centro_costo; agriculture only with its centre. Where nothing
    speaks for any, services have their own fallback and everything else another, both inferred."""
    names = dict(catalogs._pairs(catalogs.MACRO_CATEGORIES))
    agro = F.coalesce(F.col("centro_costo") == catalogs.AGRO_CENTER, F.lit(False))
    fields = "macro_categoria:code nombre:name confianza:confianza criterio_inferido:criterio_inferido justificacion:justificacion"
    got = _ranked_signals(_signals(catalogs.signal_rows(catalogs.MACRO_SIGNALS), {catalogs.AGRO_MACRO: agro}, None), fields, names)
    service = plain("descripcion").rlike("(^|[^a-z0-9])servic") | plain("proveedor").rlike("(^|[^a-z0-9])servic")
    code = F.when(service, catalogs.SERVICE_MACRO).otherwise(catalogs.OTHER_MACRO)
    name = F.when(service, names[catalogs.SERVICE_MACRO]).otherwise(names[catalogs.OTHER_MACRO])
    default = F.array(F.struct(code.alias("macro_categoria"), name.alias("nombre"), F.lit("baja").alias("confianza"), F.lit(True).alias("criterio_inferido"), F.lit("sin señal específica").alias("justificacion")))
    return F.when(F.size(got) > 0, got).otherwise(default)


def primary(options: Column, code: str) -> Column:
    """The code of the first of ranked options, null if there is none."""
    return F.try_element_at(options, F.lit(1))[code]


def ranked(scores: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """The best options of each key: scores (keys, code, score) with rank, at most so many, by score and then code."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "code")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def dominant_rates(lines: DataFrame) -> DataFrame:
    """lines (doc_id, ord, rate, net) to (doc_id, dominant_rate, rates): the rate of the greatest net sum, of ties the smallest; rates in order of appearance."""
    sums = lines.filter("net > 0").groupBy("doc_id", "rate").agg(F.sum("net").alias("net"), F.min("ord").alias("ord"))
    return sums.groupBy("doc_id").agg(F.max_by("rate", F.struct("net", -F.col("rate"))).alias("dominant_rate"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "rate"))), lambda x: x["rate"]).alias("rates"))


def invoice_totals(vouchers: DataFrame) -> DataFrame:
    """vouchers (doc_id, letter, net, vat, total, non_taxed): A states net and VAT apart, other letters the total and no VAT;
    final adds what isn't taxed, and mismatch flags parts that don't make the total."""
    is_a = F.col("letter") == "A"
    out = vouchers.withColumns({"subtotal": F.when(is_a, F.col("net")).otherwise(F.col("total")), "iva": F.when(is_a, F.col("vat")).otherwise(F.lit(0).cast("decimal(18,2)"))})
    return out.withColumns({"final": (F.col("total") + F.col("non_taxed")).cast("decimal(18,2)"), "mismatch": F.abs(F.col("subtotal") + F.col("iva") - F.col("total")) > F.lit(0.01).cast("decimal(18,2)")})


def description(items: DataFrame) -> DataFrame:
    """items (doc_id, ord, rubric, text, amount) to (doc_id, description): the rubric that over half of the items share, else the text of the largest item."""
    n = items.groupBy("doc_id", "rubric").agg(F.count("*").alias("n"))
    common = n.groupBy("doc_id").agg(F.max_by("rubric", F.struct("n", "rubric")).alias("rubric"), F.max("n").alias("most"), F.sum("n").alias("all"))
    largest = items.groupBy("doc_id").agg(F.max_by("text", F.struct("amount", -F.col("ord"))).alias("text"))
    return common.join(largest, "doc_id").select("doc_id", F.when(2 * F.col("most") > F.col("all"), F.col("rubric")).otherwise(F.col("text")).alias("description"))
