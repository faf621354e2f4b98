"""Typed answers of the extraction steps and the faults that an answer shows against its own rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.operators.rules import option_check

# The keys of each answer, in order, with their types.
GENERIC = "tipo_documento string, resumen string, proveedor string, monto decimal(18,2)"
INVOICE = (
    "comprobante_valido boolean, motivo_rechazo string, tipo_comprobante string, razon_social_emisor string, cuit_emisor string, fecha_emision date, nro_comprobante string, moneda string, "
    "subtotal decimal(18,2), iva decimal(18,2), impuestos_internos decimal(18,2), percepcion_iibb decimal(18,2), otros_impuestos decimal(18,2), monto_no_gravado decimal(18,2), importe_total_facturado decimal(18,2), "
    "descripcion string, condicion_impositiva_dominante string, alicuotas_detectadas string, categoria_gasto string, notas string, cantidad_comensales_personas int, cantidad_litros double, centro_de_costo string"
)
CENTERS = "centros_costos array<struct<codigo_centro_costo:string,centro:string,confianza:string,senal_usada:string,justificacion:string>>"
MACROS = "macro_categorias array<struct<macro_categoria:string,nombre:string,confianza:string,criterio_inferido:boolean,justificacion:string>>"
CONCEPT = (
    "macro_categoria string, concepto string, nombre_concepto string, cuenta_contable string, condicion_impositiva string, codigo_final string, candidatos_codigo_final array<string>, "
    "requiere_revision_humana boolean, confianza string, criterio_inferido boolean, justificacion string"
)
NESTED = (
    "control_calidad struct<comprobante_valido:boolean,motivo_rechazo:string,categoria_gasto:string>, "
    "emisor struct<razon_social:string,cuit_emisor:string,domicilio_fiscal:string>, "
    "comprobante struct<tipo_comprobante:string,fecha_emision:string,nro_comprobante:string,centro_de_costo:string>, "
    "financiero struct<moneda:string,subtotal_neto:decimal(18,2),impuestos:struct<iva_21:decimal(18,2),iva_105:decimal(18,2),iva_otras_alicuotas:decimal(18,2),impuestos_internos:decimal(18,2),percepcion_iibb:decimal(18,2),otros_impuestos:decimal(18,2)>,monto_no_gravado:decimal(18,2),importe_total_facturado:decimal(18,2),monto_total_transaccion_final:decimal(18,2)>, "
    "datos_especificos_rubro struct<cantidad_comensales_personas:int,cantidad_litros_combustible:decimal(18,2)>, "
    "auditoria_interna struct<notas:string,descuadre_detectado:boolean>"
)
# What allows a head count and litres.
WITH_PEOPLE = ("Restaurante", "Supermercado", "Hospedaje")
WITH_LITRES = "Combustible"


def keys(schema: str) -> list[str]:
    depth, names, start = 0, [], 0
    for i, c in enumerate(schema + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            names.append(schema[start:i].split()[0])
            start = i + 1
    return names


def typed(response: Column, schema: str) -> Column:
    """The answer as a structure; a value that doesn't fit its type is null, and so is an answer that is no object."""
    return F.when(F.json_object_keys(response).isNotNull(), F.from_json(response, schema))


def missing_keys(response: Column, schema: str) -> Column:
    """Keys of the schema that the answer lacks, in order; all of them if it is no object."""
    found = F.coalesce(F.json_object_keys(response), F.array().cast("array<string>"))
    return F.array_except(F.array(*map(F.lit, keys(schema))), found)


def extra_keys(response: Column, schema: str) -> Column:
    return F.array_except(F.coalesce(F.json_object_keys(response), F.array().cast("array<string>")), F.array(*map(F.lit, keys(schema))))


def open_map(response: Column) -> Column:
    """Every key of a flat answer, as text."""
    return F.from_json(response, "map<string,string>")


def generic_faults(response: Column) -> Column:
    """What a flat answer breaks, in order: keys it lacks, values that are no single ones, dates, identifiers and amounts not in normal form."""
    entries = F.coalesce(F.map_entries(open_map(response)), F.array().cast("array<struct<key:string,value:string>>"))
    bad = lambda name, test: F.transform(F.filter(entries, lambda e: F.coalesce(test(e["key"], e["value"]), F.lit(False))), lambda e: F.concat(F.lit(name + ":"), e["key"]))
    lacking = F.transform(missing_keys(response, GENERIC), lambda k: F.concat(F.lit("falta:"), k))
    return F.concat(
        lacking,
        bad("anidado", lambda k, v: v.rlike(r"^\s*[\[{]")),
        bad("fecha", lambda k, v: k.startswith("fecha") & ~v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")),
        bad("id", lambda k, v: k.rlike("^(cuit|cuil)") & ~v.rlike(r"^[0-9-]+$")),
        bad("monto", lambda k, v: k.startswith("monto") & ~v.rlike(r"^-?[0-9]+(\.[0-9]+)?$")),
    )


def nested(response: Column) -> Column:
    """The older answer in six blocks; one person and no litres where it names none, and the final total from its parts."""
    a = typed(response, NESTED)
    money, special = a["financiero"], a["datos_especificos_rubro"]
    zero = lambda c: F.coalesce(c, F.lit(0).cast("decimal(18,2)"))
    final = F.coalesce(money["monto_total_transaccion_final"], (money["importe_total_facturado"] + zero(money["monto_no_gravado"])).cast("decimal(18,2)"))
    people = special.withField("cantidad_comensales_personas", F.coalesce(special["cantidad_comensales_personas"], F.lit(1))).withField("cantidad_litros_combustible", zero(special["cantidad_litros_combustible"]))
    none = F.struct(F.lit(1).alias("cantidad_comensales_personas"), F.lit(0).cast("decimal(18,2)").alias("cantidad_litros_combustible"))
    full = a.withField("datos_especificos_rubro", F.coalesce(people, none)).withField("financiero", money.withField("monto_total_transaccion_final", final))
    return F.when(a.isNotNull(), full)


def with_defaults(given: dict[str, Column], defaults: Column, zero_counts: tuple[str, ...] = ()) -> dict[str, Column]:
    """Request fields: what is given, else the default of the same key in a JSON object. An empty text or a zero counts as not given, but for the fields of zero_counts."""
    out = {}
    for name, value in given.items():
        text = value.cast("string")
        there = value.isNotNull() if name in zero_counts else value.isNotNull() & (text != "") & ~F.coalesce(text.try_cast("double") == 0, F.lit(False))
        out[name] = F.when(there, text).otherwise(F.get_json_object(defaults, f"$.{name}"))
    return out


def invoice_faults(a: Column) -> Column:
    """Rules that a typed invoice answer breaks, in order."""
    is_a = a["tipo_comprobante"] == "A"
    no = lambda c: F.coalesce(c, F.lit(False))
    people, litres, rate = a["cantidad_comensales_personas"].isNotNull(), a["cantidad_litros"].isNotNull(), a["condicion_impositiva_dominante"].isNotNull()
    return F.array_compact(F.array(
        F.when(no(~is_a & (a["subtotal"] != a["importe_total_facturado"])), "subtotal"),
        F.when(no(~is_a & (a["iva"] != 0)), "iva"),
        F.when(no(~is_a) & rate, "condicion_impositiva"),
        F.when(rate & a["alicuotas_detectadas"].isNull(), "alicuotas"),
        F.when(people & ~no(a["categoria_gasto"].isin(*WITH_PEOPLE)), "personas"),
        F.when(litres & ~no(a["categoria_gasto"] == WITH_LITRES), "litros"),
        F.when(a["centro_de_costo"].isNotNull(), "centro_de_costo"),
        F.when(~no(a["comprobante_valido"]) & a["motivo_rechazo"].isNull(), "motivo_rechazo"),
        F.when(a["cuit_emisor"].isNotNull() & ~no(a["cuit_emisor"].rlike(r"^[0-9-]+$")), "cuit"),
    ))


def check_invoices(answers: DataFrame) -> DataFrame:
    """answers (doc_id, response) with the faults of each: missing and extra keys, then rules."""
    a = F.col("answer")
    got = answers.withColumn("answer", typed(F.col("response"), INVOICE))
    return got.withColumns({"missing": missing_keys(F.col("response"), INVOICE), "extra": extra_keys(F.col("response"), INVOICE), "faults": F.when(a.isNotNull(), invoice_faults(a))})


def ranked_fault(response: Column, schema: str, catalog: tuple[str, ...]) -> Column:
    """option_check of a ranked answer given as text."""
    name, code = keys(schema)[0], schema.split("struct<")[1].split(":")[0]
    return option_check(typed(response, schema)[name], catalog, code)
