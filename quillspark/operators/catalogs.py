"""The accounting catalogs as dimension tables. Fixed values, in their natural order; accounts are text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COST_CENTERS = """
CC0001 Nuevas
CC0002 Usadas
CC0003 Motores
CC0004 Repuestos
CC0005 Servicios
CC0006 Indirectos
CC0007 Agro
CC0008 Chapería
"""

MACRO_CATEGORIES = """
MC01 RRHH
MC02 Movilidad y Representación
MC03 Marketing y Comercial
MC04 Infraestructura y Edificios
MC05 Tecnología y Comunicaciones
MC06 Administración y Oficina
MC07 Operaciones y Logística
MC08 Activos y Mantenimiento
MC09 Servicios Profesionales
MC10 Impuestos y Tasas
MC11 Servicios Generales
MC12 Seguros
MC13 Gastos Financieros
MC14 Pérdidas y Ajustes
MC15 Agricultura
"""

#: Offline signals of each cost centre: code | word beginnings that speak for it | word beginnings that speak against it.
#: Text is compared in lower case without accents.
CENTER_SIGNALS = """
CC0001 | 0 km, cero km, patentamiento, preentrega | usad, repuesto, taller, motor, administra
CC0002 | usad, reacondicionamiento | 0 km, cero km, repuesto, motor, taller
CC0003 | motor, rectificacion | repuesto, vehiculo, maquinaria
CC0004 | repuesto, accesorio, taller, service, neumatico | motor, chaperia
CC0005 | servicio | administra, repuesto, chaperia, agro
CC0006 | viatico, comida, almuerzo, combustible, nafta, peaje, estacionamiento, oficina, computa, software, curso, farmacia, libreria, limpieza, administra, honorario | -
CC0007 | agro, semilla, cosecha, sembradora, tractor | vehiculo, motor, administra
CC0008 | chapa, chaperia, pintura | mecanica, motor, repuesto
"""
#: The centre of last resort, which explicit signals of any other outrank.
DEFAULT_CENTER = "CC0006"

#: Offline signals of each macro category: code | word beginnings that speak for it.
MACRO_SIGNALS = """
MC01 | uniforme, curso, capacitacion, asistencia medica
MC02 | viatico, viaje, combustible, nafta, peaje, regalo, agasajo, almuerzo, comida
MC03 | publicidad, promocion, carteleria, merchandising
MC04 | edificio, alquiler, limpieza, seguridad, luz, agua, gas
MC05 | software, telefon, internet, computa, licencia
MC06 | papeleria, escritorio, resma, libreria
MC07 | material, insumo, herramienta, flete, envio
MC08 | vehiculo, maquinaria, repuesto, service
MC09 | honorario, asesoramiento, legal, escribania
MC10 | impuesto, tasa, sellado
MC12 | seguro, poliza
MC13 | interes, comision, bancari, tarjeta
MC14 | incobrable, faltante
MC15 | semilla, agroquimico, fertilizante
"""
#: Where no signal stands: services, and everything else; the category that one cost centre alone may have, and that centre.
SERVICE_MACRO, OTHER_MACRO, AGRO_MACRO, AGRO_CENTER = "MC11", "MC14", "MC15", "CC0007"

#: Tax conditions, in the order of the code columns below.
CONDITIONS = ("21", "10_5", "27", "2_5", "exento_no_gravado")

#: macro | concept | name | account | final code for each tax condition (- for none, / between several).
CONCEPTS = """
MC01 | CT001 | Indumentaria personal | 4221,05 | 164 | 79 | - | - | -
MC01 | CT002 | Entrenamiento al personal | 4221,07 | 73 | 241 | - | - | 57
MC01 | CT003 | Asistencia médica al personal | 4221,25 | 74 | 54 | - | - | -
MC02 | CT004 | Movilidad y Viáticos | 4221,08 | 7 | 41 | - | - | 42
MC02 | CT005 | Cortesías | 4221,14 | 177 | - | - | - | 178
MC02 | CT006 | Gastos de representación | 4221,34 | 215 | 67 | - | - | 153
MC03 | CT007 | Publicidad | 4221,10 | 44 | 222 | - | 71 | 78
MC04 | CT008 | Mantenimiento edificio | 4221,11 | 53 | 112 | 342 | - | 117
MC04 | CT009 | Alquileres | 4221,24 | 407 | - | - | - | 201
MC04 | CT010 | Luz, agua y gas | 4221,29 | 264 | 328 | - | - | 64
MC04 | CT011 | Limpieza | 4221,30 | 172 | - | - | - | 240
MC04 | CT012 | Seguridad | 4221,35 | 173 | 263 | - | - | 235
MC05 | CT013 | Suscripciones | 4221,19 | 163 | - | - | - | 196
MC05 | CT014 | Teléfono, Correo e Internet | 4221,20 | 24 | - | 65 | - | 66
MC05 | CT015 | Gastos / Servicios de computación | 4221,22 | 13 | 28 | 170 | - | 116
MC06 | CT016 | Papelería y artículos de oficina | 4221,15 | 55 | 181 | - | - | 189
MC07 | CT017 | Materiales, insumos y herramientas | 4221,16 | 48 | 49 | - | - | 50
MC07 | CT018 | Fletes | 4221,13 | 92 | 333 | - | 193 | 194
MC08 | CT019 | Gastos vehículos | 4221,12 | 47 | 397 | - | - | 115
MC08 | CT020 | Mantenimiento maquinarias | 4221,27 | 46 | 135/167 | - | - | 166
MC08 | CT021 | Mantenimiento vehículos en stock | 4221,28 | 45/142 | - | - | - | 191
MC09 | CT022 | Honorarios | 4221,18 | 20 | - | - | - | 76
MC09 | CT023 | Gastos legales | 4221,32 | 21 | 26 | - | - | 133
MC10 | CT024 | Impuestos y tasas | 4221,21 | - | - | - | - | -
MC10 | CT025 | Impuesto Ley 25.413 | 4223,02 | - | - | - | - | -
MC11 | CT026 | Gastos por servicios varios | 4221,23 | 18 | 27 | 111 | 157 | 144
MC12 | CT027 | Seguros | 4221,31 | 307 | - | - | - | 308
MC13 | CT028 | Gastos bancarios | 4223,01 | 108/216 | 152 | - | - | 118/225
MC13 | CT029 | Comisiones tarjetas | 4223,03 | 169 | - | - | - | 312
MC13 | CT030 | Intereses pagados | 4223,04 | 340 | 109 | - | - | -
MC13 | CT031 | Intereses financiación | 4223,05 | 336 | 102/242 | - | - | 151
MC13 | CT032 | Diferencia de cambio | 4221,33 | 68/93 | 99 | - | - | 195/221
MC14 | CT033 | Incobrables | 4221,36 | - | - | - | - | -
MC14 | CT034 | Faltantes de caja | 4223,99 | - | - | - | - | -
MC14 | CT035 | Gastos varios | 4221,99 | 12 | 162 | - | - | 62
MC15 | CT036 | Semillas | 4221,90 | 126 | - | - | - | -
MC15 | CT037 | Agroquímicos | 4221,91 | - | 218 | - | 219 | -
"""


def _pairs(text: str) -> list[tuple[str, str]]:
    return [tuple(line.split(" ", 1)) for line in text.strip().splitlines()]


def signal_rows(text: str) -> list[tuple[str, str, str | None]]:
    """(code, pattern for, pattern against) of a table of signals: any of its word beginnings, at the start of a word."""
    pattern = lambda words: "(^|[^a-z0-9])(" + "|".join(words.split(", ")) + ")"
    rows = [line.split(" | ") for line in text.strip().splitlines()]
    return [(r[0], pattern(r[1]), pattern(r[2]) if len(r) > 2 and r[2] != "-" else None) for r in rows]


def concept_rows() -> list[list[str]]:
    return [line.split(" | ") for line in CONCEPTS.strip().splitlines()]


def cell_rows() -> list[tuple[str, str, str | None]]:
    """(concept, condition, cell) of all cells, null where there is no code."""
    return [(r[1], c, None if v == "-" else v) for r in concept_rows() for c, v in zip(CONDITIONS, r[4:], strict=True)]


def cost_centers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_pairs(COST_CENTERS), "cost_center string, name string")


def macro_categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_pairs(MACRO_CATEGORIES), "macro_category string, name string")


def concepts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([r[:4] for r in concept_rows()], "macro_category string, concept string, concept_name string, account string")


def code_cells(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(cell_rows(), "concept string, tax_condition string, cell string")


def values_sql(rows: list, columns: str) -> str:
    """The rows as a VALUES table of SQL."""
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") AS v({columns}))"
