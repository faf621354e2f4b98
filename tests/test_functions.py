import datetime
import decimal
import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import jsonx, text

CASES = [
    (text.strip, "  a b \t\n", "a b"), (text.tax_id, "20-1 Ing, Brutos", "20-1"), (text.tax_id, "Ing", None), (text.repair_zero, "ROSARI0 100", "ROSARIO 100"), (text.snake_key, "Alícuota 21%", "alicuota_21"),
    (text.compact_date, "05/03/2024", "20240305"), (text.compact_date, "2024-03-05", "2024-03-05"), (text.iso_date, "31/02/2024", None), (text.iso_date, "05/03/2024", datetime.date(2024, 3, 5)),
    (text.repair_zero, "CC0007 MC01 A0 N0 100 ROSARI0 n0rte C00PERATIVA C000", "CC0007 MC01 A0 N0 100 ROSARIO norte COOPERATIVA C000"), (text.amount, "$ 1.234", decimal.Decimal("1234.00")), (text.amount, "1.234.567", decimal.Decimal("1234567.00")), (text.amount, "1,234", decimal.Decimal("1234.00")),
    (text.amount, "0.125", decimal.Decimal("0.13")), (text.amount, "1234.567", decimal.Decimal("1234.57")), (text.amount, "1.234.567,8", decimal.Decimal("1234567.80")), (text.amount, "12", decimal.Decimal("12.00")), (text.amount, "-1,5", decimal.Decimal("-1.50")), (text.amount, "1,234,567.8", decimal.Decimal("1234567.80")),
    (jsonx.strict_json, '{"a": "\\ud800"}', '{"a": "\\ud800"}'),
    (text.amount, "$ 1.234,50", decimal.Decimal("1234.50")), (text.amount, "1,234.75", decimal.Decimal("1234.75")), (text.amount, "none", None), (text.currency, "U$S 3", "USD"), (text.currency, "3", "ARS"),
    (text.suffix, "a.b/c.tar.GZ", ".GZ"), (text.suffix, "a.b/c", ""), (text.suffix, "x/.env", ""), (text.stem, "a/b.c.md", "b.c"), (text.header_letter, "FACTURA  B", "B"), (text.header_letter, "RECIBO X", None),
    (text.document_kind, "Nota de crédito A", "Nota de Crédito"), (text.document_kind, "FACTURA", "Factura"), (text.ellipsis, "x" * 81, "x" * 80 + "..."), (text.ellipsis, "x" * 80, "x" * 80),
    (lambda c: text.invoice_number(c)[0], "00001-00000031", 1), (lambda c: text.invoice_number(c)[1], " 00001 - 00000031 ", 31), (lambda c: text.invoice_number(c)[1], "1/31", None),
    (jsonx.json_block, 'x {"a": 1}\n y', '{"a": 1}'), (jsonx.json_block, "none", None), (jsonx.json_block, '{"a": "b" v"\n}', '{"a": "b"\n}'),
    (lambda c: jsonx.strict_json(jsonx.json_block(c)), '{"a": 1, "a": 2}', '{"a": 2}'), (lambda c: jsonx.strict_json(jsonx.json_block(c)), '{"a": 1} and {"b": 2}', None), (lambda c: jsonx.strict_json(jsonx.json_block(c)), '{"a": "é"}', '{"a": "é"}'),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_vectors(spark, i):
    fn, value, want = CASES[i]
    df = spark.createDataFrame([(value,), (None,)], "v string")
    got = df.select(fn(F.col("v")).alias("x")).collect()
    assert got[0]["x"] == want and got[1]["x"] in (None, "ARS", False, "Factura")


def test_recovery_of_replies(spark):
    rows = [('x {"a": 1} y',), ("none",), ('{"a": 1} {"b": 2}',), ('{"a": "\\ud800"}',), (None,)]
    got = spark.createDataFrame(rows, "v string").select(jsonx.recover("v").alias("g")).select("g.*").collect()
    assert [tuple(r) for r in got] == [('{"a": 1}', None), (None, "no JSON object in reply: none"), (None, "invalid JSON object in reply"), ('{"a": "\\ud800"}', None), (None, "no JSON object in reply: ")]


def test_json_strings_and_objects(spark):
    df = spark.createDataFrame([('a"b\\\n',), (None,)], "v string")
    assert [json.loads(r[0]) for r in df.select(jsonx.json_string("v")).collect()] == ['a"b\\\n', None]
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (('k"1', "x\ty"), ("a", "é"))])
    assert json.loads(df.select(jsonx.json_object(entries)).first()[0]) == {'k"1': "x\ty", "a": "é"}


def test_filling_order(spark):
    df = spark.createDataFrame([("{{b}}", "B")], "a string, b string")
    values = {"a": F.col("a"), "b": F.col("b")}
    r = df.select(text.fill("{{a}} {{c}}", values).alias("x"), text.fill_once("{{a}} {{c}}", values).alias("y")).first()
    assert (r["x"], r["y"]) == ("B {{c}}", "{{b}} {{c}}")
