"""Every query against its SQL, on the smallest tables."""

import decimal

import duckdb
import pytest

from quillspark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_sql(spark, small, con, name):
    got = catalog.QUERIES[name](spark, small)
    cols = ", ".join(f'"{c}"' for c in got.columns)
    want = con.sql(f"select {cols} from ({catalog.ORACLE_SQL[name]})").fetchall()
    plain = lambda row: tuple(str(decimal.Decimal(v)) if isinstance(v, decimal.Decimal) else v for v in row)
    assert sorted(map(str, map(plain, map(tuple, got.collect())))) == sorted(map(str, map(plain, want)))
    assert want


def test_entry_registers_all(spark, small):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
