"""Every query of the core over whole small tables, against its SQL where it has one."""

import datetime
import decimal
import os

import duckdb
import pandas as pd
import pytest

from slipworks.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def tables(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return "~"
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 5) + 0.0)
    if isinstance(v, (pd.Timestamp, datetime.datetime)):
        return v.strftime("%Y-%m-%d %H:%M:%S.%f")
    return cell(v.item()) if hasattr(v, "item") else str(v)


def rows(df):
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, tables, name):
    out = QUERIES[name](spark, data).toPandas()
    assert len(out.columns) == len(set(out.columns))
    if name in SQL:
        expected = tables.sql(SQL[name]).df()
        assert sorted(out.columns) == sorted(expected.columns)
        assert rows(out) == rows(expected)
    elif name != "extracted_fields":
        assert not out.duplicated().any() if not out.map(lambda v: isinstance(v, (list, dict)) or hasattr(v, "__len__") and not isinstance(v, str)).any().any() else True


def test_entry_names_all(spark):
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
