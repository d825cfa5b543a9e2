"""Every query of the subpackage over whole small tables, against its SQL where it has one."""

import os

import duckdb
import pytest

from slipworks.llm import oracle, queries

QUERIES, SQL = queries.queries(), oracle.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    out = QUERIES[name](spark, data).toPandas()
    assert len(out) or name in ("p6_found", "p6_report", "p4_found")
    keys = [c for c in out.columns if c != "ids"]
    assert not out[keys].duplicated().any()
    if name in SQL:
        con = duckdb.connect()
        for f in os.listdir(data):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
        expected = con.sql(SQL[name]).df()
        assert sorted(map(tuple, out[sorted(out.columns)].astype(str).values)) == sorted(map(tuple, expected[sorted(expected.columns)].astype(str).values))


def test_found_columns(spark, data):
    expected = {
        "p1_found": ["src string", "row_key string", "merchant_id string"], "p2_found": ["src string", "row_key bigint"], "p3_found": ["image_id string", "root_id string"],
        "p4_found": ["group_id string"], "p5_found": ["receipt_a string", "receipt_b string"], "p6_found": ["image_a string", "image_b string"],
        "p8_ids": ["doc_id bigint", "ids array<int>"], "p10_found": ["doc_id bigint", "level int"],
    }
    for name, columns in expected.items():
        assert [f"{c} {t}" for c, t in QUERIES[name](spark, data).dtypes] == columns
