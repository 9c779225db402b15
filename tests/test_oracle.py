"""Every value-checked query against its DuckDB oracle (sf0.001), as the gate does."""
import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as E
from postlens.plans import catalog
from conftest import SF_SMALL

TABLES = ["orders", "events", "documents", "pages", "benchmark"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF_SMALL)
    s_rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(catalog.ORACLE[name])
    d_cols = rel.columns
    d_rows = rel.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    s_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString()) for f in df.schema.fields}
    assert s_types == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert _rows(df.columns, s_rows) == _rows(d_cols, d_rows)


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["weekday", "hour", "posts", "weekday_label"]
