"""Every registered query runs at sf0.001 and agrees with its DuckDB oracle."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001
from pairloom.plans.catalog import QUERIES
from pairloom.plans.oracle import ORACLE_SQL as ORACLE
from pairloom.session import TABLES


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    return con


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 1
    assert df.columns == ["pair_id", "lang", "src_raw", "tgt_raw", "n_src", "n_tgt", "dist", "ratio"]


def test_entry_registers_every_query():
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


def test_every_query_has_an_oracle():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == set()


TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "array<int>": "INTEGER[]", "array<bigint>": "BIGINT[]", "array<string>": "VARCHAR[]"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF001)
    got = rows_of(df.columns, df.collect())
    rel = duck.sql(ORACLE[name])
    exp = rows_of(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns)
    # same column types on both engines, not only the same values
    duck_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    for f in df.schema.fields:
        assert TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) == duck_types[f.name], f.name
    assert got == exp
