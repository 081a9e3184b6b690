"""Every registered query against its independent DuckDB SQL at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from sparkpact.contracts import queries as contract_queries
from sparkpact.operators import registry

from .conftest import DATA, TABLES

NAMES = sorted(registry.ORACLE | contract_queries.oracle_sql())
MAY_BE_EMPTY = {"anti_not_exists", "anti_not_in_null", "json_table_source"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(([cell(r[k]) for k in order] for r in data), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck, name):
    got = entry_module.queries()[name](spark, DATA)
    want = duck.sql(entry_module.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    assert a == b
    assert a or name in MAY_BE_EMPTY


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_contracts_are_true(spark):
    """min <= rows <= max, and a proved non-null column holds no null."""
    actual = {r.statement: r for r in contract_queries.soundness_rows(spark, DATA).collect()}
    for c in contract_queries.contracts_of(spark, DATA):
        seen = actual[c.statement]
        assert c.bounds.min <= seen.n_rows and (c.bounds.max is None or seen.n_rows <= c.bounds.max)
        if c.columns[0].null.kind == "nonNull":
            assert seen.n_nulls == 0


def test_filter_reaches_the_scan(spark):
    plan = registry.QUERIES["pushed_filter_scan"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThan(l_shipdate" in plan
    assert "l_comment" not in plan and "ReadSchema: struct<l_quantity:double,l_returnflag:string,l_shipdate" in plan
