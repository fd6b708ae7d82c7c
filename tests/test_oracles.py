"""Every registered query against its DuckDB SQL on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from shelfwise.plans import all_queries

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.sql(f"create view {t} as from read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float):
        return repr(v) if math.isnan(v) or math.isinf(v) else float(f"{v:.9g}")
    return v


def rows(found):
    return sorted(repr([plain(v) for v in r]) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = df.select([f"`{c}`" for c in columns]).collect()
    if name not in ORACLES:
        assert got
        return
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    assert rows(got) == rows(want.select(*map(duckdb.ColumnExpression, columns)).fetchall())


def test_each_query_has_its_operator_number():
    assert all(n.split("_")[0][0] in "spjawmfgt" and n.split("_")[0][1:].isdigit() for n in QUERIES)
