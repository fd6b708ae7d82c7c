"""The SQL of the training-data queries against the queries, and against odd rows."""

import duckdb
import pytest

from shelfwise.llm import queries

ODD = [(1, "A b c d"), (2, "a  B\nc d"), (3, ""), (4, None), (5, " \t"), (6, "two words"), (7, "Two Words"), (8, "a<P>b"), (9, "naïve 猫 text"), (9, "naïve 猫 text"), (10, "x " * 500)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("data", ["/root/testdata/sf0.001", "odd", "empty"])
def test_query_equals_sql(spark, tmp_path, name, data):
    folder = data if data.startswith("/") else str(tmp_path)
    if folder == str(tmp_path):
        spark.createDataFrame(ODD if data == "odd" else [], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    c = duckdb.connect()
    files = f"{folder}/documents.parquet" if data.startswith("/") else f"{folder}/documents.parquet/*.parquet"
    c.sql(f"create view documents as from read_parquet('{files}')")
    want = c.sql(queries.ORACLE_SQL[name])
    found = queries.QUERIES[name](spark, folder)
    assert sorted(want.columns) == sorted(found.columns)
    order = sorted(found.columns)
    assert sorted((tuple(r) for r in found.select(order).collect()), key=repr) == sorted(want.select(*map(duckdb.ColumnExpression, order)).fetchall(), key=repr)
