"""Queries over documents against their SQL, on texts without words, lines or characters and with odd blanks."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfwise.functions import text as T
from shelfwise.plans import all_queries


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """The smallest tables, with texts that hold no word, no line, no character, or other blanks than spaces, and one that is null."""
    data, folder = Path("/root/testdata/sf0.001"), tmp_path_factory.mktemp("odd")
    for t in data.iterdir():
        if t.name != "documents.parquet":
            (folder / t.name).symlink_to(t)
    docs = spark.read.parquet(str(data / "documents.parquet"))
    texts = ["", None, " ", "\n\t\n", "。。。!!", "日本語 中文\n\n 　", "...\n---", "a|\n|b", "a|　x\t|b", "| \t|", "a|\xa0 |b", "the a. b!the c?\n d the", "7 " * 900 + "a b c d e f g h i j k l m", "1 2 3 " * 60, "a b"]
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("web").alias("source"), F.length("text").alias("n_chars"))
    docs.unionByName(more.select([F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])).coalesce(1).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def plain_rows(rows):
    return sorted(repr([float(f"{v:.9g}") if isinstance(v, (float, Decimal)) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", ["a55_drop_reasons", "a56_quality_tag_counts", "f3_ttr", "f4_char_ratios", "f2_line_features", "p10_normalise_blank", "f16_sentence_context", "f24_repair_json", "f26_is_multi_product", "a66_merged_attributes", "a46_attribute_counts", "a46_brand_counts", "f19_keyword_count", "a78_orphan_report", "w20_low_high_lists"])
def test_odd_texts_equal_sql(spark, odd_tables, name):
    queries, oracles = all_queries()
    c = duckdb.connect()
    for t in ("documents", "lineitem", "orders", "part"):
        c.execute(f"create view {t} as from read_parquet('{odd_tables}/{t}.parquet/*.parquet')" if t == "documents" else f"create view {t} as from read_parquet('{odd_tables}/{t}.parquet')")
    df = queries[name](spark, odd_tables)
    columns = sorted(df.columns)
    want = c.sql(oracles[name]).select(*map(duckdb.ColumnExpression, columns)).fetchall()
    assert plain_rows(df.select(columns).collect()) == plain_rows(want)


def test_ratios_are_rounded_as_sql_rounds(spark):
    """1.00005 and its like lie below the tie as doubles: scaled first, they reach it or don't as in SQL."""
    df = spark.range(1, 4000).select((F.col("id") * 2 + 1).alias("part"), F.lit(20000).alias("whole"))
    got = [r[0] for r in df.orderBy("part").select(T.share(F.col("part"), F.col("whole"))).collect()]
    assert got == [r[0] for r in duckdb.sql("select round((2 * i + 1) / 20000, 4) from range(1, 4000) t(i) order by i").fetchall()]
