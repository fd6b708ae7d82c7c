"""Inputs that are read once, and columns that Python doesn't get."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import aggregates as A
from shelfwise.operators import joins as J
from shelfwise.operators import windows as W
from shelfwise.plans.promo import a45_season_counts, j13_unmatched_mentions, w15_best_match
from shelfwise.sources.tables import promotions, sales_lines
from shelfwise.streaming import incremental as I


@pytest.mark.parametrize("job", [lambda df: W.rank_correlation(df, "x", "y"), lambda df: A.distribution(df, "x", {"m": 0.5}), lambda df: A.anomaly_report(df, ["d"], ["x", "y"], ["t"])], ids=["rank_correlation", "distribution", "anomaly_report"])
def test_input_is_computed_once(spark, job):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(0, 100, 1, 2).select(F.col("id").alias("x"), (F.col("id") % 7).alias("y"), F.lit("2020-01-01").cast("date").alias("d"), F.lit("-").alias("t"))
    assert job(df.mapInArrow(count, df.schema)).collect()
    assert seen.value == 100


def test_reextract_hands_on_what_is_asked_for(spark, tmp_path):
    def fn(batches):
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "result": ["+".join(b.columns)] * len(b)})

    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, text string, other string")
    got = I.reextract(rows, F.lit(True), str(tmp_path / "store"), "k", 1, fn, "other", ["text"]).collect()
    assert sorted((r["k"], r["old_other"], r["other"]) for r in got) == [(1, "x", "k+text"), (2, "y", "k+text")]


def test_seasons_are_looked_for_once(spark):
    plan = a45_season_counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("harvest") == 2  # the words of the names, and one search


@pytest.mark.parametrize("query", [j13_unmatched_mentions, w15_best_match])
def test_mentions_are_computed_once(spark, query):
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan  # the lines aren't joined again


def test_repeated_ranges_stay_once(spark):
    rows = [("a", "n", "2020-01-01", "2020-01-09"), ("b", "n", "2020-01-01", "2020-01-20"), ("c", "n", "2020-01-03", "2020-01-05")]
    ranges = spark.createDataFrame(rows * 3, "event_code string, event_name string, s string, e string").select("event_code", "event_name", F.to_date("s").alias("start_date"), F.to_date("e").alias("end_date"))
    assert sorted(r["event_code"] for r in J.foremost_ranges(ranges, ["event_name"]).collect()) == ["a", "b"]


@pytest.mark.parametrize("source", [sales_lines, promotions])
def test_lines_are_not_sorted_to_meet_their_orders(spark, source):
    with_limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        found = source(spark, "/root/testdata/sf0.001")
        plan = found._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_limit)
    join = next(x for x in plan.splitlines() if "l_orderkey" in x and "Join" in x)
    assert "ShuffledHashJoin" in join and "BuildRight" in join
