"""Edge tables of the product graph: (src, dst, kind, weight)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(df: DataFrame, src: Column, dst: Column, kind: str, weight: Column) -> DataFrame:
    return df.select(src.cast("string").alias("src"), dst.cast("string").alias("dst"), F.lit(kind).alias("kind"), weight.cast("double").alias("weight"))


def item_type_edges(promo: DataFrame) -> DataFrame:
    counts = promo.groupBy("item_code", "promo_type").agg(F.count("*").alias("n"))
    return edges(counts, F.col("item_code"), F.col("promo_type"), "IN_PROMO", F.col("n"))


def category_type_edges(cells: DataFrame, totals: DataFrame, gini: DataFrame, category: str) -> DataFrame:
    """Items of the pair over the category's promoted items, times one less the Gini of events per item."""
    joined = cells.join(totals, category).join(gini, category)
    return edges(joined, F.col(category), F.col("promo_type"), "CATEGORY_PROMO", F.round(F.col("n_pair") / F.col("n_items") * (1 - F.col("gini")), 6))


def distinct_edges(df: DataFrame, src: str, dst: str, kind: str) -> DataFrame:
    return edges(df.select(src, dst).dropna().distinct(), F.col(src), F.col(dst), kind, F.lit(1.0))


def keyword_edges(rows: DataFrame, src: str, entries: Column, kind: str) -> DataFrame:
    exploded = rows.select(src, F.explode(entries).alias("_k")).distinct()
    return edges(exploded, F.col(src), F.col("_k"), kind, F.lit(1.0))


def allowed_attributes(rows: DataFrame, entries: Column, vocabulary: Sequence[str]) -> DataFrame:
    """Keywords that a fixed vocabulary has; the vocabulary is as long as the caller's list."""
    words = rows.sparkSession.createDataFrame([(w,) for w in vocabulary], "keyword string")
    return rows.select("ord", F.explode(entries).alias("keyword")).join(F.broadcast(words), "keyword", "left_semi")
