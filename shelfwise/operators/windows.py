"""Rankings and concentration: Pareto, top shares, Lorenz, Gini, ranks.

Lines are summed to items first, so windows see items, not lines. Every running sum is over
ROWS with the item code as tie-break.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.ordering import grouped_percentiles, grouped_prefix_sums, percentiles, prefix_sums, value_ranks
from shelfwise.sources.files import written

ROWS = (Window.unboundedPreceding, Window.currentRow)


def item_sales(lines: DataFrame, items: DataFrame, keep_all: bool = False) -> DataFrame:
    """(item_code, item_name, cat_l, cat_m, cat_s, amount, qty) per item sold."""
    total = lines.groupBy("item_code").agg(F.sum("amount").alias("amount"), F.sum("qty").alias("qty"))
    return total.join(items, "item_code", "left" if keep_all else "inner")


def ranked_shares(sales: DataFrame, category: str, measure: str = "amount") -> DataFrame:
    """Adds rn, n, total, cum_pct within the category, largest first. A category of any size is dealt to several tasks."""
    step = grouped_prefix_sums(sales, category, [F.desc(measure), "item_code"], rn=F.lit(1), _run=F.col(measure))
    named = step.withColumnsRenamed({"total_rn": "n", "total__run": "total"}).withColumn("rn", F.col("rn").cast("int"))
    return named.withColumn("cum_pct", F.try_divide(100.0 * F.col("_run"), "total")).drop("_run")


def pareto_by_category(sales: DataFrame, category: str, cut: float = 80, least_items: int = 5, floor: int = 0, measure: str = "amount") -> DataFrame:
    """Per category with enough items and sales: items up to the cut, their share, the top 20 % share."""
    r = ranked_shares(sales, category, measure).filter((F.col("n") >= least_items) & (F.col("total") > 0))
    top = F.greatest(F.lit(1), F.floor(0.2 * F.col("n")))
    agg = r.groupBy(category).agg(F.max("n").alias("n_items"), F.greatest(F.lit(floor), F.count_if(F.col("cum_pct") <= cut)).alias("n_cut"), F.max("total").alias("total"), F.sum(F.when(F.col("rn") <= top, F.col(measure))).alias("_top"))
    return agg.select(category, "n_items", "n_cut", F.round(100 * F.col("n_cut") / F.col("n_items"), 2).alias("pct_items"), "total", F.round(100 * F.col("_top") / F.col("total"), 2).alias("top20_share"))


def pareto_names(sales: DataFrame, category: str, cut: float = 80.5, names: int = 10, measure: str = "amount") -> DataFrame:
    """As pareto_by_category with one item at least, and the first names in order."""
    r = ranked_shares(sales, category, measure).filter("total > 0")
    kept = r.filter((F.col("cum_pct") <= cut) | (F.col("rn") == 1))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("rn") <= names, F.struct("rn", "item_name")))), lambda x: x["item_name"]), ", ")
    return kept.groupBy(category).agg(F.max("n").alias("n_items"), F.count("*").alias("n_cut"), F.round(F.max("cum_pct"), 2).alias("reached_pct"), listed.alias("names"))


def top80_items(sales: DataFrame, category: str, cut: float = 80.5, measure: str = "amount") -> DataFrame:
    """The items themselves: up to the cut, and always the first."""
    r = ranked_shares(sales, category, measure).filter("total > 0")
    return r.filter((F.col("rn") == 1) | (F.col("cum_pct") <= cut)).select(category, "item_code", "item_name", measure, "rn", F.round("cum_pct", 2).alias("cum_pct"))


def top_share_items(sales: DataFrame, category: str, share: float = 0.2, measure: str = "amount") -> DataFrame:
    """The first max(1, int(share x n)) items of each category."""
    r = ranked_shares(sales, category, measure)
    return r.filter(F.col("rn") <= F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("n")))).select(category, "item_code", measure, "rn", "n", "total")


def top_quantile_items(sales: DataFrame, q: float = 0.95, measure: str = "amount") -> DataFrame:
    """Items at or above the quantile over all (linear interpolation), one row of the quantile joined back."""
    edge = percentiles(sales, [measure], [q]).select(F.get(measure, F.lit(0)).alias("edge"))
    return sales.join(F.broadcast(edge), F.col(measure) >= F.col("edge"))


def top_quantile_by(sales: DataFrame, category: str, q: float = 0.95, least_items: int = 1, measure: str = "amount") -> DataFrame:
    """Per category: items at or above its quantile, their number and share."""
    edges = grouped_percentiles(sales, category, measure, [q]).select(category, F.get("percentiles", F.lit(0)).alias("edge"))
    totals = sales.groupBy(category).agg(F.sum(measure).alias("total"), F.count("*").alias("n")).filter(F.col("n") >= least_items)
    kept = sales.join(edges.join(totals, category), category).filter(F.col(measure) >= F.col("edge"))
    return kept.groupBy(category).agg(F.count("*").alias("n_top"), F.max("n").alias("n_items"), F.round(100 * F.sum(measure) / F.max("total"), 2).alias("share"))


def lorenz(sales: DataFrame, measure: str = "amount") -> DataFrame:
    """Every item's rank, item share and cumulative share over all, largest first, ties by item code."""
    totals = F.broadcast(sales.agg(F.count("*").alias("n"), F.sum(measure).alias("total")))
    r = prefix_sums(sales.select("item_code", measure), [F.desc(measure), "item_code"], rn=F.lit(1), run=F.col(measure)).join(totals)
    return r.select("item_code", measure, F.col("rn").cast("int").alias("rn"), F.round(100.0 * F.col("rn") / F.col("n"), 4).alias("item_pct"), F.round(F.try_divide(100.0 * F.col("run"), "total"), 4).alias("cum_pct"))


def lorenz_summary(sales: DataFrame, measure: str = "amount", share: float = 20.0) -> DataFrame:
    curve = lorenz(sales, measure)
    return curve.filter(F.col("item_pct") <= share).agg(F.count("*").alias("n_items"), F.max("cum_pct").alias("share_reached"))


def rank_in_category(sales: DataFrame, category: str, n: int = 10) -> DataFrame:
    rank = F.dense_rank().over(Window.partitionBy(category).orderBy(F.desc("qty")))
    return sales.withColumn("rank", rank).filter(F.col("rank") <= n)


def main_categories(ranked: DataFrame, category: str, n: int) -> DataFrame:
    return ranked.groupBy(category).agg(F.sum("qty").alias("qty")).orderBy(F.desc("qty"), category).limit(n)


def longtail_rank(items: DataFrame, level: str) -> DataFrame:
    """Categories by item count, with rank and cumulative ratio. One ordering over categories."""
    counts = items.groupBy(level).agg(F.count("*").alias("n"))
    order = Window.orderBy(F.desc("n"), level)
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(level, "n", F.row_number().over(order).alias("rank"), F.round(F.sum("n").over(order.rowsBetween(*ROWS)) / total, 6).alias("cum_ratio"))


def label_index(items: DataFrame, column: str) -> DataFrame:
    """A number from 0 for each distinct value in order."""
    numbered = prefix_sums(items.select(column).dropna().distinct(), [column], label=F.lit(1))
    return numbered.withColumn("label", (F.col("label") - 1).cast("int"))


def top_k_per_group(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


def dedupe_keep_first(df: DataFrame, key: str, order: str, drop_null: bool = False) -> DataFrame:
    rows = df.filter(F.col(key).isNotNull()) if drop_null else df
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_rn = 1").drop("_rn")


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each stratum, the first by a hash of the key and the seed."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws(":", key, F.lit(seed)).cast("binary")), key)
    return df.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n).drop("_rn")


def outliers(df: DataFrame, columns: list[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Rows outside both percentiles in every one of the columns."""
    edges = percentiles(df, columns, [low, high]).select(*[F.get(c, F.lit(i)).alias(f"_{c}_{i}") for c in columns for i in (0, 1)])
    joined = df.join(F.broadcast(edges))
    for c in columns:
        joined = joined.filter((F.col(c) < F.col(f"_{c}_0")) | (F.col(c) > F.col(f"_{c}_1")))
    return joined.select(df.columns)


def gini_by_group(counts: DataFrame, group: str, measure: str = "x") -> DataFrame:
    """2 sum(i x) / (n sum(x)) - (n + 1) / n with ranks from the smallest; null for a zero total."""
    ranked = grouped_prefix_sums(counts, group, [measure, "item_code"], _i=F.lit(1))
    g = ranked.groupBy(group).agg(F.sum(F.col("_i") * F.col(measure)).alias("_s"), F.sum(measure).alias("_t"), F.count("*").alias("n"), F.max(measure).alias("max_x"), F.round(F.avg(measure), 4).alias("mean_x"))
    value = F.try_divide(2 * F.col("_s"), F.col("n") * F.col("_t")) - (F.col("n") + 1) / F.col("n")
    return g.select(group, "n", "max_x", "mean_x", F.round(value, 4).alias("gini"))


def rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman: Pearson's coefficient of average ranks. Distinct values are ranked and joined back; rows with a null are left out."""
    rows = written(df.select(F.col(x).alias("x"), F.col(y).alias("y")).filter("x is not null and y is not null"))  # read for either rank and for the join
    rank = lambda c: value_ranks(rows, c).select(F.col("value").alias(c), (F.col("upto") - (F.col("n") - 1) / 2).alias(f"r{c}"))
    return rows.join(rank("x"), "x").join(rank("y"), "y").agg(F.round(F.corr("rx", "ry"), 6).alias("spearman"))


def topk_disagreement(df: DataFrame, x: str, y: str, k: int, key: str = "item_code") -> DataFrame:
    """Keys among the first k by x but not by y."""
    a = df.orderBy(F.desc(x), key).limit(k).select(key)
    b = df.orderBy(F.desc(y), key).limit(k).select(key)
    return a.join(b, key, "left_anti").agg(F.count("*").alias("n_changed"))
