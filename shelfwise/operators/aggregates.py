"""Profiles, baskets, launches, promotions, seasons and text statistics as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.joins import RECEIPT, range_join
from shelfwise.operators.ordering import grouped_prefix_sums, grouped_running_max, percentiles
from shelfwise.sources.files import written

# Fixed values.
PLACEHOLDERS = ["-", "N/A", "n/a", "없음", "미정", "0", "미분류", "null", "NULL", "?", "."]


def pct(part: Column, whole: Column, scale: int = 2) -> Column:
    return F.round(F.try_divide(100 * part, whole), scale)


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts if n is None else counts.orderBy(F.desc("n"), column).limit(n)


def share_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts with their percentage of all rows; the window runs over the counted values."""
    return value_counts(df, column).withColumn("pct", pct(F.col("n"), F.sum("n").over(Window.partitionBy())))


def column_profile(df: DataFrame) -> DataFrame:
    """Nulls, their percentage and distinct values per column: one aggregate over all, then a row per column."""
    aggs = [F.count("*").alias("_n")]
    for c in df.columns:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}|nulls"), F.countDistinct(c).alias(f"{c}|distinct")]
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}|nulls`").alias("nulls"), F.col(f"`{c}|distinct`").alias("n_distinct")) for c in df.columns]
    return df.agg(*aggs).select("_n", F.explode(F.array(*rows)).alias("r")).select("r.*", pct(F.col("r.nulls"), F.col("_n")).alias("null_pct"))


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    rows = [F.struct(F.lit(c).alias("column"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), F.count_if(F.col(c) < 0).alias("n_negative")) for c in columns]
    return df.agg(F.array(*rows).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def format_errors(df: DataFrame, lengths: dict[str, int]) -> DataFrame:
    rows = [F.struct(F.lit(c).alias("column"), F.count_if(F.length(c) != n).alias("n_wrong")) for c, n in lengths.items()]
    return df.agg(F.array(*rows).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def anomaly_report(df: DataFrame, dates: Sequence[str], numbers: Sequence[str], texts: Sequence[str], years: tuple[int, int] = (2010, 2026)) -> DataFrame:
    """Dates outside the years; zero, negative and extreme (over ten times the 99th percentile) numbers; placeholder strings."""
    stored = written(df.select(*dict.fromkeys([*dates, *numbers, *texts])))  # read for each number and for the report
    edges = percentiles(stored, numbers, [0.99]).select(*[F.get(c, F.lit(0)).alias(f"_q_{c}") for c in numbers])
    joined = stored.join(F.broadcast(edges))
    rows = [F.struct(F.lit(c).alias("column"), F.lit("date").alias("kind"), F.count_if(~F.year(c).between(*years)).alias("n")) for c in dates]
    rows += [F.struct(F.lit(c).alias("column"), F.lit("number").alias("kind"), F.count_if((F.col(c) <= 0) | (F.col(c) > 10 * F.col(f"_q_{c}"))).alias("n")) for c in numbers]
    rows += [F.struct(F.lit(c).alias("column"), F.lit("text").alias("kind"), F.count_if(F.col(c).isin(PLACEHOLDERS)).alias("n")) for c in texts]
    return joined.agg(F.array(*rows).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def null_rate_by(df: DataFrame, key: str, column: str) -> DataFrame:
    nulls = F.count_if(F.col(column).isNull())
    return df.groupBy(key).agg(F.count("*").alias("n"), nulls.alias("nulls"), F.round(100 * nulls / F.count("*"), 1).alias("null_pct"))


def compare_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.count_if(F.col(a) == F.col(b)).alias("equal"), F.count_if(F.col(a) < F.col(b)).alias("less"), F.count_if(F.col(a) > F.col(b)).alias("more"))


def category_sales(lines: DataFrame, items: DataFrame, category: str = "cat_l") -> DataFrame:
    """Sums by item meet the master before they are summed by category."""
    by_item = lines.groupBy("item_code").agg(F.sum("amount").alias("amount"), F.sum("qty").alias("qty"))
    return by_item.join(items, "item_code").groupBy(category).agg(F.sum("amount").alias("amount"), F.sum("qty").alias("qty"), F.countDistinct("item_name").alias("n_names"))


def baskets(lines: DataFrame) -> DataFrame:
    valid = lines.filter("qty > 0 and amount > 0")
    return valid.groupBy(*RECEIPT).agg(F.sum("qty").alias("size"), F.sum("amount").alias("amount"), F.max("item_code").alias("item_code"), F.max("sale_time").alias("sale_time"), F.count("*").alias("n_lines"))


def trim_top(df: DataFrame, columns: Sequence[str], q: float = 0.99) -> DataFrame:
    edges = percentiles(df, columns, [q]).select(*[F.get(c, F.lit(0)).alias(f"_q_{c}") for c in columns])
    out = df.join(F.broadcast(edges))
    for c in columns:
        out = out.filter(F.col(c) <= F.col(f"_q_{c}"))
    return out.select(df.columns)


def cumulative_windows(enriched: DataFrame, days: Sequence[int], key: str = "item_code") -> DataFrame:
    """Amount within so many days after the launch, day 0 included."""
    return enriched.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("days_since_launch") <= d, F.col("amount"))), F.lit(0)).alias(f"amount_{d}d") for d in days])


def launch_class(lines: DataFrame, cutoff: str, key: str = "item_code") -> DataFrame:
    agg = lines.groupBy(key).agg(F.min("sale_date").alias("first_sale"), F.max("sale_date").alias("last_sale"))
    return agg.withColumn("launch", F.when(F.col("first_sale") < F.lit(cutoff).cast("date"), "existing").otherwise("new"))


def weekly_launch_sales(enriched: DataFrame, weeks: int = 4, key: str = "item_code") -> DataFrame:
    week = F.floor(F.col("days_since_launch") / 7)
    return enriched.withColumn("week", week).filter(F.col("week") < weeks).groupBy(key, "week").agg(F.sum("qty").alias("qty"))


def success_label(weekly: DataFrame, classes: DataFrame, least_avg: float = 119, least_weeks: int = 3, alive: str = "2025-06-01", key: str = "item_code") -> DataFrame:
    """1 when the weeks with sales average enough, are enough, and the last sale is late enough."""
    agg = weekly.groupBy(key).agg(F.avg("qty").alias("avg_qty"), F.count("*").alias("n_weeks"))
    joined = agg.join(classes.select(key, "last_sale"), key)
    good = (F.col("avg_qty") >= least_avg) & (F.col("n_weeks") >= least_weeks) & (F.col("last_sale") >= F.lit(alive).cast("date"))
    return joined.select(key, F.round("avg_qty", 4).alias("avg_qty"), "n_weeks", "last_sale", good.cast("int").alias("success"))


def distribution(df: DataFrame, column: str, quantiles: dict[str, float]) -> DataFrame:
    rows = written(df.select(column))  # read for the quantiles and for the mean
    edges = percentiles(rows, [column], list(quantiles.values()))
    return rows.agg(F.round(F.avg(column), 4).alias("mean")).join(F.broadcast(edges)).select("mean", *[F.round(F.get(column, F.lit(i)), 4).alias(k) for i, k in enumerate(quantiles)])


def node_degree(df: DataFrame, key: str) -> DataFrame:
    """Distinct items per node in numbers: nodes, median, max, singletons, hubs at the 99th percentile or above."""
    d = df.groupBy(key).agg(F.countDistinct("item_code").alias("d"))
    edges = percentiles(d, ["d"], [0.5, 0.99]).select(F.get("d", F.lit(0)).alias("_median"), F.get("d", F.lit(1)).alias("q99"))
    return d.join(F.broadcast(edges)).agg(F.count("*").alias("n_nodes"), F.round(F.max("_median"), 2).alias("median"), F.max("d").alias("largest"), F.count_if(F.col("d") == 1).alias("n_single"), pct(F.count_if(F.col("d") == 1), F.count("*")).alias("single_pct"), F.count_if(F.col("d") >= F.col("q99")).alias("n_hubs"))


def interval_union(df: DataFrame, key: str, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Intervals that overlap or touch within a day, merged: their number, days, span, first and last.

    Of the intervals of one start only the longest counts. In order of their starts, an interval that
    begins over a day after every earlier end opens a new one and adds all its days; any other adds
    the days beyond the latest end so far. That end is carried between ranges of the order, so one key
    with all intervals is several tasks' work. A null start or end is no interval; a null key is a key.
    """
    longest = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).groupBy(key, start).agg(F.max(end).alias(end))
    seen = grouped_running_max(longest, key, [start], end, "_seen")
    fresh = F.col("_seen").isNull() | (F.datediff(start, "_seen") > 1)
    added = F.when(fresh, F.datediff(end, start) + 1).otherwise(F.greatest(F.datediff(end, "_seen"), F.lit(0)))
    merged = seen.groupBy(key).agg(F.count_if(fresh).alias("n_intervals"), F.sum(added).alias("days"), F.min(start).alias("first"), F.max(end).alias("last"))
    return merged.withColumn("span", F.datediff("last", "first") + 1)


def crosstab_share(df: DataFrame, row: str, column: str) -> DataFrame:
    """Distinct items per row and column, and each cell's percentage of its row."""
    cells = df.groupBy(row, column).agg(F.countDistinct("item_code").alias("n"))
    return cells.withColumn("row_pct", pct(F.col("n"), F.sum("n").over(Window.partitionBy(row))))


def event_pairs(df: DataFrame, keys: Sequence[str], category: str) -> DataFrame:
    """Category pairs inside one event, counted per ``keys`` and then summed."""
    from shelfwise.operators.joins import co_purchase_pairs

    return co_purchase_pairs(df, list(keys), category)


def daily_item_qty(lines: DataFrame, date: str = "sale_date") -> DataFrame:
    return lines.groupBy(F.col(date).alias("date"), "item_code").agg(F.sum("qty").alias("qty"))


def period_lift(daily: DataFrame, periods: DataFrame, min_lift: float = 1.5, least: float = 10, ratio: float = 0.5) -> DataFrame:
    """Items whose daily sales in a period rise over those of the period's months outside it.

    Inside: quantity over the period's days; baseline: quantity over the distinct dates in the data, of the
    same calendar months, outside the period. The year's quantity gives the specificity. Months are
    matched without the year, so ``daily`` should hold one year.
    """
    months = periods.withColumn("m", F.explode(F.array_distinct(F.transform(F.sequence("start_date", "end_date"), F.month)))).withColumn("period_days", F.datediff("end_date", "start_date") + 1)
    inside = F.col("date").between(F.col("start_date"), F.col("end_date"))
    met = daily.withColumn("m", F.month("date")).join(F.broadcast(months), "m")
    sums = met.groupBy("period_key", "item_code").agg(F.sum(F.when(inside, F.col("qty"))).alias("period_qty"), F.coalesce(F.sum(F.when(~inside, F.col("qty"))), F.lit(0)).alias("_base"), F.max("period_days").alias("period_days"))
    dates = daily.select("date").distinct().withColumn("m", F.month("date")).join(F.broadcast(months), "m").filter(~inside).groupBy("period_key").agg(F.count("*").alias("_days"))
    year = daily.groupBy("item_code").agg(F.sum("qty").alias("annual_qty"))
    joined = sums.filter("period_qty is not null").join(dates, "period_key", "left").join(year, "item_code")
    base = F.coalesce(F.try_divide("_base", "_days"), F.lit(0.0))
    rate = F.col("period_qty") / F.col("period_days")
    lift = F.when(base == 0, F.lit(float("inf"))).otherwise(F.try_divide(rate, base))
    enough = F.col("period_qty") >= F.greatest(base * 7 * ratio, F.lit(float(least)))
    found = joined.withColumns({"lift": lift, "baseline": base, "specificity": F.coalesce(F.try_divide("period_qty", "annual_qty"), F.lit(0.0)), "_enough": enough})
    return found.filter((F.col("lift") >= min_lift) & F.col("_enough")).select("period_key", "item_code", F.round("lift", 4).alias("lift"), F.round("specificity", 6).alias("specificity"), "period_qty", "annual_qty", F.round("baseline", 6).alias("baseline"))


def period_sales(daily: DataFrame, periods: DataFrame) -> DataFrame:
    """Sales inside each period, periods may overlap. Rows of one day and item are summed before they meet the periods."""
    return range_join(daily_item_qty(daily, "date"), periods, "date").groupBy("period_key", "item_code").agg(F.sum("qty").alias("qty"), F.countDistinct("date").alias("n_days"))


def merge_by_key(df: DataFrame, key: str, order: str, first: str, link: str, text: str, separator: str = "\n---\n") -> DataFrame:
    """One row per key: the first value, distinct links in order, texts joined in order.

    A key's lists are one row: where keys may be hot, ``merge_in_chunks`` has rows of a stated size.
    """
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(order, c)))), lambda x: x[c])
    agg = df.groupBy(key).agg(F.min_by(first, order).alias(first), F.array_distinct(listed(link)).alias("_links"), F.filter(listed(text), lambda t: F.length(F.trim(t)) > 0).alias("_texts"))
    return agg.select(key, first, F.array_join("_links", ", ").alias("links"), F.size("_links").alias("n_links"), F.array_join("_texts", separator).alias("merged"))


def merge_in_chunks(df: DataFrame, key: str, order: Sequence[str], text: str, separator: str, most: int) -> DataFrame:
    """(key, chunk, n, merged): a key's texts joined in order, in rows of fewer than ``most`` characters besides the last text of each.

    The chunk of a text is the number of characters before it in its key, separators included, over
    ``most``, rounded down; numbers rise in order, and one is left out where a text is longer than
    ``most``. The characters are counted by range of (key, order), so no task holds a key. The order
    must be total within a key. Null and blank texts are left out; a null key is a key.
    """
    size = F.length(text) + len(separator)
    kept = df.filter(F.length(F.trim(text)) > 0).select(key, *order, *([] if text in order else [text]))
    counted = grouped_prefix_sums(kept, key, list(order), _upto=size).withColumn("chunk", F.floor((F.col("_upto") - size) / most))
    texts = F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_text")))), lambda x: x["_text"])
    return counted.groupBy(key, "chunk").agg(F.count("*").alias("n"), F.array_join(texts, separator).alias("merged"))


def listed_in_chunks(df: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """(key, chunk, values): a key's values that aren't null, repeats included, in ordered lists of ``most`` or, the last, fewer.

    The rows of a key are numbered by range of (key, value), so no task or row holds a hot key's values.
    """
    numbered = grouped_prefix_sums(df.filter(F.col(value).isNotNull()).select(key, value), key, [value], _at=F.lit(1))
    return numbered.groupBy(key, F.floor((F.col("_at") - 1) / most).alias("chunk")).agg(F.sort_array(F.collect_list(value)).alias("values"))


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that meet each rule."""
    rows = [F.struct(F.lit(k).alias("rule"), F.count_if(c).alias("n")) for k, c in rules.items()]
    return df.agg(F.array(*rows).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def exploded_counts(df: DataFrame, entries: Column, n: int | None = None, name: str = "value") -> DataFrame:
    counts = df.select(F.explode(entries).alias(name)).groupBy(name).agg(F.count("*").alias("n"))
    return counts if n is None else counts.orderBy(F.desc("n"), name).limit(n)


def log_length_thresholds(df: DataFrame, column: str, ks: Sequence[float] = (2, 2.5, 3)) -> DataFrame:
    """int(exp(mean + k deviations)) of the logarithm, by sample deviation, over positive values."""
    stats = df.filter(F.col(column) > 0).agg(F.avg(F.ln(column)).alias("mu"), F.stddev_samp(F.ln(column)).alias("sd"))
    return stats.select(F.explode(F.array(*[F.struct(F.lit(float(k)).alias("k"), F.floor(F.exp(F.col("mu") + k * F.col("sd"))).alias("threshold")) for k in ks])).alias("r")).select("r.*")


def percentile_bands(df: DataFrame, column: str, hit: Column, cuts: Sequence[float]) -> DataFrame:
    """Rows and hits between neighbouring percentiles; the last band holds its upper end. Rows below the first cut are left out."""
    edges = percentiles(df, [column], cuts).withColumnRenamed(column, "q")
    band = F.lit(None).cast("int")
    for i in range(len(cuts) - 1):
        band = F.when(F.col(column) >= F.get("q", F.lit(i)), i).otherwise(band)
    rows = df.withColumn("_hit", hit).join(F.broadcast(edges)).withColumn("band", band).filter("band is not null")
    return rows.groupBy("band").agg(F.count("*").alias("n"), F.count_if("_hit").alias("n_hit"), F.count_if(~F.col("_hit")).alias("n_miss"))


def parents_per_child(items: DataFrame, child: str, parent: str) -> DataFrame:
    return items.groupBy(child).agg(F.countDistinct(parent).alias("n_parents"))


def hierarchy_flows(items: DataFrame) -> DataFrame:
    """Item counts from all to large, large to middle, middle to small: one grouping-sets pass."""
    sets = items.groupingSets([[F.col("cat_l")], [F.col("cat_l"), F.col("cat_m")], [F.col("cat_m"), F.col("cat_s")]], "cat_l", "cat_m", "cat_s")
    g = sets.agg(F.count("*").alias("n"), F.grouping("cat_l").alias("gl"), F.grouping("cat_m").alias("gm"), F.grouping("cat_s").alias("gs"))
    source = F.when((F.col("gl") == 0) & (F.col("gm") == 1), "total").when(F.col("gs") == 0, F.col("cat_m")).otherwise(F.col("cat_l"))
    target = F.when((F.col("gl") == 0) & (F.col("gm") == 1), F.col("cat_l")).when(F.col("gs") == 0, F.col("cat_s")).otherwise(F.col("cat_m"))
    level = F.when((F.col("gl") == 0) & (F.col("gm") == 1), "total-l").when(F.col("gs") == 0, "m-s").otherwise("l-m")
    return g.select(level.alias("level"), source.alias("source"), target.alias("target"), "n")


def symmetric_matrix(pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Counts both ways over a fixed list of labels, zero where there are none, null on the diagonal."""
    both = pairs.select("cat_a", "cat_b", "n").union(pairs.select("cat_b", "cat_a", "n"))
    wide = both.filter(F.col("cat_a").isin(list(labels))).groupBy("cat_a").pivot("cat_b", list(labels)).agg(F.sum("n"))
    axis = pairs.sparkSession.createDataFrame([(x,) for x in labels], "cat_a string")
    full = axis.join(wide, "cat_a", "left").fillna(0, list(labels))
    return full.select("cat_a", *[F.when(F.col("cat_a") != x, F.col(f"`{x}`")).alias(x) for x in labels])


def wide_lists(items: DataFrame, column: str, value: str, labels: Sequence[str]) -> DataFrame:
    """A column per label; the k-th row holds its k-th value in order."""
    distinct = items.select(column, value).distinct().withColumn("k", F.row_number().over(Window.partitionBy(column).orderBy(value)))
    return distinct.groupBy("k").pivot(column, list(labels)).agg(F.first(value))


def file_periods(events: DataFrame, date: Column) -> DataFrame:
    """First and last date and rows of each file that ``events`` is read from, and of all (null): from the files' metadata."""
    dated = events.select(F.col("_metadata.file_path").alias("file"), date.alias("date"))
    return dated.rollup("file").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n"))


def control_totals(steps: DataFrame, expected: DataFrame) -> DataFrame:
    """(step, n, expected): counts beside those that the caller expects; a step without one has null."""
    return steps.join(expected, "step", "left")
