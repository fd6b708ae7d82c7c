"""Joins of sales, items, promotions and posts.

No join is told how to run: Catalyst broadcasts a side it knows to be small and AQE splits
skewed partitions. Range joins meet on a month number first, so they hash instead of looping.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.text import tokenize
from shelfwise.sources.files import written

RECEIPT = ["sale_date", "store", "pos_no", "trade_no"]


def sales_with_master(lines: DataFrame, items: DataFrame) -> DataFrame:
    return lines.join(items, "item_code")


def restrict_to_items(lines: DataFrame, items: DataFrame) -> DataFrame:
    return lines.join(items.select("item_code"), "item_code", "left_semi")


def distinct_sales_of_items(lines: DataFrame, items: DataFrame) -> DataFrame:
    return restrict_to_items(lines, items).dropDuplicates()


def events_with_item(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """events (with online_item_code) left joined to the map."""
    return events.join(mapping, "online_item_code", "left")


def promo_list_by_item(promo: DataFrame) -> DataFrame:
    """Distinct event names of an item, in order, in one string."""
    return promo.groupBy("item_code").agg(F.array_join(F.sort_array(F.collect_set("event_name")), ", ").alias("promo_list"))


def items_with_promo_text(items: DataFrame, promo: DataFrame) -> DataFrame:
    return items.join(promo_list_by_item(promo), "item_code", "left")


def match_voids(lines: DataFrame) -> DataFrame:
    """A row per void with the number of sales of equal store, register, item and amount, and of those on its day.

    Sales and voids of one key and amount are counted side by side: one shuffle of the lines, no join.
    """
    keys = ["store", "pos_no", "item_code", "amount"]
    lines = lines.filter("amount <> 0").select("store", "pos_no", "item_code", F.abs("amount").alias("amount"), "trade_no", "sale_date", (F.col("amount") < 0).alias("_void"))
    sold = F.count(F.when(~F.col("_void"), 1))
    counted = lines.withColumns({"n_sales": sold.over(Window.partitionBy(*keys)), "n_same_day": sold.over(Window.partitionBy(*keys, "sale_date"))})
    return counted.filter("_void").select(*keys, "trade_no", F.col("sale_date").alias("void_date"), "n_sales", "n_same_day")


def void_match_rate(lines: DataFrame) -> DataFrame:
    """Voids that have a matching sale, by count of voids."""
    return match_voids(lines).agg(F.count("*").alias("n_voids"), F.count_if(F.col("n_sales") > 0).alias("n_matched"), F.count_if(F.col("n_same_day") > 0).alias("n_same_day"), F.round(100 * F.count_if(F.col("n_sales") > 0) / F.count("*"), 2).alias("match_pct"))


def multi_item_receipts(lines: DataFrame, items: DataFrame, least: int = 2) -> DataFrame:
    """Lines of receipts with ``least`` items or more, of items the master knows."""
    big = lines.filter("qty > 0 and amount > 0").groupBy(*RECEIPT).agg(F.countDistinct("item_code").alias("_size")).filter(F.col("_size") >= least)
    return lines.filter("qty > 0 and amount > 0").join(big, RECEIPT, "left_semi").join(items, "item_code")


def co_purchase_pairs(lines: DataFrame, key: list[str], category: str, least: int = 1) -> DataFrame:
    """(cat_a, cat_b, n): receipts that hold both, cat_a < cat_b; of pairs in ``least`` receipts or more.

    A receipt's distinct categories become one sorted array, whose pairs are exploded: one shuffle
    by receipt. A receipt has as many pairs as its categories allow. With ``least`` above 1 a
    category that fewer receipts hold can be in no such pair and goes before pairs are made.
    """
    known = lines.filter(F.col(category).isNotNull()).select(*key, category)
    if least > 1:
        known = written(known.distinct())
        known = known.join(known.groupBy(category).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least), category, "left_semi")
    sets = known.groupBy(*key).agg(F.sort_array(F.collect_set(category)).alias("c")).filter(F.size("c") > 1)
    pairs = F.flatten(F.transform("c", lambda a, i: F.transform(F.slice("c", i + 2, F.size("c")), lambda b: F.struct(a.alias("cat_a"), b.alias("cat_b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.cat_a", "p.cat_b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def first_sale_enriched(lines: DataFrame, key: str = "item_code", date: str = "sale_date") -> DataFrame:
    """Adds first_sale and days_since_launch; the first dates are aggregated and joined back."""
    first = lines.groupBy(key).agg(F.min(date).alias("first_sale"))
    return lines.join(first, key).withColumn("days_since_launch", F.datediff(date, "first_sale"))


def promo_with_category(promo: DataFrame, items: DataFrame) -> DataFrame:
    return promo.join(items.drop("item_name"), "item_code", "left")


def promo_in_scope(promo: DataFrame, sold: DataFrame, categories: DataFrame) -> DataFrame:
    """Promotions of items that were sold, in target categories (column cat_m)."""
    return promo.join(sold.select("item_code").distinct(), "item_code", "left_semi").join(categories.select("cat_m").distinct(), "cat_m", "left_semi")


def months_between(start: Column, end: Column) -> Column:
    """Month numbers that a range touches."""
    number = lambda d: F.year(d) * 12 + F.month(d)
    return F.sequence(number(start), number(end))


def range_join(points: DataFrame, ranges: DataFrame, date: str, start: str = "start_date", end: str = "end_date", keys: Sequence[str] = ()) -> DataFrame:
    """Points joined to the ranges that hold their date, and have their ``keys`` if any are named.

    Ranges are cut to the points' first and last date (a joined table of one row) before their
    months are exploded: an end in 2099 or 9999 costs nothing. A null date or end matches nothing.
    """
    span = F.broadcast(points.agg(F.min(date).alias("_low"), F.max(date).alias("_high")))
    kept = ranges.filter(F.col(start) <= F.col(end)).join(span, (F.col(start) <= F.col("_high")) & (F.col(end) >= F.col("_low")))
    bucketed = kept.withColumn("_month", F.explode(months_between(F.greatest(F.col(start), F.col("_low")), F.least(F.col(end), F.col("_high"))))).drop("_low", "_high")
    dated = points.withColumn("_month", F.year(date) * 12 + F.month(date))
    return dated.join(bucketed, ["_month", *keys]).filter(F.col(date).between(F.col(start), F.col(end))).drop("_month")


def foremost_ranges(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that can be the first to have begun (then the smallest event code) among those of their keys that run on some date.

    A row is left out if one that comes before it by (start, code) ends no sooner, so repeated rows
    stay once. Rows of one start are weighed first, so that no window holds more than the starts of a key.
    """
    by_start = [*keys, "start_date"]
    beside = Window.partitionBy(*by_start).orderBy("event_code").rowsBetween(Window.unboundedPreceding, -1)
    first = ranges.filter("start_date <= end_date").withColumn("_seen", F.max("end_date").over(beside)).filter("_seen is null or end_date > _seen").drop("_seen")
    before = Window.partitionBy(*keys).orderBy("start_date").rowsBetween(Window.unboundedPreceding, -1)
    starts = first.groupBy(*by_start).agg(F.max("end_date").alias("_end")).withColumn("_before", F.max("_end").over(before)).drop("_end")
    return first.join(starts, by_start).filter("_before is null or end_date > _before").drop("_before")


def token_postings(products: DataFrame, names: DataFrame) -> DataFrame:
    """(token, event_name): the names that hold each token of the products anywhere, whatever the case.

    A token meets the names that hold its first two characters, then the whole token is looked for.
    """
    low = F.lower("event_name")
    grams = names.select("event_name", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(2))))).alias("_gram"))
    known = products.select(F.explode(tokenize(F.col("product"))).alias("token")).distinct().withColumn("_gram", F.substring(F.lower("token"), 1, 2))
    return known.join(grams, "_gram").filter(F.contains(low, F.lower("token"))).select("token", "event_name")


def token_bounds(products: DataFrame, postings: DataFrame) -> DataFrame:
    """(product, token, deficit): each distinct token of a product, and how far below the highest score a name stays that has none of its rarer tokens.

    The rarest token has deficit 0. A name without the tokens of a deficit of d or less scores over d below the number of tokens.
    """
    listed = products.select("product", F.explode(tokenize(F.col("product"))).alias("token")).groupBy("product", "token").agg(F.count("*").alias("times"))
    rarity = listed.join(postings.groupBy("token").agg(F.count("*").alias("_names")), "token", "left").fillna(0, ["_names"])
    rarer = Window.partitionBy("product").orderBy("_names", "token").rowsBetween(Window.unboundedPreceding, -1)
    return rarity.withColumn("deficit", F.coalesce(F.sum("times").over(rarer), F.lit(0)).cast("int")).filter("_names > 0").select("product", "token", "deficit")


def name_scores(pairs: DataFrame) -> DataFrame:
    """``pairs`` (product, event_name, once each) plus score: the product's tokens that stand in the name, repeats counted."""
    return pairs.withColumn("score", F.size(F.filter(tokenize(F.col("product")), lambda t: F.contains(F.lower(F.col("event_name")), F.lower(t)))))


def best_fits(asked: DataFrame, running: DataFrame, watch: list[int] | None = None) -> DataFrame:
    """For each (product, post_date) of ``asked``, the promotion of ``running`` with the highest score above 0 that runs then.

    Names are looked up by a product's rarest token first. What has no promotion on its date with a
    score that no name left out could reach goes on to the next rarest, and so on: a common token's
    names are met only by products that nothing better fits. A round is a few joins; there are as
    many as a product has tokens at most. ``watch`` gets the number of names scored in each.
    """
    products = written(asked.select("product").distinct())
    postings = written(token_postings(products, running.select("event_name").distinct()))
    bounds = written(token_bounds(products, postings))
    last = bounds.agg(F.max("deficit")).first()[0]
    highest = F.size(tokenize(F.col("product")))
    order = Window.partitionBy("product", "post_date").orderBy(F.desc("score"), "start_date", "event_code")
    open_, found, settled = asked, None, None
    for deficit in range(0 if last is None else last + 1):
        # names of this deficit's token, of products that are still open
        pairs = bounds.filter(F.col("deficit") == deficit).join(open_.select("product").distinct(), "product", "left_semi").join(postings, "token").select("product", "event_name").distinct()
        scored = written(name_scores(pairs))
        if watch is not None:
            watch.append(scored.count())
        found = scored if found is None else found.unionByName(scored)
        mine = found.join(open_.select("product").distinct(), "product", "left_semi").distinct() if deficit else scored
        fits = foremost_ranges(mine.join(running, "event_name"), ["product", "score"])
        best = written(range_join(open_, fits, "post_date", keys=["product"]).withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank"))
        sure = best.filter(F.col("score") >= highest - deficit) if deficit < last else best
        settled = sure if settled is None else settled.unionByName(sure)
        if deficit < last:
            open_ = written(open_.join(sure, ["product", "post_date"], "left_anti"))
            if open_.isEmpty():
                break
    return settled if settled is not None else asked.join(running, F.lit(False)).withColumn("score", F.lit(0))


def post_promo_match(mentions: DataFrame, promo: DataFrame) -> DataFrame:
    """The promotion that fits a mention best: it runs on the post's date and shares most tokens with the product.

    Ties go to the earlier start, then to the smaller event code. Mentions without a match have no
    row. Of the promotions of one name, and again of those with one score for a product, only the
    foremost reach the dates, so an open-ended promotion meets few others.
    """
    asked = written(mentions.select("post_date", "product").distinct())
    running = written(foremost_ranges(promo.select("event_code", "event_name", "start_date", "end_date"), ["event_name"]))
    return mentions.join(best_fits(asked, running), ["post_date", "product"])


def unmatched_mentions(mentions: DataFrame, matched: DataFrame) -> DataFrame:
    return mentions.join(matched.select("mention_id"), "mention_id", "left_anti").dropDuplicates()


def pending_rows(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return source.join(done.select(key), key, "left_anti")


def apply_updates(base: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New values where an update has one."""
    new = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = base.join(new, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def code_coverage(a: DataFrame, b: DataFrame, key: str = "item_code") -> DataFrame:
    """Keys in both, in a only, in b only."""
    left, right = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    both = left.join(right, key, "full")
    return both.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"), F.count_if(F.col("_b").isNull()).alias("n_a_only"), F.count_if(F.col("_a").isNull()).alias("n_b_only"))


def coverage_by_category(part: DataFrame, whole: DataFrame, category: str, key: str = "item_code") -> DataFrame:
    """Distinct keys of the part against the whole, per category, in percent."""
    w = whole.groupBy(category).agg(F.countDistinct(key).alias("n_whole"))
    p = part.groupBy(category).agg(F.countDistinct(key).alias("n_part"))
    joined = w.join(p, category, "left").fillna(0, ["n_part"])
    return joined.withColumn("pct", F.round(100 * F.col("n_part") / F.col("n_whole"), 2))


def lookup_by_body(posts: DataFrame, done: DataFrame) -> DataFrame:
    """Results stored for the same text: hashes meet, then texts are compared."""
    a = posts.withColumn("_h", F.xxhash64("body"))
    b = done.select(F.xxhash64("body").alias("_h"), F.col("body").alias("_body"), "result")
    return a.join(b, (a["_h"] == b["_h"]) & (a["body"] == b["_body"]), "left").select(*posts.columns, "result")
