"""Projections, filters and repairs of the canonical tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.text import BLANKS, pad_code, strip

# Fixed values.
NON_FOOD_WORDS = ["텀블러", "머그", "커피밀", "여과지", "그라인더", "티스픈", "잔세트", "유리머그", "포장Tray", "봉투", "박스", "금액키", "쿠폰", "소모품", "Tray"]
COMBO = "콤보할인"


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def resolve_column(df: DataFrame, candidates: Sequence[str]) -> Column:
    """The first of the names that the table has."""
    for name in candidates:
        if name in df.columns:
            return F.col(f"`{name}`")
    raise ValueError(f"none of {list(candidates)} in {df.columns}")


def filter_in(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return df.filter(F.col(column).isin(list(values)))


def filter_not_in(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Nulls go too, as in every comparison."""
    return df.filter(~F.col(column).isin(list(values)))


def filter_food(items: DataFrame, category: str, words: Sequence[str] = NON_FOOD_WORDS) -> DataFrame:
    """Other categories than ``category`` (null is one), whose name holds none of the words."""
    bad = F.lit(False)
    for w in words:
        bad = bad | F.contains(F.coalesce("item_name", F.lit("")), F.lit(w))
    return items.filter(~F.coalesce(F.col("cat_l") == category, F.lit(False)) & ~bad)


def valid_sales(lines: DataFrame) -> DataFrame:
    return lines.filter("qty > 0 and amount > 0")


def unit_price(lines: DataFrame, low: float = 0, high: float = 50_000) -> DataFrame:
    """Adds unit_price and keeps low < unit_price < high."""
    priced = lines.withColumn("unit_price", F.try_divide("amount", "qty"))
    return priced.filter((F.col("unit_price") > low) & (F.col("unit_price") < high))


def high_price_items(lines: DataFrame, items: DataFrame, least: float, word: str) -> DataFrame:
    """Items whose mean price reaches ``least``, with a mark where the name holds the word."""
    price = lines.filter("qty > 0").groupBy("item_code").agg(F.sum("amount").alias("a"), F.sum("qty").alias("q"))
    priced = price.select("item_code", F.round(F.col("a") / F.col("q"), 4).alias("mean_price")).filter(F.col("mean_price") >= least)
    return priced.join(items.select("item_code", "item_name"), "item_code").withColumn("has_word", F.contains("item_name", F.lit(word)))


def primary_attribution(events: DataFrame) -> DataFrame:
    return events.filter(F.col("is_primary").cast("string").isin("참", "true", "True"))


def normalise_blank(df: DataFrame, columns: Sequence[str], blanks: str = BLANKS) -> DataFrame:
    """Trimmed of the blanks; rows with an empty or null value in one of the columns go."""
    out = df.withColumns({c: F.nullif(strip(F.col(c), blanks), F.lit("")) for c in columns})
    return out.dropna(subset=list(columns))


def strip_category(items: DataFrame, placeholder: str = "XXXXXX") -> DataFrame:
    return items.withColumns({c: strip(F.col(c)) for c in ("cat_l", "cat_m", "cat_s")}).filter(F.col("item_code") != placeholder)


def with_padded_code(df: DataFrame, column: str = "item_code", width: int = 6) -> DataFrame:
    return df.withColumn(column, pad_code(F.col(column).cast("string"), width))


def derive_promo_type(promo: DataFrame) -> DataFrame:
    """Kinds that ever carry a form take the form, others themselves: what follows the last ' : ', blanks out.

    The kinds with a form are a distinct list of kinds, joined back; no window over all rows.
    """
    with_form = promo.filter("event_form is not null").select("event_kind").distinct().withColumn("_form", F.lit(True))
    joined = promo.join(with_form, "event_kind", "left")
    source = F.when(F.col("_form"), F.col("event_form")).otherwise(F.col("event_kind"))
    return joined.withColumn("promo_type", F.regexp_replace(F.element_at(F.split(source, " : "), -1), r"(?U)\s+", "")).drop("_form")


def fill_discount_price(promo: DataFrame, lines: DataFrame, combo: str = COMBO) -> DataFrame:
    """Combo rows without a discount price take the item's mean sales price, all others left the event price."""
    price = lines.filter("qty > 0").groupBy("item_code").agg((F.sum("amount") / F.sum("qty")).alias("_sold"))
    is_combo = F.coalesce(F.col("promo_type") == combo, F.lit(False))
    joined = promo.join(price, "item_code", "left").withColumn("is_combo", is_combo)
    filled = F.coalesce("discount_price", F.when(F.col("is_combo"), F.col("_sold")), F.col("event_price").cast("double"))
    return joined.withColumn("discount_price", filled).drop("_sold")


def drop_null_basis(promo: DataFrame) -> DataFrame:
    return promo.dropna(subset=["basis"])


def open_ended_split(promo: DataFrame) -> DataFrame:
    open_ = F.year("end_date") == 9999
    return promo.agg(F.count("*").alias("n"), F.count_if(open_).alias("n_open"), F.round(100 * F.count_if(open_) / F.count("*"), 2).alias("pct_open"))


def closed_promos(promo: DataFrame) -> DataFrame:
    return promo.filter("year(end_date) < 9999")


def cap_end_date(promo: DataFrame, cap: str = "2099-12-31") -> DataFrame:
    return promo.withColumn("end_date", F.when(F.col("end_date").isNull() | (F.year("end_date") >= 9000), F.lit(cap).cast("date")).otherwise(F.col("end_date")))


def split_caption(posts: DataFrame, size: int = 50, empty: str = "(no title)") -> DataFrame:
    """First line as title (cut with dots when longer), the rest as body."""
    parts = F.split(F.coalesce("body", F.lit("")), "\n", 2)
    first = strip(F.get(parts, 0))
    title = F.when(first == "", empty).when(F.length(first) > size, F.concat(F.substring(first, 1, size), F.lit("..."))).otherwise(first)
    return posts.withColumns({"title": title, "body": F.coalesce(F.get(parts, 1), F.lit(""))})


def date_window(posts: DataFrame, low: str, high: str) -> DataFrame:
    return posts.filter(F.col("post_date").between(F.lit(low).cast("date"), F.lit(high).cast("date")))


def assign_post_id(posts: DataFrame) -> DataFrame:
    """The given id, else the last part of the url, else the url, else a hash of the row."""
    tail = F.nullif(F.element_at(F.split(F.rtrim("url", F.lit("/")), "/"), -1), F.lit(""))
    return posts.withColumn("post_id", F.coalesce("post_id", tail, F.nullif("url", F.lit("")), F.hex(F.xxhash64("body"))))


def row_limit(df: DataFrame, key: str, n: int | None) -> DataFrame:
    return df if n is None else df.orderBy(key).limit(n)


def post_type(title: Column) -> Column:
    ad = F.contains(title, F.lit("#광고")) | F.contains(title, F.lit("#AD")) | F.contains(title, F.lit("#제작지원"))
    return F.when(F.contains(title, F.lit("딩동")) | F.contains(title, F.lit("신상템")), "신상템 알림").when(ad, "광고/AD").otherwise("지역·F&B 가이드")


def post_type_by_body(body: Column) -> Column:
    head = F.substring(body, 1, 200)
    has = lambda c, w: F.contains(c, F.lit(w))
    collab = has(body, " X CU") | has(body, "CU X ") | (has(head, "콜라보") & has(head, "CU"))
    fresh = has(head, "신상") & (has(head, "#EVENT") | has(head, "주차") | has(head, "Pick"))
    return F.when(collab, "콜라보 공지").when(fresh, "신상 소개").otherwise("이벤트·프로모션")


def conditional_text(items: DataFrame, default: str = "no promotion") -> DataFrame:
    """A description with the promotions' names, or the default where there are none."""
    clause = F.when(F.col("promo_list").isNotNull() & (F.col("promo_list") != ""), F.concat(F.lit("promotions: "), F.col("promo_list"))).otherwise(F.lit(default))
    return items.withColumn("description", F.concat_ws(", ", "item_name", "cat_l", clause))
