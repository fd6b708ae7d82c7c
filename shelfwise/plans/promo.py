"""Queries over promotions, their items, intervals, pairs and edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import text as T
from shelfwise.operators import aggregates as A
from shelfwise.operators import clean as P
from shelfwise.operators import graph as G
from shelfwise.operators import joins as J
from shelfwise.operators import ordering as O
from shelfwise.operators import windows as W
from shelfwise.plans.registry import query
from shelfwise.sources.files import written
from shelfwise.sources.tables import item_master, promotions, sales_lines, sql

CATS = "+pc AS (SELECT p.*, i.cat_l, i.cat_m, i.cat_s FROM promo p LEFT JOIN items i USING (item_code)) "
NORM = "trim(regexp_replace(regexp_replace(regexp_replace(event_name, '^[0-9]{2}년\\s+[0-9]{1,2}월\\s+', ''), '^[0-9]{1,2}(~[0-9]{1,2})?월\\s+', ''), '\\s*\\([0-9]+\\)\\s*$', ''))"


def with_cats(s, d):
    return J.promo_with_category(promotions(s, d), item_master(s, d))


@query(sql("items promo", "+pl AS (SELECT item_code, string_agg(DISTINCT event_name, ', ' ORDER BY event_name) AS promo_list FROM promo GROUP BY 1) SELECT item_code, item_name || ', ' || cat_l || ', ' || CASE WHEN promo_list <> '' THEN 'promotions: ' || promo_list ELSE 'no promotion' END AS description FROM items LEFT JOIN pl USING (item_code)"))
def p14_conditional_text(s, d):
    return P.conditional_text(J.items_with_promo_text(item_master(s, d), promotions(s, d))).select("item_code", "description")


DERIVED = "+k AS (SELECT DISTINCT event_kind FROM promo WHERE event_form IS NOT NULL), dv AS (SELECT event_code, item_code, replace(list_extract(string_split(CASE WHEN event_kind IN (SELECT event_kind FROM k) THEN event_form ELSE event_kind END, ' : '), -1), ' ', '') AS promo_type, event_price, discount_price, event_name, start_date FROM promo) "


@query(sql("promo", DERIVED + "SELECT event_code, item_code, promo_type FROM dv"))
def p15_derive_promo_type(s, d):
    return P.derive_promo_type(promotions(s, d)).select("event_code", "item_code", "promo_type")


FILLED = DERIVED + ", pos AS (SELECT item_code, sum(amount) / sum(qty) AS sold FROM sales WHERE qty > 0 GROUP BY 1), fl AS (SELECT event_code, item_code, promo_type, promo_type = 'URGENT' AS is_combo, event_price, round(coalesce(discount_price, CASE WHEN promo_type = 'URGENT' THEN sold END, CAST(event_price AS DOUBLE)), 4) AS discount_price FROM (SELECT *, CASE WHEN promo_type LIKE '%+%' THEN 'URGENT' ELSE promo_type END AS promo_type FROM (SELECT * FROM dv)) LEFT JOIN pos USING (item_code)) "


def filled(s, d):
    derived = P.derive_promo_type(promotions(s, d)).withColumn("promo_type", F.when(F.contains("promo_type", F.lit("+")), "URGENT").otherwise(F.col("promo_type")))
    return P.fill_discount_price(derived, sales_lines(s, d), "URGENT")


FILLED = FILLED.replace("(SELECT *, CASE WHEN promo_type LIKE", "(SELECT * EXCLUDE (promo_type), CASE WHEN promo_type LIKE")


@query(sql("promo sales", FILLED + "SELECT event_code, item_code, is_combo, discount_price FROM fl"))
def p16_fill_discount_price(s, d):
    return filled(s, d).select("event_code", "item_code", "is_combo", F.round("discount_price", 4).alias("discount_price"))


@query(sql("promo", "SELECT event_code, item_code, basis FROM promo WHERE basis IS NOT NULL"))
def p17_drop_null_basis(s, d):
    return P.drop_null_basis(promotions(s, d)).select("event_code", "item_code", "basis")


@query(sql("promo", "SELECT count(*) AS n, count_if(year(end_date) = 9999) AS n_open, round(100 * count_if(year(end_date) = 9999) / count(*), 2) AS pct_open FROM promo"))
def p18_open_ended_split(s, d):
    return P.open_ended_split(promotions(s, d))


@query(sql("promo", "SELECT event_code, item_code, CASE WHEN year(end_date) >= 9000 THEN DATE '2099-12-31' ELSE end_date END AS end_date FROM promo"))
def p19_cap_end_date(s, d):
    return P.cap_end_date(promotions(s, d)).select("event_code", "item_code", "end_date")


@query(sql("items promo", "SELECT item_code, item_name, string_agg(DISTINCT event_name, ', ' ORDER BY event_name) AS promo_list FROM items LEFT JOIN (SELECT item_code, event_name FROM promo) USING (item_code) GROUP BY 1, 2"))
def j5_items_with_promo_text(s, d):
    return J.items_with_promo_text(item_master(s, d), promotions(s, d)).select("item_code", "item_name", "promo_list")


@query(sql("items promo", CATS + "SELECT event_code, item_code, cat_l, cat_m FROM pc"))
def j10_promo_with_category(s, d):
    return with_cats(s, d).select("event_code", "item_code", "cat_l", "cat_m")


@query(sql("items promo sales", CATS + "SELECT event_code, item_code, cat_m FROM pc WHERE item_code IN (SELECT item_code FROM sales WHERE qty > 0) AND cat_m IN ('Brand#1', 'Brand#2')"))
def j11_promo_in_scope(s, d):
    targets = s.createDataFrame([("Brand#1",), ("Brand#2",)], "cat_m string")
    return J.promo_in_scope(with_cats(s, d), sales_lines(s, d).filter("qty > 0"), targets).select("event_code", "item_code", "cat_m")


MENTIONS = "+mt AS (SELECT o_orderkey AS mention_id, CAST(o_orderdate AS DATE) AS post_date, p_name AS product FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 JOIN part ON p_partkey = l_partkey), cp AS (SELECT DISTINCT event_code, event_name, start_date, CASE WHEN year(end_date) >= 9000 THEN DATE '2099-12-31' ELSE end_date END AS end_date FROM promo), nm AS (SELECT product, event_name, len(list_filter(list_filter(string_split(product, ' '), lambda t: length(t) >= 2), lambda t: contains(lower(event_name), lower(t)))) AS score FROM (SELECT DISTINCT product FROM mt), (SELECT DISTINCT event_name FROM cp)), sc AS (SELECT post_date, product, arg_min({'event_code': event_code, 'event_name': event_name, 'score': score}, (-score, start_date, event_code)) AS b FROM (SELECT DISTINCT post_date, product FROM mt) JOIN cp ON post_date BETWEEN start_date AND end_date JOIN nm USING (product, event_name) WHERE score > 0 GROUP BY 1, 2), best AS (SELECT mention_id, b.event_code AS event_code, b.event_name AS event_name, CAST(b.score AS INTEGER) AS score FROM mt JOIN sc USING (post_date, product)) "


def mentions(s, d):
    """What posts say: the product of an order's first line, on the order's date."""
    orders, lines, part = (s.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "lineitem", "part"))
    first = lines.filter("l_linenumber = 1").join(part, F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "p_name")
    return orders.join(first, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("mention_id"), F.col("o_orderdate").cast("date").alias("post_date"), F.col("p_name").alias("product"))


def matched(s, d, said=None):
    return J.post_promo_match(mentions(s, d) if said is None else said, P.cap_end_date(promotions(s, d)))


@query(sql("promo", MENTIONS + "SELECT * FROM best"))
def j12_post_promo_match(s, d):
    return matched(s, d).select("mention_id", "event_code", "event_name", "score")


@query(sql("promo", MENTIONS + "SELECT DISTINCT mention_id, product FROM mt WHERE mention_id NOT IN (SELECT mention_id FROM best)"))
def j13_unmatched_mentions(s, d):
    said = written(mentions(s, d))  # read three times
    return J.unmatched_mentions(said, matched(s, d, said)).select("mention_id", "product")


@query(sql("promo", MENTIONS + ", strong AS (SELECT * FROM best WHERE score >= 2), weak AS (SELECT * FROM best) SELECT mention_id, max(score) AS score FROM (FROM strong UNION ALL FROM weak) GROUP BY 1"))
def w15_best_match(s, d):
    """Two runs of the match joined: the higher score stays."""
    best = written(matched(s, d, written(mentions(s, d))).select("mention_id", "score"))
    return best.filter("score >= 2").unionByName(best).groupBy("mention_id").agg(F.max("score").alias("score"))


@query(sql("items promo", CATS + "SELECT cat_m, n_whole, coalesce(n_part, 0) AS n_part, round(100 * coalesce(n_part, 0) / n_whole, 2) AS pct FROM (SELECT cat_m, count(DISTINCT item_code) AS n_whole FROM items GROUP BY 1) LEFT JOIN (SELECT cat_m, count(DISTINCT item_code) AS n_part FROM pc GROUP BY 1) USING (cat_m)"))
def j18_coverage_by_category(s, d):
    return J.coverage_by_category(with_cats(s, d), item_master(s, d), "cat_m")


@query(sql("promo", "+q AS (SELECT quantile_cont(event_price, 0.99) AS p, quantile_cont(cost, 0.99) AS c FROM promo) SELECT 'start_date' AS \"column\", 'date' AS kind, count_if(NOT year(start_date) BETWEEN 1996 AND 2000) AS n FROM promo UNION ALL SELECT 'end_date', 'date', count_if(NOT year(end_date) BETWEEN 1996 AND 2000) FROM promo UNION ALL SELECT 'event_price', 'number', count_if(event_price <= 0 OR event_price > 10 * p) FROM promo, q UNION ALL SELECT 'cost', 'number', count_if(cost <= 0 OR cost > 10 * c) FROM promo, q UNION ALL SELECT 'basis', 'text', count_if(basis IN ('-', 'N/A', '0', '?')) FROM promo"))
def a7_anomaly_report(s, d):
    return A.anomaly_report(promotions(s, d), ["start_date", "end_date"], ["event_price", "cost"], ["basis"], (1996, 2000))


@query(sql("promo", "SELECT promo_type, count(*) AS n, count_if(cost = 0) AS n_zero_cost, count_if(cost = 0 AND discount_price IS NULL) AS n_zero_cost_no_discount FROM promo GROUP BY 1"))
def a8_zero_price_by_type(s, d):
    return promotions(s, d).groupBy("promo_type").agg(F.count("*").alias("n"), F.count_if(F.col("cost") == 0).alias("n_zero_cost"), F.count_if((F.col("cost") == 0) & F.col("discount_price").isNull()).alias("n_zero_cost_no_discount"))


@query(sql("promo", "SELECT event_kind, count(*) AS n, count_if(discount_price IS NULL) AS nulls, round(100 * count_if(discount_price IS NULL) / count(*), 1) AS null_pct FROM promo GROUP BY 1"))
def a9_null_rate_by(s, d):
    return A.null_rate_by(promotions(s, d), "event_kind", "discount_price")


@query(sql("promo", "SELECT count_if(discount_price = event_price) AS equal, count_if(discount_price < event_price) AS less, count_if(discount_price > event_price) AS more FROM promo"))
def a10_price_relation(s, d):
    return A.compare_counts(promotions(s, d), "discount_price", "event_price")


@query(sql("promo sales", FILLED + "SELECT is_combo, count(*) AS n, round(100 * count_if(discount_price = event_price) / count(*), 2) AS pct_equal FROM fl GROUP BY 1"))
def a11_fill_check(s, d):
    f = filled(s, d).withColumn("discount_price", F.round("discount_price", 4))
    return f.groupBy("is_combo").agg(F.count("*").alias("n"), A.pct(F.count_if(F.col("discount_price") == F.col("event_price")), F.count("*")).alias("pct_equal"))


@query(sql("promo", "SELECT event_name, count(*) AS n FROM promo GROUP BY 1 ORDER BY n DESC, event_name LIMIT 20"))
def a12_value_counts(s, d):
    return A.value_counts(promotions(s, d), "event_name", 20)


@query(sql("promo", "SELECT item_code, string_agg(DISTINCT event_name, ', ' ORDER BY event_name) AS promo_list FROM promo GROUP BY 1"))
def a31_promo_list_by_item(s, d):
    return J.promo_list_by_item(promotions(s, d))


CHUNKED = "+n AS (SELECT DISTINCT item_code, event_name FROM promo WHERE trim(event_name) <> ''), o AS (SELECT *, sum(length(event_name) + 2) OVER (PARTITION BY item_code ORDER BY event_name) - length(event_name) - 2 AS before FROM n) "


@query(sql("promo", CHUNKED + "SELECT item_code, CAST(before // 200 AS BIGINT) AS chunk, count(*) AS n, string_agg(event_name, ', ' ORDER BY event_name) AS merged FROM o GROUP BY 1, 2"))
def a31_promo_list_in_chunks(s, d):
    names = promotions(s, d).select("item_code", "event_name").distinct()
    return A.merge_in_chunks(names, "item_code", ["event_name"], "event_name", ", ", 200)


@query(sql("promo", "+dg AS (SELECT event_name, count(DISTINCT item_code) AS d FROM promo GROUP BY 1) SELECT count(*) AS n_nodes, round(quantile_cont(d, 0.5), 2) AS median, max(d) AS largest, count_if(d = 1) AS n_single, round(100 * count_if(d = 1) / count(*), 2) AS single_pct, count_if(d >= (SELECT quantile_cont(d, 0.99) FROM dg)) AS n_hubs FROM dg"))
def a32_node_degree(s, d):
    return A.node_degree(promotions(s, d), "event_name")


@query(sql("promo", "SELECT n_types, count(*) AS n_items FROM (SELECT item_code, count(DISTINCT event_kind) AS n_types FROM promo GROUP BY 1) GROUP BY 1"))
def a33_types_per_item(s, d):
    per = promotions(s, d).groupBy("item_code").agg(F.countDistinct("event_kind").alias("n_types"))
    return per.groupBy("n_types").agg(F.count("*").alias("n_items"))


@query(sql("promo", "SELECT strftime(start_date, '%Y-%m') AS month, count(*) AS n FROM promo GROUP BY 1"))
def a34_promo_by_month(s, d):
    return A.value_counts(promotions(s, d).withColumn("month", F.date_format("start_date", "yyyy-MM")), "month")


@query(sql("items promo", CATS + "SELECT cat_m, round(avg(days), 4) AS mean_days, max(days) AS max_days, quantile_cont(days, 0.5) AS median_days FROM (SELECT cat_m, CAST(end_date - start_date AS BIGINT) AS days FROM pc WHERE year(end_date) < 9999) GROUP BY 1"))
def a35_promo_duration(s, d):
    days = P.closed_promos(with_cats(s, d)).withColumn("days", F.datediff("end_date", "start_date").cast("long"))
    median = O.grouped_percentiles(days, "cat_m", "days", [0.5]).select("cat_m", F.get("percentiles", F.lit(0)).alias("median_days"))
    return days.groupBy("cat_m").agg(F.round(F.avg("days"), 4).alias("mean_days"), F.max("days").alias("max_days")).join(median, "cat_m")


@query(sql("promo", "SELECT CAST(end_date - start_date AS BIGINT) AS days, count(*) AS n FROM promo WHERE year(end_date) < 9999 GROUP BY 1 ORDER BY n DESC, days LIMIT 10"))
def a35_duration_mode(s, d):
    days = P.closed_promos(promotions(s, d)).withColumn("days", F.datediff("end_date", "start_date").cast("long"))
    return A.value_counts(days, "days", 10)


UNION = "+nv AS (SELECT DISTINCT " + NORM + " AS event, start_date, end_date FROM promo WHERE year(end_date) < 9999), f AS (SELECT *, CASE WHEN max(end_date) OVER w IS NULL OR start_date - max(end_date) OVER w > 1 THEN 1 ELSE 0 END AS fresh FROM nv WINDOW w AS (PARTITION BY event ORDER BY start_date, end_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), i AS (SELECT *, sum(fresh) OVER (PARTITION BY event ORDER BY start_date, end_date ROWS UNBOUNDED PRECEDING) AS island FROM f), m AS (SELECT event, min(start_date) AS s, max(end_date) AS e FROM i GROUP BY event, island) "


@query(sql("promo", UNION + "SELECT event, count(*) AS n_intervals, CAST(sum(e - s + 1) AS BIGINT) AS days, min(s) AS first, max(e) AS last, CAST(max(e) - min(s) + 1 AS BIGINT) AS span FROM m GROUP BY 1"))
def a36_interval_union(s, d):
    named = P.closed_promos(promotions(s, d)).withColumn("event", T.norm_event(F.col("event_name")))
    return A.interval_union(named, "event").withColumn("span", F.col("span").cast("long"))


@query(sql("promo", "SELECT event_kind, count(DISTINCT item_code) AS n_items FROM promo WHERE item_code IN (SELECT item_code FROM promo WHERE event_kind LIKE '1%') AND event_kind NOT LIKE '1%' GROUP BY 1"))
def a37_promo_overlap(s, d):
    promo = promotions(s, d)
    shared = promo.join(promo.filter("event_kind like '1%'").select("item_code"), "item_code", "left_semi").filter("event_kind not like '1%'")
    return shared.groupBy("event_kind").agg(F.countDistinct("item_code").alias("n_items"))


@query(sql("items promo", CATS + "SELECT cat_m, event_kind, count(DISTINCT item_code) AS n, round(100 * count(DISTINCT item_code) / sum(count(DISTINCT item_code)) OVER (PARTITION BY cat_m), 2) AS row_pct FROM pc GROUP BY 1, 2"))
def a38_category_type_crosstab(s, d):
    return A.crosstab_share(with_cats(s, d), "cat_m", "event_kind")


@query(sql("items promo", CATS + "SELECT event_kind, cat_m, count(*) AS n, count(DISTINCT item_code) AS n_items, row_number() OVER (PARTITION BY event_kind ORDER BY count(*) DESC, cat_m) AS rank FROM pc WHERE event_kind LIKE '1%' OR event_kind LIKE '2%' GROUP BY 1, 2 QUALIFY rank <= 10"))
def a39_type_focus(s, d):
    focus = with_cats(s, d).filter("event_kind like '1%' or event_kind like '2%'").groupBy("event_kind", "cat_m").agg(F.count("*").alias("n"), F.countDistinct("item_code").alias("n_items"))
    return W.top_k_per_group(focus, "event_kind", [F.desc("n"), "cat_m"], 10)


EVENT_PAIRS = CATS + ", ec AS (SELECT DISTINCT event_kind, " + NORM + " AS event, cat_l FROM pc), ep AS (SELECT a.event_kind, a.cat_l AS cat_a, b.cat_l AS cat_b, count(*) AS n FROM ec a JOIN ec b ON a.event_kind = b.event_kind AND a.event = b.event AND a.cat_l < b.cat_l GROUP BY 1, 2, 3) "


def event_categories(s, d):
    return with_cats(s, d).withColumn("event", T.norm_event(F.col("event_name")))


@query(sql("items promo", EVENT_PAIRS + "SELECT cat_a, cat_b, CAST(sum(n) AS BIGINT) AS n FROM ep GROUP BY 1, 2"))
def a40_event_pairs(s, d):
    return A.event_pairs(event_categories(s, d), ["event_kind", "event"], "cat_l")


@query(sql("items promo", EVENT_PAIRS + "SELECT cat_a, cat_b, n FROM ep WHERE event_kind LIKE '1%'"))
def a40_event_pairs_of_type(s, d):
    return A.event_pairs(event_categories(s, d).filter("event_kind like '1%'"), ["event"], "cat_l")


@query(sql("items promo", CATS + "SELECT event_name, count(*) AS n, string_agg(DISTINCT cat_m, ', ' ORDER BY cat_m) AS categories FROM pc WHERE event_kind LIKE '1%' GROUP BY 1 ORDER BY n DESC, event_name LIMIT 10"))
def a41_top_events(s, d):
    grouped = with_cats(s, d).filter("event_kind like '1%'").groupBy("event_name").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("cat_m")), ", ").alias("categories"))
    return grouped.orderBy(F.desc("n"), "event_name").limit(10)


GINI = CATS + ", x AS (SELECT cat_m, item_code, count(*) AS x FROM pc GROUP BY 1, 2), g AS (SELECT cat_m, count(*) AS n, max(x) AS max_x, round(avg(x), 4) AS mean_x, round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*), 4) AS gini FROM (SELECT *, row_number() OVER (PARTITION BY cat_m ORDER BY x, item_code) AS i FROM x) GROUP BY 1), ts AS (SELECT cat_m, round(sum(x) FILTER (rn <= greatest(1, floor(0.2 * n))) / sum(x), 4) AS top_share FROM (SELECT *, row_number() OVER (PARTITION BY cat_m ORDER BY x DESC, item_code) AS rn, count(*) OVER (PARTITION BY cat_m) AS n FROM x) GROUP BY 1) "


def item_events(s, d):
    return with_cats(s, d).groupBy("cat_m", "item_code").agg(F.count("*").alias("x"))


def top_share(s, d):
    r = W.ranked_shares(item_events(s, d), "cat_m", "x")
    top = F.col("rn") <= F.greatest(F.lit(1), F.floor(0.2 * F.col("n")))
    return r.groupBy("cat_m").agg(F.round(F.sum(F.when(top, F.col("x"))) / F.sum("x"), 4).alias("top_share"))


@query(sql("items promo", GINI + "SELECT cat_m, n, gini FROM g"))
def a42_gini_by_category(s, d):
    return W.gini_by_group(item_events(s, d), "cat_m").select("cat_m", "n", "gini")


@query(sql("items promo", GINI + "SELECT * FROM ts"))
def a43_top_share_by_category(s, d):
    return top_share(s, d)


@query(sql("items promo", GINI + "SELECT g.*, top_share, round(100 * n / n_whole, 2) AS coverage_pct FROM g JOIN ts USING (cat_m) JOIN (SELECT cat_m, count(DISTINCT item_code) AS n_whole FROM items GROUP BY 1) USING (cat_m)"))
def a44_concentration_report(s, d):
    whole = item_master(s, d).groupBy("cat_m").agg(F.countDistinct("item_code").alias("n_whole"))
    joined = W.gini_by_group(item_events(s, d), "cat_m").join(top_share(s, d), "cat_m").join(whole, "cat_m")
    return joined.withColumn("coverage_pct", A.pct(F.col("n"), F.col("n_whole"))).drop("n_whole")


#: The driver's names have no season in them: one of all words, or none, is put behind each, and the name alone then decides.
SEASON_WORDS = ["", *[w for _, words in T.SEASONS for w in words]]
NAMED = "event_name || ' ' || [" + ", ".join(f"'{w}'" for w in SEASON_WORDS) + f"][CAST(item_code AS INTEGER) % {len(SEASON_WORDS)} + 1]"
SEASON_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(nm), '{w}')" for w in words) + f" THEN '{label}'" for label, words in T.SEASONS) + " END"


def seasonal(s, d):
    word = F.get(F.array(*map(F.lit, SEASON_WORDS)), F.col("item_code").cast("int") % len(SEASON_WORDS))
    return promotions(s, d).withColumn("season", T.season(F.concat("event_name", F.lit(" "), F.upper(word))))


@query(sql("promo", f"SELECT {SEASON_SQL} AS season, count(*) AS n FROM (SELECT {NAMED} AS nm FROM promo) WHERE {SEASON_SQL} IS NOT NULL GROUP BY 1"))
def a45_season_counts(s, d):
    # a filter on the season itself would be pushed down and look for it twice
    return seasonal(s, d).groupBy("season").agg(F.count("season").alias("n")).filter("n > 0")


@query(sql("promo", "SELECT promo_type, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM promo GROUP BY 1"))
def a77_type_share(s, d):
    return A.share_counts(promotions(s, d), "promo_type")


@query(sql("promo", f"SELECT DISTINCT event_name, {NORM} AS event FROM promo"))
def f9_norm_event(s, d):
    return promotions(s, d).select("event_name", T.norm_event(F.col("event_name")).alias("event")).distinct()


@query(sql("promo", f"SELECT event, count(*) AS n_names FROM (SELECT DISTINCT event_name, {NORM} AS event FROM promo) GROUP BY 1 HAVING count(*) >= 2"))
def f10_norm_groups(s, d):
    names = promotions(s, d).select("event_name", T.norm_event(F.col("event_name")).alias("event"))
    return names.groupBy("event").agg(F.countDistinct("event_name").alias("n_names")).filter("n_names >= 2")


@query(sql("promo", "SELECT DISTINCT event_name FROM promo WHERE regexp_matches(event_name, '([0-9]{4}|[0-9]{1,2}월|[0-9]+차|[0-9]+회|\\(|\\[)')"))
def f11_event_name_pattern(s, d):
    return promotions(s, d).filter(T.has_event_pattern(F.col("event_name"))).select("event_name").distinct()


@query(sql("promo", "SELECT event_code, item_code, CAST(regexp_extract(event_name, '(^|[^0-9])(1[0-2]|[1-9])월', 2) AS INTEGER) AS month FROM promo"))
def f12_months_in_name(s, d):
    return promotions(s, d).select("event_code", "item_code", F.explode(T.months_in_name(F.col("event_name"))).alias("month"))


@query("SELECT DISTINCT p_name, array_to_string(list_filter(string_split(p_name, ' '), lambda t: length(t) >= 2), ' ') AS tokens FROM part")
def f13_tokenize(s, d):
    return s.read.parquet(f"{d}/part.parquet").select("p_name", F.array_join(T.tokenize(F.col("p_name")), " ").alias("tokens")).distinct()


@query("SELECT a.p_partkey, CAST(len(list_filter(string_split(a.p_name, ' '), lambda t: length(t) >= 2 AND contains(lower(b.p_name), lower(t)))) AS INTEGER) AS score FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def f14_match_score(s, d):
    """A name's tokens against the next item's name in capitals."""
    part = s.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name")
    following = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.upper("p_name").alias("text"))
    return part.join(following, "p_partkey").select("p_partkey", T.match_score(T.tokenize(F.col("p_name")), F.col("text")).alias("score"))


@query(sql("promo", f"SELECT event_code, item_code, {SEASON_SQL} AS season FROM (SELECT event_code, item_code, {NAMED} AS nm FROM promo)"))
def f17_season(s, d):
    return seasonal(s, d).select("event_code", "item_code", "season")


@query(sql("promo", "SELECT item_code AS src, promo_type AS dst, 'IN_PROMO' AS kind, CAST(count(*) AS DOUBLE) AS weight FROM promo GROUP BY 1, 2"))
def g2_item_type_edges(s, d):
    return G.item_type_edges(promotions(s, d))


@query(sql("items promo", GINI + "SELECT cat_m AS src, promo_type AS dst, 'CATEGORY_PROMO' AS kind, round(n_pair / n_items * (1 - gini), 6) AS weight FROM (SELECT cat_m, promo_type, count(DISTINCT item_code) AS n_pair FROM pc GROUP BY 1, 2) JOIN (SELECT cat_m, count(DISTINCT item_code) AS n_items FROM pc GROUP BY 1) USING (cat_m) JOIN g USING (cat_m)"))
def g3_category_type_edges(s, d):
    promo = with_cats(s, d)
    cells = promo.groupBy("cat_m", "promo_type").agg(F.countDistinct("item_code").alias("n_pair"))
    totals = promo.groupBy("cat_m").agg(F.countDistinct("item_code").alias("n_items"))
    return G.category_type_edges(cells, totals, W.gini_by_group(item_events(s, d), "cat_m").select("cat_m", "gini"), "cat_m")
