"""Edge cases by hand: ties, nulls, empty tables, zero denominators, non-ASCII text."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from shelfwise.functions import text as T
from shelfwise.operators import aggregates as A
from shelfwise.operators import clean as P
from shelfwise.operators import joins as J
from shelfwise.operators import ordering as O
from shelfwise.operators import windows as W
from shelfwise.sources import files as S

D = dt.date


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def text(spark, f, value):
    return one(spark, f(F.col("v")), v=value)


SALES = "item_code string, item_name string, cat string, amount long, qty long"


def test_pareto_rules_differ_on_small_and_top_heavy_categories(spark):
    rows = [("a", "A", "one", 90, 1), ("b", "B", "one", 10, 1), *[(f"c{i}", f"C{i}", "many", 5, 1) for i in range(5)], *[(f"z{i}", "Z", "zero", 0, 1) for i in range(5)]]
    sales = spark.createDataFrame(rows, SALES)
    plain = {r["cat"]: r["n_cut"] for r in W.pareto_by_category(sales, "cat").collect()}
    assert plain == {"many": 4}  # under five items and zero sales are left out
    named = {r["cat"]: (r["n_cut"], r["names"]) for r in W.pareto_names(sales, "cat").collect()}
    assert named["one"] == (1, "A") and named["many"] == (4, "C0, C1, C2, C3")
    assert {r["item_code"] for r in W.top80_items(sales, "cat").collect()} == {"a", "c0", "c1", "c2", "c3"}


def test_ranked_shares_count_ties_once_each(spark):
    sales = spark.createDataFrame([("a", "", "x", 5, 1), ("b", "", "x", 5, 1), ("c", "", "x", 1, 1)], SALES)
    got = [round(r["cum_pct"], 2) for r in W.ranked_shares(sales, "cat").orderBy("rn").collect()]
    assert got == [45.45, 90.91, 100.0]


def test_gini(spark):
    rows = [("a", "even", 3), ("b", "even", 3), ("c", "alone", 7), ("d", "zero", 0), ("e", "zero", 0)]
    got = {r["g"]: r["gini"] for r in W.gini_by_group(spark.createDataFrame(rows, "item_code string, g string, x long"), "g").collect()}
    assert got == {"even": 0.0, "alone": 0.0, "zero": None}


def test_voids_with_no_one_or_two_sales(spark):
    day, other = D(2025, 1, 1), D(2025, 1, 2)
    line = lambda date, trade, item, amount: (date, "s", "p", trade, item, 1 if amount > 0 else -1, amount)
    rows = [line(day, "1", "a", 10), line(other, "2", "a", 10), line(day, "3", "a", -10), line(day, "4", "b", -10), line(other, "5", "c", 7), line(day, "6", "c", -7)]
    lines = spark.createDataFrame(rows, "sale_date date, store string, pos_no string, trade_no string, item_code string, qty long, amount long")
    got = {r["trade_no"]: (r["n_sales"], r["n_same_day"]) for r in J.match_voids(lines).collect()}
    assert got == {"3": (2, 1), "4": (0, 0), "6": (1, 0)}
    assert J.void_match_rate(lines).first()["match_pct"] == 66.67


def test_pairs_count_a_receipt_once(spark):
    rows = [("r1", "a"), ("r1", "b"), ("r1", "b"), ("r1", "c"), ("r2", "a"), ("r3", "b"), ("r3", "a"), ("r4", None)]
    got = {(r["cat_a"], r["cat_b"]): r["n"] for r in J.co_purchase_pairs(spark.createDataFrame(rows, "k string, c string"), ["k"], "c").collect()}
    assert got == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}


def test_interval_union(spark):
    rows = [("touch", D(2025, 1, 1), D(2025, 1, 3)), ("touch", D(2025, 1, 4), D(2025, 1, 5)), ("apart", D(2025, 1, 1), D(2025, 1, 2)), ("apart", D(2025, 1, 5), D(2025, 1, 6)), ("nested", D(2025, 1, 1), D(2025, 1, 9)), ("nested", D(2025, 1, 2), D(2025, 1, 3)), ("nested", D(2025, 1, 10), D(2025, 1, 10)), ("same", D(2025, 1, 1), D(2025, 1, 1)), ("same", D(2025, 1, 1), D(2025, 1, 1))]
    got = {r["k"]: (r["n_intervals"], r["days"], r["span"]) for r in A.interval_union(spark.createDataFrame(rows, "k string, start_date date, end_date date"), "k").collect()}
    assert got == {"touch": (1, 5, 5), "apart": (2, 4, 6), "nested": (1, 10, 10), "same": (1, 1, 1)}


def test_lift_is_infinite_without_a_baseline(spark):
    days = [(D(2025, 2, d), "a", 20) for d in range(8, 15)] + [(D(2025, 2, 1), "b", 1), (D(2025, 2, 10), "b", 70)]
    daily = spark.createDataFrame(days, "date date, item_code string, qty long")
    periods = spark.createDataFrame([("VALENTINE", D(2025, 2, 8), D(2025, 2, 14))], "period_key string, start_date date, end_date date")
    got = {r["item_code"]: (r["lift"], r["specificity"]) for r in A.period_lift(daily, periods).collect()}
    assert got["a"] == (float("inf"), 1.0) and got["b"][0] == 10.0


def test_range_join_skips_nulls_and_open_ends_cheaply(spark):
    points = spark.createDataFrame([(1, D(2025, 1, 15)), (2, D(2025, 3, 1)), (3, None)], "id int, day date")
    ranges = spark.createDataFrame([("open", D(2025, 1, 1), D(9999, 12, 31)), ("null", D(2025, 1, 1), None), ("jan", D(2025, 1, 15), D(2025, 1, 15)), ("back", D(2025, 3, 2), D(2025, 2, 1))], "k string, start_date date, end_date date")
    got = {(r["id"], r["k"]) for r in J.range_join(points, ranges, "day").collect()}
    assert got == {(1, "open"), (2, "open"), (1, "jan")}
    assert J.range_join(points.limit(0), ranges, "day").count() == 0


def test_post_promo_match_against_brute_force(spark):
    """Every promotion in force is weighed: open-ended, nested, equal and touching ones, tokens inside longer words."""
    rng = random.Random(6)
    day = lambda n: D(2025, 1, 1) + dt.timedelta(days=n)
    stems = ["Cola", "cocoa", "co", "콜라", "제로", "zero", "ze", "a", "라"]
    promo = []
    for i in range(150):
        start = rng.randrange(60)
        end = D(2099, 12, 31) if rng.random() < 0.1 else day(start + rng.choice([-2, 0, 1, 3, 3, 10, 30]))
        promo.append((f"e{i % 140:03d}", " ".join(rng.choice(stems) + rng.choice(["", "1", "라"]) for _ in range(rng.randrange(1, 3))), day(start), end))
    said = [(i, day(rng.randrange(-3, 75)), " ".join(rng.choice(stems) for _ in range(rng.randrange(1, 4)))) for i in range(200)] + [(900, None, "cola"), (901, day(3), None), (902, day(3), "!! a")]
    want = {}
    for i, date, product in said:
        tokens = [t for t in re.sub(r"[^\w]", " ", product or "").split(" ") if len(t) >= 2]
        fits = [(-sum(t.lower() in name.lower() for t in tokens), start, code, name) for code, name, start, end in promo if date and start <= date <= end]
        if fits and min(fits)[0] < 0:
            want[i] = min(fits)[:3]
    mentions = spark.createDataFrame(said, "mention_id int, post_date date, product string")
    got = J.post_promo_match(mentions, spark.createDataFrame(promo, "event_code string, event_name string, start_date date, end_date date")).collect()
    assert {r["mention_id"]: (-r["score"], r["start_date"], r["event_code"]) for r in got} == want and len(got) == len(want) > 100


def test_prefix_sums_and_percentiles_against_plain_lists(spark):
    """Orders over a whole table, dealt by range: ties, nulls, one value for half of the rows, an empty table."""
    rng = random.Random(12)
    rows = [(i, rng.choice([None, 7, 7, 7, rng.randrange(-50, 50)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, v long").repartition(7)
    got = [tuple(r) for r in O.prefix_sums(df.filter("v is not null"), [F.desc("v"), "k"], n=F.lit(1), total=F.col("v")).collect()]
    kept = sorted(((k, v) for k, v in rows if v is not None), key=lambda r: (-r[1], r[0]))
    assert sorted(got, key=lambda r: r[2]) == [(k, v, i + 1, sum(x for _, x in kept[: i + 1])) for i, (k, v) in enumerate(kept)]
    shares = [0.0, 0.05, 0.5, 0.99, 1.0]
    exact = df.agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("v")).first()["v"]
    assert all(abs(a - b) < 1e-9 for a, b in zip(O.percentiles(df, ["v"], shares).first()["v"], exact, strict=True))
    assert O.percentiles(df.limit(0), ["v", "k"], [0.5]).first()[:] == ([None], [None])
    assert O.prefix_sums(df.limit(0), ["v"], n=F.lit(1)).count() == 0
    one = lambda rows: W.rank_correlation(spark.createDataFrame(rows, "x int, y int"), "x", "y").first()[0]
    assert one([(1, 9), (2, 7), (2, 7), (5, 1), (None, 3)]) == -1.0


def test_cp949_files_are_read(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("코드,이름\n1,세븐일레븐 컵라면\nx,\"삼각,김밥\"\n3,\n".encode("cp949"))
    got = S.read_csv_encoded(spark, str(tmp_path), "code int, name string", "CP949").collect()
    assert [tuple(r) for r in got] == [(1, "세븐일레븐 컵라면"), (None, "삼각,김밥"), (3, None)]


def test_launch_windows_include_both_ends(spark):
    rows = [("a", D(2025, 1, 1) + dt.timedelta(days=n), 1, 1) for n in (0, 7, 8, 14, 28, 29)]
    lines = spark.createDataFrame(rows, "item_code string, sale_date date, qty long, amount long")
    e = J.first_sale_enriched(lines)
    assert A.cumulative_windows(e, [7, 14, 28]).first()[1:] == (2, 4, 5)
    assert {r["week"]: r["qty"] for r in A.weekly_launch_sales(e).collect()} == {0: 1, 1: 2, 2: 1}


def test_codes_are_padded_not_cut(spark):
    assert [text(spark, P.pad_code, v) for v in ("12345", "123456", "1234567", None)] == ["012345", "123456", "1234567", None]


def test_event_names(spark):
    assert [text(spark, T.norm_event, v) for v in ("3월 a", "25년 3월 a (2)", "1~2월 행사 (3)", "a", None)] == ["a", "a", "행사", "a", None]
    assert [text(spark, T.months_in_name, v) for v in ("12월", "112월", "1~2월 행사 (3)", "13월", None)] == [[12], [], [2], [], None]
    assert text(spark, T.season, "봄맛 Christmas") == "봄페스티벌"
    assert text(spark, T.season, None) is None


def test_keywords(spark):
    assert [text(spark, T.keyword_count, v) for v in ("", " ", "a, , b", None)] == [0, 0, 2, 0]
    assert [text(spark, T.has_fake, v) for v in ("없음", "맛없음", "해당 없음", "a, N/A", "부담없음", None)] == [True, False, True, True, False, False]


def test_text_cleaning(spark):
    got = one(spark, T.clean_post_text(F.col("t"), F.col("b")), t="#태그 @계정.x　안녕", b="a\t\tb\n c 😀")
    assert got == "태그 안녕 a b c 😀"
    assert [text(spark, T.clean_blog_text, "x" * n) for n in (99, 100)] == ["", "x" * 100]
    assert text(spark, lambda c: T.line_features(c)["num_lines"], " \n\n ") == 0
    assert text(spark, lambda c: T.line_features(c)["mean_line_len"], None) == 0
    assert text(spark, T.type_token_ratio, "a b a") == 0.6667
    assert text(spark, T.parse_product_name, "세븐일레븐  브랜드)빵") == "브랜드)빵"
    assert text(spark, T.parse_product_name, None) == ""


def test_replies(spark):
    good = 'x {"metadata":[{"name":"a","price":1}],"promotion_type":["1+1"]} y'
    assert text(spark, T.extract_json_block, good).startswith("{") and text(spark, T.extract_json_block, "none") is None
    for broken in ('{"a": [1, 2,], "b": "x",}', '{"a": ["x" "y"]}', '{"a": {"b": ["c"', '{"a": "open'):
        assert text(spark, T.repair_json, broken) is not None, broken
    assert text(spark, T.repair_json, "no braces") is None
    assert [text(spark, lambda c: T.is_promo_post(c, F.lit(""), F.lit("")), v) for v in ('{"metadata":[{"promotion_type":["1+1"]}]}', '{"metadata":[{"promotion_type":"sale"}]}', '{"metadata":[{"promotion_type":[""]}]}', None)] == [True, True, False, False]
    assert text(spark, T.structured_keyword_count, good) == 1


def test_time_of_day(spark):
    assert [text(spark, T.hour, v) for v in ("93000", "0", "235959", "xxxxxx")] == [9, 0, 23, None]
    assert text(spark, lambda c: T.weekday(c.cast("date")), "2025-01-06") == 1


def test_captions_and_ids(spark):
    posts = spark.createDataFrame([(None, "https://x/p/abc/", "t" * 60 + "\nrest"), ("7", None, ""), (None, None, None)], "post_id string, url string, body string")
    got = P.split_caption(P.assign_post_id(posts)).collect()
    assert [r["title"] for r in got] == ["t" * 50 + "...", "(no title)", "(no title)"]
    assert [r["post_id"] for r in got][:2] == ["abc", "7"]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SALES)
    for f in (W.pareto_by_category, W.pareto_names, W.top80_items, W.top_share_items, W.top_quantile_by):
        assert f(empty, "cat").count() == 0
    assert W.lorenz(empty).count() == 0 and W.top_quantile_items(empty).count() == 0
