"""Forms that hold at scale: scans of hot groups in several tasks, matching by postings, JSON repair without Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import text as T
from shelfwise.operators import joins as J
from shelfwise.operators import ordering as O
from shelfwise.operators import windows as W


@pytest.fixture(scope="module")
def hot(spark):
    """Half of the items are of one category, a few have none."""
    rng = random.Random(1)
    rows = [(f"i{k:05d}", "hot" if k % 2 else rng.choice(["a", "b", "c", None]), rng.randrange(50)) for k in range(4000)]
    return rows, spark.createDataFrame(rows, "item_code string, cat string, amount long").repartition(6)


def test_grouped_prefix_sums_equal_a_window(spark, hot):
    rows, df = hot
    found = O.grouped_prefix_sums(df, "cat", [F.desc("amount"), "item_code"], rn=F.lit(1), run=F.col("amount"))
    want, totals = {}, {}
    for code, cat, amount in sorted(rows, key=lambda r: (-r[2], r[0])):
        n, s = totals.get(cat, (0, 0))
        totals[cat] = (n + 1, s + amount)
        want[code] = totals[cat]
    got = {r["item_code"]: r for r in found.collect()}
    assert len(got) == len(rows)
    for code, cat, _ in rows:
        r = got[code]
        assert (r["rn"], r["run"], r["total_rn"], r["total_run"]) == (*want[code], *totals[cat])


def test_a_hot_category_is_dealt_to_several_tasks(spark, hot, monkeypatch):
    paths = []
    monkeypatch.setattr(O, "scratch_dir", lambda s, f=O.scratch_dir: paths.append(f(s)) or paths[-1])
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"  # would join parts as small as these
    spark.conf.set(coalesce, "false")
    W.ranked_shares(hot[1].select("item_code", "cat", "amount"), "cat").count()
    spark.conf.unset(coalesce)
    parts = spark.read.parquet(paths[0]).filter("cat = 'hot'").groupBy("_part").count().collect()
    assert len(parts) >= 2 and max(r["count"] for r in parts) < 1900


def test_grouped_percentiles_equal_percentile(spark, hot):
    df = hot[1].withColumn("amount", F.when(F.col("amount") != 7, F.col("amount")))
    want = {r["cat"]: r["p"] for r in df.groupBy("cat").agg(F.percentile("amount", [0.0, 0.5, 0.95, 1.0]).alias("p")).collect()}
    got = {r["cat"]: r["percentiles"] for r in O.grouped_percentiles(df, "cat", "amount", [0.0, 0.5, 0.95, 1.0]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert O.grouped_percentiles(df.limit(0), "cat", "amount", [0.5]).count() == 0


def plain_fit(product, date, promos):
    tokens = [t for t in product.split() if len(t) >= 2]
    scored = [(-sum(t.lower() in name.lower() for t in tokens), start, code, name) for code, name, start, end in promos if start <= date <= end]
    return min((x for x in scored if x[0] < 0), default=None)


def test_match_by_postings_scores_names_in_proportion_to_products(spark):
    """With a vocabulary of 10,000 words, a common one in every name among them, few names are scored for a product."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10_000):04d}x"
    names = [" ".join([word(), word(), word(), "aktion"]) for _ in range(1500)]
    promos = [(f"e{i:04d}", n, f"2020-{rng.randint(1, 12):02d}-01", rng.choice(["2020-12-31", "2020-06-15", "2099-12-31"])) for i, n in enumerate(names)]
    products = [" ".join([*rng.sample(n.split()[:3], 2), "aktion"]) for n in rng.sample(names, 300)] + ["aktion", "aktion aktion", "nichts davon", "w", ""]
    mentions = [(i, p, f"2020-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}") for i, p in enumerate(products)]
    typed = lambda rows, schema, *dates: spark.createDataFrame(rows, schema).withColumns({d: F.col(d).cast("date") for d in dates})
    running = J.foremost_ranges(typed(promos, "event_code string, event_name string, start_date string, end_date string", "start_date", "end_date"), ["event_name"])
    asked = typed(mentions, "mention_id long, product string, post_date string", "post_date")
    watch = []
    found = {(r["product"], str(r["post_date"])): (-r["score"], str(r["start_date"]), r["event_code"], r["event_name"]) for r in J.best_fits(asked.select("product", "post_date").distinct(), running, watch).collect()}
    want = {(p, d): w for _, p, d in mentions if (w := plain_fit(p, d, promos))}
    assert found == want
    # the rarest token's names; two products have the common token alone. All pairs that share a token would be 300 x 1500
    assert watch[0] <= 2 * len(set(names)) + 3 * len(products)


def test_match_without_any_token_or_promotion(spark):
    none = spark.createDataFrame([], "event_code string, event_name string, start_date date, end_date date")
    asked = spark.createDataFrame([("abc", None)], "product string, post_date string").withColumn("post_date", F.lit("2020-01-01").cast("date"))
    assert J.post_promo_match(asked.withColumn("mention_id", F.lit(1)), none).count() == 0


DAMAGED = {
    '{"a": 1, "b": [1, 2': {"a": 1, "b": [1, 2]},
    '{"a": "x, y", "b": {"c": ["d"': {"a": "x, y", "b": {"c": ["d"]}},
    'Text {"a": [1, 2,], "b": 3,} end': {"a": [1, 2], "b": 3},
    '{"a": "open bracket [ and , ] inside", "b": "cut he': {"a": "open bracket [ and , ] inside", "b": "cut he"},
    '{"m": [{"n": 1} {"n": 2}]}': {"m": [{"n": 1}, {"n": 2}]},
    '{"l": ["x" "y"]}': {"l": ["x", "y"]},
    '{"a": 1, "key': {"a": 1, "key": None},
    '{"a": 1, "key":': {"a": 1, "key": None},
    '{"a": 1,': {"a": 1},
    '{"a": "say \\"hi\\" {", "b": [': {"a": 'say "hi" {', "b": []},
    '{"a": "ends in a backslash \\': {"a": "ends in a backslash "},
    '{"a":\n1,\t"b": "x\ny"}': {"a": 1, "b": "x y"},
    '{"a": 1}': {"a": 1},
}


def test_damaged_json_is_repaired_natively(spark):
    rows = [(k,) for k in DAMAGED]
    fixed = spark.createDataFrame(rows, "r string").select("r", T.repair_json(F.col("r")).alias("f"))
    assert {r["r"]: json.loads(r["f"]) for r in fixed.collect() if r["f"]} == DAMAGED
    plan = fixed._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    odd = spark.createDataFrame([(None,), ("",), ("no braces",), ("}{",), ("}",)], "r string").select(T.repair_json(F.col("r")).alias("f"))
    assert [r["f"] for r in odd.collect()][:3] == [None] * 3


def test_every_cut_of_a_reply_is_repaired(spark):
    whole = '{"m": [{"n": "a{b", "p": 12, "l": ["x", "y, z"]}, {"n": "q\\\\"}], "t": "s"}'
    cuts = [whole[:i] for i in range(1, len(whole) + 1)]
    fixed = spark.createDataFrame([(i, c) for i, c in enumerate(cuts)], "i int, r string").select("i", T.repair_json(F.col("r")).alias("f"))
    found = {r["i"]: r["f"] for r in fixed.collect()}
    for i, c in enumerate(cuts):
        assert found[i] is not None, c
        m = json.loads(found[i]).get("m") or []
        if '"a{b"' in c:
            assert m[0]["n"] == "a{b", c
