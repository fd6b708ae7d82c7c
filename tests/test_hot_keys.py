"""Scans, merges and pairs whose hot keys are the work of several tasks, and character sets that are decoded before fields are split."""

import datetime
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import aggregates as A
from shelfwise.operators import joins as J
from shelfwise.operators import ordering as O
from shelfwise.sources import files as S

DAY = datetime.date(2020, 1, 1)


@pytest.fixture
def parts(spark, monkeypatch):
    """The folders of the tables that are dealt by range; small parts aren't joined again."""
    paths = []
    monkeypatch.setattr(O, "scratch_dir", lambda s, f=O.scratch_dir: paths.append(f(s)) or paths[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield paths
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_union(intervals):
    """(islands, days) by walking every day."""
    held = sorted({d for a, b in intervals for d in range(a, b + 1)})
    return sum(1 for i, d in enumerate(held) if i == 0 or d - held[i - 1] > 1), len(held)


def test_one_key_with_nearly_all_intervals_is_split(spark, parts):
    rng = random.Random(3)
    rows = [("hot", a := rng.randrange(30_000), a + rng.choice([0, 1, 5, 9])) for _ in range(6000)] + [("hot", 4000, 19_000)]
    rows += [(k, a := rng.randrange(90), a + rng.randrange(4)) for k in ["x", "y", None] for _ in range(20)]
    typed = spark.createDataFrame(rows + [("x", None, 5), ("y", 7, None), ("only null", None, None)], "k string, a int, b int").select("k", *[F.date_add(F.lit(DAY), c).alias(n) for c, n in (("a", "start_date"), ("b", "end_date"))])
    got = {r["k"]: (r["n_intervals"], r["days"], (r["first"] - DAY).days, (r["last"] - DAY).days, r["span"]) for r in A.interval_union(typed, "k").collect()}
    want = defaultdict(list)
    for k, a, b in rows:
        want[k].append((a, b))
    assert got == {k: (*plain_union(v), low := min(a for a, _ in v), high := max(b for _, b in v), high - low + 1) for k, v in want.items()}
    dealt = spark.read.parquet(parts[0]).filter("k = 'hot'").groupBy("_part").count().collect()
    assert len(dealt) >= 3 and max(r["count"] for r in dealt) < 3000


def test_running_max_crosses_parts_without_a_value(spark, parts):
    rows = [("k", i, {0: 99, 40: None, 150: 120}.get(i, None if i % 3 else i % 7)) for i in range(200)]
    got = {r["i"]: r["m"] for r in O.grouped_running_max(spark.createDataFrame(rows, "k string, i int, v int"), "k", ["i"], "v", "m").collect()}
    assert got == {i: None if i == 0 else 120 if i > 150 else 99 for i in range(200)}
    assert O.grouped_running_max(spark.createDataFrame([], "k string, i int, v int"), "k", ["i"], "v", "m").count() == 0


def plain_chunks(rows, separator, most):
    out, upto = defaultdict(list), Counter()
    for k, _, t in sorted((r for r in rows if r[2] and r[2].strip(" ")), key=lambda r: r[1]):
        out[k, upto[k] // most].append(t)
        upto[k] += len(t) + len(separator)
    return {k: (len(v), separator.join(v)) for k, v in out.items()}


def test_merge_in_chunks_keeps_order_and_bounds_rows(spark, parts):
    rng = random.Random(5)
    rows = [("hot" if i % 4 else rng.choice(["a", None]), i, rng.choice(["", "  ", None, "é" * rng.randrange(1, 60), "x" * rng.randrange(1, 9)])) for i in range(3000)] + [("long", 1, "y" * 5000), ("long", 2, "z")]
    df = spark.createDataFrame(rows, "k string, i long, t string").repartition(5)
    found = A.merge_in_chunks(df, "k", ["i"], "t", " | ", 500).collect()
    assert {(r["k"], r["chunk"]): (r["n"], r["merged"]) for r in found} == plain_chunks(rows, " | ", 500)
    assert max(len(r["merged"]) for r in found if r["k"] != "long") < 560
    whole = A.merge_by_key(df.withColumns({"c": F.lit("c"), "l": F.lit("l")}), "k", "i", "c", "l", "t", " | ")
    joined = defaultdict(list)
    for r in sorted(found, key=lambda r: r["chunk"]):
        joined[r["k"]].append(r["merged"])
    assert {r["k"]: r["merged"] for r in whole.collect()} == {k: " | ".join(v) for k, v in joined.items()}
    dealt = spark.read.parquet(parts[0]).filter("k = 'hot'").groupBy("_part").count().collect()
    assert len(dealt) >= 2 and A.merge_in_chunks(df.limit(0), "k", ["i"], "t", " | ", 500).count() == 0


def test_lists_in_chunks_hold_every_value_once(spark):
    rows = [("hot", f"{i:05d}") for i in range(2500)] + [("hot", "00007"), ("cold", "b"), ("cold", "a"), (None, "n"), ("cold", None)]
    found = A.listed_in_chunks(spark.createDataFrame(rows, "k string, v string").repartition(3), "k", "v", 100).collect()
    assert max(len(r["values"]) for r in found) == 100
    got = [(r["k"], v) for r in sorted(found, key=lambda r: (str(r["k"]), r["chunk"])) for v in r["values"]]
    assert got == sorted(((k, v) for k, v in rows if v), key=lambda r: (str(r[0]), r[1]))


def test_pairs_of_rare_values_are_not_made(spark):
    rng = random.Random(6)
    rows = [(i, c) for i in range(200) for c in {*rng.sample("abcde", 3), f"rare{rng.randrange(400)}", f"rare{rng.randrange(400)}"}] + [(1, None), (2, "a"), (2, "a")]
    df = spark.createDataFrame(rows, "k int, c string")
    full = {(r["cat_a"], r["cat_b"]): r["n"] for r in J.co_purchase_pairs(df, ["k"], "c").collect()}
    few = {(r["cat_a"], r["cat_b"]): r["n"] for r in J.co_purchase_pairs(df, ["k"], "c", 4).collect()}
    assert few == {p: n for p, n in full.items() if n >= 4} and 0 < len(few) < len(full) / 10


@pytest.mark.parametrize("encoding", ["shift_jis", "cp949", "gbk", "big5"])
def test_characters_with_a_separators_byte_in_several_splits(spark, tmp_path, encoding):
    """0x5C is the second byte of common characters in Shift-JIS, GBK and Big5."""
    words = {"shift_jis": ["表示", "ソ連", "能力"], "cp949": ["컵라면", "똠방각하", "햏"], "gbk": ["誠", "乗", "汉字"], "big5": ["功能", "許", "蓋"]}[encoding]
    rows = [(i, words[i % 3] * (1 + i % 5), words[(i + 1) % 3]) for i in range(900)]
    for part in range(2):
        lines = ["code,name,note", *[f'{i},"{a}, {b}",{b}' for i, a, b in rows[part::2]], "", f"{words[0]},,"]
        (tmp_path / f"{part}.csv").write_bytes("\r\n".join(lines).encode(encoding))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = S.read_csv_encoded(spark, str(tmp_path), "code long, name string, note string", encoding)
        assert found.rdd.getNumPartitions() > 4
        got = sorted((tuple(r) for r in found.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted([(i, f"{a}, {b}", b) for i, a, b in rows] + [(None, None, None)] * 2, key=str)


def test_encoded_file_of_a_header_alone_or_bad_bytes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"code,name\n")
    (tmp_path / "b.csv").write_bytes(b"code,name\n1,\xff\xff\n")
    got = S.read_csv_encoded(spark, str(tmp_path), "code long, name string", "cp949").collect()
    assert [r["code"] for r in got] == [1] and "�" in got[0]["name"]
