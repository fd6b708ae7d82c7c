"""Repeated passages: words hashed and ranges aligned side by side, seeds joined without a sort, all as one by one."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import substring_dedup
from shelfwise.llm.common import salted_join


def odd_texts():
    rng = random.Random(21)
    texts = ["", " ", "A", "aB", "x" * 31, "Y" * 32, "Z" * 33 + " q", " lead", "trail ", "a b　C", "É" * 16, "\t\n\x0b\f\r", "\x1c\x1d a", "ab", "cd"]
    texts += ["".join(rng.choice("aB \n\té漢\U0001f600.") for _ in range(rng.randrange(200))) for _ in range(200)]
    return texts + [" ".join("".join(rng.choice("abcXYZ09") for _ in range(rng.randrange(1, 40))) for _ in range(300))]


@pytest.mark.parametrize("texts", [pa.array(odd_texts()), pa.array(odd_texts()).slice(5, 90), pa.array(odd_texts(), pa.large_string()).slice(3), pa.array(["", ""]), pa.array([], pa.string())])
def test_words_hashed_by_length_are_hashed_as_one_by_one(texts):
    flat, sizes = substring_dedup.word_hashes(texts)
    hasher = substring_dedup.WordHasher()
    want = [hasher.hashes(t.as_py()).tolist() for t in texts]
    assert flat.tolist() == [h for hashes in want for h in hashes] and sizes.tolist() == [len(h) for h in want]


def test_short_words_are_not_hashed_one_by_one(monkeypatch):
    asked = []
    monkeypatch.setattr(substring_dedup.xxhash, "xxh64_intdigest", lambda word, seed: asked.append(word) or 0)
    substring_dedup.word_hashes(pa.array([f"w{i} " * 3 for i in range(5000)] + ["L" * 32]))
    assert asked == [b"l" * 32]


def test_distances_side_by_side():
    rng = np.random.default_rng(22)
    draw = lambda n, k: rng.integers(0, k, n).astype(np.int32)
    pairs = [(draw(rng.integers(0, 90), k), draw(rng.integers(0, 90), k)) for k in (1, 2, 3, 50) for _ in range(200)]
    for n in (63, 64, 65, 200):
        for _ in range(20):
            a = draw(n, 50)
            b = a.copy()
            b[rng.integers(0, n, 9)] += 50
            pairs += [(a, np.delete(b, rng.integers(0, n, 3))), (a, draw(rng.integers(240, 300), 50))]
    assert substring_dedup.edit_distances(pairs).tolist() == [substring_dedup.edit_distance(a, b) for a, b in pairs]
    assert substring_dedup.edit_distances([]).tolist() == []


def test_seeds_meet_their_firsts_without_a_sort(spark):
    """Hot keys included, the hashed join has the rows of the plain one, and nothing is sorted for it."""
    left = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000).alias("key"), F.col("id").alias("doc_id"))
    right = left.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1").localCheckpoint()
    joined = salted_join(left, right, "key", "n", "doc_id", hashed=True)
    plan = joined._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    rows = lambda df: Counter(tuple(r) for r in df.select("key", "doc_id", "first").collect())
    assert rows(joined) == rows(left.join(right.drop("n"), "key"))
