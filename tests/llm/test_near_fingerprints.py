"""The near-duplicate stage compares what the BK-trees join by fingerprints, and the shingle sets decide."""

import random

import pytest
from pyspark.sql import functions as F

from shelfwise.llm import simhash


@pytest.mark.parametrize("part_limit", [512, 3])
def test_fingerprint_classes_alone_find_near_copies(spark, monkeypatch, part_limit):
    rng = random.Random(31)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    bases = [words(2000) for _ in range(6)]
    rows = [(k, " ".join([*base, *words(1)] if copy else base)) for k, (base, copy) in enumerate((b, c) for c in range(4) for b in bases)]
    rows += [(90, None), (91, " "), (92, "alone")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = simhash._sketches
    monkeypatch.setattr(simhash, "_sketches", lambda texts, shingle: plain(texts, shingle).withColumn("bands", F.when(F.size("bands") > 0, F.array("node")).otherwise(F.col("bands"))))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_classes(table, part_limit=part_limit).collect()}
    assert got == {k: k % 6 for k in range(24)} | {92: 92}
    assert {r["doc_id"] for r in simhash.without_near_copies(table, part_limit=part_limit).collect()} == {*range(6), 90, 91, 92}


def test_equal_fingerprints_do_not_link_texts_that_differ(spark, monkeypatch):
    rng = random.Random(32)
    rows = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for k in range(20)]
    plain = simhash._sketches
    monkeypatch.setattr(simhash, "_sketches", lambda texts, shingle: plain(texts, shingle).withColumn("fp", F.lit(0).cast("long")))
    table = spark.createDataFrame([*rows, (50, rows[7][1] + " end")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_classes(table, part_limit=4).collect()}
    assert got == {k: k for k in range(20)} | {50: 7}
