"""The quality model is fitted on every labelled document: no limit leaves one out."""

import itertools
import math

from pyspark.sql import functions as F

from shelfwise.llm import quality_rules as Q


def best_cut(good, bad):
    cuts = [-math.inf, *((a + b) / 2 for a, b in itertools.pairwise(sorted(set(good + bad)))), math.inf]
    loss = [sum(s < c for s in good) * len(bad) + sum(s >= c for s in bad) * len(good) for c in cuts]
    return cuts[loss.index(min(loss))]


def test_threshold_counts_every_labelled_document(spark):
    n = 40_000  # some 5,000 of either label are held out
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    noise = F.pmod(F.xxhash64("doc_id"), F.lit(10_007)) / 10_007
    scores = labels.select("doc_id", F.lit(60).alias("n_words"), F.round(noise + F.col("quality") * 0.4, 9).alias("score"))
    sides = [[r[0] for r in scores.join(Q.labelled_ids(labels, good)[1], "doc_id").select("score").collect()] for good in (True, False)]
    assert min(map(len, sides)) > 4_000
    assert math.isclose(Q.threshold_from(scores, labels), best_cut(*sides), abs_tol=1e-12)
    assert Q.threshold_from(scores, labels.filter("quality = 1")) == sorted(sides[0])[int(Q.GOOD_LOST * len(sides[0]))]
    assert Q.threshold_from(scores, labels.filter("quality = 0")) == -math.inf


def test_multinomial_counts_every_trusted_document(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("word").alias("text"))
    trusted = Q.labelled_ids(docs.select("doc_id", F.lit(1).alias("quality")), True)[0]
    raw, target = Q._bucket_counts(docs, trusted, 16)
    assert (sum(raw), sum(target)) == (40_000, trusted.count()) and sum(target) > 20_000


def test_labels_are_joined_alike_at_every_size(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("word").alias("text"))
    trusted = Q.labelled_ids(docs.select("doc_id", F.lit(1).alias("quality")), True)[0]
    marked = Q._marked(docs, trusted)
    assert marked.filter("_trusted").count() == trusted.count() and marked.count() == 50
    plan = marked._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
