"""Rule counts and importance scores of documents, in DataFrame expressions alone.

The score of a document is the mean, over its word unigrams and bigrams, of
log(p_target / p_raw) of the n-gram's hash bucket: a likelihood ratio, normalised by length.

p_raw is the bucket multinomial of the whole corpus, with add-one smoothing; p_target that of
trusted documents, mixed with a share of p_raw (Jelinek-Mercer): a bucket that no trusted
document has costs log(MIX) and no more, so rare words don't condemn a clean document. Both
count tables have ``buckets`` rows at most, so their size doesn't follow the corpus; the
weights go into the scoring expression as one constant array. The threshold comes from all
labelled documents that the multinomials haven't seen: their scores are counted, and an order
dealt by range gives the loss at each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import clashing, stored, words_of
from shelfwise.operators.ordering import prefix_sums

SYMBOLS = "#*$%&|<>"
BUCKETS = 1 << 16
#: Share of p_raw in p_target.
MIX = 0.1
#: Where no document is labelled bad, this share of the good ones may fall below the threshold.
GOOD_LOST = 0.005


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus _words, _windows and the five counts; one row in, one row out.

    Nulls and blank texts have no words and zero counts. Raises ValueError if ``docs`` has a
    column of one of these names; callers project first.
    """
    if taken := clashing(docs, "_words", "_lines", "_windows", "_again", "_sorted", "_at", "word_chars", "n_symbols", "n_words", "n_dup_lines", "n_repeat_words"):
        raise ValueError(f"docs has columns of the operator's names: {taken}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    blanks = " \t\n\x0b\f\r"
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, blanks, "")) > 0)
    step = docs.withColumns({"_words": words_of(F.col(text_col)), "_lines": lines, "word_chars": F.length(F.translate(text, blanks, "")).cast("long"), "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")})
    word = lambda i: F.get("_words", i)
    windows = F.when(F.size("_words") >= 3, F.transform(F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, word(i + 1), word(i + 2)))).otherwise(F.array().cast("array<long>"))
    step = step.withColumns({"n_words": F.size("_words").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "_windows": windows})
    step = step.withColumn("_again", F.size("_windows") > F.size(F.array_distinct("_windows")))
    # windows in the order of their hashes: equal ones are neighbours
    step = step.withColumn("_sorted", F.when(F.col("_again"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda j: F.get("_sorted", j)["h"]
    step = step.withColumn("_at", F.sort_array(F.transform(F.filter("_sorted", lambda e, j: F.coalesce(e["h"] == F.when(j > 0, at(j - 1)), F.lit(False)) | F.coalesce(e["h"] == at(j + 1), F.lit(False))), lambda e: e["i"])))
    covered = F.aggregate(F.transform("_at", lambda p, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get("_at", k - 1)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_lines", "_again", "_sorted", "_at", "_windows")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def gram_buckets(words: str, buckets: int) -> Column:
    """Bucket numbers of a word array's unigrams and bigrams."""
    bucket = lambda *x: F.pmod(F.xxhash64(*x), F.lit(buckets)).cast("int")
    ones = F.transform(words, lambda w: bucket(w))
    twos = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: bucket(w, F.get(words, i + 1)))
    return F.concat(ones, twos)


def _marked(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``docs`` plus _trusted: true for the ids that ``trusted`` has, else null.

    The ids grow with the documents, so they are never broadcast: small tables are joined as large ones are.
    """
    return docs.join(trusted.withColumn("_trusted", F.lit(True)).hint("merge"), "doc_id", "left")


def _bucket_counts(docs: DataFrame, trusted: DataFrame, buckets: int) -> tuple[list[int], list[int]]:
    """N-grams by bucket, of all documents and of those whose id ``trusted`` has, in one pass.

    Partial counts are summed before they move, at most ``buckets`` rows arrive.
    """
    grams = _marked(docs, trusted).select(words_of(F.col("text")).alias("w"), F.col("_trusted").isNotNull().alias("t")).select("t", F.explode(gram_buckets("w", buckets)).alias("b"))
    counts = {r["b"]: (r["n"], r["t"]) for r in grams.groupBy("b").agg(F.count("*").alias("n"), F.count_if("t").alias("t")).collect()}
    raw, target = zip(*(counts.get(b, (0, 0)) for b in range(buckets)), strict=True)
    return list(raw), list(target)


def log_ratios(corpus: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, mix: float = MIX) -> list[float]:
    """log(p_target / p_raw) by bucket; ``trusted`` has the target's ids. With an empty target or corpus all are 0: nothing tells texts apart."""
    r, t = _bucket_counts(corpus, trusted, buckets)
    raw, total = sum(r) + buckets, sum(t)
    return [round(math.log((1 - mix) * a * raw / ((b + 1) * total) + mix), 6) if total else 0.0 for a, b in zip(t, r, strict=True)]


def importance(words: str, weights: list[float]) -> Column:
    """Mean log ratio of a word array's n-grams; 0 without words."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded to one constant
    grams = gram_buckets(words, len(weights))
    total = F.aggregate(grams, F.lit(0.0), lambda a, b: a + F.get(table, b))
    return F.when(F.size(words) > 0, total / (2 * F.size(words) - 1)).otherwise(F.lit(0.0))


def labelled_ids(labels: DataFrame, good: bool) -> tuple[DataFrame, DataFrame]:
    """Ids of documents labelled good (or bad): those for the multinomial and those for the threshold, a quarter."""
    ids = labels.filter(f"quality = {int(good)} and doc_id is not null").select("doc_id").distinct()
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)), F.lit(4))
    return ids.filter(part > 0), ids.filter(part == 0)


def threshold_from(scores: DataFrame, labels: DataFrame, good_lost: float = GOOD_LOST) -> float:
    """The score that parts good and bad best: the least share of good ones below plus of bad ones not below.

    ``scores``: doc_id, n_words, score. All documents of 50 words or more count whose label the
    multinomials haven't seen. The middle of the gap where the least loss is reached first; without
    bad ones the ``good_lost`` quantile; without good ones nothing is cut. One row reaches the driver at a time.
    """
    sides = [labelled_ids(labels, good)[1].select("doc_id", F.lit(int(good)).alias("_good"), F.lit(int(not good)).alias("_bad")) for good in (True, False)]
    seen = scores.filter("n_words >= 50").join(sides[0].union(sides[1]).hint("merge"), "doc_id")
    counts = seen.groupBy("score").agg(F.sum("_good").alias("n_good"), F.sum("_bad").alias("n_bad"))
    ranks = prefix_sums(counts, ["score"], good=F.col("n_good"), bad=F.col("n_bad"))
    whole = ranks.agg(F.coalesce(F.sum("n_good"), F.lit(0)).alias("good"), F.coalesce(F.sum("n_bad"), F.lit(0)).alias("bad")).first()
    if not whole["good"]:
        return -math.inf
    if not whole["bad"]:
        return ranks.filter(F.col("good") > int(good_lost * whole["good"])).agg(F.min("score")).first()[0]
    # times both numbers, so whole numbers are compared
    loss = F.col("good") * whole["bad"] - F.col("bad") * whole["good"]
    least = ranks.agg(F.min(F.struct(loss.alias("loss"), "score")).alias("m")).first()["m"]
    if least["loss"] >= 0:
        return -math.inf
    following = ranks.filter(F.col("score") > least["score"]).agg(F.min("score")).first()[0]
    return math.inf if following is None else (least["score"] + following) / 2


def judged(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, min_score: float | None = None, columns: list[str] | None = None) -> DataFrame:
    """(row struct, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) from a stored table.

    ``row`` holds a row's own ``columns`` (all by default), so no name can clash. See ``quality_rules``.
    """
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    weights = log_ratios(plain, labelled_ids(labels, True)[0], buckets)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("row"), F.col("doc_id").alias("_doc_id"), F.col("text").cast("string").alias("text"))
    counted = with_counts(rows).withColumn("base_failed", base_failed())
    counted = counted.withColumn("score", F.round(importance("_words", weights), 9))
    # stored: the threshold is found in the scores, and a filter on kept, pushed below, would repeat the nested expressions
    found = stored(counted.select("row", "_doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score"), "verdicts")
    if min_score is None:
        min_score = threshold_from(found.select(F.col("_doc_id").alias("doc_id"), "n_words", "score"), labels)
    return found.drop("_doc_id").withColumn("kept", ~F.col("base_failed") & (F.col("score") >= min_score))


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, min_score: float | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) per row of ``docs``.

    ``kept`` is false where a base rule fails, else whether the score reaches ``min_score`` (by
    default what ``threshold_from`` finds); every document is decided by the same numbers. Null
    texts count as empty and fail the length rule; a null id is judged like any other, repeated
    rows get equal results, and rows that share an id are judged each by its own text; empty
    tables stay empty. Only doc_id and text of ``docs`` and doc_id and quality of ``labels`` are
    read, so other columns may have any name. Without trusted documents nothing tells texts
    apart, so only the base rules decide. Very long texts take memory for their own words only.
    """
    found = judged(docs.select("doc_id", "text"), labels, buckets, min_score, ["doc_id"])
    return found.select("row.doc_id", *[c for c in found.columns if c != "row"])


def keep_good(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, min_score: float | None = None) -> DataFrame:
    """The rows of ``docs`` (all columns) that ``quality_rules`` keeps: each row by its own text, null and repeated ids too."""
    return judged(docs, labels, buckets, min_score).filter("kept").select("row.*")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    from shelfwise.llm.common import table

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
