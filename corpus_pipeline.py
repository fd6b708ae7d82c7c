"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All stages
but the last return the columns of documents; the last returns the pieces with their places.
Further columns, whatever their names, pass through all stages but the last. A very long text
costs a stage time and memory for that text only; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm.line_dedup import without_repeated_lines
from shelfwise.llm.packing import pack_documents
from shelfwise.llm.quality_rules import keep_good
from shelfwise.llm.simhash import without_near_copies
from shelfwise.llm.substring_dedup import cut_passages, repeated_passages


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or score too low go.

    Each row is judged by its own text: a null id is judged like any other, rows that share an id
    each for themselves, equal rows alike. Null, empty and short texts fail the length rule and go.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, equal or one edit away, go; so do documents of such lines alone.

    Null ids and null texts stay as they are. Rows equal in id and text are one document and are cut
    alike; rows that share an id with other texts are equally early, each cut by its own lines.
    """
    return without_repeated_lines(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that share 0.8 or more of their five-word shingles stays: the smallest id.

    Null ids, null and wordless texts stay. Rows equal in id and text stay or go together; rows that
    share an id with other texts are judged apart.
    """
    return without_near_copies(docs)


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; a document of fewer than five words that are left goes.

    Null ids and null texts stay as they are. Of rows that share an id, the one whose text has the
    smallest hash (and its equals) is cut; the others stay whole.
    """
    return cut_passages(docs, repeated_passages(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset.

    Every row is packed for itself, null and repeated ids too; a null or empty text has its end id alone.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", filter_quality),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", dedup_near),
    ("substring dedup", dedup_passages),
    ("packing", pack),
]

#: The stages have no SQL form; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what one stage returns is stored before the next, and all that led to it goes."""
    from shelfwise.llm.common import discard, stored_step

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *stages, (_, last) = STAGES
    for i, (_, stage) in enumerate(stages):
        before = docs
        docs = stored_step(lambda stage=stage, docs=before: stage(spark, docs, sf_dir), f"stage-{i}")
        discard(before)
    return last(spark, docs, sf_dir)
