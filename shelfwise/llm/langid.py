"""Language identification by compression.

Each language has a zstandard raw-content dictionary of sample text. A text is encoded in
blocks with every dictionary; the language with the smallest total wins. Letters count
only: case is folded and ASCII signs and digits become blanks before texts are encoded.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import salted_order

#: The fit's bounds: sample documents of a language, and bytes taken of each. A dictionary holds their product at most.
SAMPLE_DOCS, SAMPLE_BYTES = 128, 1024
BLOCK = 8192
#: A prediction whose runner-up is less than this share larger is marked as rejected.
MIN_MARGIN = 0.01
_TABLE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_WORDLY = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: str) -> bool:
    """Whether a character of Unicode's letters (L) occurs; numerals such as a half or a Roman five are none."""
    return any(unicodedata.category(m[0])[0] == "L" for m in _WORDLY.finditer(text))


def letters(text: str) -> bytes:
    """Lower-case UTF-8 with ASCII signs, digits and controls as blanks."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_TABLE).split())


def in_sample(order: Column, rows: Column, limit: int) -> Column:
    """Whether a row is among about ``limit`` of so many rows. In doubles: a product of longs would overflow from 2^23 rows on."""
    return F.pmod(order, F.lit(1 << 40)).cast("double") * rows.cast("double") < float(limit) * (1 << 40)


def sample_window(text: Column, key: Column, chars: int) -> Column:
    """A window of ``chars`` characters of the text, at a place that a hash of ``key`` gives; a shorter text is taken whole."""
    room = F.greatest(F.length(text) - chars, F.lit(0)) + 1
    return F.substring(text, F.pmod(salted_order(key, 13), room).cast("int") + 1, F.lit(chars))


def fit_dictionaries(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """A dictionary for each language of ``docs``: windows of SAMPLE_DOCS documents at most.

    The sample is the first documents by a hash of the id, and a window lies anywhere in its
    document, by another hash: the same on every run. Every language that occurs is learned; the
    driver gets 2 x SAMPLE_BYTES characters of SAMPLE_DOCS documents for each. Null languages and
    texts are left out.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id")).filter("lang is not null and text is not null")
    # a count leaves about three times the sample of each language, wherever it lies: no task sees more
    counts = F.broadcast(rows.groupBy("lang").agg(F.count("*").alias("all")))  # a row for each language that gets a dictionary
    order = salted_order(F.col("id"), 11)
    few = rows.join(counts, "lang").filter(in_sample(order, F.col("all"), 3 * sample_docs))
    windows = few.select("lang", order.alias("h"), "id", sample_window(F.col("text"), F.col("id"), 2 * sample_bytes).alias("text"))
    picked = windows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", "text"))).filter(F.col("n") <= sample_docs)
    found: dict[str, list[bytes]] = {}
    for r in picked.select("lang", "n", "text").orderBy("lang", "n").collect():
        found.setdefault(r["lang"], []).append(letters(r["text"])[:sample_bytes])
    return {lang: b" ".join(parts) for lang, parts in sorted(found.items()) if any(parts)}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        import zstandard as z

        self.tries = []
        # short matches count: the languages' syllables and short words tell them apart
        how = z.ZstdCompressionParameters(window_log=21, chain_log=17, hash_log=17, search_log=5, min_match=3, target_length=16, strategy=z.STRATEGY_LAZY2, write_content_size=False)
        for lang, raw in dictionaries.items():
            self.tries.append((lang, z.ZstdCompressor(dict_data=z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=how)))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score from 0 to 1, margin of the runner-up over the winner)."""
        if text is None or not self.tries or not has_letter(text):
            return "und", 0.0, 0.0
        raw = b" " + letters(text) + b" "  # words at the ends match as others do
        parts = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = sorted((sum(len(c.compress(p)) for p in parts), lang) for lang, c in self.tries)
        if len(sizes) == 1:
            return sizes[0][1], 1.0, 1.0
        margin = sizes[1][0] / sizes[0][0] - 1
        return sizes[0][1], round(min(1.0, 0.5 + 5 * margin), 6), round(margin, 6)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN, text_col: str = "text") -> DataFrame:
    """``docs`` plus lang_pred, score, rejected; every whole text is read.

    ``und`` for a null text or one without a letter, or when no dictionary was learned; such rows
    and narrow margins are ``rejected``. Ties go to the language that comes first by name. Columns of
    these names in ``docs`` are replaced; all rows are kept, repeated ones with equal results. An empty
    table stays empty. A very long text is encoded block by block.
    """
    kept = docs.drop("lang_pred", "score", "rejected")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", lang_pred string, score double, rejected boolean"
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(dictionaries)
        for batch in batches:
            got = [classifier.predict(t.as_py()) for t in batch.column(at)]
            more = [pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[0] == "und" or x[2] < min_margin for x in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    return kept.mapInArrow(run, schema)


def op8_langid(spark, sf_dir: str) -> DataFrame:
    from shelfwise.llm.common import table

    docs = table(spark, sf_dir, "documents")
    dictionaries = fit_dictionaries(docs.filter(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", F.col("text").cast("string").alias("text")), dictionaries)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
