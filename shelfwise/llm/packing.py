"""Packing documents' tokens into fixed-length sequences, shortest pack first.

Documents are cut into pieces of at most ``length`` tokens. The histogram of piece lengths
(at most ``length`` rows, whatever the corpus) is placed on the driver, longest length
first: a length goes to the open pack with the fewest tokens. Packs with the same content
are one pattern with a count, so this takes work by the number of lengths, not of pieces.
The n-th piece of a length then takes the n-th slot of that length in the pattern list.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import clashing, stored, unused
from shelfwise.llm.encoder import WordEncoder


def cut_documents(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): every document's pieces, its end id included.

    A null or empty text has the end id alone. Ids may be null or repeated; each row is cut
    on its own. Columns besides the two named are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer)
        end = int(end_id).to_bytes(encoder.width, "little")
        for batch in batches:
            at, starts, sizes, crcs, totals = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.frombuffer(encoder.packed(text.as_py()) + end, dtype=encoder.kind).astype("<u4")
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length]
                    at.append(i)
                    starts.append(start)
                    sizes.append(len(piece))
                    crcs.append(zlib.crc32(piece))
                    totals.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, sizes, crcs, totals))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in a pack, number of such packs) that hold every piece once."""
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by tokens used
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], used: int, count: int) -> None:
        if used == length:
            done.append((pattern, count))
        else:
            open_packs.setdefault(used, []).append((pattern, count))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            used = min(open_packs, default=length)
            if used + size > length:
                per = length // size  # nothing open has room: new packs, filled with this length alone
                full, rest = divmod(left, per)
                if full:
                    put((size,) * per, per * size, full)
                if rest:
                    put((size,) * rest, rest * size, 1)
                break
            pattern, count = open_packs[used].pop()
            if not open_packs[used]:
                del open_packs[used]
            take = min(left, count)
            if count > take:
                open_packs.setdefault(used, []).append((pattern, count - take))
            put((*pattern, size), used + size, take)
            left -= take
    return done + [x for packs in open_packs.values() for x in packs]


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank of every slot, its pattern's first sequence id, its offset."""
    ranks: Counter[int] = Counter()
    found: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for pattern, count in patterns:
        offset = 0
        for size in pattern:
            found.setdefault(size, []).append((ranks[size], base, offset))
            ranks[size] += count
            offset += size
        base += count
    return {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)) for k, v in found.items()}


def place(pieces: DataFrame, length: int = 2048, order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """``pieces`` (with a column length from 1 to ``length``) plus sequence_id and offset.

    A piece's rank among those of its length is its slice's base plus its row number there;
    slices (by hash of ``order``) keep a frequent length from becoming one task. Only the
    histogram reaches the driver. An empty table stays empty; ties in ``order`` may trade places.
    Other columns of ``pieces`` may have any names but sequence_id and offset (ValueError).
    """
    if taken := clashing(pieces, "sequence_id", "offset"):
        raise ValueError(f"pieces has columns of the result's names: {taken}")
    slice_, row, rank, base = (unused(pieces, x) for x in ("slice", "row", "rank", "base"))
    slices = max(1, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = pieces.withColumn(slice_, F.pmod(F.xxhash64(*order), F.lit(slices)))
    counts = stored(cut.groupBy("length", F.col(slice_).alias("slice")).agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if any(not 0 < k <= length for k in histogram):
        raise ValueError(f"pieces must have 1 to {length} tokens")
    slots = _slots(shortest_pack_first(histogram, length))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # length x shuffle partitions rows at most, whatever the corpus
    bases = counts.select("length", F.col("slice").alias(slice_), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    within = Window.partitionBy("length", slice_).orderBy(*order)
    ranked = cut.withColumn(row, F.row_number().over(within) - 1).join(bases, ["length", slice_]).withColumn(rank, F.col(base) + F.col(row))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes, ranks = frame["length"].to_numpy(), frame[rank].to_numpy()
            seq, off = np.zeros(len(frame), dtype=np.int64), np.zeros(len(frame), dtype=np.int64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                first, base, offset = slots[int(size)]
                at = np.searchsorted(first, ranks[rows], side="right") - 1
                seq[rows] = base[at] + ranks[rows] - first[at]
                off[rows] = offset[at]
            yield frame.drop(columns=[rank]).assign(sequence_id=seq, offset=off)

    kept = ranked.select(*[F.col(f"`{c}`") for c in pieces.columns], rank)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return kept.mapInPandas(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its place: sequence_id and a gapless offset from 0.

    See ``cut_documents`` and ``place`` for nulls, empty texts, ties and empty tables.
    """
    pieces = stored(cut_documents(docs, tokenizer, length, end_id, id_col, text_col), "pieces")
    return place(pieces, length)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from shelfwise.llm.common import table

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
