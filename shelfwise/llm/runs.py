"""Periodic runs of words by string synchronising sets.

A run is a stretch of words with smallest period q, at least four periods and six words long, that
no neighbouring word extends. Runs of periods up to 3 are read off directly: words equal to those q
before. Longer periods are found at dyadic scales t = 4, 8, 16, ...: a synchronising set is a thin
set of positions that depends on the 2t words from a position on only, so two places with equal
surroundings are both in it or both not. It takes a position whose t-word window, or the window t
further on, has the least hash among the windows between. In a run of period q, with t <= q < 2t,
some position and the one q further on are in the set with equal contexts of 2t words; they are
neighbours among the positions of that context and propose the period. Windows inside runs of a
period of t/4 or less, which would all tie, are left out of the choice: such highly periodic
regions are known from smaller scales, and the direct ones supply the periods below the smallest
scale. Each proposed period is then verified word by word over its text.

Texts are independent, so nothing is shuffled: texts of a task are laid end to end, longest first,
with a word of its own between any two, and each scale works on those long enough for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import by_bytes, words_of

#: A run has so many periods and words at least.
MIN_EXPONENT, MIN_LENGTH = 4, 6
#: The smallest scale; smaller periods are looked for directly.
FIRST_SCALE = 4


class Numbered(dict):
    """A number for each distinct word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stretches(words: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the longest stretches with this period, of MIN_EXPONENT periods and MIN_LENGTH words or more."""
    if len(words) < max(MIN_LENGTH, MIN_EXPONENT * period):
        return (np.empty(0, dtype=np.int64),) * 2
    edge = np.zeros(len(words) - period + 2, dtype=np.int8)
    edge[1:-1] = words[period:] == words[:-period]
    turn = np.diff(edge)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1) + period
    long = ends - starts >= max(MIN_LENGTH, MIN_EXPONENT * period)
    return starts[long], ends[long]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` values in a row."""
    span, least = 1, values
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def synchronising(hashes: np.ndarray, scale: int, periodic: np.ndarray) -> np.ndarray:
    """The positions of the synchronising set. ``hashes``: of the ``scale`` words from each position on; ``periodic``: windows left out of the choice."""
    if len(hashes) <= scale:
        return np.empty(0, dtype=np.int64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    rank = np.where(periodic, top, hashes)
    least = _least(rank, scale + 1)
    chosen = (least != top) & ((rank[: len(least)] == least) | (rank[scale:] == least))
    return np.flatnonzero(chosen)


def runs_of(flat: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of all runs, sorted, of texts laid end to end in ``flat``.

    Sizes descend; each text is followed by one word that occurs nowhere else.
    """
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))[: len(sizes)]
    found: dict[tuple[int, int], int] = {}

    def keep(starts: np.ndarray, ends: np.ndarray, period: int) -> None:
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if found.setdefault((s, e), period) > period:
                found[s, e] = period

    for period in range(1, FIRST_SCALE):
        keep(*_stretches(flat, period), period)
    scale, hashes, width = FIRST_SCALE, _mixed(flat.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
    while len(sizes) and sizes[0] >= MIN_EXPONENT * scale:
        texts = int(np.searchsorted(-sizes, -MIN_EXPONENT * scale, side="right"))
        upto = int(begins[texts - 1] + sizes[texts - 1] + 1)
        hashes = hashes[:upto]
        while width < scale:
            hashes = _mixed(hashes[:-width] * np.uint64(0x9E3779B97F4A7C15) + hashes[width:])
            width *= 2
        edge = np.zeros(len(hashes) + 1, dtype=np.int64)
        for (s, e), period in found.items():
            if scale >= MIN_LENGTH and MIN_EXPONENT * period <= scale <= e - s and s < len(hashes):
                edge[s] += 1
                edge[min(e - scale + 1, len(hashes))] -= 1
        at = synchronising(hashes, scale, np.cumsum(edge[:-1]) > 0)
        at = at[at + 2 * scale <= upto]
        context = _mixed(hashes[at] * np.uint64(0x9E3779B97F4A7C15) + hashes[at + scale])
        order = np.lexsort((at, context))
        here, there = at[order[:-1]], at[order[1:]]
        step = there - here
        near = (context[order[:-1]] == context[order[1:]]) & (step >= scale) & (step < 2 * scale)
        owner = np.searchsorted(begins, here[near], side="right") - 1
        for text, period in set(zip(owner.tolist(), step[near].tolist(), strict=True)):
            low = int(begins[text])
            starts, ends = _stretches(flat[low : low + int(sizes[text])], period)
            keep(starts + low, ends + low, period)
        scale *= 2
    owner = np.searchsorted(begins, np.array([s for s, _ in found], dtype=np.int64), side="right") - 1
    return sorted((t, s - int(begins[t]), e - s, p) for t, ((s, e), p) in zip(owner.tolist(), found.items(), strict=True))


def word_runs(texts: list[str | None]) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """(words, runs) of each text; a run is (start, length, period), in order of start, then period."""
    numbers = Numbered()
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]  # bytes: the ASCII blanks alone part words
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    sizes = np.array([len(words[i]) for i in order], dtype=np.int64)
    flat = np.empty(int(sizes.sum()) + len(order), dtype=np.int64)
    at = 0
    for k, i in enumerate(order):
        n = len(words[i])
        flat[at : at + n] = np.fromiter(map(numbers.__getitem__, words[i]), dtype=np.int64, count=n)
        flat[at + n] = -1 - k
        at += n + 1
    out: list = [(w, []) for w in words]
    for text, start, length, period in runs_of(flat, sizes):
        out[order[text]][1].append((start, length, period))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words outside runs and of each run's first period, joined by one blank: a word that any run repeats goes."""
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    kept = np.cumsum(gone[:-1]) == 0
    return b" ".join(w for w, k in zip(words, kept.tolist(), strict=True) if k).decode("utf-8", "surrogatepass")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed) for every row: runs is an array of (start, length, period), collapsed the text without what runs repeat.

    Words are what ASCII blanks part, numbered from 0. A null, empty or blank text has no runs and
    an empty collapsed text. Rows are judged one by one, so null and repeated ids and equal rows
    need nothing; an empty table gives an empty one. A very long text is a batch of its own and
    takes time in proportion to its words and the logarithm of their number. Other columns aren't
    read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in by_bytes(batches, 1, 1 << 21):
            both = word_runs(batch.column(1).to_pylist())
            runs = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for _, r in both], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), runs, pa.array([collapsed(w, r) for w, r in both], pa.string())], names=["doc_id", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def repeated_tail(doc_id: Column, text: Column) -> Column:
    """The text, for a tenth of the ids with its words from some place on replaced by repeats of the first of them.

    With h the crc32 of the decimal id and g = h div 10: where h mod 10 is 0, word a + i becomes word
    a + i mod p, for a = g mod n and p = 1 + (n - a) div (3 + g mod 8). Null ids leave the text alone.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def rewritten(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
        left = (n - a).cast("int")
        p = (F.lit(1) + F.floor(left / (F.lit(3) + F.pmod(g, F.lit(8))))).cast("int")
        block = F.slice(words, a + 1, F.greatest(p, F.lit(1)))
        tail = F.slice(F.flatten(F.array_repeat(block, F.floor(left / p).cast("int") + 1)), F.lit(1), F.greatest(left, F.lit(0)))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)

    # a lambda's argument is computed once
    return F.when(F.pmod(h, F.lit(10)) == 0, F.get(F.transform(F.array(words_of(text)), rewritten), 0)).otherwise(text)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    from shelfwise.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    found = periodic_runs(docs.withColumn("text", repeated_tail(F.col("doc_id"), F.col("text"))))
    # the longest, then the first, then the shortest period
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("size"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    chosen = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), digest(listed).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))
    length = -F.col("b.size")
    return chosen.select("doc_id", "n_runs", F.col("b.start").alias("start"), length.alias("length"), F.col("b.period").alias("period"), F.floor(1000 * length / F.col("b.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
