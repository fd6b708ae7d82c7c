"""Fill-in-middle transformation by secondary sort.

A text is cut into units, two cuts part it into prefix, middle and suffix, and the parts leave in
another order behind markers. No task puts a transformed text together: a text becomes pieces of
whole units keyed by document and place in the output, the pieces are dealt by document and sorted
by place (``repartition`` and ``sortWithinPartitions``, the DataFrame form of
``repartitionAndSortWithinPartitions``), and a document's pieces then stream by, into incremental
digests or wherever the caller wants them. Restoring needs no second shuffle: a document's pieces
lie in one partition already, so the partition is sorted again, by the places that the markers
met in the output give.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import by_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
#: Of 100 texts so many stay plain, and of 100 others so many begin with their suffix.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: Characters of a piece, at least; a unit is never cut.
PIECE_CHARS = 4096
#: What tells rows apart: the partition they come from, their id, and 128 bits of their text's hash.
ROW = ["part", "doc_id", "high", "low"]
SCHEMA = "part int, doc_id long, high long, low long, at int, form string, n long, prefix_chars long, middle_chars long, piece string"


def unit_starts(text: str) -> np.ndarray:
    """Where the units ``[A-Za-z]+|[^A-Za-z]`` of a text begin, in code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    folded = points | 32
    letter = (folded >= 97) & (folded <= 122)
    inside = letter.copy()
    inside[:1] = False
    inside[1:] &= letter[:-1]
    return np.flatnonzero(~inside)


@dataclass
class Cut:
    """How a text of n units leaves: its form, and the code points where prefix and middle end."""

    form: str
    n: int
    first: int
    second: int


def cut_of(doc_id: int | None, text: str, starts: np.ndarray) -> Cut:
    """The cut that the sha256 of ``1:`` and the decimal id gives; a null id counts as no digits."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(starts)
    ends = np.append(starts, len(text))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    plain = not text or any(m in text for m in MARKERS) or h3 % 100 >= 100 - PLAIN_PERCENT
    form = "plain" if plain else "spm" if h4 % 100 < SPM_PERCENT else "psm"
    return Cut(form, n, int(ends[a]), int(ends[b]))


def _pieces(text: str, begin: int, end: int, starts: np.ndarray) -> Iterator[str]:
    """The text from begin to end in pieces of whole units."""
    while begin < end:
        at = np.searchsorted(starts, begin + PIECE_CHARS)
        stop = min(end, int(starts[at]) if at < len(starts) else len(text))
        yield text[begin:stop]
        begin = stop


def emitted(text: str, cut: Cut, starts: np.ndarray) -> Iterator[str]:
    """Markers and pieces in the order of the output; an empty text gives one empty piece."""
    if cut.form == "plain":
        yield from _pieces(text, 0, len(text), starts) if text else ("",)
        return
    parts = {PREFIX: (0, cut.first), MIDDLE: (cut.first, cut.second), SUFFIX: (cut.second, len(text))}
    for marker in (PREFIX, SUFFIX, MIDDLE) if cut.form == "psm" else (SUFFIX, PREFIX, MIDDLE):
        yield marker
        yield from _pieces(text, *parts[marker], starts)


def fim_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The transformed texts as pieces: part, doc_id, high, low tell rows apart, ``at`` orders a row's pieces.

    form, n (units) and, unless the form is plain, prefix_chars and middle_chars stand on a row's
    first piece only. Each row of ``docs`` is cut for itself; equal rows of one input partition give
    equal pieces side by side. A null text counts as empty, a null id as one without digits. Long
    texts give more pieces of the same size (a run of letters is one unit and never cut), so a task
    holds an input text and then pieces only. An empty table gives none. Other columns aren't
    read, whatever their names. Pieces come dealt by row and sorted: a row's pieces are adjacent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2):
            rows, pieces = [], []
            for part, own, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                starts = unit_starts(text)
                cut = cut_of(own, text, starts)
                whole = xxhash.xxh3_128_intdigest(text.encode("utf-8", "surrogatepass"))
                high, low = (x - (1 << 63) for x in divmod(whole, 1 << 64))
                shown = (None, None) if cut.form == "plain" else (cut.first, cut.second - cut.first)
                for at, piece in enumerate(emitted(text, cut, starts)):
                    rows.append((part, own, high, low, at, *((None,) * 4 if at else (cut.form, cut.n, *shown))))
                    pieces.append(piece)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pieces, pa.string())], names=[*ROW, "at", "form", "n", "prefix_chars", "middle_chars", "piece"])

    texts = docs.select(F.spark_partition_id().alias("part"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, SCHEMA).repartition(*ROW).sortWithinPartitions(*ROW, "at")


class _Row:
    """What is known of a row while its pieces stream by."""

    def __init__(self, key: tuple) -> None:
        self.key, self.at, self.section, self.place, self.copies = key, -1, 0, 0, 0
        self.head: tuple = (None,) * 4
        self.digest = hashlib.sha256()


def restored_pieces(pieces: DataFrame) -> DataFrame:
    """The pieces of ``fim_pieces`` without markers, at their places in the original text; markers met in the output give the places.

    A row's last line has no piece but the output's digest, form and counts, and how many equal rows it stands for.
    """
    section = {m.encode(): i for i, m in enumerate((PREFIX, MIDDLE, SUFFIX))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Row | None = None
        out: list[tuple] = []

        def close() -> None:
            if now is not None:
                out.append((*now.key, 3, 0, None, now.copies, *now.head, now.digest.hexdigest()))

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:-1]]
            raw = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            for *key, at, form, n, prefix, middle, piece in zip(*columns, raw, strict=True):
                if now is None or now.key != tuple(key):
                    close()
                    now = _Row(tuple(key))
                if at == 0:
                    now.copies += 1
                if at == now.at:  # the same piece of an equal row
                    continue
                now.at = at
                now.digest.update(piece)
                if at == 0:
                    now.head = (form, n, prefix, middle)
                if now.head[0] != "plain" and piece in section:
                    now.section = section[piece]
                else:
                    out.append((*key, now.section, now.place, piece, *(None,) * 6))
                    now.place += 1
            if out:
                yield _batch(out)
                out.clear()
        close()
        if out:
            yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*ROW, "section", "place", "piece", "copies", "form", "n", "prefix_chars", "middle_chars", "output_sha256"])

    schema = "part int, doc_id long, high long, low long, section int, place int, piece binary, copies long, form string, n long, prefix_chars long, middle_chars long, output_sha256 string"
    return pieces.mapInArrow(run, schema).sortWithinPartitions(*ROW, "section", "place")


def fim_digests(pieces: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256): a line per row of the documents.

    The output's digest is taken over its pieces in order, the restored text's over the pieces as
    the partition is sorted back. Nothing longer than a piece is held.
    """
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, out = hashlib.sha256(), []
        for batch in batches:
            for _, own, _, _, section, _, piece, copies, form, n, prefix, middle, output in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if section < 3:
                    digest.update(piece)
                else:
                    out += [(own, n, form, prefix, middle, output, digest.hexdigest())] * copies
                    digest = hashlib.sha256()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []

    return restored_pieces(pieces).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def fim_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, form, output): the whole transformed texts, a line per row of ``docs``; a row's output is held while it grows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, copies, form, parts = None, -1, 0, None, []

        def whole() -> list[tuple]:
            return [(key[1], form, "".join(parts))] * copies if key else []

        for batch in batches:
            out = []
            columns = batch.to_pydict()
            for part, own, high, low, at, kind, piece in zip(*(columns[c] for c in (*ROW, "at", "form", "piece")), strict=True):
                if key != (part, own, high, low):
                    out += whole()
                    key, last, copies, form, parts = (part, own, high, low), -1, 0, kind, []
                copies += at == 0
                if at != last:
                    parts.append(piece)
                    last = at
            yield _texts(out)
        yield _texts(whole())

    def _texts(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "form", "output"])

    return fim_pieces(docs, id_col, text_col).mapInArrow(run, "doc_id long, form string, output string")


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    from shelfwise.llm.common import table

    return fim_digests(fim_pieces(table(spark, sf_dir, "documents")))
