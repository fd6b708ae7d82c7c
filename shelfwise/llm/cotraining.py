"""Quality classifier by co-training of two views.

The content view sees the text alone: hashed words, word pairs and classes of surface counts.
The metadata view sees the source and language that came with it, nothing that the text says.
Each is a naive Bayes model: log ratios of its tokens' document counts in good and bad
documents, averaged by kind, and a logistic fit that combines them (in the content view with the
surface counts' own values) and calibrates the sum.

Both start from labelled documents. In every round each view scores all documents, and those
without a label that it is confident about count for the other view with the label it gives
them. Counts are summed in Spark over every such document, however many: only two count tables
of a fixed number of slots reach the driver. Calibration uses about CALIBRATION labelled
documents that neither view has counted; at the end a document's score adds both log odds.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import stored

#: Labelled documents kept for calibration: half of them, about so many at most.
CALIBRATION = 4_000
ROUNDS = 3
#: A pseudo-label needs this probability at least.
CONFIDENT = 0.95
KEEP = 0.5
#: Slots: hashed words and pairs, classes of surface counts (WIDTH for each), hashed (field, value).
GRAMS, WIDTH, META = 1 << 14, 8, 1 << 12
_NO_UPPER = {i: None for i in range(0x250) if chr(i).isupper()}
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def surface_shares(text: str, words: list[str]) -> list[float]:
    """Surface counts as numbers of about 0 to 1; a few signs a word may exceed it."""
    n, size = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        math.log1p(len(words)) / 10,
        min(40.0, size / n) / 40,
        (size - len(text.translate(_NO_UPPER))) / size,
        min(3.0, sum(text.count(c) for c in "#*$%&|<>{}=") / n),
        min(3.0, text.count("!") / n),
        sum(map(text.count, "0123456789")) / size,
        1 - len(counts) / n,
        max(counts.values(), default=0) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(1 for w in counts if w.isupper() and len(w) > 1) / max(1, len(counts)),
    ]


N_SHARES = len(surface_shares("", []))
#: Where each kind's slots end: words and pairs, classes of shares; then the metadata's.
CONTENT, SLOTS = GRAMS + N_SHARES * WIDTH, GRAMS + N_SHARES * WIDTH + META


def share_slots(shares: np.ndarray) -> np.ndarray:
    """A slot for each share of each row: which of WIDTH classes it falls in, on a logarithmic scale."""
    classes = WIDTH - 1 + np.floor(np.log(np.clip(shares, 1e-9, 1.0)) / np.log(3.0) + 1e-9)
    return GRAMS + np.arange(N_SHARES) * WIDTH + np.where(shares <= 0, 0, np.clip(classes, 1, WIDTH - 1)).astype(np.int64)


class Hasher:
    """Slots of texts; the hashes of words that were met before are remembered, in bounded number."""

    def __init__(self, limit: int = 400_000) -> None:
        self.known: dict[str, int] = {}
        self.limit = limit

    def grams(self, words: list[str]) -> np.ndarray:
        """Distinct slots of the words and of neighbouring pairs, ascending."""
        known = self.known
        if len(known) > self.limit:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"), 1)
        one = np.array([known[w] for w in words], dtype=np.uint64)
        two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]
        two ^= two >> np.uint64(29)
        return np.unique(np.concatenate((one, two)) % np.uint64(GRAMS)).astype("<u2")


def meta_slots(source: str | None, lang: str | None) -> list[int]:
    """A slot for the source and one for the language; null is a value of its own."""
    return [CONTENT + zlib.crc32(f"{name}\0{'' if x is None else '=' + x}".encode("utf-8", "replace")) % META for name, x in (("source", source), ("lang", lang))]


def view_features(docs: DataFrame) -> DataFrame:
    """(doc_id, grams binary, shares array<float>, meta array<int>); grams are compressed differences of ascending slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            grams, shares = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                words = _WORD.findall(text)
                grams.append(zlib.compress(np.diff(hasher.grams(words), prepend=np.uint16(0)).astype("<u2").tobytes(), 1))
                shares.append(surface_shares(text, words))
            meta = [meta_slots(*x) for x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.binary()), pa.array(shares, pa.list_(pa.float32())), pa.array(meta, pa.list_(pa.int32()))], names=["doc_id", "grams", "shares", "meta"])

    given = lambda c: F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", given("text"), given("source"), given("lang")).mapInArrow(run, f"doc_id {kind}, grams binary, shares array<float>, meta array<int>")


def unpacked(grams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(slots of all documents in a row, how many each has)."""
    raw = [zlib.decompress(g) for g in grams]
    sizes = np.array([len(r) // 2 for r in raw], dtype=np.int64)
    total = np.cumsum(np.frombuffer(b"".join(raw), dtype="<u2").astype(np.int64))
    begin = np.cumsum(sizes) - sizes
    before = np.concatenate(([0], total))[begin]
    return total - np.repeat(before, sizes), sizes


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights and intercept of a ridge logistic regression by Newton steps; inputs are scaled to unit spread, constant ones left out."""
    spread = x.std(axis=0)
    spread[spread < 1e-9] = np.inf
    z = np.hstack((x / spread, np.ones((len(x), 1))))
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        curve = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(penalty)
        move = np.linalg.solve(curve, z.T @ (p - y) + penalty * w)
        w -= move * min(1.0, 10 / max(1e-9, float(np.abs(move).max())))
        if float(np.abs(move).max()) < 1e-7:
            break
    return np.append(w[:-1] / spread, w[-1])


def probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


@dataclass
class CoTrained:
    """Log ratios by slot, and each view's combining weights, an intercept last: constant until ``calibrated``."""

    ratios: np.ndarray
    content: np.ndarray
    meta: np.ndarray
    prior: float

    @classmethod
    def constant(cls, prior: float) -> CoTrained:
        return cls(np.zeros(SLOTS), np.append(np.zeros(2 + N_SHARES), prior), np.append(np.zeros(2), prior), prior)

    @classmethod
    def counted(cls, counts: np.ndarray, sizes: np.ndarray, prior: float) -> CoTrained:
        """From documents by (class, slot), and how many documents of either class each view has counted (view, class)."""
        of = np.repeat(np.maximum(1.0, sizes), (CONTENT, META), axis=0)
        share = (counts.T + 0.5) / (of + 1.0)
        return replace(cls.constant(prior), ratios=np.log(share[:, 1] / share[:, 0]))

    def averages(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Both views' inputs from the columns grams, shares, meta: log ratios by kind, and for the content the shares themselves."""
        slots, sizes = unpacked(batch.column("grams").to_pylist())
        rows = np.repeat(np.arange(len(sizes)), sizes)
        words = np.bincount(rows, weights=self.ratios[slots], minlength=len(sizes)) / np.maximum(1, sizes)
        flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)
        shares = flat("shares").astype(float).reshape(len(sizes), N_SHARES)
        return np.column_stack((words, self.ratios[share_slots(shares)].mean(axis=1), shares)), self.ratios[flat("meta")].reshape(len(sizes), 2)

    def calibrated(self, rows: pa.RecordBatch, y: np.ndarray) -> CoTrained:
        """The combining weights from labelled rows that weren't counted; a constant where they hold one class."""
        if len(set(y.tolist())) < 2:
            return self
        content, meta = self.averages(rows)
        return replace(self, content=_fit(content, y), meta=_fit(meta, y))

    def odds(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        content, meta = self.averages(batch)
        return content @ self.content[:-1] + self.content[-1], meta @ self.meta[:-1] + self.meta[-1]

    def scored(self, features: DataFrame, keep: float = KEEP) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                content, meta = self.odds(batch)
                columns = [np.round(probability(x), 6) for x in (content, meta, content + meta - self.prior)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns), pa.array(columns[2] >= keep)], names=["doc_id", "p_content", "p_meta", "score", "kept"])

        kind = features.schema["doc_id"].dataType.simpleString()
        return features.select("doc_id", "grams", "shares", "meta").mapInArrow(run, f"doc_id {kind}, p_content double, p_meta double, score double, kept boolean")


def _counts(features: DataFrame, model: CoTrained | None, confident: float) -> tuple[np.ndarray, np.ndarray]:
    """Documents by (class, slot) and by (view, class): labelled ones, and with a model those that the other view is sure of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sizes = np.zeros((2, SLOTS), dtype=np.int64), np.zeros((2, 2), dtype=np.int64)
        for batch in batches:
            y = batch.column("y").fill_null(-1).to_numpy(zero_copy_only=False)
            given = [y, y]
            if model is not None:
                content, meta = (probability(x) for x in model.odds(batch))
                given = [np.where(y >= 0, y, np.where(p >= confident, 1, np.where(p <= 1 - confident, 0, -1))) for p in (meta, content)]
            slots, n = unpacked(batch.column("grams").to_pylist())
            rows = np.repeat(np.arange(len(n)), n)
            shares, meta = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("shares", "meta"))
            classes = share_slots(shares.astype(float).reshape(len(n), N_SHARES))
            for k in (0, 1):
                mine = given[0] == k
                counts[k] += np.bincount(slots[mine[rows]], minlength=SLOTS)
                counts[k] += np.bincount(classes[mine].ravel(), minlength=SLOTS)
                counts[k] += np.bincount(meta[np.repeat(given[1] == k, 2)], minlength=SLOTS)
                sizes[:, k] += [int((g == k).sum()) for g in given]
        at = np.flatnonzero(counts.any(axis=0))
        slots = np.concatenate((at, [-1, -2]))
        both = np.vstack((counts[:, at].T, sizes))
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), *(pa.array(both[:, k], pa.int64()) for k in (0, 1))], names=["slot", "bad", "good"])

    # held-out rows are counted by neither view
    counted = features.filter("not held").select("grams", "shares", "meta", "y").mapInArrow(run, "slot int, bad long, good long")
    rows = {r["slot"]: (r["bad"], r["good"]) for r in counted.groupBy("slot").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()}
    counts = np.zeros((2, SLOTS))
    for slot, both in rows.items():
        if slot >= 0:
            counts[:, slot] = both
    return counts, np.array([rows.get(-1, (0, 0)), rows.get(-2, (0, 0))], dtype=float)


def labelled(features: DataFrame, labels: DataFrame, calibration: int = CALIBRATION) -> DataFrame:
    """``features`` plus y (0, 1 or null) and held: whether a row serves calibration alone. Stored.

    An id with several labels counts as good if one of them says so; other values than 0 and 1 are no label.
    """
    truth = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    share = min(0.5, calibration / max(1, truth.count()))
    held = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(3)), F.lit(1 << 40)) < int(share * (1 << 40))
    # labels grow with the documents, so they are never broadcast: small tables are joined as large ones are
    return stored(features.join(truth.hint("merge"), "doc_id", "left").withColumn("held", F.col("y").isNotNull() & held), "views")


def cotrain(features: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT) -> CoTrained:
    """Fit both views on what ``labelled`` returns.

    With labels of one class only (or none) both views are constant at that class's share.
    """
    counts, sizes = _counts(features, None, confident)
    rows = features.filter("held").select("doc_id", "grams", "shares", "meta", "y").toArrow().combine_chunks()
    held = rows.to_batches()[0] if rows.num_rows else None
    y = held.column("y").to_numpy(zero_copy_only=False).astype(float) if held is not None else np.zeros(0)
    bad, good = sizes[0][0] + (y == 0).sum(), sizes[0][1] + (y == 1).sum()
    share = float(np.clip(good / max(1, good + bad), 1e-3, 1 - 1e-3)) if good + bad else 0.5
    prior = float(np.log(share / (1 - share)))
    if held is None or not sizes[0].all():
        return CoTrained.constant(prior)
    model = CoTrained.counted(counts, sizes, prior).calibrated(held, y)
    for _ in range(rounds):
        model = CoTrained.counted(*_counts(features, model, confident), prior).calibrated(held, y)
    return model


def classify_quality(docs: DataFrame, labels: DataFrame, keep: float = KEEP, calibration: int = CALIBRATION) -> DataFrame:
    """(doc_id, p_content, p_meta, score, kept) for every row of ``docs``.

    Reads doc_id, text, source and lang, whatever other columns there are; the last two may be
    missing or null, and a null text counts as empty. Every row is scored by what it holds: equal
    rows get equal scores, rows that share an id share its label, and a null id has none. An empty
    table stays empty. Long texts count all their words. Features are stored once and reread each round.
    """
    features = labelled(view_features(docs), labels, calibration)
    return cotrain(features).scored(features, keep)


def op2_cotraining(spark, sf_dir: str) -> DataFrame:
    from shelfwise.llm.common import table

    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
