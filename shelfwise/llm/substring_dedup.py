"""Fuzzy repeated passages by collinear chaining.

Words are 64-bit hashes. Seeds are k-word windows, thinned to the minimum of every ``window``
neighbours, so any shared run of k + window - 1 words shares a seed. The n-th occurrence of a
seed in a document is joined to the n-th in the first document that has so many (a star, never
all pairs), which a map-side minimum finds. Where the first documents of a run's seeds each
hold a part of the run only, its seeds don't lead to a document that has it whole: seeds that
recur are therefore joined once more, by the hash of the ``min_words`` words that begin there.
Per (document, earlier document) the matches in word order are chained: the best chain that
ascends in both texts, with a cost for gaps, through a Fenwick tree of prefix maxima. Chains
are cut at wide gaps; one seed is enough for a chain, as ends are widened over edited words
by a banded alignment. The ranges are aligned by bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import by_bytes, discard, freed, salted_join, stored, stored_parts, unused

#: A window below SEED_WORDS keeps a seed of those that lie across the point where two pieces meet.
SEED_WORDS, WINDOW = 6, 4
#: A passage has so many words at least, and so large a share of words that stay in the alignment.
MIN_WORDS, MIN_IDENTITY = 40, 0.8
#: Words that may lie between two matches of a passage, and what a word of gap costs in matches.
MAX_GAP, GAP_COST = 48, 0.01
#: Seeds are written once, in so many parts by their hash, and matched part by part, so that the disk holds one part's shuffle files at a time.
PARTS = 8
#: Words beyond a chain's end that are looked at, inserted or left-out words followed there, the
#: loss in value at which that ends, and what an edit costs in equal words.
MARGIN, BAND, DROP, EDIT_COST = 48, 8, 24, 3
#: The next cost to try after one that takes too many edits in.
DEARER = {EDIT_COST: EDIT_COST + 2, EDIT_COST + 2: 10**6}


class WordHasher:
    """64-bit hashes of the words of ASCII-lower-cased texts; those of words met before are remembered, in bounded number."""

    def __init__(self, limit: int = 500_000) -> None:
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def hashes(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and the ASCII blanks count
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        except KeyError:
            pass
        if len(known) > self.limit:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w, 42)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


#: XXH64's primes.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: A-Z in lower case; which bytes aren't blanks.
LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
IN_WORD = np.array([x != 0x20 and not 0x09 <= x <= 0x0D for x in range(256)])


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``WordHasher``'s hashes of the words of all texts end to end, and each text's number of words.

    XXH64 of all words of one length side by side; words of 32 bytes or more one by one.
    """
    wide = pa.types.is_large_string(texts.type)
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.zeros(bounds[-1] - bounds[0] + 8, dtype=np.uint8)  # each word is followed by 8 bytes
    if len(data) == 8:
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    data[:-8] = LOWER[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]]]
    bounds -= bounds[0]
    inside = IN_WORD[data[:-8]]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = bounds[(bounds > 0) & (bounds < len(inside))]  # a word ends with its text, whatever follows
    starts[edges], ends[edges - 1] = inside[edges], inside[edges - 1]
    begin = np.flatnonzero(starts)
    size = np.flatnonzero(ends) + 1 - begin
    lanes = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))  # the 8 bytes from each place on
    kind = np.minimum(size, 32).astype(np.uint8)
    order = np.argsort(kind, kind="stable")
    upto = np.cumsum(np.bincount(kind, minlength=33))
    found = np.empty(len(begin), dtype=np.uint64)
    for length in range(1, 32):
        of = order[upto[length - 1] : upto[length]]
        if not len(of):
            continue
        at = begin[of]
        h = np.full(len(of), (42 + int(P5) + length) % (1 << 64), dtype=np.uint64)
        for k in range(length // 8):
            h = _turned(h ^ _turned(lanes[at + 8 * k] * P2, 31) * P1, 27) * P1 + P4
        if length % 8:
            rest = lanes[at + length // 8 * 8]
            if length & 4:
                h = _turned(h ^ (rest & np.uint64(0xFFFFFFFF)) * P1, 23) * P2 + P3
                rest = rest >> np.uint64(32)
            for k in range(length & 3):
                h = _turned(h ^ (rest >> np.uint64(8 * k) & np.uint64(255)) * P5, 11) * P1
        h = (h ^ h >> np.uint64(33)) * P2
        h = (h ^ h >> np.uint64(29)) * P3
        found[of] = h ^ h >> np.uint64(32)
    for i in order[upto[31] :].tolist():
        found[i] = xxhash.xxh64_intdigest(data[begin[i] : begin[i] + size[i]].tobytes(), 42)
    return found, np.diff(np.searchsorted(begin, bounds))


def minimizers(flat: np.ndarray, sizes: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, hash) of the thinned seeds of texts laid end to end in ``flat``.

    Texts too short for a full window keep their smallest seed if they have k words.
    """
    n = len(flat)
    if n < k:
        return (np.empty(0, np.int64),) * 3
    h = flat.astype(np.uint64)
    seed = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        seed = seed * np.uint64(0x9E3779B97F4A7C15) + h[j : n - k + 1 + j]
    seed ^= seed >> np.uint64(29)
    seed *= np.uint64(0xBF58476D1CE4E5B9)
    seed ^= seed >> np.uint64(32)
    row = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(n) - begin[row]
    whole = row[: n - k + 1] == row[k - 1 :]
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    seed[~whole] = top
    m = len(seed)
    least = seed.copy()  # of the window that starts here, cut at the text's end
    for j in range(1, min(window, m)):
        np.minimum(least[: m - j], seed[j:], out=least[: m - j], where=row[: m - j] == row[j:m])
    # windows that run past a text's last seed add nothing, unless the text has no full window
    room = sizes[row[:m]] - k + 1 - place[:m]
    full = (room >= window) | ((place[:m] == 0) & (room > 0))
    keep = np.zeros(m, dtype=bool)
    for j in range(min(window, m)):
        keep[j:] |= (seed[j:] == least[: m - j]) & full[: m - j] & (row[j:m] == row[: m - j])
    at = np.flatnonzero(keep & (seed != top))
    return row[at], place[at], seed[at].view(np.int64)


def occurrence(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How many rows with smaller places share a row's key. Rows come in order of row and place."""
    both = key.view(np.uint64) ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(both, kind="stable")
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (key[order[1:]] != key[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
    starts = np.flatnonzero(fresh)
    out = np.empty(len(key), dtype=np.int64)
    out[order] = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
    return out


def run_hashes(flat: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """A hash of the ``words`` words from each place of ``flat`` in ``at`` on; all of them are there.

    The words are the digits of a number; sums of digits times powers, from the beginning on, give any part of it.
    """
    base = 0x9E3779B97F4A7C15
    digits = np.full(len(flat) + 1, base, dtype=np.uint64)
    back = np.full(len(flat) + 1, pow(base, -1, 1 << 64), dtype=np.uint64)
    digits[0] = back[0] = 1
    powers, back = np.cumprod(digits), np.cumprod(back)
    sums = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum(flat.astype(np.uint64) * powers[:-1], out=sums[1:])
    found = (sums[at + words] - sums[at]) * back[at]
    found ^= found >> np.uint64(29)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    found ^= found >> np.uint64(32)
    return found.view(np.int64)


def seeds(docs: DataFrame, k: int = SEED_WORDS, window: int = WINDOW, run_words: int = MIN_WORDS, parts: int = PARTS) -> DataFrame:
    """(seed, doc_id, place, run, again, part) from (doc_id, text); part is the seed's hash modulo ``parts``.

    The number of a seed's earlier occurrences in that row is mixed into it; run is the hash of
    the ``run_words`` words from there on, null if there are fewer; again: an earlier place of the row has that run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            flat, sizes = word_hashes(batch.column(1))
            row, place, seed = minimizers(flat, sizes, k, window)
            begin = np.cumsum(sizes) - sizes
            room = place + run_words <= sizes[row]
            long = np.zeros(len(seed), dtype=np.int64)
            long[room] = run_hashes(flat, (begin[row] + place)[room], run_words)
            again = np.zeros(len(seed), dtype=bool)
            again[room] = occurrence(row[room], long[room]) > 0
            nth = occurrence(row, seed).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            part = (seed.view(np.uint64) % np.uint64(parts)).astype(np.int32)
            columns = [pa.array((seed.view(np.uint64) ^ nth).view(np.int64), pa.int64()), batch.column(0).take(pa.array(row, pa.int64())), pa.array(place, pa.int32()), pa.array(long, pa.int64(), mask=~room), pa.array(again), pa.array(part, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["seed", "doc_id", "place", "run", "again", "part"])

    return docs.select("doc_id", "text").mapInArrow(run, "seed long, doc_id long, place int, run long, again boolean, part int")


class PrefixMax:
    """Fenwick tree: the largest (value, payload) among the first i places."""

    def __init__(self, n: int) -> None:
        self.tree = [(0.0, -1)] * (n + 1)

    def put(self, i: int, item: tuple[float, int]) -> None:
        i += 1
        tree, n = self.tree, len(self.tree)
        while i < n:
            if item[0] > tree[i][0]:
                tree[i] = item
            i += i & -i

    def best(self, i: int) -> tuple[float, int]:
        found, tree = (0.0, -1), self.tree
        while i > 0:
            if tree[i][0] > found[0]:
                found = tree[i]
            i -= i & -i
        return found


def chain(matches: list[tuple[int, int]], gap_cost: float = GAP_COST) -> list[list[tuple[int, int]]]:
    """Disjoint best chains of (place, other place) matches, best first.

    A chain ascends strictly in both texts. Its value is the number of its matches less
    ``gap_cost`` for every word that lies between neighbours, in either text. That cost is a
    difference of sums of places, so the best predecessor of a match is the one with the
    largest value plus cost of its own places among the smaller other places: a prefix maximum.
    """
    matches = sorted(set(matches))
    ranks = {b: i for i, b in enumerate(sorted({b for _, b in matches}))}
    tree = PrefixMax(len(ranks))
    values, before = [0.0] * len(matches), [-1] * len(matches)
    i = 0
    while i < len(matches):
        j = i
        while j < len(matches) and matches[j][0] == matches[i][0]:  # those of one place don't follow each other
            a, b = matches[j]
            top, prior = tree.best(ranks[b])
            gain = top - gap_cost * (a + b)
            values[j], before[j] = (1 + gain, prior) if prior >= 0 and gain > 0 else (1.0, -1)
            j += 1
        for m in range(i, j):
            tree.put(ranks[matches[m][1]], (values[m] + gap_cost * sum(matches[m]), m))
        i = j
    used, chains = [False] * len(matches), []
    for i in sorted(range(len(matches)), key=lambda i: (-values[i], i)):
        run = []
        while i >= 0 and not used[i]:
            used[i] = True
            run.append(matches[i])
            i = before[i]
        if run:
            chains.append(run[::-1])
    return chains


def passages(run: list[tuple[int, int]], k: int, max_gap: int = MAX_GAP) -> Iterator[tuple[int, int, int, int, int]]:
    """(start, end, other start, other end, matches) of a chain's parts between wide gaps."""
    begin = 0
    for i in range(1, len(run) + 1):
        if i == len(run) or run[i][0] - run[i - 1][0] - k > max_gap or run[i][1] - run[i - 1][1] - k > max_gap:
            yield run[begin][0], run[i - 1][0] + k, run[begin][1], run[i - 1][1] + k, i - begin
            begin = i


def _unequal(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What two sequences keep between equal ends; their distance is the same."""
    for turn in (1, -1):  # from the beginning, then from the end
        n = min(len(a), len(b))
        apart = np.flatnonzero(a[::turn][:n] != b[::turn][:n])
        same = int(apart[0]) if len(apart) else n
        a, b = (a[same:], b[same:]) if turn == 1 else (a[: len(a) - same], b[: len(b) - same])
    return a, b


def edit_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Levenshtein distance by Myers' bit vectors, as wide as what ``a`` keeps between equal ends."""
    a, b = _unequal(np.asarray(a), np.asarray(b))
    if not len(a) or not len(b):
        return len(a) + len(b)
    a, b = a.tolist(), b.tolist()
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    n, full, top = len(a), (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, n
    for y in b:
        eq = masks.get(y, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | x
        plus, minus = down | ~(d | up) & full, up & d
        score += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 | 1, minus << 1
        up, down = (minus | ~(d | plus)) & full, plus & d & full
    return score


def edit_distances(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """``edit_distance`` of each pair. Pairs whose shorter side keeps no more than 64 words go through Myers' bit vectors side by side, a word a pair."""
    found, narrow = np.zeros(len(pairs), dtype=np.int64), []
    for at, (a, b) in enumerate(pairs):
        a, b = sorted(_unequal(a, b), key=len)
        if not len(a):
            found[at] = len(b)
        elif len(a) <= 64 and len(b) <= 256:
            narrow.append((len(b), at, a, b))
        else:
            found[at] = edit_distance(a, b)
    if not narrow:
        return found
    narrow.sort(key=lambda x: -x[0])  # those that go on are always the first ones
    m, at = (np.array([x[i] for x in narrow]) for i in (0, 1))
    n = np.array([len(x[2]) for x in narrow])
    a, b = np.zeros((len(narrow), 64), dtype=narrow[0][2].dtype), np.zeros((m[0], len(narrow)), dtype=narrow[0][3].dtype)
    for i, (size, _, x, y) in enumerate(narrow):
        a[i, : len(x)], b[:size, i] = x, y
    one = np.uint64(1)
    full = np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - n).astype(np.uint64)
    top = one << (n - 1).astype(np.uint64)
    up, down, score = full.copy(), np.zeros(len(narrow), dtype=np.uint64), n.copy()
    for j in range(m[0]):
        k = int(np.searchsorted(-m, -j))  # the pairs with more than j words
        f, t, u, w = full[:k], top[:k], up[:k], down[:k]
        eq = np.packbits(a[:k] == b[j, :k, None], axis=1, bitorder="little").view("<u8")[:, 0] & f
        d = (((eq & u) + u) ^ u) | eq | w
        plus, minus = w | ~(d | u) & f, u & d
        score[:k] += ((plus & t) != 0).astype(np.int64) - ((minus & t) != 0)
        plus, minus = plus << one | one, minus << one
        up[:k], down[:k] = (minus | ~(d | plus)) & f, plus & d & f
    found[at] = score
    return found


def widened_many(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, cost: float, band: int = BAND, drop: int = DROP) -> tuple[np.ndarray, np.ndarray]:
    """How many words of each row of ``a`` and ``b``, of n and m words, belong together from their beginnings on.

    Where the best alignment of two beginnings ends: an equal word counts 1, an edit less
    ``cost``. No more than ``band`` words are inserted or left out on balance, and it ends
    where all values lie ``drop`` below the best. All rows go through the band side by side.
    """
    rows, low = len(a), -1e9
    best, used, other = np.zeros(rows), np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
    # row[d]: the value where d - band - 1 more words of b than of a are used; its ends are walls
    row = np.full((rows, 2 * band + 3), low)
    row[:, band + 1 : 2 * band + 2] = -cost * np.arange(band + 1)
    at = np.arange(rows)  # the rows that go on
    for i in range(a.shape[1]):
        going = n[at] > i
        at, row = at[going], row[going]
        if not len(at):
            break
        now = np.full_like(row, low)
        word, last, length = a[at, i], np.full(len(at), low), m[at]
        for d in range(1, 2 * band + 2):
            j = i - band + d - 1
            value = np.maximum(row[:, d + 1], last) - cost
            if 0 <= j < b.shape[1]:
                step = row[:, d] + np.where(word == b[at, j], 1.0, -cost)
                value = np.where(j < length, np.maximum(value, step), value)
            now[:, d] = last = np.where(0 <= j + 1 <= length, value, low) if j + 1 >= 0 else np.full(len(at), low)
        top, place = now.max(axis=1), now.argmax(axis=1)
        better = top > best[at]
        best[at[better]], used[at[better]], other[at[better]] = top[better], i + 1, i - band + place[better]
        on = top >= best[at] - drop
        at, row = at[on], now[on]
    return used, other


def widened(a: list[int], b: list[int], band: int = BAND, drop: int = DROP, cost: float = EDIT_COST) -> tuple[int, int]:
    """``widened_many`` of one row."""
    used, other = widened_many(*(np.array([x], dtype=np.int64).reshape(1, -1) for x in (a, b)), np.array([len(a)]), np.array([len(b)]), cost, band, drop)
    return int(used[0]), int(other[0])


def _ends(flat: np.ndarray, begin: np.ndarray, end: np.ndarray, cut: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """What lies before each cut, backwards (turn -1), or from it on: a matrix of MARGIN words a row at most, and their numbers.

    Rows lie end to end in ``flat``, from begin to end each; a cut is a place there.
    """
    steps = np.arange(MARGIN)
    size = np.minimum(cut - begin if turn < 0 else end - cut, MARGIN)
    at = cut[:, None] + (-1 - steps if turn < 0 else steps)
    return np.where(steps < size[:, None], flat[np.clip(at, 0, len(flat) - 1)], 0), size


def matched_places(texts: DataFrame, k: int = SEED_WORDS, window: int = WINDOW, run_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, place, ref_id, ref_place): seeds of a document that an earlier one has.

    Each occurrence of a seed meets the first document that has it so often and, if the
    ``run_words`` words from there on stand in an earlier document, the first that has them.
    The stored tables that the result reads are listed in its ``_made_of``, to be discarded.
    """
    spark, met, tables = texts.sparkSession, None, []
    parts = stored_parts(seeds(texts, k, window, run_words), "part", "seeds", PARTS)
    for found in parts:
        firsts = stored(found.groupBy("seed").agg(F.min("doc_id").alias("ref_id"), F.min_by("place", "doc_id").alias("ref_place"), F.count("*").alias("n")).filter("n > 1"), "firsts")
        freed(spark)
        kept = stored(salted_join(found, firsts, "seed", "n", "doc_id", hashed=True).select("doc_id", "place", "run", "again", "ref_id", "ref_place"), "met")
        tables.append(kept)
        met = kept if met is None else met.union(kept)
        for t in (found, firsts):
            discard(t)
        freed(spark)
    runs = met.filter("run is not null")
    # a row that repeats a run is referred to at its first place: any other choice would change from call to call
    first = F.when(~F.col("again"), F.col("doc_id"))
    by_run = stored(runs.groupBy("run").agg(F.min("doc_id").alias("ref_id"), F.min_by("place", first).alias("ref_place"), F.count("*").alias("n")).filter("n > 1"), "runs")
    # most runs lead where their seeds lead
    others = salted_join(runs.select("run", "doc_id", "place", F.col("ref_id").alias("known")), by_run, "run", "n", "doc_id", hashed=True).filter("ref_id <> known")
    columns = ["doc_id", "place", "ref_id", "ref_place"]
    matches = met.select(*columns).union(others.select(*columns)).filter("doc_id <> ref_id")
    matches._made_of = [*tables, by_run]
    return matches


def _chained(matches: DataFrame, k: int) -> DataFrame:
    """(doc_id, start, end, ref_id, ref_start, ref_end): unaligned passages."""
    names = ["doc_id", "start", "end", "ref_id", "ref_start", "ref_end"]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """Rows of whole pairs, as a matrix with a column for each of doc_id, place, ref_id, ref_place."""
        held = np.empty((0, 4), dtype=np.int64)
        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            held = np.concatenate((held, rows))
            last = np.flatnonzero((held[:, 0] != held[-1, 0]) | (held[:, 2] != held[-1, 2]))
            if len(last):
                yield held[: last[-1] + 1]
                held = held[last[-1] + 1 :]
        if len(held):
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pairs(b for b in batches if b.num_rows):
            doc, place, ref, other = rows.T
            fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (ref[1:] != ref[:-1])))
            begin = np.flatnonzero(fresh)
            end = np.append(begin[1:], len(rows))
            # matches side by side, without a shift and with steps that cost less than a match, are one chain
            step = np.concatenate(([0], np.diff(place)))
            shift = np.concatenate(([0], np.diff(place - other)))
            bent = ~fresh & ((shift != 0) | (step <= 0) | (2 * GAP_COST * step >= 1) | (step - k > MAX_GAP))
            straight = np.add.reduceat(bent, begin) == 0
            one, last = begin[straight], end[straight] - 1
            out = [np.column_stack((doc[one], place[one], place[last] + k, ref[one], other[one], other[last] + k))]
            for s, e in zip(begin[~straight].tolist(), end[~straight].tolist(), strict=True):
                found = [(doc[s], lo, hi, ref[s], rlo, rhi) for c in chain(list(zip(place[s:e].tolist(), other[s:e].tolist(), strict=True))) for lo, hi, rlo, rhi, _ in passages(c, k)]
                out.append(np.array(found, dtype=np.int64).reshape(-1, 6))
            whole = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(whole[:, i], pa.int64()) for i in range(6)], names=names)

    by = ["doc_id", "ref_id", "place", "ref_place"]
    rows = matches.repartition("doc_id", "ref_id").sortWithinPartitions(*by).select("doc_id", "place", "ref_id", "ref_place")
    return rows.mapInArrow(run, ", ".join(f"`{n}` long" for n in names))


def _slices(texts: DataFrame, sides: DataFrame, margin: int) -> DataFrame:
    """(id, lo, hi, weight, words, from): 32 bits of the word hashes of each asked range with a margin; from: where they begin. ``sides``: (id, lo, hi, weight), once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2):
            ranges = batch.column(1)
            sizes = pa.compute.list_value_length(ranges).to_numpy(zero_copy_only=False)
            flat = ranges.flatten()
            lo, hi, weight = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("lo", "hi", "weight"))
            hashes, words = word_hashes(batch.column(2))
            begin = np.repeat(np.cumsum(words) - words, sizes)
            low = np.maximum(lo - margin, 0)
            length = np.minimum(hi + margin, np.repeat(words, sizes)) - low
            ends = np.cumsum(length)
            at = np.arange(ends[-1]) + np.repeat(begin + low - (ends - length), length)
            own = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), sizes), pa.int64()))
            lo, hi, weight, low = (pa.array(x, pa.int64()) for x in (lo, hi, weight, low))
            found = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(hashes[at].astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([own, lo, hi, weight, found, low], names=["id", "lo", "hi", "weight", "words", "from"])

    asked = sides.groupBy("id").agg(F.collect_list(F.struct("lo", "hi", "weight")).alias("ranges"))
    joined = asked.join(texts.select(F.col("doc_id").alias("id"), "text"), "id")
    return joined.select("id", "ranges", "text").mapInArrow(run, "id long, lo long, hi long, weight long, words array<int>, from long")


def _laid_out(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values of all lists end to end, and where each list begins and ends there."""
    end = np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), np.append(0, end[:-1])[: len(end)], end


def _aligned(rows: DataFrame, min_words: int, min_identity: float) -> DataFrame:
    names = ["doc_id", "start", "end", "ref_id", "ref_start", "ref_end", "edits"]
    allowed = round((1 - min_identity) * 10**9)  # in integers: 1 - 0.8 is a little less than a fifth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, s, e, r, rs, re_, a0, b0 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3, 4, 5, 7, 9))
            (a, a_begin, a_end), (b, b_begin, b_end) = (_laid_out(batch.column(i)) for i in (6, 8))
            # from here on places in a and b
            s, e, rs, re_ = s - a0 + a_begin, e - a0 + a_begin, rs - b0 + b_begin, re_ - b0 + b_begin
            sides = [(*_ends(a, a_begin, a_end, s, -1), *_ends(b, b_begin, b_end, rs, -1)), (*_ends(a, a_begin, a_end, e, 1), *_ends(b, b_begin, b_end, re_, 1))]
            waiting, out = {EDIT_COST: np.arange(batch.num_rows)}, [np.empty((0, len(names)), dtype=np.int64)]
            put = lambda cost, rows: waiting.update({cost: np.append(waiting.get(cost, rows[:0]), rows)})
            while waiting:
                cost, rows = waiting.popitem()
                (i, j), (u, v) = (widened_many(x[rows], y[rows], n[rows], m[rows], cost) for x, n, y, m in sides)
                lo, hi, rlo, rhi = s[rows] - i, e[rows] + u, rs[rows] - j, re_[rows] + v
                size = hi - lo
                long = size >= min_words
                # a range that is just too short may end in few equal words behind an edit
                if cost == EDIT_COST and len(short := rows[~long & (2 * size >= min_words)]):
                    put(0.5, short)
                rows, lo, hi, rlo, rhi, size = (x[long] for x in (rows, lo, hi, rlo, rhi, size))
                edits = edit_distances([(a[w:x], b[y:z]) for w, x, y, z in zip(lo.tolist(), hi.tolist(), rlo.tolist(), rhi.tolist(), strict=True)])
                alike = edits * 10**9 <= allowed * np.maximum(size, rhi - rlo)
                to_a, to_b = (a0 - a_begin)[rows], (b0 - b_begin)[rows]
                out.append(np.column_stack((d[rows], lo + to_a, hi + to_a, r[rows], rlo + to_b, rhi + to_b, edits))[alike])
                # ends that take too many edits in are looked for again, last over equal words only
                if cost in DEARER and not alike.all():
                    put(DEARER[cost], rows[~alike])
            whole = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(whole[:, i], pa.int64()) for i in range(len(names))], names=names)

    return rows.mapInArrow(run, ", ".join(f"`{n}` long" for n in names))


def several_texts(texts: DataFrame) -> DataFrame:
    """(doc_id, least): ids with different texts, and the smallest hash of those. Stored; mostly empty."""
    hashes = texts.select("doc_id", F.xxhash64("text").alias("h")).groupBy("doc_id").agg(F.min("h").alias("least"), F.max("h").alias("most"), F.count("*").alias("n"))
    return stored(hashes.filter("n > 1").select("doc_id", "least"), "several")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY, k: int = SEED_WORDS, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, end, ref_id, ref_start, ref_end, edits): passages that an earlier document has too.

    Places count words; ``end`` is past the last. ref_id is a smaller id: the first document that
    has the passage's seeds, or the first that has ``min_words`` of its words in a row. Copies of
    one passage all point at its first document. Of a run of ``min_words`` + ``window`` - 1
    words or more that an earlier document has too, all but ``window`` - 1 words at its ends are
    inside rows' ranges, though a row may point at a document that has a part of the run only.
    Up to 1 - ``min_identity`` of a range's words are edited. Edited passages are found by the
    runs of k words left in them: with a fifth of the words replaced, some have none. Repeats
    inside one row don't count. Of rows that share an id, the one whose text has the smallest hash
    stands for it: the others neither have passages nor are pointed at. Rows with a null id or
    text have no passages; an empty table has none. Long texts only make their own chains longer.
    Only doc_id (long) and text are read, so other columns may have any name.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    several = several_texts(texts)
    if not several.isEmpty():
        texts = texts.join(several, "doc_id", "left").filter("least is null or xxhash64(text) = least").drop("least").dropDuplicates(["doc_id"])
    matches = matched_places(texts, k, window, min_words)
    found = stored(_chained(matches, k), "passages")
    for t in matches._made_of:
        discard(t)
    freed(docs.sparkSession)
    here = found.select(F.col("doc_id").alias("id"), F.col("start").alias("lo"), F.col("end").alias("hi"), F.lit(0).alias("weight"))
    there = found.select(F.col("ref_id").alias("id"), F.col("ref_start").alias("lo"), F.col("ref_end").alias("hi"), F.lit(1).alias("weight"))
    # weight: the rows that refer to a range
    asked = here.union(there).groupBy("id", "lo", "hi").agg(F.sum("weight").alias("weight"))
    slices = stored(_slices(texts, asked, MARGIN), "slices")
    freed(docs.sparkSession)
    a = slices.select(F.col("id").alias("doc_id"), F.col("lo").alias("start"), F.col("hi").alias("end"), F.col("words").alias("a"), F.col("from").alias("a0"))
    b = slices.filter("weight > 0").select(F.xxhash64("id", "lo", "hi").alias("side"), "weight", F.col("id").alias("_ref_id"), F.col("lo").alias("_ref_start"), F.col("hi").alias("_ref_end"), F.col("words").alias("b"), F.col("from").alias("b0"))
    # one passage that many documents repeat is the reference of as many rows: deal those
    met = found.withColumn("side", F.xxhash64("ref_id", "ref_start", "ref_end"))
    joined = salted_join(met, b, "side", "weight", "doc_id").filter("ref_id = _ref_id and ref_start = _ref_start and ref_end = _ref_end")
    both = joined.join(a, ["doc_id", "start", "end"])
    aligned = stored(_aligned(both.select("doc_id", "start", "end", "ref_id", "ref_start", "ref_end", "a", "a0", "b", "b0"), min_words, min_identity), "aligned")
    for t in (found, slices):
        discard(t)
    freed(docs.sparkSession)
    # chains of one pair that were widened to the same passage are one row
    earlier = Window.partitionBy("doc_id", "ref_id").orderBy("start", F.desc("end"), "ref_start", "ref_end").rowsBetween(Window.unboundedPreceding, -1)
    return aligned.withColumn("upto", F.max("end").over(earlier)).filter("upto is null or end > upto").drop("upto")


def cut_passages(docs: DataFrame, found: DataFrame, min_left: int = 5) -> DataFrame:
    """``docs`` (all columns) without the words of the passages; n_chars follows if it is there.

    A document that is cut and has fewer than ``min_left`` words left goes. Others, null ids
    and null texts included, stay as they are. A document's ranges are joined before it is cut.
    Of rows that share an id, those are cut that ``repeated_passages`` takes; equal rows alike.
    Columns may have any names.
    """
    at, rows = unused(docs, "ranges"), docs
    ranges = found.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct(F.col("start").alias("s"), F.col("end").alias("e")))).alias(at))
    several = several_texts(docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null"))
    if several.isEmpty():
        rows = docs.join(ranges, "doc_id", "left")
    else:
        least = unused(docs, "least")
        rows = docs.join(ranges, "doc_id", "left").join(several.withColumnRenamed("least", least), "doc_id", "left")
        rows = rows.withColumn(at, F.when(F.col(least).isNull() | (F.xxhash64(F.col("text").cast("string")) == F.col(least)), F.col(at)))
    schema = docs.schema
    names = docs.columns
    at_text, at_chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(r"[^\x20\x09-\x0D]+")
        for batch in batches:
            texts, keep = [], []
            for text, ranges in zip(batch.column(at_text).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if not ranges or text is None:
                    texts.append(text)
                    keep.append(True)
                    continue
                spans = [m.span() for m in word.finditer(text)]
                parts, at, upto, gone = [], 0, 0, 0
                for r in ranges:
                    s, e = max(r["s"], upto), r["e"]
                    if e <= s:
                        continue
                    gone, upto = gone + e - s, e
                    parts.append(text[at : spans[s][0]])
                    at = spans[e - 1][1]
                texts.append("".join(parts) + text[at:])
                keep.append(len(spans) - gone >= min_left)
            columns = list(batch.columns[:-1])
            columns[at_text] = pa.array(texts, pa.string())
            if at_chars is not None:
                old, new = columns[at_chars], pa.array([None if t is None else len(t) for t in texts], columns[at_chars].type)
                changed = pa.array([r is not None for r in batch.column(batch.num_columns - 1).to_pylist()])
                columns[at_chars] = pa.compute.if_else(changed, new, old)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return rows.select(*[F.col(f"`{c}`") for c in names], at).mapInArrow(run, schema)


def op3_repeated_passages(spark, sf_dir: str) -> DataFrame:
    from shelfwise.llm.common import table

    found = repeated_passages(table(spark, sf_dir, "documents"))
    n = F.greatest(F.col("end") - F.col("start"), F.col("ref_end") - F.col("ref_start"))
    return found.withColumn("identity", F.round(1 - F.col("edits") / n, 4)).withColumnRenamed("ref_id", "ref_doc_id")
