"""Jaccard join of shingle sets by T-occurrence search.

Two sets of a similarity of p per cent share many shingles: of a set of n, at least p n / 100, and if
the other is no smaller, at least 2 p n / (100 + p). So in any fixed order of all shingles the first
few of both, their prefixes, share one. The order here puts rare shingles first (by counts in a table
of fixed size, so it is the same everywhere), which leaves few sets with a prefix shingle in common.

1. Texts with equal sets are one node. Nodes meet by prefix shingle and size class; those that meet
   go to the shard of the smallest of them, so any two nodes that can be alike are in one shard, and
   a group of near copies, which share many prefix shingles, is a few shards and not many.
2. Nodes that no other node of their shard can resemble, by the shingles' counts in buckets, go.
3. A shard is searched by DivideSkip: every shingle has an inverted list; of a query's lists the
   longest are put aside, the others are merged by a heap that skips what cannot reach the number
   still asked for, and the survivors are looked up in the long lists by binary search. A node is
   compared with the leaders of the classes so far; then those outside the largest class are
   compared with all others.
4. A shard of over ``part_limit`` nodes is searched part by part, and what lies outside its largest
   class then visits the other parts. Links are joined into components.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import by_bytes, discard, freed, salted_join, stored
from shelfwise.llm.components import connected_components
from shelfwise.llm.substring_dedup import WordHasher

#: Buckets that shingles are counted in for their order, and the slices that the table is summed in.
ORDER_BITS, SLICES = 20, 64
#: Logarithms of the fewest and most buckets of a set's profile; between them there are about 8 shingles a bucket.
PROFILE_BITS = (4, 12)
#: Sets that a task holds at a time, and how willingly DivideSkip puts lists aside (the smaller, the more).
PART_LIMIT, WILLING = 512, 0.0085


def set_of(words: np.ndarray, shingle: int = 3) -> np.ndarray:
    """Distinct 64-bit hashes, ascending, of the shingles of hashed words; fewer words than a shingle are one, none give none."""
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    size = min(n, shingle)
    h = np.full(n - size + 1, size, dtype=np.uint64)
    for j in range(size):
        h = (h ^ words[j : n - size + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(32)))


def node_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.astype("<u8").tobytes())


def short_of(node: bytes) -> int:
    return int.from_bytes(node[:8], "little", signed=True)


def least_overlap(n: int, percent: int) -> int:
    """What a set of n shares at least with any that resembles it."""
    return -(-percent * n // 100)


def least_overlap_upward(n: int, percent: int) -> int:
    """What a set of n shares at least with one that resembles it and is no smaller."""
    return -(-2 * percent * n // (100 + percent))


def profile_of(shingles: np.ndarray) -> np.ndarray:
    """How many shingles fall to each of a power of two of buckets, the more the larger the set."""
    low, high = PROFILE_BITS
    bits = min(high, max(low, (len(shingles) // 8).bit_length()))
    return np.bincount((shingles & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits).astype("<u4")


def size_class(n: Column, percent: int) -> Column:
    """Sets that can resemble each other are in one class or in neighbouring ones."""
    return F.floor(F.ln(n.cast("double")) / math.log(100 / percent) + 1e-9).cast("int")


def _each(batches: Iterator[pa.RecordBatch], column: int, shingle: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    hasher = WordHasher()
    for batch in by_bytes(batches, column):
        yield batch, [set_of(hasher.hashes(t.as_py() or ""), shingle) for t in batch.column(column)]


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, node, k, n, profile) of each text, null but for n where the set is empty; and (slice, counts): each task's table of shingles by bucket.

    k is 64 bits of the node: candidates are looked for by k alone, and where two nodes share one, both come along.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = np.zeros(1 << ORDER_BITS, dtype=np.int64), set()
        for batch, sets in _each(batches, 1, shingle):
            if fresh := [sets[i] for i, _ in _fresh(sets, seen)]:
                table += np.bincount(_bucket(np.concatenate(fresh)), minlength=len(table))
            nodes = [node_of(s) if len(s) else None for s in sets]
            profiles = [profile_of(s).tobytes() if len(s) else None for s in sets]
            yield _row(batch.column(0), nodes, [None if x is None else short_of(x) for x in nodes], [len(s) for s in sets], profiles, [None] * len(sets), [None] * len(sets))
        if table.any():
            none = [None] * SLICES
            yield _row(none, none, none, none, none, range(SLICES), [x.astype("<u4").tobytes() for x in table.reshape(SLICES, -1)])

    def _row(*columns) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "node", "k", "n", "profile", "slice", "counts"])

    return texts.mapInArrow(run, "id long, node binary, k long, n long, profile binary, slice int, counts binary")


def _fresh(sets: list[np.ndarray], seen: set[bytes], limit: int = 100_000) -> Iterator[tuple[int, bytes]]:
    """Places and nodes of the sets that aren't empty and that this task hasn't just met; later ones are met again downstream at worst."""
    for i, s in enumerate(sets):
        if len(s) and (node := node_of(s)) not in seen:
            if len(seen) >= limit:
                seen.clear()
            seen.add(node)
            yield i, node


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


def order_levels(counts: DataFrame) -> bytes:
    """A level for each of 2^ORDER_BITS buckets of hashes from (slice, counts): the logarithm of how many shingles fall there, in eighths.

    Each task has counted into a table of this fixed size; slices of those are summed in tasks
    again, and the driver gets a byte a bucket.
    """

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(raw, dtype="<u4").astype(np.int64)
        levels = [np.round(8 * np.log2(np.maximum(c, 1))).clip(0, 255).astype(np.uint8).tobytes() for c in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], names=["slice", "levels"])

    rows = counts.repartition("slice").mapInArrow(total, "slice int, levels binary")
    return b"".join(bytes(r["levels"]) for r in sorted(rows.collect(), key=lambda r: r["slice"]))


def _prefixes(texts: DataFrame, shingle: int, percent: int, levels: bytes) -> DataFrame:
    """(token, k, n, indexed): a node's prefix shingles; ``indexed``: also in the shorter prefix that meets larger sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = np.frombuffer(levels, dtype=np.uint8), set()
        for _, sets in _each(batches, 0, shingle):
            tokens, short, sizes, indexed = [], [], [], []
            for i, node in _fresh(sets, seen):
                s, n = sets[i], len(sets[i])
                ordered = s[np.lexsort((s, table[_bucket(s)]))]
                size = n - least_overlap(n, percent) + 1
                tokens.append(ordered[:size])
                short.append(np.full(size, short_of(node)))
                sizes.append(np.full(size, n, dtype=np.int32))
                indexed.append(np.arange(size) < n - least_overlap_upward(n, percent) + 1)
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(short)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(indexed))], names=["token", "k", "n", "indexed"])

    return texts.select("text").mapInArrow(run, "token long, k long, n int, indexed boolean")


def _node_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) from texts; shingles as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _each(batches, 0, shingle):
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.binary()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    return texts.select("text").mapInArrow(run, "node binary, shingles binary")


def _plausible(rows: list[tuple[bytes, int, bytes]], percent: int) -> list[tuple[bytes, int, bytes]]:
    """The nodes (node, n, profile) that another one may resemble: sets share no more than the smaller counts of each bucket.

    A profile is halved to meet one with half its buckets; sets of like sizes are no further apart.
    """
    n = np.array([r[1] for r in rows], dtype=np.int64)
    profiles = [np.frombuffer(r[2], dtype="<u4").astype(np.int64) for r in rows]
    width = np.array([len(p) for p in profiles])
    at = {w: np.flatnonzero(width == w) for w in np.unique(width).tolist()}
    whole = {w: np.array([profiles[i] for i in places]) for w, places in at.items()}
    half = lambda p: p[..., : p.shape[-1] // 2] + p[..., p.shape[-1] // 2 :]
    alive = np.zeros(len(rows), dtype=bool)
    for i, mine in enumerate(profiles):
        if alive[i]:
            continue
        for w in (len(mine) // 2, len(mine), 2 * len(mine)):
            if w in at:
                others, own = (half(whole[w]), mine) if w > len(mine) else (whole[w], half(mine) if w < len(mine) else mine)
                shared = np.minimum(others, own).sum(axis=1)
                fits = 100 * shared >= percent * (n[at[w]] + n[i] - shared)
                fits &= at[w] != i
                if fits.any():
                    alive[i] = True
                    alive[at[w][fits]] = True
    return [r for r, a in zip(rows, alive.tolist(), strict=True) if a]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list, list[tuple]]]:
    """Rows with equal first ``keys`` columns, which are adjacent."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != row[:keys]:
                if rows:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield now, rows


def _sized(members: DataFrame) -> DataFrame:
    """``members`` (shard, node, n, ..., stored) plus ``size``: how much a shard holds, in nodes of 512 shingles or fewer."""
    sizes = stored(members.groupBy("shard").agg(F.greatest(F.count("*"), F.floor(F.sum("n") / 512)).alias("size"), F.count("*").alias("weight")), "join-sizes")
    return salted_join(members, sizes, "shard", "weight", "node")


def _pruned(members: DataFrame, percent: int, part_limit: int) -> DataFrame:
    """(shard, node, n): members (shard, size, node, n, profile) without those that nothing in their shard resembles. Crowded shards stay whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard,), rows in _groups(batches, 1):
            if len(kept := _plausible(rows, percent)) > 1:
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(kept), pa.int64()), pa.array([r[0] for r in kept], pa.binary()), pa.array([r[1] for r in kept], pa.int64())], names=["shard", "node", "n"])

    few = members.filter(F.col("size") <= part_limit).select("shard", "node", "n", "profile")
    small = few.repartition("shard").sortWithinPartitions("shard", "node").mapInArrow(run, "shard long, node binary, n long")
    return small.union(members.filter(F.col("size") > part_limit).select("shard", "node", "n"))


def _sharing(texts: DataFrame, shingle: int, percent: int, levels: bytes) -> DataFrame:
    """(shard, k), stored: nodes that share a prefix shingle with another of about their size, in the shard of the smallest that has it.

    A node meets larger ones in its own size class, and smaller ones in that or the one below.
    """
    prefixes = stored(_prefixes(texts, shingle, percent, levels), "join-prefixes")
    met = prefixes.groupBy("token").agg(F.max("indexed").alias("indexed"), F.count("*").alias("weight"))
    shared = stored(met.filter("weight > 1 and indexed").select("token", "weight"), "join-shared")
    freed(texts.sparkSession)
    own = size_class(F.col("n"), percent)
    live = salted_join(prefixes, shared, "token", "weight", "k").select("token", "k", "indexed", F.explode(F.array(own, own - 1)).alias("class"), own.alias("own"))
    live = stored(live.select("token", "k", "class", (F.col("indexed") & (F.col("class") == F.col("own"))).alias("indexed")), "join-live")
    for t in (prefixes, shared):
        discard(t)
    freed(texts.sparkSession)
    groups = live.groupBy("token", "class").agg(F.min("k").alias("least"), F.max("indexed").alias("indexed"), F.count("*").alias("weight")).filter("weight > 1 and indexed")
    keyed = stored(groups.select(F.xxhash64("token", "class").alias("group"), F.xxhash64("least", "class").alias("shard"), "weight").groupBy("group").agg(F.min("shard").alias("shard"), F.sum("weight").alias("weight")), "join-groups")
    found = stored(salted_join(live.select("k", F.xxhash64("token", "class").alias("group")), keyed, "group", "weight", "k").select("shard", "k").distinct(), "join-sharing")
    for t in (live, keyed):
        discard(t)
    return found


def _sets_of(rows: DataFrame, nodes: DataFrame, wanted: DataFrame, shingle: int, limit: int = 1_000_000) -> DataFrame:
    """(node, shingles) of the wanted nodes, from one document each. Their ids are broadcast if they are ``limit`` (8 MB) or fewer, else joined by a shuffle."""
    having = nodes.select("id", "node").join(wanted, "node", "left_semi")
    ids = stored(having.filter("id is not null").select("id").distinct(), "join-ids")
    chosen = rows.join(F.broadcast(ids) if ids.count() <= limit else ids, "id", "left_semi")
    if not having.filter("id is null").isEmpty():
        chosen = chosen.unionByName(rows.filter("id is null"))
    # rows that share an id may bring other sets along, and equal rows bring one twice
    return _node_sets(chosen.filter("text is not null"), shingle).join(wanted, "node", "left_semi").dropDuplicates(["node"])


class InvertedLists:
    """Places of sets by shingle, each list ascending; searched by DivideSkip."""

    def __init__(self) -> None:
        self.lists: dict[int, list[int]] = {}
        self.sizes: list[int] = []

    def add(self, shingles: list[int]) -> None:
        place = len(self.sizes)
        self.sizes.append(len(shingles))
        for s in shingles:
            self.lists.setdefault(s, []).append(place)

    def alike(self, shingles: list[int], percent: int) -> Iterator[int]:
        """Places of the sets with this similarity to the one given, ascending."""
        n = len(shingles)
        # a set that resembles this one has percent n / 100 of it at least, and so this one's share of the union
        for place, shared in self.occurring(shingles, least_overlap(n, percent)):
            if 100 * shared >= percent * (n + self.sizes[place] - shared):
                yield place

    def occurring(self, shingles: list[int], least: int) -> Iterator[tuple[int, int]]:
        """(place, shared): sets that hold ``least`` of the shingles or more."""
        found = sorted((self.lists[s] for s in shingles if s in self.lists), key=len)
        if len(found) < least:
            return
        aside = min(least - 1, math.floor(least / (WILLING * math.log2(max(2, len(found[-1]))) + 1)))
        short, long = found[: len(found) - aside], found[len(found) - aside :]
        asked = least - aside  # of a survivor of the short lists
        heap = [(x[0], i, 0) for i, x in enumerate(short)]
        heapq.heapify(heap)
        while len(heap) >= asked:
            top, popped = heap[0][0], []
            while heap and heap[0][0] == top:
                popped.append(heapq.heappop(heap))
            if len(popped) >= asked:
                count = len(popped)
                for i, x in enumerate(long):
                    if count + len(long) - i < least:
                        break
                    at = bisect.bisect_left(x, top)
                    count += at < len(x) and x[at] == top
                if count >= least:
                    yield top, count
                after = top + 1
            else:
                # no set before the asked-for head can stand in so many lists: skip to it
                while heap and len(popped) < asked - 1:
                    popped.append(heapq.heappop(heap))
                if not heap:
                    return
                after = heap[0][0]
            for _, i, at in popped:
                x = short[i]
                at = bisect.bisect_left(x, after, at)
                if at < len(x):
                    heapq.heappush(heap, (x[at], i, at))


class Classes:
    """Disjoint sets of places."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def top(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def part_links(sets: list[list[int]], percent: int) -> list[tuple[int, int]]:
    """Links that join the sets into the classes that all links between them make."""
    classes, leaders, index, out = Classes(len(sets)), [], InvertedLists(), []
    for i, s in enumerate(sets):
        met = [leaders[p] for p in index.alike(s, percent)]
        out += [(i, j) for j in met if classes.join(i, j)]
        if not met:
            leaders.append(i)
            index.add(s)
    tops = [classes.top(i) for i in range(len(sets))]
    main = max(set(tops), key=tops.count)
    rest = [i for i, t in enumerate(tops) if t != main]
    if rest:  # a link may also join members of two classes whose leaders aren't alike
        whole = InvertedLists()
        for s in sets:
            whole.add(s)
        for i in rest:
            out += [(i, j) for j in whole.alike(sets[i], percent) if classes.join(i, j)]
    return out


def _links_within(parts: DataFrame, percent: int) -> DataFrame:
    """(a, b) for parts (shard, part, node, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 2):
            sets = [np.frombuffer(r[1], dtype="<u8").tolist() for r in rows]
            out = [(rows[i][0], rows[j][0]) for i, j in part_links(sets, percent)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out, strict=True)], names=["a", "b"])

    by = ["shard", "part"]
    return parts.select(*by, "node", "shingles").repartition(*by).sortWithinPartitions(*by, "node").mapInArrow(run, "a binary, b binary")


def _links_across(parts: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of visitors to a part's own nodes of other classes. ``parts``: shard, part, visits, node, class, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index, own, joined = None, InvertedLists(), [], set()
        for batch in batches:
            out = []
            for shard, part, visits, node, group, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (shard, part):
                    now, index, own, joined = (shard, part), InvertedLists(), [], set()
                shingles = np.frombuffer(raw, dtype="<u8").tolist()
                if not visits:
                    index.add(shingles)
                    own.append((node, group))
                    continue
                for place in index.alike(shingles, percent):
                    other, theirs = own[place]
                    if theirs != group and (group, theirs) not in joined:
                        joined.add((group, theirs))
                        out.append((node, other))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out, strict=True)], names=["a", "b"])

    by = ["shard", "part", "visits"]
    return parts.select(*by, "node", "class", "shingles").repartition("shard", "part").sortWithinPartitions(*by, "node").mapInArrow(run, "a binary, b binary")


def _components(members: DataFrame, sets: DataFrame, percent: int, part_limit: int) -> DataFrame:
    """(node, component) of the nodes with a link. ``members``: (shard, node, size), stored; ``sets``: (node, shingles), stored."""
    parts = F.ceil(F.col("size") / part_limit).cast("int")
    parted = members.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
    links = stored(_links_within(parted.join(sets, "node"), percent), "join-links")
    named = connected_components(links)
    crowded = parted.filter(F.col("size") > part_limit)
    if crowded.isEmpty():
        return named
    classed = stored(crowded.join(named.select("node", F.col("component").alias("class")), "node", "left").withColumn("class", F.coalesce("class", "node")), "join-classes")
    largest = classed.groupBy("shard", "class").agg(F.count("*").alias("m")).groupBy("shard").agg(F.max_by("class", F.struct("m", "class")).alias("main"))
    rest = classed.join(largest, "shard").filter("class <> main").drop("main")
    if rest.isEmpty():
        discard(classed)
        return named
    own = classed.join(rest.select("shard").distinct(), "shard", "left_semi").withColumn("visits", F.lit(False))
    visitors = rest.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("visits", F.lit(True))
    more = stored(_links_across(own.unionByName(visitors).join(sets, "node"), percent), "join-links")
    discard(classed)
    return connected_components(links.union(more))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 90, part_limit: int = PART_LIMIT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Two rows link when the sets of their distinct word shingles (A-Z folded; fewer words than a
    shingle are one, the whole text) have ``percent`` per cent of their union in common, or more;
    component_id is the smallest id that links reach, the row's own included. No link between
    different texts is lost; shingles are 64-bit hashes and sets 128-bit hashes of those. Texts
    without words have an empty set and link with nothing, not even each other. A null text counts
    as empty. Repeated ids are kept as rows; they are one document to links. A null id gets its
    class's smallest id, null if it has none. An empty table gives an empty one. A very long text
    is a long set, held by the tasks that compare it. Other columns aren't read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    both = stored(_sets(rows, shingle), "join-nodes")
    of = both.filter("slice is null").select("id", "node", "k", "n", "profile")
    levels = order_levels(both.filter("slice is not null").select("slice", "counts"))
    members = _sharing(rows.filter("text is not null"), shingle, percent, levels)
    freed(spark)
    nodes = of.filter("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("weight"), *[F.first(c).alias(c) for c in ("k", "n", "profile")])
    nodes = stored(nodes, "join-distinct")
    met = nodes.select("k", "node", "n", "profile")
    profiled = stored(members.join(met, "k").drop("k"), "join-profiles")
    discard(members)
    kept = stored(_pruned(_sized(profiled), percent, part_limit), "join-kept")
    discard(profiled)
    again = stored(_sized(kept), "join-shards")
    discard(kept)
    freed(spark)
    sets = stored(_sets_of(rows, nodes, again.select("node").distinct(), shingle), "join-sets")
    freed(spark)
    named = _components(again, sets, percent, part_limit)
    # a class's smallest id, and that for every row
    classed = stored(nodes.select("node", "id", "weight").join(named, "node", "left").withColumn("component", F.coalesce("component", "node")), "join-named")
    least = stored(classed.groupBy("component").agg(F.min("id").alias("least"), F.count("*").alias("members")), "join-least")
    by_node = stored(salted_join(classed.select("node", "component", "weight"), least, "component", "members", "node").select("node", "least", "weight"), "join-classes")
    found = salted_join(of.filter("node is not null").select("id", "node", "n"), by_node, "node", "weight", "id").select("id", "n", "least")
    wordless = of.filter("node is null").select("id", "n", F.col("id").alias("least"))
    return found.union(wordless).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))


def op11_jaccard_join(spark, sf_dir: str) -> DataFrame:
    from shelfwise.llm.common import table

    return jaccard_classes(table(spark, sf_dir, "documents"))
