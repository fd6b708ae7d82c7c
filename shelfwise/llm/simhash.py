"""SimHash near-duplicate classes with BK-trees.

A document's fingerprint has bit b set where over half of its word shingles' 64-bit hashes
have it set. Texts with one fingerprint are one node. Two fingerprints at a distance of r
or less agree on one of r + 1 bit blocks, so nodes are sharded by (block, its value); every
shard builds a BK-tree (children keyed by their integer Hamming distance to the parent) and
searches it along the edges within the radius only. A shard returns one link per node to
the root of its local class, never all pairs, and the links are joined into components.
A crowded shard is divided by blocks of the bits it doesn't fix, again and again: after a few
divisions so few bits are open that no shard can hold more than a thousand nodes.

``similar_classes`` serves a similarity of whole texts (Jaccard of word shingles) instead of a
bit distance. The same trees join the fingerprints of the distinct shingles, and a class of them
is a shard of texts. At a similarity of 0.8 fingerprints differ in ten bits on average, so no few
blocks of bits agree: for what lies beyond the radius texts also share a shard when they agree on
a band of shingle minima. The shingle sets alone decide on each link. A crowded shard's texts are compared part by part, and then across parts
where they are not in one class already, so no task holds more than a part's sets.

The shard trees meet their queries by a shuffle on the shard key. Broadcasting them all, as
the textbook form does, would ship data that grows with the corpus.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import discard, salted_join, stored, unused
from shelfwise.llm.components import connected_components

BITS = 64


def shingle_hashes(text: str | None, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Unsigned 64-bit hashes of the word shingles in order; fewer words than a shingle are one, none give none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and the ASCII blanks count
    if not words:
        return np.empty(0, dtype="<u8")
    flat, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[s:e], seed) for s, e in zip(starts, ends, strict=True)], dtype="<u8")


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of one text; null, empty and blank texts have 0."""
    return fingerprint_of(shingle_hashes(text, shingle, seed))


def fingerprint_of(hashes: np.ndarray) -> int:
    n = len(hashes)
    if not n:
        return 0
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64), pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, fp long")


class BKTree:
    """Children keyed by Hamming distance to their parent."""

    def __init__(self) -> None:
        self.root: tuple | None = None

    def near_then_add(self, key: int, value: int, radius: int) -> list[tuple[int, int]]:
        """(distance, value) of the nodes within the radius of ``key``; then ``key`` joins the tree.

        Equal keys hang in a chain of children at distance 0, so that each keeps its value.
        """
        node, found = self.root, []
        if node is None:
            self.root = (key, value, {})
            return found
        stack = [node]
        while stack:
            at, own, children = stack.pop()
            d = (at ^ key).bit_count()
            if d <= radius:
                found.append((d, own))
            if children:
                if len(children) <= 2 * radius + 1:
                    stack += [c for k, c in children.items() if d - radius <= k <= d + radius]
                else:
                    stack += [children[k] for k in range(d - radius, d + radius + 1) if k in children]
        while True:
            d = (node[0] ^ key).bit_count()
            if d not in node[2]:
                node[2][d] = (key, value, {})
                return found
            node = node[2][d]


def _shard_links(keys: list[int], ids: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """One link from each node of a class to the class's smallest id."""
    parent = {i: i for i in ids}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    tree = BKTree()
    for key, own in zip(keys, ids, strict=True):
        for _, other in tree.near_then_add(key, own, radius):
            a, b = top(own), top(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
    for i in ids:
        if (root := top(i)) != i:
            yield i, root


def _divided(masks: list[int], radius: int) -> list[int]:
    """For each mask of agreed bits, the ``radius`` + 1 masks that each agree on one block of the others too."""
    found = []
    for mask in masks:
        free = [i for i in range(BITS) if not mask >> i & 1]
        cuts = [len(free) * i // (radius + 1) for i in range(radius + 2)]
        found += [mask | sum(1 << i for i in free[a:b]) for a, b in itertools.pairwise(cuts)]
    return found


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(nodes: DataFrame, radius: int = 2, shard_limit: int = 1024) -> DataFrame:
    """(a, b): links that join exactly the nodes (id, fp) within the radius into classes.

    Nodes of a shard agree on the bits of a mask and differ in ``radius`` others or fewer, so they
    agree on one of ``radius`` + 1 blocks of the other bits as well: shards of more than
    ``shard_limit`` nodes are divided so, until ten bits or fewer are open (2^10 nodes at most).
    """
    masks, whole = [0], []
    now = nodes.select("id", "fp", F.lit(0).alias("mask"))
    while True:
        masks = _divided(masks, radius)
        table = F.array(*[F.lit(_signed(m)) for m in masks])
        next_masks = F.transform(F.sequence(F.lit(0), F.lit(radius)), lambda j: F.col("mask") * (radius + 1) + j)
        shards = now.select("id", "fp", F.explode(next_masks).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.get(table, F.col("mask"))))
        level = F.lit(len(whole))
        sizes = stored(shards.groupBy("mask", "key").agg(F.count("*").alias("size")).filter("size > 1"), "shard-sizes")
        sized = shards.join(sizes, ["mask", "key"])
        open_bits = BITS - min(m.bit_count() for m in masks)
        crowded = sizes.filter(F.col("size") > shard_limit)
        if open_bits <= 10 or crowded.isEmpty():
            whole.append(sized.select(level.alias("level"), "mask", "key", "fp", "id"))
            break
        whole.append(sized.filter(F.col("size") <= shard_limit).select(level.alias("level"), "mask", "key", "fp", "id"))
        now = stored(sized.filter(F.col("size") > shard_limit).select("id", "fp", "mask"), "crowded")
    shards = functools.reduce(DataFrame.union, whole)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, keys, ids, out = None, [], [], []

        def close() -> None:
            if len(ids) > 1:
                out.extend(_shard_links(keys, ids, radius))

        for frame in frames:
            # each shard's rows are adjacent: the partitions are sorted by shard
            for *at, fp, own in zip(*(frame[c].tolist() for c in ("level", "mask", "key", "fp", "id")), strict=True):
                if at != shard:
                    close()
                    shard, keys, ids = at, [], []
                keys.append(fp & 0xFFFFFFFFFFFFFFFF)
                ids.append(own)
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        close()
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])

    by = ["level", "mask", "key"]
    return shards.repartition(*by).sortWithinPartitions(*by, "fp").mapInPandas(run, "a long, b long")


def fingerprint_classes(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, component_id, n), stored: a row for each fingerprint of ``fps`` (id, fp; stored), its class's smallest id and its own number of rows."""
    groups = stored(fps.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")), "fingerprint-groups")
    nodes = groups.filter("id is not null").select("fp", "id")
    found = connected_components(fingerprint_links(nodes, radius)).select(F.col("node").alias("id"), "component")
    named = stored(groups.join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"), "n"), "fingerprint-classes")
    discard(groups)
    return named


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the smallest id that can be reached over links of ``radius`` or fewer
    differing bits, the row's own id included. Repeated ids are kept as rows; a null id gets
    its text's class too (null when no other row shares it). A null text counts as empty, and
    texts without words share fingerprint 0. An empty table gives an empty result. Other
    columns, whatever their names, aren't read. Ids are longs.
    """
    fps = stored(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    return salted_join(fps, fingerprint_classes(fps, radius), "fp", "n", "id").select(F.col("id").alias("doc_id"), "fp", "component_id")


#: Bands of shingle minima and minima in a band: a pair of similarity 0.8 shares none in three cases of a million.
BANDS, ROWS = 24, 4
_MIX = np.random.default_rng(20240611).integers(1, 1 << 63, size=BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def band_keys(hashes: np.ndarray) -> list[int]:
    """A hash of each band's number and minima, as signed longs; no shingles give none."""
    if not len(hashes):
        return []
    least = np.array([((hashes ^ (hashes >> np.uint64(31))) * m).min() for m in _MIX], dtype="<u8").reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least)]


def _sketches(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, row, node, fp, bands) from (id, row, text): node is a hash of the words, equal for texts with the same words.

    fp is the fingerprint of the distinct shingles: repeats move neither it nor the similarity.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, bands = [], [], []
            for t in batch.column(2):
                hashes = shingle_hashes(t.as_py(), shingle)
                nodes.append(xxhash.xxh64_intdigest(hashes.tobytes(), 1) - (1 << 63))
                fps.append(_signed(fingerprint_of(np.unique(hashes))))
                bands.append(band_keys(hashes))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "row", "node", "fp", "bands"])

    return texts.mapInArrow(run, "id long, row long, node long, fp long, bands array<long>")


def _fingerprint_shards(sketches: DataFrame, radius: int) -> DataFrame:
    """(node, shard): a shard for each class of two nodes or more that the BK-trees join by fingerprints."""
    fps = stored(sketches.select(F.col("node").alias("id"), "fp").distinct(), "near-fingerprints")
    classes = fingerprint_classes(fps, radius)
    several = classes.groupBy("component_id").agg(F.sum("n").alias("nodes")).filter("nodes > 1").select("component_id")
    shards = stored(classes.join(several, "component_id", "left_semi").select("fp", F.xxhash64(F.lit("fingerprint"), "component_id").alias("shard"), "n"), "fingerprint-shards")
    discard(classes)
    return salted_join(fps, shards, "fp", "n", "id").select(F.col("id").alias("node"), "shard")


def _shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) from (node, text): distinct shingle hashes as binary, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique((shingle_hashes(t.as_py(), shingle) >> np.uint64(32)).astype("<u4")).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles binary")


def _alike(mine: np.ndarray, theirs: np.ndarray, similarity: float) -> bool:
    if min(len(mine), len(theirs)) < similarity * max(len(mine), len(theirs)):
        return False
    both = len(np.intersect1d(mine, theirs, assume_unique=True))
    return both >= similarity * (len(mine) + len(theirs) - both)


def _links_within(parts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): verified links that join each part's texts into classes. ``parts`` has shard, part, node, shingles.

    A text is compared with the members of each class until one is alike, the class's first and
    then its latest ones: a part of n copies takes about n comparisons of sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, classes, out = None, [], []  # a class is a list of (node, set)
        for batch in batches:
            for *at, own, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != part:
                    part, classes = at, []
                mine = np.frombuffer(raw, dtype="<u4")
                joined, apart = [], []
                for members in classes:
                    other = next((i for i, theirs in itertools.chain(members[:1], members[:0:-1]) if _alike(mine, theirs, similarity)), None)
                    if other is None:
                        apart.append(members)
                    else:
                        joined.append(members)
                        out.append((own, other))
                whole = joined[0] if joined else []
                for members in joined[1:]:
                    whole += members
                whole.append((own, mine))
                classes = [*apart, whole]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
                out.clear()

    by = ["shard", "part"]
    return parts.select(*by, "node", "shingles").repartition(*by).sortWithinPartitions(*by, "node").mapInArrow(run, "a long, b long")


def _links_across(parts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): verified links from visitors to the own texts of a part that are in other classes.

    ``parts`` has shard, part, visits, node, class, shingles. Own texts come first and are held, visitors
    stream by; classes that a link has joined aren't compared again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, top, out = None, {}, {}, []

        def root(x: int) -> int:
            while top.get(x, x) != x:
                x = top[x]
            return x

        for batch in batches:
            for *at, visits, own, group, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != part:
                    part, held, top = at, {}, {}
                mine = np.frombuffer(raw, dtype="<u4")
                if not visits:
                    held.setdefault(group, []).append((own, mine))
                    continue
                for other, members in held.items():
                    if root(other) != root(group) and (found := next((i for i, theirs in members if _alike(mine, theirs, similarity)), None)) is not None:
                        out.append((own, found))
                        top[root(group)] = root(other)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
                out.clear()

    by = ["shard", "part", "visits"]
    return parts.select(*by, "node", "class", "shingles").repartition("shard", "part").sortWithinPartitions(*by, "node").mapInArrow(run, "a long, b long")


def similarity_components(members: DataFrame, sets: DataFrame, similarity: float, part_limit: int) -> DataFrame:
    """(node, component) of the nodes that have a link. ``members``: (shard, node, n), stored; ``sets``: (node, shingles), stored.

    Shards of more than ``part_limit`` nodes are parted by a hash of the node. What their parts
    leave outside a shard's largest class then visits every part of the shard, so each pair of a
    shard is compared or known to be in one class.
    """
    parts = F.ceil(F.col("n") / part_limit).cast("int")
    parted = members.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
    links = stored(_links_within(parted.join(sets, "node"), similarity), "near-links")
    named = connected_components(links)
    crowded = parted.filter(F.col("n") > part_limit)
    if crowded.isEmpty():
        discard(links)
        return named
    classed = stored(crowded.join(named.select("node", F.col("component").alias("class")), "node", "left").withColumn("class", F.coalesce("class", "node")), "near-classes")
    largest = classed.groupBy("shard", "class").agg(F.count("*").alias("m")).groupBy("shard").agg(F.max_by("class", F.struct("m", "class")).alias("main"))
    rest = classed.join(largest, "shard").filter("class <> main").drop("main")
    if rest.isEmpty():
        for t in (links, classed):
            discard(t)
        return named
    own = classed.join(rest.select("shard").distinct(), "shard", "left_semi").withColumn("visits", F.lit(False))
    visitors = rest.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("visits", F.lit(True))
    more = stored(_links_across(own.unionByName(visitors).join(sets, "node"), similarity), "near-links")
    found = connected_components(links.union(more))
    for t in (links, classed, more):
        discard(t)
    return found


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, part_limit: int = 512, radius: int = 2) -> DataFrame:
    """(doc_id, row, component_id, first): classes of texts whose shingle sets have this Jaccard similarity or more, through any chain.

    Texts are compared where the BK-trees put their fingerprints into one class (links of
    ``radius`` or fewer bits) and where they share a band; their shingle sets decide on a link.
    A row for each id and text; ``row`` is the text's hash (xxhash64 of Spark). component_id is
    the class's smallest id, and ``first`` marks one text of each class, of that id: the one
    with the smallest hash of its words and then of itself. Texts with the same words are one
    node, and only nodes that share a class or a band with another carry their shingles to a shard. Null
    and wordless texts form no class; null ids are left out; rows that share an id are apart
    unless their texts are alike. An empty table stays empty. Other columns aren't read.
    """
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("row"), text.alias("text")).filter("id is not null")
    sketches = stored(_sketches(texts, shingle).filter(F.size("bands") > 0), "sketches")
    banded = sketches.select("node", F.explode("bands").alias("shard")).union(_fingerprint_shards(sketches, radius)).distinct()
    crowded = banded.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1")
    members = stored(banded.join(crowded, "shard"), "shards")
    rows = sketches.select("id", "row", "node").distinct()
    nodes = stored(rows.groupBy("node").agg(F.min(F.struct("id", "row")).alias("s"), F.count("*").alias("n")), "near-nodes")
    one = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "s.*")
    sets = stored(_shingle_sets(texts.join(one, ["id", "row"]).dropDuplicates(["node"]).select("node", "text"), shingle), "shingles")
    named = similarity_components(members, sets, similarity, part_limit)
    classed = stored(nodes.join(named, "node", "left").select("node", "s", "n", F.coalesce("component", "node").alias("component")), "near-classes")
    least = stored(classed.groupBy("component").agg(F.min(F.struct("s.id", "node", "s.row")).alias("least"), F.count("*").alias("nodes")), "near-firsts")
    by_node = stored(salted_join(classed.select("node", "n", "component"), least, "component", "nodes", "node").select("node", "n", "least"), "near-classes")
    for t in (members, sets, nodes, classed, least):
        discard(t)
    mark = (F.col("id") == F.col("least.id")) & (F.col("node") == F.col("least.node")) & (F.col("row") == F.col("least.row"))
    # copies of one text are one node: those are dealt
    return salted_join(rows, by_node, "node", "n", "id").select(F.col("id").alias("doc_id"), "row", F.col("least.id").alias("component_id"), mark.alias("first"))


def without_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, part_limit: int = 512) -> DataFrame:
    """The rows of ``docs`` (all columns) that are the first of their class by ``similar_classes``, or in none.

    Rows equal in id and text are one document: they stay or go together. Null ids and texts stay.
    Columns may have any names.
    """
    row = unused(docs, "row")
    later = similar_classes(docs, shingle=shingle, similarity=similarity, part_limit=part_limit).filter("not first").select("doc_id", F.col("row").alias(row))
    return docs.withColumn(row, F.xxhash64(F.col("text").cast("string"))).join(later, ["doc_id", row], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    from shelfwise.llm.common import table

    found = near_duplicate_classes(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
