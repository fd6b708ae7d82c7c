"""Near-equal lines across the corpus: a segment-partition edit join in DataFrame expressions alone.

A line is cut into ``edits`` + 1 segments of even length. Of two lines within ``edits``
edits one has a segment that the other contains unchanged, near the same place and with a
near-equal length. Segments are indexed by (line length, segment number, content); every line
probes the lengths from its own less ``edits`` up to its own with the substrings that can
stand there. Candidates whose letter counts differ by more than edits can explain are dropped
inside the join; the others are verified by banded bit-parallel edit distance.

A key that more than GROUP lines are indexed under makes no pairs. With one edit, the lines of
such a group agree on all but a window, so it is parted: they must agree on one half of the
window too, and so on, until a group is small or its window is one character. Lines that
agree on all but one character are one class without a comparison: each is linked to the first,
and the group's size gives its number of links. So rows grow with the lines, not their pairs.

Equal lines are one node (a 64-bit hash of the line), so copies are never paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import discard, salted_join, stored, unused
from shelfwise.llm.components import connected_components

#: Lines of fewer characters match when equal only: an edit is a large part of them.
MIN_CHARS = 20
EDITS = 1
#: Lines under one key that are compared with each other.
GROUP = 64
_COUNTED = "etaoin"


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, pos, line, line_id) for each line with a word; pos from 0, row a hash of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the hash has a projection of its own, below the generator: beside it, every line would hash the whole text
    lines = docs.select("doc_id", text.alias("text")).withColumn("row", F.xxhash64("text")).select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("line_id", F.xxhash64("line"))


def _letter_counts(line: Column) -> Column:
    """Counts of the commonest letters, ten bits each; a count stops at 1023."""
    total = F.lit(0).cast("long")
    for i, c in enumerate(_COUNTED):
        n = F.least((F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))).cast("long"), F.lit(1023).cast("long"))
        total = total + F.shiftleft(n, 10 * i)
    return total


def _count_gap(a: Column, b: Column) -> Column:
    """Sum of the differences of the packed counts: each edit changes it by 2 at most."""
    total = F.lit(0).cast("long")
    for i in range(len(_COUNTED)):
        total = total + F.abs(F.shiftrightunsigned(a, 10 * i).bitwiseAND(F.lit(1023)) - F.shiftrightunsigned(b, 10 * i).bitwiseAND(F.lit(1023)))
    return total


def _segment(n: Column, edits: int, i: int) -> tuple[Column, Column]:
    """First place (from 1) and length of segment i of a line of n characters: short ones come first."""
    parts = edits + 1
    short, longer = F.floor(n / parts), F.pmod(n, F.lit(parts))
    shorts = F.lit(parts) - longer
    before = F.lit(i) * short + F.greatest(F.lit(i) - shorts, F.lit(0))
    return (before + 1).cast("int"), (short + (F.lit(i) >= shorts).cast("int")).cast("int")


def line_keys(edits: int) -> Column:
    """Array of (key, code) of a line: code is twice the segment's number, plus one for keys that only probe.

    Keys without that one index the line, and probe for lines of its own length. Segment i (from 0)
    can be shifted by i at most on its left, and by what the edits left over on its right allow:
    the multi-match-aware bounds, which still miss no pair.
    """
    n, keys = F.length("line"), []
    for less in range(edits + 1):
        m = n - less
        for i in range(edits + 1):
            at, size = _segment(m, edits, i)
            low, high = max(-i, less - (edits - i)), min(i, less + (edits - i))
            for shift in range(low, high + 1):
                key = F.xxhash64(m.cast("int"), F.lit(i), F.substring(F.col("line"), at + shift, size))
                keys.append(F.struct(key.alias("key"), F.lit(2 * i + (less > 0 or shift != 0)).alias("code")))
    return F.array_distinct(F.array(*keys)) if edits > 1 else F.array(*keys)


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two strings if ``edits`` or less, else some larger number.

    Bit vectors of the 2 x edits + 1 diagonals around the main one slide down a row with each
    character of ``b`` after the common prefix. Bit i of column j is row j - edits + i; the
    score follows the main diagonal, and the last column's differences lead to the last row.
    """
    width, mask = 2 * edits + 1, (1 << 2 * edits + 1) - 1
    bits = lambda x: F.lit(x).cast("long")
    inverse = lambda x: bits(mask).bitwiseXOR(x.bitwiseAND(bits(mask)))
    shortest = F.least(F.length(a), F.length(b))
    halvings = F.array(*[F.lit(1 << i) for i in range(24, -1, -1)])
    same = F.aggregate(halvings, F.lit(0), lambda n, more: F.when((n + more <= shortest) & (F.substring(a, n + 1, more) == F.substring(b, n + 1, more)), n + more).otherwise(n))
    rest = F.transform(F.array(same), lambda n: F.struct(F.substring(a, n + 1, F.length(a)).alias("a"), F.substring(b, n + 1, F.length(b)).alias("b")))

    def distance(p: Column) -> Column:
        x, y = p["a"], p["b"]
        padded = F.concat(F.repeat(F.lit(" "), F.lit(edits)), x)

        def step(acc: Column, j: Column) -> Column:
            letter, eq = F.substring(y, j, 1), bits(0)
            for i in range(width):
                inside = (j + i > edits) & (j + i <= edits + F.length(x))
                eq = eq.bitwiseOR(F.when(inside & (F.substring(padded, j + i, 1) == letter), bits(1 << i)).otherwise(bits(0)))
            # the vectors are used several times: each is made an element that a lambda names
            return F.when(acc["score"] > 2 * edits, acc).otherwise(F.get(F.transform(F.array(F.struct(eq.alias("eq"), acc["vp"].alias("vp"), acc["vn"].alias("vn"), acc["score"].alias("score"))), column), 0))

        def column(s: Column) -> Column:
            d0 = (s["eq"].bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(s["eq"]).bitwiseOR(s["vn"]).bitwiseAND(bits(mask))
            return F.get(F.transform(F.array(F.struct(d0.alias("d0"), s["vp"].alias("vp"), s["vn"].alias("vn"), s["score"].alias("score"))), after), 0)

        def after(s: Column) -> Column:
            hp, hn, moved = s["vn"].bitwiseOR(inverse(s["d0"].bitwiseOR(s["vp"]))), s["d0"].bitwiseAND(s["vp"]), F.shiftrightunsigned(s["d0"], 1)
            miss = F.when(s["d0"].bitwiseAND(bits(1 << edits)) == 0, F.lit(1)).otherwise(F.lit(0))
            return F.struct(hn.bitwiseOR(inverse(moved.bitwiseOR(hp))).alias("vp"), moved.bitwiseAND(hp).alias("vn"), (s["score"] + miss).alias("score"))

        begin = F.struct(bits(mask & ~((1 << edits) - 1)).alias("vp"), bits(0).alias("vn"), F.lit(0).alias("score"))
        longer = F.length(x) - F.length(y)

        def last(state: Column) -> Column:
            cell = lambda i: (F.shiftrightunsigned(state["vp"], i).bitwiseAND(bits(1)) - F.shiftrightunsigned(state["vn"], i).bitwiseAND(bits(1))).cast("int")
            total = state["score"]
            for i in range(edits):
                total = total + F.when(longer > i, cell(edits + i)).otherwise(F.lit(0)) - F.when(longer < -i, cell(edits - 1 - i)).otherwise(F.lit(0))
            return total

        banded = F.aggregate(F.sequence(F.lit(1), F.length(y)), begin, step, last)
        return F.when(F.abs(longer) > edits, F.lit(edits + 1)).when((F.length(x) == 0) | (F.length(y) == 0), F.abs(longer)).otherwise(banded)

    return F.get(F.transform(rest, distance), 0)


def _indexed() -> Column:
    return F.col("code") % 2 == 0


def _sized(rows: DataFrame) -> DataFrame:
    """``rows`` of the keys under which different lines meet, with n: how many lines are indexed there. Stored.

    ``rows`` has a row once. The counts are stored before they are joined, so that a hot key's rows can be split.
    """
    counts = rows.groupBy("key").agg(F.count(F.when(_indexed(), 1)).alias("n"), F.count("*").alias("all")).filter("n > 0 and `all` > 1").drop("all")
    counted = stored(counts, "line-counts")
    found = stored(rows.join(counted, "key"), "line-groups")
    discard(counted)
    return found


def _met(sized: DataFrame, edits: int) -> DataFrame:
    """(a, b): the candidates of groups, each with no more than their limit of indexed lines."""
    index = sized.filter(_indexed()).select("key", F.col("line_id").alias("a"), F.col("letters").alias("la"))
    probe = sized.select("key", F.col("line_id").alias("b"), F.col("letters").alias("lb"), (~_indexed()).alias("longer"))
    near = ((F.col("a") < F.col("b")) | F.col("longer") & (F.col("a") != F.col("b"))) & (_count_gap(F.col("la"), F.col("lb")) <= 2 * edits)
    return index.join(probe, (index["key"] == probe["key"]) & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _windows(hot: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, line_id, letters, code, at, rest) from rows of halves' keys: rest is what the key leaves open, from ``at`` on, a character more in probes."""
    joined = hot.join(texts, "line_id")
    extra = F.col("code") % 2
    half = F.floor((F.length("line") - extra) / 2).cast("int")
    rest = F.when(F.col("code") < 2, F.substring(F.col("line"), half + 1, F.length("line"))).otherwise(F.substring(F.col("line"), F.lit(1), half + extra))
    return joined.select("key", "line_id", "letters", extra.alias("code"), F.when(F.col("code") < 2, half).otherwise(F.lit(0)).alias("at"), rest.alias("rest"))


def _halved(groups: DataFrame) -> DataFrame:
    """The rows of two groups for each: one leaves the first half of the window open, one the second."""
    half = F.floor((F.length("rest") - F.col("code")) / 2).cast("int")
    open_, rest = F.col("code"), F.col("rest")
    first = F.struct(F.xxhash64("key", F.lit(0), F.substring(rest, half + open_ + 1, F.length(rest))).alias("key"), F.col("at"), F.substring(rest, F.lit(1), half + open_).alias("rest"))
    second = F.struct(F.xxhash64("key", F.lit(1), F.substring(rest, F.lit(1), half)).alias("key"), (F.col("at") + half).alias("at"), F.substring(rest, half + 1, F.length(rest)).alias("rest"))
    return groups.select("line_id", "letters", "code", F.explode(F.array(first, second)).alias("s")).select("s.key", "line_id", "letters", "code", "s.at", "s.rest")


def _union(parts: list[DataFrame]) -> DataFrame:
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found


def line_links(lines: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """((a, b), (line_id, links)) of the different lines of ``min_chars`` or more within ``edits`` edits, both stored.

    The first are links that join the same lines into classes as all pairs do, the second every
    line's number of near lines. With one edit neither they nor what is compared on the way
    outgrow the lines: see the module's text. With more edits, groups of more than ``group``
    lines are compared in full; only then do rows grow with the square of a group.
    """
    full = lines.filter(F.length("line") >= min_chars).select("line_id", "line")
    keyed = full.select("line_id", _letter_counts(F.col("line")).alias("letters"), F.explode(line_keys(edits)).alias("k")).select("k.key", "line_id", "letters", "k.code")
    # most keys belong to one line, and the copies of a line are no reason to keep its keys
    shared = keyed.groupBy("key").agg(F.min("line_id").alias("least"), F.max("line_id").alias("most"), F.min(F.col("code") % 2).alias("code")).filter("least < most and code = 0").select("key")
    keys = stored(shared, "line-keys")
    members = stored(keyed.join(keys, "key").distinct(), "line-members")
    discard(keys)
    sized = _sized(members)
    discard(members)
    groups = [sized]
    limit = group if edits == 1 else 1 << 62
    met, stars, longer = [_met(sized.filter(F.col("n") <= limit), edits)], [], []
    hot = sized.filter(F.col("n") > limit)
    if not hot.isEmpty():
        texts = stored(full.join(hot.select("line_id").distinct(), "line_id", "left_semi").distinct(), "line-texts")
        now = _windows(hot, texts)
        while True:
            sized = _sized(_halved(now))
            groups.append(sized)
            met.append(_met(sized.filter(F.col("n") <= limit), edits))
            crowded = sized.filter(F.col("n") > limit)
            one = F.length("rest") - F.col("code") <= 1
            stars.append(crowded.filter(one & (F.col("code") == 0)).select("key", "line_id"))
            longer.append(crowded.filter(one & (F.col("code") == 1)).select("line_id", "at"))
            now = crowded.filter(~one)
            if now.isEmpty():
                break
    pairs = stored(_union(met).distinct(), "line-pairs")
    wanted = pairs.select(F.col("a").alias("line_id")).union(pairs.select("b")).distinct()
    if not stars:  # else the longer lines and the stars still read them
        discard(groups.pop())
    texts_of = stored(full.join(wanted, "line_id", "left_semi").distinct(), "line-texts")
    both = pairs.join(texts_of.select(F.col("line_id").alias("a"), F.col("line").alias("ta")), "a").join(texts_of.select(F.col("line_id").alias("b"), F.col("line").alias("tb")), "b")
    near = both.filter(banded_distance(F.col("ta"), F.col("tb"), edits) <= edits).select("a", "b")
    if not stars:
        links = stored(near, "line-links")
        for t in (pairs, texts_of):
            discard(t)
        return links, links.select(F.explode(F.array("a", "b")).alias("line_id")).groupBy("line_id").agg(F.count("*").alias("links"))
    # where the others agree on all else, a line a character longer can be one of two of them and that character
    without = _union(longer).distinct().join(texts, "line_id").withColumn("i", F.explode(F.array(F.col("at"), F.col("at") + 1)))
    shorter = without.select(F.col("line_id").alias("b"), F.xxhash64(F.concat(F.substring("line", F.lit(1), F.col("i")), F.substring(F.col("line"), F.col("i") + 2, F.length("line")))).alias("a")).distinct()
    known = shorter.join(texts.select(F.col("line_id").alias("a")), "a").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = stored(near.union(known).distinct(), "line-links")
    star = stored(_union(stars), "line-stars")
    for t in (*groups, texts, pairs, texts_of):
        discard(t)
    root = stored(star.groupBy("key").agg(F.min("line_id").alias("root"), (F.count("*") - 1).alias("others")), "line-roots")
    stood = stored(star.join(root, "key"), "line-stars")
    for t in (star, root):
        discard(t)
    edges = links.union(stood.filter("line_id <> root").select(F.col("line_id").alias("a"), F.col("root").alias("b")))
    degrees = links.select(F.explode(F.array("a", "b")).alias("line_id"), F.lit(1).cast("long").alias("n")).union(stood.select("line_id", "others"))
    return stored(edges, "line-edges"), degrees.groupBy("line_id").agg(F.sum("n").alias("links"))


def line_classes(lines: DataFrame, places: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, group: int = GROUP) -> DataFrame:
    """(line_id, class_id, own, n, first_doc, links) of every line that recurs: equal or linked lines, in any document.

    ``places`` are the (doc_id, row, pos, line_id) of ``lines``, without the texts.

    class_id is the smallest line_id of the class; own counts the line's occurrences, n the class's,
    first_doc is its smallest doc_id, links the line's own links to different lines.
    """
    links, degree = line_links(lines, edits, min_chars, group)
    named = connected_components(links).select(F.col("node").alias("line_id"), F.col("component").alias("class_id"))
    counts = places.groupBy("line_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    found = stored(counts.join(named, "line_id", "left").join(degree, "line_id", "left").filter("n > 1 or class_id is not null").select("line_id", F.coalesce("class_id", "line_id").alias("class_id"), "n", "first_doc", F.coalesce("links", F.lit(0)).cast("long").alias("links")), "line-classes")
    whole = found.groupBy("class_id").agg(F.sum("n").alias("n"), F.min("first_doc").alias("first_doc"))
    classes = stored(found.select("line_id", "class_id", "links", F.col("n").alias("own")).join(whole, "class_id"), "line-classes")
    for t in (links, found):
        discard(t)
    return classes


def repeated_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, group: int = GROUP) -> DataFrame:
    """(doc_id, row, class_id, n, places, removed, links): a row per document and recurring line class.

    ``row`` is a hash of the text. ``places`` are the class's line numbers in the document (from 0,
    ascending), ``removed`` those that repeat an earlier one: all but the first in the class's first
    document, all elsewhere. Lines without a word don't count; lines under ``min_chars`` recur only
    as equals. Rows with a null id are left out (they have no order). Rows that share an id and a
    text are one document; with different texts they are equally early, so a line of both stays in
    both. Null and empty texts have no lines. Only doc_id and text are read.
    """
    lines = document_lines(docs.filter("doc_id is not null"))
    places = stored(lines.select("doc_id", "row", "pos", "line_id"), "line-places")
    found = salted_join(places, line_classes(lines, places, edits, min_chars, group), "line_id", "own", "doc_id")
    by_class = found.groupBy("doc_id", "row", "class_id").agg(F.sort_array(F.collect_set("pos")).alias("places"), F.max("n").alias("n"), F.min("first_doc").alias("first_doc"), F.sum("links").alias("links"))
    removed = F.when(F.col("doc_id") == F.col("first_doc"), F.filter("places", lambda p, i: i > 0)).otherwise(F.col("places"))
    return by_class.select("doc_id", "row", "class_id", "n", "places", removed.alias("removed"), "links")


def without_repeated_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, group: int = GROUP) -> DataFrame:
    """``docs`` (all columns) without lines that repeat an earlier document's or their own.

    n_chars follows the text where it is there. A document left without a word by this goes; others
    stay, null ids and texts as they are. Columns may have any names. A text of many lines takes
    time in proportion to them.
    """
    gone, row, kept = (unused(docs, x) for x in ("gone", "row", "kept"))
    by_doc = repeated_lines(docs.select("doc_id", "text"), edits, min_chars, group).groupBy("doc_id", F.col("row").alias(row)).agg(F.flatten(F.collect_list("removed")).alias(gone)).filter(F.size(gone) > 0)
    joined = docs.withColumn(row, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).join(by_doc, ["doc_id", row], "left")
    # an element that a lambda names is computed once; array_except keeps the order and looks places up in a hash set
    left = lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(gone)), lambda i: F.get(ls, i))
    text = F.get(F.transform(F.array(F.split("text", "\n")), lambda ls: F.array_join(left(ls), "\n")), 0)
    out = joined.withColumn(kept, F.when(F.col(gone).isNotNull() & F.col("text").isNotNull(), text).otherwise(F.col("text")))
    out = out.filter(F.col(gone).isNull() | F.col("text").isNull() | (F.length(F.translate(kept, " \t\n\x0b\f\r", "")) > 0))
    columns = {"text": F.col(kept)}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col(gone).isNotNull(), F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    from shelfwise.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeated_lines(docs)
    lines = document_lines(docs).groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    by_doc = found.groupBy("doc_id").agg(F.sum(F.size("places")).alias("n_recurring"), F.sum(F.size("removed")).alias("n_removed"), F.sum("links").alias("n_links"), F.array_join(F.sort_array(F.collect_set(F.hex("class_id"))), ",").alias("line_classes"))
    joined = docs.select("doc_id").join(lines, "doc_id", "left").join(by_doc, "doc_id", "left")
    return joined.select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_lines", "n_recurring", "n_removed", "n_links")], F.coalesce("line_classes", F.lit("")).alias("line_classes"))
