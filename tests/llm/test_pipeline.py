"""Each stage of the corpus pipeline against a brute-force version, on its predecessor's output."""

import itertools
import math
import re
from collections import Counter

import pytest
import xxhash

import corpus_pipeline
from shelfwise.llm import quality_rules as Q
from tests_llm_helpers import crc, ids_of, within_one_edit

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before and after every stage, as dictionaries by id (the last stage's rows as they are)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        columns = docs.columns
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if i < 4:
            assert docs.columns == columns
            rows = docs.collect()
            assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] != found[0][r["doc_id"]])
            found.append({r["doc_id"]: r["text"] for r in rows})
    return [*found, docs.collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_quality_stage(spark, stages):
    before, after = stages[0], stages[1]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = {(good, part): {r[0] for r in Q.labelled_ids(labels, good)[part].collect()} for good in (True, False) for part in (0, 1)}

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def grams(tokens):
        one = [xxhash.xxh64_intdigest(t.encode(), 42) for t in tokens]
        two = [xxhash.xxh64_intdigest(b.encode(), h) for h, b in zip(one, tokens[1:], strict=False)]
        return [signed(h) % Q.BUCKETS for h in one + two]

    of = {k: grams(words(t)) for k, t in before.items()}
    raw, trusted = Counter(), Counter()
    for k, g in of.items():
        raw.update(g)
        if k in ids[True, 0]:
            trusted.update(g)
    n_raw, n_trusted = raw.total() + Q.BUCKETS, trusted.total()
    weight = {b: math.log((1 - Q.MIX) * trusted[b] / n_trusted / ((n + 1) / n_raw) + Q.MIX) for b, n in raw.items()}
    score = {k: sum(weight[b] for b in of[k]) / len(of[k]) for k in before if of[k]}
    good, bad = ([score[k] for k in ids[g, 1] if k in score and len(words(before[k])) >= 50] for g in (True, False))
    cuts = [-math.inf, *((a + b) / 2 for a, b in itertools.pairwise(sorted(good + bad)))]
    loss = [sum(s < c for s in good) / len(good) + sum(s >= c for s in bad) / len(bad) for c in cuts]
    least = cuts[min(range(len(cuts)), key=lambda i: (round(loss[i], 9), i))]
    kept = set()
    for k, t in before.items():
        w = words(t)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = Counter(windows)
        repeated = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 3)}
        if len(w) >= 50 and 100 * len(repeated) <= 50 * len(w) and score[k] >= least:
            kept.add(k)
    assert set(after) == kept and all(after[k] == before[k] for k in kept)


def test_line_stage(stages):
    before, after = stages[1], stages[2]
    lines = {x for t in before.values() for x in t.split("\n") if words(x)}
    top = {x: x for x in lines}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    by_size = {}
    for x in lines:
        if len(x) >= 20:
            by_size.setdefault(len(x), []).append(x)
    for n, xs in by_size.items():
        for a, b in [*itertools.combinations(xs, 2), *itertools.product(xs, by_size.get(n + 1, []))]:
            if within_one_edit(a, b):
                top[root(a)] = root(b)
    seen, want = set(), {}
    for k in sorted(before):
        kept, cut = [], False
        for x in before[k].split("\n"):
            if words(x) and root(x) in seen:
                cut = True
            else:
                kept.append(x)
                if words(x):
                    seen.add(root(x))
        text = "\n".join(kept)
        if not cut or words(text):
            want[k] = text if cut else before[k]
    assert after == want


def test_near_stage(stages):
    before, after = stages[2], stages[3]
    sets = {}
    for k, t in before.items():
        w = [x.encode().lower() for x in words(t)]
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    top = {k: k for k in before}
    for _ in range(3):
        for a, b in itertools.combinations(sorted(before), 2):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                top[a] = top[b] = min(top[a], top[b])
    assert after == {k: t for k, t in before.items() if top[k] == k}


def test_passage_stage(stages):
    """Every run of 50 words or more that two documents share is cut from the later one; nothing unshared goes."""
    before, after = stages[3], stages[4]
    run = 50

    def runs(texts):
        found = {}
        for k, t in texts.items():
            w = [x.encode().lower() for x in words(t)]
            for i in range(len(w) - run + 1):
                found.setdefault(tuple(w[i : i + run]), set()).add(k)
        return {r: ks for r, ks in found.items() if len(ks) > 1}

    assert not runs(after)
    shared = {k for ks in runs(before).values() for k in ks}
    five = Counter()
    for t in before.values():
        w = [x.encode().lower() for x in words(t)]
        five.update({tuple(w[i : i + 6]) for i in range(len(w) - 5)})
    for k, t in before.items():
        w = [x.encode().lower() for x in words(t)]
        if k not in shared and not any(five[tuple(w[i : i + 6])] > 1 for i in range(len(w) - 5)):
            assert after[k] == t


def test_packing_stage(stages):
    before, rows = stages[4], stages[5]
    want = Counter()
    for k, t in before.items():
        ids = ids_of(t)
        want.update((k, s, len(ids[s : s + 2048]), crc(ids[s : s + 2048]), len(ids)) for s in range(0, len(ids), 2048))
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        ends = list(itertools.accumulate(n for _, n in sorted(parts)))
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_run_returns_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "start", "ids_crc32").collect()
    assert Counter(got) == Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in stages[5])


LONG = "".join(f"word{i % 977} {i * 7919 % 10_007} other{i % 31}\n" for i in range(20_000))
A, B = (" ".join(f"{c}{i * 37 % 4001}x of the" for i in range(40)) for c in "ab")
EDGES = [(1, A), (2, None), (3, ""), (4, " \n\t"), (5, A), (6, B), (6, A + " more"), (6, A + " more"), (7, LONG), (None, A), (None, B), (None, None), (8, "short")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, very long and repeated texts, repeated ids, and columns named as helpers are."""
    names = ("kept", "row", "_removed", "_ranges", "ranges", "Score", "line_id", "component_id")
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"`{n}` int" for n in names)
    return spark.createDataFrame([(k, t, None if t is None else len(t), *range(len(names))) for k, t in EDGES], schema)


def rows_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


@pytest.mark.parametrize("i", range(5))
def test_stages_on_odd_rows(spark, odd, i):
    stage = corpus_pipeline.STAGES[i][1]
    got = stage(spark, odd, SF)
    assert stage(spark, odd.limit(0), SF).count() == 0
    before = Counter(EDGES)
    if i < 4:
        assert got.columns == odd.columns
        rows = got.collect()
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) and tuple(r)[3:] == tuple(range(8)) for r in rows)
    if i == 0:  # by their own texts: those of 50 words or more that don't repeat themselves, whatever the id
        assert rows_of(got) <= before and set(rows_of(got)) <= {x for x in before if x[1] in (A, B, A + " more", LONG)}
        kept = rows_of(got)
        assert all(kept[x] in (0, before[x]) for x in before) and len({kept[k, A] > 0 for k in (1, 5, None)}) == 1
    if i == 1:  # document 1 has A first, document 6 has B (rows of one id are equally early); null ids stay
        after = rows_of(got)
        assert after[1, A] == 1 and not any(k == 5 for k, _ in after) and after[6, B] == 1 and after[6, A + " more"] == 2
        assert after[None, A] == after[None, B] == after[None, None] == after[2, None] == after[3, ""] == after[8, "short"] == 1
        assert after[4, " \n\t"] == 1 and sum(1 for k, _ in after if k == 7) == 1
    if i == 2:
        assert rows_of(got) == before - Counter([(5, A), (6, A + " more"), (6, A + " more")])
    if i == 3:
        after = rows_of(got)
        assert not any(k == 5 for k, _ in after) and after[None, A] == after[None, B] == after[2, None] == after[1, A] == after[7, LONG] == 1
        assert sum(n for (k, _), n in after.items() if k == 6) in (1, 3)  # B stays; A with a word more is cut if its hash is smaller
    if i == 4:
        pieces = got.collect()
        assert Counter(r["doc_id"] for r in pieces if r["start"] == 0) == Counter(k for k, _ in EDGES)
        assert sum(r["length"] for r in pieces) == sum(len(ids_of(t)) for _, t in EDGES)


def test_a_stored_step_leaves_its_result_alone(spark):
    import os

    from shelfwise.llm.common import stored, stored_step

    before, on_the_way = stored(spark.range(5), "before"), []

    def step():
        on_the_way.append(stored(before.filter("id > 1"), "inner"))
        return on_the_way[0].join(before, "id")

    found = stored_step(step, "outer")
    at = lambda df: os.path.exists(df._stored_at.removeprefix("file:"))
    assert sorted(r["id"] for r in found.collect()) == [2, 3, 4]
    assert at(found) and at(before) and not at(on_the_way[0])
