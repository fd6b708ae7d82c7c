"""The registered queries op11, op12 and op13 against plain versions, and their operators on odd rows."""

import hashlib
import random
import re
import zlib

import pytest

from shelfwise.llm import jaccard_join as J
from shelfwise.llm import queries
from shelfwise.llm import runs as R
from shelfwise.llm.fim import fim_pieces, fim_texts

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, folder=DATA):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def written(spark, tmp_path, rows):
    """A folder with a documents table of these (doc_id, text), and columns whose names the operators use themselves."""
    full = [(i, t, None, None, None, 1, b"x") for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, piece long, node binary").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


# ---- op11


def shingles(text, k=3):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def jaccard_plain(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                top[x] = y
    least = {}
    for i, (own, _) in enumerate(rows):
        if own is not None:
            least[root(i)] = min(own, least.get(root(i), own))
    return sorted(((own, len(sets[i]), own if not sets[i] else least.get(root(i))) for i, (own, _) in enumerate(rows)), key=repr)


def edited(rng, words, share):
    return [rng.choice(["neu", "vier", "alt"]) + str(rng.randint(0, 99)) if rng.random() < share else w for w in words]


def near_copies(rng, n=240):
    """Chains and groups of near copies at all degrees, with a passage that most texts share, and odd texts."""
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for _ in range(n // 8):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        if rng.random() < 0.6:
            base += passage
        for _ in range(rng.choice([1, 1, 4, 12])):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.03]))))
    rows += [None, "", " \t\n", "One", "one", "one two", "ONE\x0btwo", "one two three", "é É x", "é é x", "\xa0", "\xa0"]
    return list(enumerate(rows, 5)) + [(None, rows[0]), (None, None), (None, "nur hier zu sehen"), (5, rows[1]), (6, rows[1])]


@pytest.mark.parametrize("part_limit", [512, 4])
def test_jaccard_classes_equal_brute_force(spark, part_limit):
    rows = near_copies(random.Random(part_limit))
    found = J.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), part_limit=part_limit)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == jaccard_plain(rows)


def test_op11_on_the_table(spark):
    found = queries.QUERIES["op11_jaccard_join"](spark, DATA)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == jaccard_plain(documents(spark))


def test_divide_skip_equals_counting():
    rng = random.Random(3)
    for _ in range(300):
        index, sets = J.InvertedLists(), []
        for _ in range(rng.randint(0, 40)):
            s = rng.sample(range(rng.choice([12, 60])), rng.randint(1, 12))
            sets.append(s)
            index.add(s)
        asked = rng.sample(range(60), rng.randint(1, 14))
        least = rng.randint(1, len(asked))
        want = [(i, n) for i, s in enumerate(sets) if (n := len(set(s) & set(asked))) >= least]
        assert list(index.occurring(asked, least)) == want


def test_a_thousand_near_copies_are_split_and_stay_one_class(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(1000):
        words = list(base)
        words[rng.randint(0, 89)] = f"x{rng.randint(0, 9999)}"
        rows.append((i, " ".join(words)))
    found = J.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), part_limit=100)
    assert {r["component_id"] for r in found.collect()} == {0}


# ---- op12


def runs_plain(words):
    n, whole = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                whole.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in whole.items()), key=lambda r: (r[0], r[2]))


def op12_plain(own, text):
    words, h = WORD.findall(text or ""), zlib.crc32(str(own).encode())
    n, g = len(words), zlib.crc32(str(own).encode()) // 10
    if own is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_plain(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (own, len(runs), *shown, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def patterned(rng):
    words = []
    for _ in range(rng.randint(0, 5)):
        kinds = rng.choice([1, 2, 3, 40])
        if rng.random() < 0.5:
            words += [str(rng.randrange(kinds)) for _ in range(rng.randint(0, 40))]
        else:
            block = [str(rng.randrange(kinds)) for _ in range(rng.randint(1, 60))]
            words += (block * rng.randint(2, 9))[: rng.randint(1, 500)]
    return words


def test_runs_equal_brute_force():
    rng, n = random.Random(12), 0
    for _ in range(150):
        texts = [patterned(rng) for _ in range(rng.randint(1, 10))]
        for words, (_, found) in zip(texts, R.word_runs([" ".join(w) for w in texts]), strict=True):
            assert found == runs_plain(words)
            n += len(found)
    assert n > 1000


def test_long_periods_are_found():
    rng = random.Random(2)
    block = [str(rng.randrange(10**6)) for _ in range(3000)]
    words = ["a", *block * 4, "b", *["c", "d"] * 3000]
    [(_, found)] = R.word_runs([" ".join(words)])
    assert found == [(1, 12000, 3000), (12002, 6000, 2)]


def test_synchronising_set_is_consistent_and_dense():
    import numpy as np

    rng = np.random.default_rng(4)
    half = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    for scale in (4, 8, 16):
        windows = np.array([hash(tuple(x)) & (1 << 63) - 1 for x in np.lib.stride_tricks.sliding_window_view(np.concatenate((half, half)), scale).tolist()], dtype=np.uint64)
        at = R.synchronising(windows, scale, np.zeros(len(windows), dtype=bool))
        assert max(np.diff(at)) <= scale
        first = {x for x in at.tolist() if x + 2 * scale <= 400}
        assert {x + 400 for x in first} == {x for x in at.tolist() if 400 <= x and x + 2 * scale <= 800}


def test_op12_on_the_table(spark):
    found = queries.QUERIES["op12_periodic_runs"](spark, DATA)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in found.dtypes] == ["bigint"] * 6 + ["string"] * 2
    want = sorted(op12_plain(*r) for r in documents(spark))
    assert sorted(tuple(r) for r in found.collect()) == want
    assert sum(r[1] > 0 for r in want) > 5


def test_op12_on_odd_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(patterned(rng))) for i in range(300)] + [(None, "a " * 9), (7, None), (8, ""), (9, " \t"), (9, " \t"), (30, "x" * 100_000), (-4, "\xa0 \xa0 \xa0 \xa0 \xa0 \xa0")]
    found = queries.QUERIES["op12_periodic_runs"](spark, written(spark, tmp_path, rows))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted((op12_plain(*r) for r in rows), key=repr)


# ---- op13


def op13_plain(own, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if own is None else own}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (own, n, "plain", None, None, sha(text), sha(text)), text
    spm = h4 % 100 < 20
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (own, n, "spm" if spm else "psm", len(prefix), len(middle), sha(output), sha(text)), output


def odd_texts(rng):
    rows = [(i, "".join(rng.choice("aB c.\n<>é猫😀PSM") for _ in range(rng.choice([0, 1, 5, 40, 3000])))) for i in range(300)]
    long = "".join(rng.choice(["wort ", "Satz. ", "😀", "猫"]) for _ in range(60_000))
    return rows + [(None, "ohne Nummer <"), (4, None), (5, ""), (5, ""), (400, long), (400, long), (401, "z" * 50_000), (402, "a<P>b"), (403, "<P><S><M>"), (-3, "minus drei"), (400, "other text of that id")]


def test_op13_on_odd_rows(spark, tmp_path):
    rows = odd_texts(random.Random(6))
    found = queries.QUERIES["op13_fill_in_middle"](spark, written(spark, tmp_path, rows))
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted((op13_plain(*r)[0] for r in rows), key=repr)


def test_op13_on_the_table(spark):
    found = queries.QUERIES["op13_fill_in_middle"](spark, DATA)
    want = sorted(op13_plain(*r)[0] for r in documents(spark))
    assert sorted(tuple(r) for r in found.collect()) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_transformed_texts_are_whole(spark):
    rows = odd_texts(random.Random(9))
    found = fim_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r["doc_id"], r["output"]) if r["doc_id"] is not None else (-1, r["output"]) for r in found.collect()) == sorted((-1 if i is None else i, op13_plain(i, t)[1]) for i, t in rows)


def test_no_piece_is_longer_than_a_unit_asks(spark):
    text = "a bc " * 20_000
    pieces = fim_pieces(spark.createDataFrame([(2, text)], "doc_id long, text string")).collect()
    assert max(len(r["piece"]) for r in pieces) <= 4096 + 2


@pytest.mark.parametrize("name", ["op11_jaccard_join", "op12_periodic_runs", "op13_fill_in_middle"])
def test_empty_table(spark, tmp_path, name):
    assert queries.QUERIES[name](spark, written(spark, tmp_path, [])).collect() == []


# ---- op8


def test_sample_of_ten_billion_rows_does_not_overflow(spark):
    from pyspark.sql import functions as F

    from shelfwise.llm.langid import in_sample

    orders = spark.createDataFrame([(0,), (10**4,), ((1 << 40) - 1,)], "h long")
    assert [r[0] for r in orders.select(in_sample(F.col("h"), F.lit(10**10), 384)).collect()] == [True, True, False]


def test_language_of_letters_only_and_of_clashing_columns(spark):
    from shelfwise.llm.langid import fit_dictionaries, identify

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(1, "\u00b2 \u00bd \u2460 \u2167 12"), (2, "\u00e9"), (3, None), (4, "the and with that which from ")]
    asked = spark.createDataFrame([(*r, 7.5, "x", True) for r in rows], "doc_id long, text string, score double, Lang_Pred string, rejected boolean")
    found = {r["doc_id"]: r for r in identify(asked, fit_dictionaries(docs)).collect()}
    assert [found[i]["lang_pred"] == "und" for i in (1, 2, 3, 4)] == [True, False, True, False]
    assert all(0 <= r["score"] <= 1 for r in found.values()) and len(found[1]) == 5
    assert identify(asked.limit(0), {}).count() == 0


def test_a_repeated_run_is_referred_to_at_its_first_place(spark):
    """The reference holds a run of 45 words three times: every call, however the rows lie, points at the first."""
    from shelfwise.llm.substring_dedup import repeated_passages

    words = [f"w{i}" for i in range(45)]
    filler = lambda n, m: [f"{n}{i}" for i in range(m)]
    rows = [(1, [*filler("a", 30), *words, *filler("b", 9), *words, *filler("c", 60), *words]), (0, words[:22] + filler("d", 50)), (2, [*filler("e", 20), *words, *filler("f", 70), *words]), (3, words)]
    rows += [(10 + i, filler(f"z{i}x", 60)) for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    columns = ["doc_id", "start", "end", "ref_id", "ref_start", "ref_end", "edits"]
    calls = [sorted(tuple(r) for r in repeated_passages(docs.repartition(n, order)).select(*columns).collect()) for n, order in ((1, "doc_id"), (7, "text"), (3, "doc_id"))]
    assert calls[0] == calls[1] == calls[2]
    assert [(r[1], r[2], r[4]) for r in calls[0] if r[0] == 3 and r[3] == 1] == [(0, 45, 30)]
