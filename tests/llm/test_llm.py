"""Training-data operators against brute force, round trips and edge rows."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfwise.llm import cotraining, encoder, gif, langid, line_dedup, packing, pieces, quality_rules, simhash, sstable, substring_dedup
from shelfwise.llm.components import connected_components
from tests_llm_helpers import within_one_edit

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
OTHERS = [public_tokenizers.path("byte_bpe_50k.json")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", None, 4), (4, "one", "de", "s", 3), (5, "same text here", "en", "s", 14), (5, "same text here", "en", "s", 14), (6, "Same  TEXT here", "en", "s", 15), (None, "lost id", "en", "s", 7), (7, "é日本 <|endoftext|> a" * 400, "fr", "s", 8000)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def ids_of(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(1, 1), (None, 2)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: top(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_encoder_equals_the_tokenizer(texts):
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(WORDS), encoder.WordEncoder(WORDS, 50)  # a cache that overflows all the time
    odd = ["", "<|endoftext|> A<|EndOfText|>b", "É'S don't 3a½ \x85x\xa0y İstanbul Σας ́a", "a\x00b <|startoftext|>z", "日本語 １２", "'s'sx''ll -- §¶ [x]' ÀÉ×÷", "é É"]
    for t in [*list(texts.values())[:80], *odd]:
        assert own.ids(t).tolist() == whole.encode(t, add_special_tokens=False).ids, t[:50]


def test_other_tokenizers_are_used_whole(texts):
    from tokenizers import Tokenizer

    for path in OTHERS:
        encoder, plain = encoder_of(path), Tokenizer.from_file(path)
        assert not encoder.by_words
        for t in [*list(texts.values())[:20], None, "", "a  b\n\tc <|endoftext|>"]:
            assert encoder.ids(t).tolist() == plain.encode(t or "", add_special_tokens=False).ids
    assert encoder_of(WORDS).by_words


def encoder_of(path):
    return encoder.WordEncoder.of(path)


def test_placing_rows_with_clashing_names(spark):
    pieces = spark.createDataFrame([(i, 0, 1 + i % 7, "x", 1, 2) for i in range(40)], "doc_id long, start long, length long, `slice` string, `Row` int, rank int")
    rows = packing.place(pieces, 8).collect()
    assert len(rows) == 40 and all(r["slice"] == "x" and r["Row"] == 1 and r["rank"] == 2 for r in rows)
    used = Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 8
    with pytest.raises(ValueError, match="offset"):
        packing.place(pieces.withColumn("Offset", F.lit(1)), 8)


@pytest.mark.parametrize("which", ["docs", "edges"])
def test_packing(spark, request, which):
    table = request.getfixturevalue(which)
    got = packing.pack_documents(table, WORDS, length=256).collect()
    want = Counter()
    for r in table.select("doc_id", "text").collect():
        ids = ids_of(r["text"])
        want.update((r["doc_id"], s, len(ids[s : s + 256]), crc(ids[s : s + 256]), len(ids)) for s in range(0, len(ids), 256))
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        ends = list(itertools.accumulate([n for _, n in sorted(parts)]))
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 256
    if which == "docs":
        assert sum(r["length"] for r in got) > 0.97 * 256 * len(by)


def test_shortest_pack_first_holds_every_piece():
    rng = random.Random(1)
    for _ in range(200):
        size = rng.randrange(4, 40)
        histogram = {rng.randrange(1, size + 1): rng.randrange(1, 50) for _ in range(8)}
        packed = packing.shortest_pack_first(histogram, size)
        held = Counter()
        for pattern, n in packed:
            assert n > 0 and sum(pattern) <= size
            held.update({k: v * n for k, v in Counter(pattern).items()})
        assert held == histogram


def test_packing_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert packing.pack_documents(empty, WORDS).count() == 0


def test_simhash_against_brute_force(spark, docs, texts):
    def fp(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    want = {k: fp(t) for k, t in texts.items()}
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicate_classes(docs, shingle=3).collect()}
    assert {k: v[0] for k, v in got.items()} == want
    top = {k: k for k in want}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(want, 2):
            if (want[a] ^ want[b]).bit_count() <= 2 and top[a] != top[b]:
                top[a] = top[b] = min(top[a], top[b])
                changed = True
    assert {k: v[1] for k, v in got.items()} == top


def test_crowded_shards_are_divided_and_lose_no_link(spark):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(60)}
    fps |= {x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in list(fps)} | {x & ~0xFFFFF for x in fps} | {(x & ~0x3) for x in fps}
    keys = sorted(fps)
    rows = [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(keys)]
    links = {}
    for limit in (4096, 40, 3):
        found = simhash.fingerprint_links(spark.createDataFrame(rows, "id long, fp long"), 2, limit)
        links[limit] = {r["node"]: r["component"] for r in connected_components(found).collect()}
    assert links[4096] == links[40] == links[3] and links[3]
    near = {x for a, b in itertools.combinations(range(len(keys)), 2) if (keys[a] ^ keys[b]).bit_count() <= 2 for x in (a, b)}
    assert set(links[3]) == near


def test_simhash_edges(edges, spark):
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicate_classes(edges, shingle=3).collect()}
    assert got[1, 0] == got[2, 0] == got[3, 0] == 1
    assert {v for (k, _), v in got.items() if k in (5, 6)} == {5}
    assert simhash.near_duplicate_classes(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("limit", [512, 2])
def test_similar_classes(spark, docs, texts, edges, limit):
    sets = {k: set(simhash.shingle_hashes(t, 5).tolist()) for k, t in texts.items()}
    top = {k: k for k in sets}
    for _ in range(3):
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                top[a] = top[b] = min(top[a], top[b])
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_classes(docs, part_limit=limit).collect()}
    assert got == {k: v for k, v in top.items() if sets[k]}
    found = simhash.similar_classes(edges, part_limit=limit).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {4: 4, 5: 5, 6: 5, 7: 7}
    assert [r["doc_id"] for r in found if not r["first"]] == [6]


def test_crowded_near_copies_are_compared_part_by_part(spark):
    """Chains of near copies around two texts that share their bands, in parts of three: the same classes as all pairs give."""
    rng = random.Random(21)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base, rows = words(120), []
    for _ in range(40):
        text = list(base)
        for _ in range(rng.randrange(1, 5)):
            text[rng.randrange(len(text))] = words(1)[0]
        rows.append(text)
    for _ in range(12):  # far enough from most others, yet sharing bands with them
        rows.append([*base[: rng.randrange(60, 110)], *words(rng.randrange(5, 40))])
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string").repartition(5)
    sets = [set(simhash.shingle_hashes(" ".join(w), 5).tolist()) for w in rows]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = {min(c): c for c in classes_of(pairs)}
    got = {}
    for r in simhash.similar_classes(table, part_limit=3).collect():
        got.setdefault(r["component_id"], set()).add(r["doc_id"])
        assert r["first"] == (r["doc_id"] == r["component_id"])
    assert {k: frozenset(v) for k, v in got.items() if len(v) > 1} == want and len(pairs) > 100


def test_near_copies_with_repeated_ids_and_clashing_names(spark):
    rng = random.Random(22)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    rows = [(1, a), (5, a + " end"), (5, b), (5, b), (6, b + " end"), (7, c), (7, c + " end"), (None, a), (8, None), (9, " ")]
    table = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, `row` int, `Shard` string")
    kept = simhash.without_near_copies(table)
    assert kept.columns == table.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    seven = [x for x in got if x[0] == 7]
    assert len(seven) == 1 and got == Counter([(1, a), (5, b), (5, b), (None, a), (8, None), (9, " "), *seven])
    assert simhash.without_near_copies(table.limit(0)).count() == 0


def test_lzw_round_trip_and_refusals():
    rng = random.Random(4)
    cases = [b"", b"a", b"ab" * 9000, bytes(rng.randrange(256) for _ in range(30000)), b"\0" * 70000]
    for data in cases:
        assert gif.lzw_decode(gif.lzw_encode(data), 8) == data
    small = bytes(rng.randrange(4) for _ in range(5000))
    assert gif.lzw_decode(gif.lzw_encode(small, 2), 2) == small
    with pytest.raises(ValueError):
        gif.lzw_decode(b"\xff" * 20, 8)
    with pytest.raises(ValueError):
        list(gif.decode_gif(b"GIF89a" + b"\0" * 7 + b"\x2c"))


def image(left, top, w, h, samples, control=b"", flags=0, palette=b""):
    import struct

    return control + b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + palette + b"\x02" + b"".join(gif._blocks(gif.lzw_encode(bytes(samples), 2)))


def test_gif_palettes_disposal_transparency_interlace():
    import struct

    control = lambda disposal, delay, clear=None: b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), delay, clear or 0) + b"\0"
    colours = bytes([10, 0, 0, 20, 0, 0, 30, 0, 0, 40, 0, 0])
    other = bytes([99, 0, 0, 98, 0, 0, 97, 0, 0, 96, 0, 0])
    head = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + colours
    file = head + image(0, 0, 2, 2, [0, 1, 2, 3], control(1, 5)) + image(0, 0, 1, 1, [3], control(3, 6)) + image(1, 1, 1, 1, [2], control(2, 7, 1)) + image(0, 0, 2, 1, [1, 0], control(0, 8, 1), 0x81, other) + b"\x3b"
    frames = list(gif.decode_gif(file))
    assert [f.delay_ms for f in frames] == [50, 60, 70, 80]
    assert [f.rgb[:, :, 0].ravel().tolist() for f in frames] == [[10, 20, 30, 40], [40, 20, 30, 40], [10, 20, 30, 30], [10, 99, 30, 0]]
    assert frames[3].shown.ravel().tolist() == [True, True, True, False]
    rows = head[:6] + struct.pack("<HHBBB", 1, 8, 0x81, 0, 0) + colours
    laced = rows + image(0, 0, 1, 8, [0, 1, 2, 2, 3, 3, 3, 3], b"", 0x40) + b"\x3b"
    assert next(gif.decode_gif(laced)).indices.ravel().tolist() == [0, 3, 2, 3, 1, 3, 2, 3]


def test_gif_refuses_colours_beyond_the_palette():
    import struct

    head = b"GIF89a" + struct.pack("<HHBBB", 2, 1, 0x80, 0, 0) + bytes([10, 0, 0, 20, 0, 0])
    clear = b"\x21\xf9\x04" + struct.pack("<BHB", 1, 5, 3) + b"\0"
    assert next(gif.decode_gif(head + image(0, 0, 2, 1, [1, 3], clear) + b"\x3b")).shown.tolist() == [[True, False]]
    with pytest.raises(ValueError, match="beyond the palette"):
        next(gif.decode_gif(head + image(0, 0, 2, 1, [1, 3]) + b"\x3b"))


def test_media_columns(spark, edges):
    got = gif.media_digests(gif.store_texts(edges)).collect()
    assert len(got) == len(EDGES)
    want = {r[0]: (r[1] or "").encode() for r in EDGES}
    for r in got:
        raw = want[r["doc_id"]]
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        payload_counts = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16)
        assert len(r["frames"]) == r["n_frames"] and r["duration_ms"] == sum(f["delay_ms"] for f in r["frames"])
        assert sum(np.array(f["histogram"]) for f in r["frames"]).tolist() == payload_counts.tolist() * 3
    assert gif.media_digests(gif.store_texts(edges.limit(0))).count() == 0
    frames = gif.media_frames(gif.store_texts(edges).withColumnRenamed("media", "m"), media_col="m").collect()
    assert sum(1 for r in frames if r["doc_id"] == 7) == -(-len(want[7]) // (192 * 256)) and all(sum(r["histogram"]) == 3 * r["width"] * r["height"] for r in frames)
    bad = spark.createDataFrame([(1, b"no"), (2, None)], "doc_id long, media binary")
    assert [(r["doc_id"], r["error"]) for r in gif.media_frames(bad).collect()] == [(1, "not a GIF")]


def test_quality_counts_against_brute_force(spark, docs, texts, edges):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for table in (docs, edges):
        plain = [(r["doc_id"], r["text"]) for r in table.collect()]
        want = Counter()
        for k, t in plain:
            words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
            windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
            often = Counter(windows)
            covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
            lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
            want[k, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered), failed] += 1
        got = quality_rules.quality_rules(table, labels).collect()
        assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
        assert not any(r["kept"] for r in got if r["base_failed"])


def test_quality_verdicts_agree_with_labels(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_rules.quality_rules(docs, labels).join(labels, "doc_id").filter("not base_failed").collect()
    assert all(r["kept"] == (r["quality"] == 1) for r in got)
    assert all(r["score"] == 0 for r in quality_rules.quality_rules(docs, labels.limit(0)).collect())
    assert quality_rules.quality_rules(docs.limit(0), labels).count() == 0


def test_language_held_out_accuracy(spark, edges):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fit = langid.fit_dictionaries(docs.filter(~langid.held_out(F.col("doc_id"))))
    got = langid.identify(docs, fit).filter(langid.held_out(F.col("doc_id")) & (F.length("text") > 40)).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.97 * len(got)
    odd = {(r["doc_id"], r["text"]): r for r in langid.identify(edges, fit).collect()}
    assert [odd[k, t]["lang_pred"] for k, t in ((1, None), (2, ""), (3, " \n\t "))] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in odd.values()) and odd[4, "one"]["lang_pred"] in fit
    assert {r["lang_pred"] for r in langid.identify(edges, {}).collect()} == {"und"}


def test_language_sizes_against_brute_force(spark, docs):
    """The prediction is the dictionary with the smallest code of the whole text, made by plain calls of the library."""
    import zstandard as z

    fit = langid.fit_dictionaries(docs, sample_docs=20, sample_bytes=300)
    how = z.ZstdCompressionParameters(window_log=21, chain_log=17, hash_log=17, search_log=5, min_match=3, target_length=16, strategy=z.STRATEGY_LAZY2, write_content_size=False)
    rows = langid.identify(docs.withColumns({"score": F.lit("x"), "rejected": F.lit("y")}), fit).collect()
    assert len(rows) == docs.count() and len(fit) == 4
    for r in rows:
        raw = b" " + langid.letters(r["text"]) + b" "
        sizes = {}
        for lang, sample in fit.items():
            one = z.ZstdCompressor(dict_data=z.ZstdCompressionDict(sample, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=how)
            sizes[lang] = sum(len(one.compress(raw[i : i + langid.BLOCK])) for i in range(0, len(raw), langid.BLOCK))
        least, second = sorted(sizes.values())[:2]
        assert r["lang_pred"] == min(sizes, key=lambda x: (sizes[x], x))
        assert r["rejected"] == (round(second / least - 1, 6) < langid.MIN_MARGIN)
    assert langid.identify(docs.limit(0), fit).count() == 0 and langid.fit_dictionaries(docs.limit(0)) == {}


def test_language_samples_come_from_whole_documents(spark):
    table = spark.createDataFrame([(i, "a" * 3000 + "b" * 3000 + "c" * 3000, f"l{i % 300}") for i in range(600)], "doc_id long, text string, lang string")
    fit = langid.fit_dictionaries(table, sample_docs=2, sample_bytes=500)
    assert len(fit) == 300 and {x for sample in fit.values() for x in sample.decode()} == {"a", "b", "c", " "}
    assert fit == langid.fit_dictionaries(table.repartition(5), sample_docs=2, sample_bytes=500)


def test_sampled_pieces_are_lossless_and_repeatable(spark, docs, edges):
    for table in (docs, edges):
        a = pieces.sample_encode(table.repartition(3), PIECES, seed=1)
        both = pieces.decode_ids(a, PIECES).collect()
        assert all(r["decoded"] == r["text"] for r in both)
        again = {(r["doc_id"], r["text"]): r["ids"] for r in pieces.sample_encode(table, PIECES, seed=1).collect()}
        assert all(again[r["doc_id"], r["text"]] == r["ids"] for r in both)
    other = {r["doc_id"]: r["ids"] for r in pieces.sample_encode(docs, PIECES, seed=2).collect()}
    assert any(other[r["doc_id"]] != r["ids"] for r in pieces.sample_encode(docs, PIECES, seed=1).collect())


@pytest.mark.parametrize("long", [256, 0])
def test_segmentations_come_in_proportion(long, monkeypatch):
    monkeypatch.setattr(pieces, "LONG", long)
    monkeypatch.setattr(pieces, "SLICE", 3)
    lattice = pieces.PieceLattice.of(PIECES)
    word, n = " then", 40000 if long else 15000

    def paths(s):
        if not s:
            yield (), 1.0
        for k in range(1, len(s) + 1):
            if s[:k] in lattice.weights:
                w, i = lattice.weights[s[:k]]
                for rest, p in paths(s[k:]):
                    yield (i, *rest), w * p

    share = dict(paths(word))
    whole = sum(share.values())
    got = Counter(tuple(x.tolist()) for x in lattice.sample([word] * n, [str(i) for i in range(n)], 3))
    assert set(got) <= set(share)
    for path, p in share.items():
        assert abs(got[path] / n - p / whole) < (0.01 if long else 0.016)


def test_long_and_odd_texts_in_the_lattice():
    lattice = pieces.PieceLattice.of(PIECES)
    odd = ["日" * 500 + "abc" * 300, "▁ ▁▁a  b\n\n <s>\x00\t y ", "", "   ", "é" * 3]
    for t, ids in zip(odd, lattice.sample(odd, list("abcde"), 5), strict=True):
        assert lattice.decode(ids).decode() == t


def test_a_million_characters_without_a_blank(spark):
    rng = random.Random(8)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABC012/+") for _ in range(1_000_000))
    chinese = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(20_000)) * 10
    table = spark.createDataFrame([(1, letters, "x"), (2, chinese, "x"), (3, letters[:300], "x"), (3, letters[:301], "x")], "doc_id long, text string, ids string").repartition(3)
    begin = time.monotonic()
    rows = pieces.sample_encode(table, PIECES, seed=2, decoded=True).collect()
    assert all(r["decoded"] == r["text"] and r["ids_crc32"] == crc(r["ids"]) for r in rows) and len(rows) == 4
    assert time.monotonic() - begin < 60
    again = {r["text"]: r["ids"] for r in pieces.sample_encode(table, PIECES, seed=2).collect()}
    assert all(again[r["text"]] == r["ids"] for r in rows)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last = [i]
        for j, y in enumerate(b, 1):
            last.append(min(row[j] + 1, last[-1] + 1, row[j - 1] + (x != y)))
        row = last
    return row[-1]


def test_edit_distance_and_chains():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in "ab")
        assert substring_dedup.edit_distance(a, b) == levenshtein(a, b)
    for _ in range(200):
        matches = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(rng.randrange(1, 12))})
        best = {}
        for a, b in matches:
            best[a, b] = max([1.0, *(1 + v - 0.05 * (a - x + b - y) for (x, y), v in best.items() if x < a and y < b)])
        found = substring_dedup.chain(matches, 0.05)
        value = len(found[0]) - 0.05 * sum(q[0] - p[0] + q[1] - p[1] for p, q in itertools.pairwise(found[0]))
        assert abs(value - max(best.values())) < 1e-9
        assert sorted(m for c in found for m in c) == matches


def test_repeated_passages(spark, edges):
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, clean = words(80), words(400)
    fuzzy = [w if i % 15 else "edited" for i, w in enumerate(passage)]
    rows = [(1, [*words(50), *passage, *words(50)]), (2, [*words(9), *passage, *words(90)]), (3, [*passage]), (4, [*words(30), *fuzzy, *words(30)]), (5, clean), (6, words(300)), (7, [*words(20), *passage[:30], *words(20)])]
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in rows] + [(8, None), (None, " ".join(passage)), (9, "")], "doc_id long, text string")
    found = substring_dedup.repeated_passages(table)
    got = {r["doc_id"]: r for r in found.collect()}
    assert set(got) == {2, 3, 4} and {r["ref_id"] for r in got.values()} == {1}
    assert (got[2]["start"], got[2]["end"], got[2]["ref_start"]) == (9, 89, 50) and (got[3]["start"], got[3]["end"]) == (0, 80)
    assert got[4]["end"] - got[4]["start"] >= 70 and got[4]["edits"] <= 6
    left = {r["doc_id"]: r["text"] for r in substring_dedup.cut_passages(table, found).collect()}
    assert 3 not in left and left[5] == " ".join(clean) and len(left[2].split()) == 99 and left[8] is None
    assert substring_dedup.repeated_passages(edges.limit(0)).count() == 0
    assert substring_dedup.repeated_passages(edges).filter("ref_id = doc_id").count() == 0


def test_repeated_passages_with_edits(spark):
    """Passages with words replaced at random are found, whole up to a few words, and nothing beside them."""
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, planted = [], {}
    for size, share in ((60, 0.1), (60, 0.15), (50, 0.05), (100, 0.15), (100, 0.2), (60, 0.2), (40, 0.1), (40, 0.2)):
        for _ in range(60):
            passage = words(size)
            edited = list(passage)
            for i in rng.sample(range(1, size - 1), round(share * size)):
                edited[i] = words(1)[0]
            rows += [(len(rows), [*words(60), *passage, *words(60)]), (len(rows) + 1, [*words(60), *edited, *words(60)])]
            planted[len(rows) - 1] = (size, share)
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    covered = dict.fromkeys(planted, 0)
    for r in substring_dedup.repeated_passages(table).collect():
        size, _ = planted[r["doc_id"]]
        assert r["ref_id"] == r["doc_id"] - 1 and 60 <= r["start"] and r["end"] <= 60 + size and r["edits"] <= 0.2 * size
        covered[r["doc_id"]] += r["end"] - r["start"]
    for (size, share), least in {(60, 0.1): 0.95, (60, 0.15): 0.95, (50, 0.05): 0.95, (100, 0.15): 0.95, (100, 0.2): 0.95, (60, 0.2): 0.9, (40, 0.1): 0.95, (40, 0.2): 0.5}.items():
        found = [covered[k] > 0 for k, v in planted.items() if v == (size, share)]
        assert sum(found) >= least * len(found), (size, share, sum(found))


def test_repeated_passages_that_repeat_themselves(spark):
    """A passage of one phrase over and over keeps its places, also where an earlier document has the phrase fewer times."""
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    phrase, single = words(9), ["again"] * 120
    loop = phrase * 12
    rows = [[*words(40), *phrase * 2, *words(40)], [*words(30), *loop, *words(50)], [*words(45), *loop, *words(20)], [*words(10), *single, *words(9)], [*words(33), *single, *words(8)]]
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string")
    covered = {}
    for r in substring_dedup.repeated_passages(table).collect():
        covered.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    assert len(covered[2] & set(range(45, 45 + len(loop)))) >= len(loop) - 10 and len(covered[4] & set(range(33, 153))) >= 110
    assert set(covered) == {2, 4}


@pytest.mark.parametrize("parts", [((0, 25), (25, 50)), ((0, 32), (18, 50)), ((0, 38), (8, 46), (12, 50))])
def test_repeated_passages_whose_parts_stand_earlier(spark, parts):
    """Two documents that share a passage meet although other, earlier documents hold parts of it that are too short."""
    rng = random.Random(13)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for _ in range(10):
        passage = words(50)
        rows += [[*words(50), *passage[s:e], *words(50)] for s, e in parts]
        rows += [[*words(20), *passage, *words(70)], [*words(60), *passage, *words(10)]]
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string")
    step = len(parts) + 2
    got = {(r["doc_id"], r["ref_id"]): (r["start"], r["end"]) for r in substring_dedup.repeated_passages(table).collect()}
    assert got == {(i * step + step - 1, i * step + step - 2): (60, 110) for i in range(10)}


def test_all_runs_of_forty_words_are_found(spark):
    """Every run of 43 words or more that an earlier document has is inside the rows' ranges, but for 3 words at its ends."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", r["text"].translate(low)) for r in docs.collect() if r["text"]}
    number = {}
    texts = {k: [number.setdefault(w, len(number)) for w in words] for k, words in plain.items()}
    first = {}
    covered = {}
    for r in substring_dedup.repeated_passages(docs).collect():
        assert r["ref_id"] < r["doc_id"] and r["end"] - r["start"] >= 40
        covered.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    runs = 0
    for k in sorted(texts):
        words, hit = texts[k], []
        for i in range(len(words) - 42):
            hit.append(first.setdefault(tuple(words[i : i + 43]), k) < k)
        i = 0
        while i < len(hit):
            if not hit[i]:
                i += 1
                continue
            j = i
            while j < len(hit) and hit[j]:
                j += 1
            runs += 1
            assert set(range(i + 3, j + 42 - 3)) <= covered.get(k, set()), (k, i, j + 42)
            i = j
    assert runs > 50


def test_passages_of_repeated_ids_and_clashing_names(spark):
    rng = random.Random(11)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    q = text(60)
    rows = [(1, text(20) + q), (2, q + text(30)), (2, text(10) + q), (3, text(25) + q), (3, text(5)), (4, q), (4, q), (None, q)]
    table = spark.createDataFrame([(i, " ".join(w), "x", 1) for i, w in rows], "doc_id long, text string, `_ranges` string, ranges int")
    found = substring_dedup.repeated_passages(table)
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted(tuple(r) for r in substring_dedup.repeated_passages(table.repartition(7)).collect())
    assert {r[0] for r in got} >= {2, 4} and all(r[3] == 1 for r in got)
    cut = substring_dedup.cut_passages(table, found)
    assert cut.columns == table.columns
    left = Counter((r["doc_id"], len(r["text"].split())) for r in cut.collect())
    # of both rows with id 2 (and 3) one is taken; both rows with id 4 are equal and go
    assert left[1, 80] == 1 and left[2, 30] + left[2, 10] == 1 and left[2, 90] + left[2, 70] == 1 and left[4, 60] == 0 and left[None, 60] == 1
    assert left[3, 5] == 1 and left[3, 85] + left[3, 25] == 1
    assert substring_dedup.cut_passages(table.limit(0), found).count() == 0


def test_parts_in_two_earlier_documents(spark):
    """Documents 3 and 4 share 76 words of which documents 1 and 2 each have a half."""
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    q = text(76)
    rows = [(1, text(100) + q[:38] + text(100)), (2, text(100) + q[38:] + text(100)), (3, text(50) + q + text(70)), (4, text(150) + q + text(20))]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert [tuple(r) for r in substring_dedup.repeated_passages(table).collect()] == [(4, 150, 226, 3, 50, 126, 0)]


def test_widened_against_whole_table():
    """Without band and drop, the end is where the best of all alignments of two beginnings ends."""
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(12))] for _ in "ab")
        got = substring_dedup.widened(a, b, band=30, drop=10**6, cost=2)
        value = {}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                steps = [0] if i == j == 0 else []
                steps += [value[i - 1, j] - 2] if i else []
                steps += [value[i, j - 1] - 2] if j else []
                steps += [value[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -2)] if i and j else []
                value[i, j] = max(steps)
        assert value[got] == max(value.values())


def test_similar_classes_with_unequal_repeats(spark):
    """Texts of one shingle set but for a few are alike however often one of them repeats a phrase."""
    rng = random.Random(14)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for n, size, times in [(300, 10, 20), (400, 5, 70)] * 15:
        text, phrase = words(n), words(size)
        rows += [text + phrase, text + phrase * times]
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_classes(table).collect()}
    assert got == {k: k - k % 2 for k in range(len(rows))}


def test_run_hashes_are_equal_for_equal_runs_only():
    rng = np.random.default_rng(4)
    flat = rng.integers(0, 1 << 64, 5000, dtype=np.uint64, endpoint=False)
    flat[4000:4060] = flat[7:67]
    at = np.arange(4960)
    found = substring_dedup.run_hashes(flat, at, 40)
    assert found.dtype == np.int64 and len(set(found.tolist())) == 4960 - 21
    assert found[4000:4021].tolist() == found[7:28].tolist()


def test_minimizers_cover_every_window():
    rng = np.random.default_rng(5)
    sizes = np.array([0, 3, 7, 40, 200, 6, 23])
    flat = rng.integers(0, 1 << 62, sizes.sum())
    row, place, seed = substring_dedup.minimizers(flat, sizes, 6, 16)
    for r, n in enumerate(sizes):
        places = sorted(place[row == r].tolist())
        if n >= 6:
            assert places and all(b - a <= 16 for a, b in itertools.pairwise([-1, *places, n - 5]))
        else:
            assert not places


def line_facts(table, edits, group):
    """The links in both directions as classes, and every line's number of links, by line."""
    all_lines = line_dedup.document_lines(table)
    names = {r["line_id"]: r["line"] for r in all_lines.collect()}
    edges, degrees = line_dedup.line_links(all_lines, edits, 20, group)
    rows = [(names[r["a"]], names[r["b"]]) for r in edges.collect()]
    return names.values(), classes_of(rows), {names[r["line_id"]]: r["links"] for r in degrees.collect()}, len(rows)


def classes_of(pairs):
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in pairs:
        top[root(a)] = root(b)
    found = {}
    for x in list(top):
        found.setdefault(root(x), set()).add(x)
    return {frozenset(c) for c in found.values()}


@pytest.mark.parametrize("edits, group", [(1, 64), (1, 1), (1, 3), (2, 64)])
def test_line_links_against_brute_force(spark, edits, group):
    rng = random.Random(edits)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(18, 40))) for _ in range(40)]
    lines = set(base) | {"", "short", "shorx"}
    for s in base:
        for _ in range(4):
            t = list(s)
            for _ in range(rng.randrange(1, 4)):
                kind, i = rng.randrange(3), rng.randrange(len(t))
                if kind == 0:
                    t.insert(i, rng.choice("abx"))
                elif kind == 1:
                    t[i] = rng.choice("abx")
                else:
                    del t[i]
            lines.add("".join(t))
    table = spark.createDataFrame([(i, x) for i, x in enumerate(sorted(lines))], "doc_id long, text string")
    names, got, degrees, _ = line_facts(table, edits, group)
    full = [x for x in names if len(x) >= 20]
    want = [(a, b) for a, b in itertools.combinations(full, 2) if levenshtein(a, b) <= edits]
    assert want and got == classes_of(want)
    assert degrees == Counter(x for pair in want for x in pair)


def test_crowded_lines_make_no_pairs(spark):
    """Lines that differ in one character, in one place or anywhere, with insertions: links in proportion to the lines."""
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh ") for _ in range(60))
    lines = {base[:30] + chr(0x400 + i) + base[31:] for i in range(300)}
    lines |= {base[:i] + c + base[i + 1 :] for i in range(60) for c in "xyz"} | {base[:i] + c + base[i:] for i in range(60) for c in "xy"} | {base[:i] + base[i + 1 :] for i in range(60)}
    lines |= {base[:40] + "".join(rng.choice("abcdefgh ") for _ in range(20)) for _ in range(200)}
    table = spark.createDataFrame([(i, x) for i, x in enumerate(sorted(lines))], "doc_id long, text string")
    names, got, degrees, n = line_facts(table, 1, 8)
    want = [(a, b) for a, b in itertools.combinations(names, 2) if within_one_edit(a, b)]
    assert got == classes_of(want) and degrees == Counter(x for pair in want for x in pair)
    assert len(want) > 45_000 and n < 12 * len(lines)


def test_many_lines_in_one_document(spark):
    lines = [f"line number {i} of very many in this one document, {i * 7919 % 100_003}" for i in range(100_000)]
    table = spark.createDataFrame([(1, "\n".join(lines[:10])), (2, "\n".join(lines))], "doc_id long, text string").repartition(2)
    begin = time.monotonic()
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_lines(table, min_chars=200).collect()}
    assert got[2] == "\n".join(lines[10:]) and time.monotonic() - begin < 150  # quadratic work took 350 s


def test_lines_of_repeated_ids_and_clashing_names(spark):
    """Rows that share an id lose their own lines only, and lines of both stay in both."""
    rows = [(1, "the first line of all\nkept here"), (2, "some words\nthe first line of all\nends so"), (2, "the first line of all\nother\nsome words"), (3, "ends so"), (3, "ends so"), (4, "not seen"), (4, "not seen")]
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, `gone` string, `Row` string, kept string")
    got = Counter((r["doc_id"], r["text"], r["gone"], r["Row"], r["kept"]) for r in line_dedup.without_repeated_lines(table).collect())
    want = [(1, rows[0][1]), (2, "some words\nends so"), (2, "other\nsome words"), (4, "not seen"), (4, "not seen")]
    assert got == Counter((*r, "x", "y", "z") for r in want)


def test_lines_without_repeats(spark):
    long = "this line stands in many documents, word for word"
    rows = [(1, f"{long}\nonly here\n{long}"), (2, f"{long[:-1]}s\nother words\n\nok"), (3, long), (4, "ok\nonly here!"), (5, None), (6, ""), (None, long), (7, " \n ")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, line string")
    got = {(r["doc_id"], r["text"]) for r in line_dedup.without_repeated_lines(table).collect()}
    assert got == {(1, f"{long}\nonly here"), (2, "other words\n\nok"), (4, "only here!"), (5, None), (6, ""), (None, long), (7, " \n ")}
    assert line_dedup.without_repeated_lines(table.limit(0)).count() == 0


def test_shards(spark, docs, texts, edges, tmp_path):
    manifest = sstable.write_shards(docs, f"file://{tmp_path}/a", WORDS, shards=3)
    got = sstable.read_shards(spark, manifest).orderBy("doc_id").collect()
    start = 0
    for r, k in zip(got, sorted(texts), strict=True):
        ids = ids_of(texts[k])
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (k, start, len(ids), crc(ids))
        start += len(ids)
    asked = spark.createDataFrame([(k,) for k in [0, 17, 199, 5000, -3, None]], "doc_id long")
    found = {r["doc_id"]: r["ids"] for r in sstable.lookup(asked, manifest).collect()}
    assert found == {k: ids_of(texts[k]) for k in (0, 17, 199) if k in texts}
    odd = sstable.write_shards(edges, f"file://{tmp_path}/b", WORDS, shards=2)
    rows = sstable.read_shards(spark, odd, with_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 5, 5, 6, 7] and rows[1]["ids"] == [1]
    assert sstable.write_shards(edges.limit(0), f"file://{tmp_path}/c", WORDS) == []
    assert [sstable.shard_count(n, 50) for n in (0, 1, 1 << 22, 1 << 24, 1 << 30, 1 << 36)] == [1, 1, 1, 4, 50, 256]
    wide = edges.withColumns({"key": F.lit("x"), "id": F.lit("x"), "None": F.lit("x")})
    assert sum(r["n_docs"] for r in sstable.write_shards(wide, f"file://{tmp_path}/d", WORDS)) == len(EDGES)


def test_shard_file_search(tmp_path):
    path = tmp_path / "x.sst"
    with path.open("wb") as f:
        w = sstable.ShardWriter(f, 2, block_bytes=64)
        for k in range(-50, 500, 5):
            w.add(sstable.key_bytes(k), np.arange(abs(k) % 7, dtype="<u2").tobytes())
        w.add(sstable.key_bytes(495), b"\1\0")
        with pytest.raises(ValueError):
            w.add(sstable.key_bytes(3), b"")
        w.close()
    with path.open("rb") as f:
        r = sstable.ShardReader(f)
        assert len(r.index) > 5 and r.n_docs == 111
        for k in range(-60, 510):
            assert len(r.get(k)) == ((k % 5 == 0 and -50 <= k < 500) + (k == 495))
        assert sum(r.may_hold(sstable.key_bytes(k)) for k in range(10_000, 12_000)) < 60


def test_cotraining(spark, edges):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fit = labels.filter("doc_id % 2 = 0")
    got = cotraining.classify_quality(docs, fit).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in got) >= 0.95 * len(got)
    # the views see different things: a text alone moves its own view only
    moved = cotraining.classify_quality(docs.withColumn("text", F.when(F.col("doc_id") == 8, F.lit("!!! BUY NOW !!! " * 50)).otherwise(F.col("text"))), fit)
    one, other = ({r["doc_id"]: r for r in t.filter("doc_id = 8").collect()}[8] for t in (cotraining.classify_quality(docs, fit), moved))
    assert abs(one["p_content"] - other["p_content"]) > 0.05 and abs(one["p_meta"] - other["p_meta"]) < 0.05
    wide = edges.withColumns({"y": F.lit("x"), "held": F.lit("x"), "grams": F.lit("x"), "Meta": F.lit("x")})
    found = cotraining.classify_quality(wide, fit).collect()
    assert len(found) == len(EDGES) and len({tuple(r) for r in found if r["doc_id"] == 5}) == 1
    assert cotraining.classify_quality(docs.select("doc_id", "text"), fit).count() == docs.count()
    flat = cotraining.classify_quality(docs, labels.filter("quality = 1")).agg(F.countDistinct("score")).first()[0]
    assert flat == 1 and cotraining.classify_quality(docs.limit(0), fit).count() == 0


def test_cotraining_round_against_brute_force(spark, docs):
    """What the views count in a round is what a loop over all documents counts."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    features = cotraining.labelled(cotraining.view_features(docs), labels, 30)
    rows = features.filter("held").toArrow().combine_chunks().to_batches()[0]
    y = rows.column("y").to_numpy().astype(float)
    first = cotraining.CoTrained.counted(*cotraining._counts(features, None, 0.95), 0.0).calibrated(rows, y)
    plain = {r["doc_id"]: r for r in docs.collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = {r["doc_id"] for r in features.filter("held").collect()}
    assert 10 < len(held) < 60 and held <= set(truth)
    hasher = cotraining.Hasher()
    views = {}
    for k, r in plain.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        shares = np.array(cotraining.surface_shares(r["text"], words), dtype=np.float32).astype(float)
        content = [{int(g) for g in hasher.grams(words)}, [int(s) for s in cotraining.share_slots(shares[None])[0]], shares.tolist()]
        views[k] = (content, [[s] for s in cotraining.meta_slots(r["source"], r["lang"])])

    def count(label):
        counts, sizes = np.zeros((2, cotraining.SLOTS)), np.zeros((2, 2))
        for k, view in views.items():
            for v in (0, 1):
                if k not in held and (y := label(k, v)) is not None:
                    sizes[v, y] += 1
                    for part in view[v][:2]:
                        for s in part:
                            counts[y, s] += 1
        return counts, sizes

    def odds(model, k, v):
        weights = (model.content, model.meta)[v]
        parts = [np.mean([model.ratios[s] for s in part]) for part in views[k][v][:2]] + (views[k][v][2] if v == 0 else [])
        return sum(w * x for w, x in zip(weights, parts, strict=False)) + weights[-1]

    want = cotraining.CoTrained.counted(*count(lambda k, v: truth.get(k)), 0.0)
    assert np.allclose(first.ratios, want.ratios)

    def pseudo(k, v):
        if k in truth:
            return truth[k]
        p = 1 / (1 + math.exp(-odds(first, k, 1 - v)))
        return 1 if p >= 0.6 else 0 if p <= 0.4 else None

    counts, sizes = cotraining._counts(features, first, 0.6)
    assert all(np.array_equal(a, b) for a, b in zip((counts, sizes), count(pseudo), strict=True))
    assert sizes.sum() > 2 * len(set(truth) - held)
