"""Operators against brute force, exact round trips and defined edge cases on small fixtures."""

import gzip
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestry.llm import components, decontaminate, fill_in_middle, jaccard_join, language_id, line_dedup, mixing, packing, quality, spelling, telephony, token_planes, unigram_count, warc
from attestry.llm.common import Scratch
from attestry.llm.queries import WORD, tokenizer_path

EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, **more):
    """Documents with the given texts, plus columns whose names clash with the operators' own."""
    rows = [(i, t, more.get("lang", ["en"] * len(texts))[i], f"s{i % 3}" if i % 5 else None, 7, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, EMPTY + ", score string, copies int")


def prose(n, seed=1, words=40):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]
    return [" ".join(r.choice(vocab) for _ in range(words)) for _ in range(n)]


ODD = [None, "", " ", "\n\n", "a", "é" * 9, "word " * 5000, "日本語 テスト", "x́ Å", "<|endoftext|> tail", "it's DON'T 123"]


# ---- token planes ---------------------------------------------------------------------------------------------------------
@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=400), st.sampled_from([4, 32]), st.integers(1, 90), st.integers(0, 420), st.integers(0, 90))
def test_segment_round_trip(ids, planes, block, first, count):
    ids = np.array(ids, "<u4")
    blob = token_planes.encode_segment(ids, planes, block)
    assert (token_planes.decode_segment(blob) == ids).all()
    assert (token_planes.decode_segment(blob, first, count) == ids[first : first + count]).all()


def test_segment_damage():
    blob = bytearray(token_planes.encode_segment(np.arange(100, dtype="<u4")))
    blob[-14] ^= 1
    with pytest.raises(ValueError):
        token_planes.decode_segment(bytes(blob))
    blob = token_planes.encode_segment(np.random.default_rng(1).integers(0, 50_000, 3000).astype("<u4"), 4, 1000)
    for at in range(17, int.from_bytes(blob[-8:], "little"), 97):
        with pytest.raises(ValueError):
            token_planes.decode_segment(blob[:at] + bytes([blob[at] ^ 4]) + blob[at + 1 :])


def test_token_output_equals_the_tokenizer(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ODD + prose(30) + ["Ünïcode ÇA va; l'été naïve ½ ² ª", "tab\tand\x1cfs\x85nel\xa0nbsp"]
    docs = frame(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 4")).unionByName(docs.where("doc_id = 10").withColumn("doc_id", F.lit(None).cast("long")))
    found = sorted(map(tuple, token_planes.token_output(docs, path, 2).collect()), key=lambda r: r[1])
    order = [(None, texts[10])] + sorted(((i, x) for i, x in [*enumerate(texts), (4, texts[4])]), key=lambda r: r[0])
    at, expected = 0, []
    for i, x in order:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert found == expected
    assert token_planes.token_output(spark.createDataFrame([], EMPTY), path, 2).count() == 0


# ---- language ----------------------------------------------------------------------------------------------------------------
def test_language_profiles(spark):
    r = random.Random(3)
    make = lambda letters: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(30))
    texts = [make("abcde") if i % 2 else make("vwxyzé") for i in range(60)] + [None, "", "12 !", "A" * 50_000, "abc"]
    lang = ["aa" if i % 2 else "vv" for i in range(60)] + [None, "aa", None, "aa", None]
    docs = frame(spark, texts, lang=lang)
    found = {x["doc_id"]: x for x in language_id.identify(docs, F.col("doc_id") < 40).collect()}
    assert all(found[i]["lang_pred"] == lang[i] for i in range(40, 60))
    assert [found[i]["lang_pred"] for i in (60, 61, 62)] == ["und"] * 3 and found[64]["lang_pred"] == "aa"
    assert all(0 <= x["score"] <= 1 for x in found.values())
    assert language_id.identify(docs, F.lit(False)).where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(spark.createDataFrame([], EMPTY), F.lit(True)).count() == 0


def test_bundle_is_the_sum_of_bound_letters():
    p = language_id.Profiles(64)
    codes, owner = p.letters(["Ab, c", "", "."])
    assert [p.points[c] for c in codes] == [0, ord("a"), ord("b"), 0, ord("c"), 0, 0, 0] and owner.tolist() == [0] * 6 + [1, 2]
    codes = codes[:6]
    direct = sum(np.roll(p.symbol(a), 2) * np.roll(p.symbol(b), 1) * p.symbol(c) for a, b, c in zip(codes.tolist(), codes.tolist()[1:], codes.tolist()[2:]))
    assert (p.bundle(["Ab, c"])[0] == direct).all()
    # a small alphabet's n-grams are counted in a table, those of a large one are sorted; both give the same sums
    texts = prose(20, 3) + ["日本語 テスト", "", "é" * 9]
    wide = language_id.Profiles(64)
    wide.letters(["".join(map(chr, range(0x4E00, 0x4F00)))])
    assert len(wide.points) > 1 << language_id.BITS >= len(p.points)
    assert (p.bundle(texts) == wide.bundle(texts)).all()
    assert (p.total(p.grams(texts)[0]) == p.bundle(texts).sum(0)).all()


def test_more_languages_than_a_block(spark, monkeypatch):
    r = random.Random(8)
    letters = ["abcde", "fghij", "klmno", "pqrst", "uvwxy"]
    texts = [" ".join("".join(r.choice(letters[i % 5]) for _ in range(5)) for _ in range(30)) for i in range(40)] + ["", None]
    docs = frame(spark, texts, lang=[f"l{i % 5}" for i in range(40)] + [None] * 2)
    one = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language_id.identify(docs, F.lit(True)).collect()}
    monkeypatch.setattr(language_id.Prototypes.blocks, "__defaults__", (2,))
    assert {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language_id.identify(docs, F.lit(True)).collect()} == one
    assert one[3][0] == "l3" and one[40] == ("und", 0.0)


def test_pipeline_language_stage_rejects_what_no_profile_knows(spark):
    import corpus_pipeline

    r = random.Random(9)
    words = {k: ["".join(r.choice(own) for _ in range(r.randint(2, 6))) for _ in range(120)] for k, own in {"aa": "abcdefgh", "vv": "rstuvwxyz", "new": "ijklmnopq"}.items()}
    make = lambda k, n: " ".join(r.choice(words[k]) for _ in range(n))
    clean = [(k, make(k, n)) for k in ("aa", "vv") for n in (60, 80, 100) for _ in range(60)] + [(k, make(k, n)) for k in ("aa", "vv") for n in (1, 2, 4) for _ in range(10)]
    junk = [(None, make("new", 80)), ("aa", "abcdxq " * 60), (None, "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400))), (None, "12 !"), (None, None)]
    rows = [(i, t, k, "s", len(t or "")) for i, (k, t) in enumerate(clean + junk)] + [(9000 + i, clean[0][1], "aa", "s", 7) for i in range(500)]
    kept = {x["doc_id"] for x in corpus_pipeline.language_stage(spark, spark.createDataFrame(rows, EMPTY), "").collect()}
    assert kept == {x[0] for x in rows} - set(range(len(clean), len(clean) + len(junk)))


# ---- quality -----------------------------------------------------------------------------------------------------------------
def test_quality_held_out(spark):
    good, bad = prose(150, 5), [" ".join(w.upper() + "!!" for w in t.split()) for t in prose(150, 6)]
    texts = [x for pair in zip(good, bad) for x in pair] + [None, "", "x" * 60_000]
    docs = spark.createDataFrame([(i, t, True, "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean, stats string, score string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)], "doc_id long, label int")
    found = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(found) == 303 and all(0 <= r["score"] <= 1 for r in found.values())
    assert np.mean([found[i]["predicted"] == 1 - i % 2 for i in range(200, 300)]) > 0.95
    one = quality.classify(docs, labels.withColumn("label", F.lit(1)))
    assert one.where("score <> 1").count() == 0
    assert quality.classify(docs, labels.limit(0)).where("score <> 0.5").count() == 0
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_isotonic_is_the_least_squares_fit():
    y = np.array([0, 1, 0, 0, 1, 1, 0, 1.0])
    x, v = quality.isotonic(np.arange(8.0), y, np.ones(8))
    assert (np.diff(v) > 0).all() and abs(v[0]) < 1e-12 and v[-1] == 1


# ---- line dedup --------------------------------------------------------------------------------------------------------------
def kept_lines(texts):
    """Brute force over (doc_id, text)."""
    blanks = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(blanks))
    held = {}
    for i, t in texts:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held.setdefault(key(x), set()).add(i)
    gone = lambda i, x: len(held.get(key(x), ())) >= 5 and i < max(held[key(x)])
    return {(i, len((t or "").split("\n")), sum(gone(i, x) for x in (t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if not gone(i, x))) for i, t in texts}


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(9)
    pool = [f"  Line number {k} that is Long enough to count as one, É\t" for k in range(12)] + ["short", "", "x" * 40, "\x85" + "y" * 39]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randint(0, 9))) for _ in range(80)] + [None, "", "\n"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, place string")
    found = line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_dropped", line_dedup.apply_bitmaps("text", "keep_runs").alias("kept"))
    assert {tuple(x) for x in found.collect()} == kept_lines(list(enumerate(texts)))
    twice = docs.unionByName(docs.where("doc_id < 3"))
    assert line_dedup.line_dedup(twice).count() == len(texts) + 3
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


# ---- mixing ------------------------------------------------------------------------------------------------------------------
def test_water_fill():
    assert mixing.water_fill([10, 100, 1000], [5, 2, 1], 300) == [20.0, 2 * 280 / 3, 280 / 3]
    assert mixing.water_fill([1, 1], [5, 2], 100) == [2.0, 2.0]
    assert mixing.water_fill([], [], 0) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.sets(st.integers(0, 3), min_size=1)), min_size=1, max_size=6), st.lists(st.integers(0, 20), min_size=4, max_size=4))
def test_flow_is_maximal_and_repeats_last(patterns, targets):
    cap, members = [float(c) for c, _ in patterns], [sorted(m) for _, m in patterns]
    flow = mixing.route(cap, members, targets)
    into = [sum(f.get(s, 0) for f in flow) for s in range(4)]
    assert all(x <= t + 1e-6 for x, t in zip(into, targets)) and all(sum(f.values()) <= 2 * c + 1e-6 for f, c in zip(flow, cap))

    def best(copies):  # max flow = min cut over subsets of sources
        return min(sum(targets[s] for s in keep) + sum(copies * c for c, m in zip(cap, members) if set(m) - set(keep)) for k in range(5) for keep in itertools.combinations(range(4), k))

    assert abs(sum(into) - best(2)) < 1e-6
    assert abs(sum(min(sum(f.values()), c) for f, c in zip(flow, cap)) - best(1)) < 1e-6  # repetition only for what fresh text can't serve


def test_mix_hits_targets(spark):
    r = random.Random(2)
    rows = [(i, r.randint(1, 60), [f"s{i % 7}"] if i % 11 else [None]) for i in range(3000)] + [(9000, 5, []), (9001, None, ["s1"])]
    docs = spark.createDataFrame(rows, "doc_id long, size long, members array<string>").withColumn("target", F.lit("clash"))
    found = mixing.mix(docs, "doc_id", "size", "members").collect()
    again = mixing.mix(docs.repartition(5), "doc_id", "size", "members").collect()
    assert sorted((x["doc_id"], x["copies"]) for x in found) == sorted((x["doc_id"], x["copies"]) for x in again) and len(found) == 3002
    for s in [f"s{k}" for k in range(7)] + [None]:
        own = [x for x in found if x["members"] == [s]]
        assert abs(sum((x["size"] or 0) * x["copies"] for x in own) - own[0]["target"]) <= 1 and max(x["copies"] for x in own) <= 2
    assert mixing.mix(docs.limit(0), "doc_id", "size", "members").count() == 0


# ---- Jaccard join -------------------------------------------------------------------------------------------------------------
def brute_components(texts, size, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(zip(*(w[k:] for k in range(size)))) if len(w) >= size else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {(i, len(sets[i]), root(i)) for i in sets}


def near_copies(seed, groups=6, members=14, edits=4):
    r, texts = random.Random(seed), []
    for base in prose(groups, seed, 60):
        for _ in range(members):
            w = base.split()
            for _ in range(r.randint(0, edits)):
                w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            texts.append(" ".join(w))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,short", [(1, 16), (2, 2)])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, seed, short):
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", short)  # with 2, most lists take the way through blocks
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 5)
    texts = near_copies(seed) + prose(20, seed + 50) + [None, "", " ", "one", "ONE", "two words", "A b\tc d"]
    names = ["node", "row", "_least", "prefix", "comp", "n_shingles"]
    docs = spark.createDataFrame([(i + 3, t, *names) for i, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    found = jaccard_join.jaccard_components(docs, 4, 85)
    assert found.columns == ["doc_id", *names[:-1], "n_shingles", "component_id"] and found.where("node = 'node' and comp = 'comp' and _least = '_least'").count() == len(texts)
    found = {tuple(r) for r in found.select("doc_id", "n_shingles", "component_id").collect()}
    assert found == brute_components([(i + 3, t) for i, t in enumerate(texts)], 4, 85)


def test_jaccard_edge_cases(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_components(none, 4, 85).count() == 0
    rows = [(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (7, "A B C D E"), (8, None)]
    found = sorted((tuple(r) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()), key=str)
    assert found == [(5, 2, 5), (5, 2, 5), (7, 2, 5), (8, 0, 8), (None, 2, None)]


def test_components(spark):
    edges = [(i + 1, i) for i in range(30)] + [(100, 101), (101, 102), (200, 100)]
    found = {tuple(r) for r in components.components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long"), "x").collect()}
    assert found == {(i, 0) for i in range(31)} | {(i, 100) for i in (100, 101, 102, 200)}


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.integers(0, 20), st.integers(0, 20), st.integers(50, 100), st.randoms())
def test_prefixes_lose_no_pair(common, left, right, percent, r):
    """Under any order, linked sets share as much of their prefixes as the filters ask for."""
    if 100 * common < percent * (common + left + right):
        return
    grams = list(range(common + left + right))
    r.shuffle(grams)
    both, a, b = grams[:common], grams[: common + left], grams[:common] + grams[common + left :]
    order = {g: r.random() for g in grams}
    assert common >= max(jaccard_join.needed(len(a), percent), jaccard_join.needed(len(b), percent))
    first = lambda x, least: set(sorted(x, key=order.get)[: jaccard_join.prefix_length(len(x), percent, least)])
    assert first(a, 1) & first(b, 1) <= set(both) and first(a, 1) & first(b, 1)
    least = lambda x: jaccard_join.shared_least(len(x), percent)
    for x in (a, b):
        assert len(first(a, least(a)) & first(b, least(b))) >= jaccard_join.shared_least(jaccard_join.needed(len(x), percent), percent)


# ---- decontamination -----------------------------------------------------------------------------------------------------------
def brute_tiles(item, doc, least):
    """Greedy string tiling straight from its definition."""
    fi, fd, out = [True] * len(item), [True] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and fi[i + k] and fd[j + k] and item[i + k] == doc[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < min(least, len(item)) or not k:
            return out
        fi[i : i + k] = [False] * k
        fd[j : j + k] = [False] * k
        out += k


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=24), st.lists(st.sampled_from([b"a", b"b", b"c", b"x"]), max_size=40), st.integers(1, 5))
def test_tiling_covers_like_the_definition(item, doc, least):
    tiles = decontaminate.tile(item, doc, least)
    assert all(item[i : i + k] == doc[j : j + k] for i, j, k in tiles)
    assert len({x for i, _, k in tiles for x in range(i, i + k)}) == sum(k for _, _, k in tiles) == len({x for _, j, k in tiles for x in range(j, j + k)})
    assert abs(sum(k for _, _, k in tiles) - brute_tiles(item, doc, least)) <= max(0, len(item) // 3)  # ties may fall either way


@settings(max_examples=100, deadline=None)
@given(st.permutations(range(24)), st.lists(st.integers(1, 23), max_size=4), st.integers(0, 9), st.randoms())
def test_tiling_without_ties_is_the_definition(item, cuts, junk, r):
    """Distinct words in pieces, moved about: every match is one place of each side, so the tiles are those of the definition."""
    ends = sorted({0, 24, *cuts})
    pieces = [item[a:b] for a, b in zip(ends, ends[1:], strict=False)] + [[100 + k] for k in range(junk)]
    r.shuffle(pieces)
    word = lambda x: [b"w%d" % k for k in x]
    doc = word([k for p in pieces for k in p])
    for least in (1, 3, 5):
        assert sum(k for _, _, k in decontaminate.tile(word(item), doc, least)) == brute_tiles(word(item), doc, least)


def test_running_fingerprints_equal_the_direct_ones():
    codes = np.random.default_rng(5).integers(1, 2**32, 300).astype(np.uint64)
    codes[200:240] = codes[20:60]
    runs = decontaminate.Running(codes)
    for length in (1, 5, 40, 300, 301):
        found = runs.hashes(length)
        pieces = [codes[i : i + length].tobytes() for i in range(300 - length + 1)]
        assert len(found) == len(pieces) and len(set(zip(found.tolist(), pieces, strict=True))) == len(set(pieces)) == len(set(found.tolist()))


def test_leaks(spark):
    items = prose(6, 30, 30)
    docs = prose(20, 31, 200)
    w = items[0].split()
    docs += [docs[0] + " " + items[1].upper().replace(" ", ", ") + " end", " ".join(w[20:] + docs[1].split()[:9] + w[10:20] + w[:10]), items[2][: len(items[2]) // 3], None, "", items[3]]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)] + [(25, items[3], "x"), (None, items[4], "x")], "doc_id long, text string, seed string")
    b = spark.createDataFrame(list(enumerate(items))[:5] + [(None, items[5]), (90, ""), (91, None), (92, "q w")], "item_id long, text string")
    d = d.unionByName(spark.createDataFrame([(26, docs[2] + " " + items[5], "x")], d.schema)).withColumn("_text_hash", F.lit("clash"))
    leaks = decontaminate.find_leaks(d, b)
    assert {(r["doc_id"], r["item_id"]) for r in leaks.collect()} == {(20, 1), (21, 0), (25, 3), (None, 4), (26, None)}
    left = decontaminate.decontaminate(d, leaks)
    assert left.count() == 23 and left.where("doc_id is null or doc_id in (20, 21, 25, 26)").count() == 0 and left.columns == d.columns
    assert decontaminate.find_leaks(d, b.limit(0)).count() == 0 and decontaminate.find_leaks(d.limit(0), b).count() == 0


# ---- WARC ----------------------------------------------------------------------------------------------------------------------
def test_warc_round_trip(spark):
    big, other = "<p>ä</p>" * 200, "z" * 1000
    rows = [(1, "http://a", big), (5, None, big), (3, "http://b\r\nX: y", big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", other), (7, "u", other), (None, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    found = sorted((tuple(r)[:5] for r in warc.warc_round_trip(pages).collect()), key=str)
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert found == sorted([(1, 1800, sha(big), "revisit", 5), (5, 1800, sha(big), "response", None), (3, 1800, sha(big), "revisit", 5), (2, 5, sha("small"), "response", None), (4, 5, sha("small"), "response", None), (6, 0, sha(""), "response", None), (7, 1000, sha(other), "response", None), (7, 1000, sha(other), "response", None), (None, 1800, sha(big), "revisit", 5)], key=str)
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_warc_reader_is_incremental_and_strict():
    a = warc.write_record(1, "u", b"hello", 5, hashlib.sha1(b"hello").hexdigest(), None)
    b = warc.write_record(2, "u", b"", 5, hashlib.sha1(b"hello").hexdigest(), 1)
    for step in (1, 7, 10_000):
        whole = a + b
        found = [warc.page_of(*r) for r in warc.read_records(whole[i : i + step] for i in range(0, len(whole), step))]
        assert [x[0] for x in found] == [1, 2] and found[1][3:] == ("revisit", 1)
    with pytest.raises(warc.WarcError):
        list(warc.read_records([a[:-9]]))
    with pytest.raises(warc.WarcError):
        list(warc.read_records([gzip.compress(gzip.decompress(a) + b"more")]))
    with pytest.raises(warc.WarcError):
        [warc.page_of(*r) for r in warc.read_records([gzip.compress(gzip.decompress(a).replace(b"hello", b"hellO"))])]


# ---- telephony -----------------------------------------------------------------------------------------------------------------
def test_companding_tables():
    mu, al = telephony.mulaw_table(), telephony.alaw_table()
    assert (mu[0], mu[0x80], mu[0x7F], mu[0xFF]) == (-32124, 32124, 0, 0)
    assert (al[0x2A], al[0xAA], al[0x55], al[0xD5]) == (-32256, 32256, -8, 8)
    assert len(set(al.tolist())) == 256 and len(set(mu.tolist())) == 255


def slow_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = telephony.STEPS[index]
            change = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                change += part if code & bit else 0
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + telephony.CHANGES[code & 7]))
            out.append(value)
    return out


def test_adpcm_across_blocks():
    blocks = np.random.default_rng(4).integers(0, 256, (9, 36)).astype(np.uint8)
    assert telephony.decode_adpcm(blocks).tolist() == [slow_adpcm(bytes(b)) for b in blocks]


def test_to_pcm_and_payloads(spark):
    good = [telephony.wav(telephony.MULAW, 8000, bytes(range(256))), telephony.wav(telephony.ALAW, 16000, bytes(400)), telephony.wav(telephony.ADPCM, 8000, bytes(72), 36, 4, 65), telephony.wav(telephony.PCM, 8000, b"", 2, 16)]
    rows = [(i, m) for i, m in enumerate([*good, None, b"junk", b"", good[2][:-5]])]
    found = {r["id"]: r for r in telephony.to_pcm(spark.createDataFrame(rows, "id int, media binary"), "media").collect()}
    assert [len(telephony.decode(found[i]["pcm"])[1]) for i in range(4)] == [256, 200, 130, 0]
    assert found[4]["pcm"] is None and found[4]["error"] is None and all(found[i]["error"] for i in (5, 6, 7))
    texts = ODD + ["a" * 64, "b" * 65]
    for r in telephony.media_round_trip(frame(spark, texts)).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        media = telephony.wav(telephony.MULAW, 8000, padded)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        mu, al = ([int(table[x]) for x in padded] for table in (telephony.mulaw_table(), telephony.alaw_table()))
        slow = [x for k in range(0, len(padded), 64) for x in slow_adpcm(padded[k : k + 64])]
        pcm = np.array(mu, "<i2")
        crossings = sum((a < 0) != (b < 0) for a, b in zip(mu, mu[1:]))
        square = lambda v: sum(x * x for x in v)
        assert r["feature"] == f"samples={len(mu)};energy={square(mu)};crossings={crossings};peak={max(map(abs, mu))};alaw={square(al)};adpcm={square(slow)};pcm={len(pcm)}:{zlib.crc32(pcm.tobytes()):08x}"


def test_long_payloads_part_by_part(monkeypatch):
    payloads = [np.random.default_rng(k).integers(0, 256, n).astype(np.uint8).tobytes() for k, n in enumerate((64, 640, 128, 4096))]
    whole = telephony._energies(payloads), [telephony.features(telephony.mulaw_table()[np.frombuffer(p, np.uint8)]) for p in payloads]
    monkeypatch.setattr(telephony, "TOGETHER", 128)
    assert whole == (telephony._energies(payloads), [telephony.features(telephony.mulaw_table()[np.frombuffer(p, np.uint8)]) for p in payloads])
    assert telephony.features(np.zeros(0, np.int16)) == "samples=0;energy=0;crossings=0;peak=0"


# ---- unigram counts --------------------------------------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab▁c", min_size=1, max_size=4), st.sampled_from([-1.0, -2.0, -3.0, -2.5])), max_size=12, unique_by=lambda x: x[0]), st.text("abcd é\n", max_size=14), st.booleans(), st.sampled_from([1, 3, 4096]))
def test_counts_equal_the_tokenizer(pieces, text, fallback, block):
    from tokenizers import Tokenizer, models, normalizers

    vocab = [("<unk>", 0.0), *pieces, *((f"<0x{i:02X}>", 0.0) for i in range(256 * fallback))]
    t = Tokenizer(models.Unigram(vocab, 0, fallback))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    v = unigram_count.Vocabulary(pieces, fallback)
    v.unknown = min(s for _, s in vocab) - 10.0 if pieces else -10.0
    before, unigram_count.BLOCK_CHARS = unigram_count.BLOCK_CHARS, block
    found = v.count(text)
    unigram_count.BLOCK_CHARS = before
    assert found == len(t.encode(text, add_special_tokens=False).ids)


def test_public_vocabulary(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    v = unigram_count.vocabulary(path)
    assert v.additive
    from tokenizers import Tokenizer, models, normalizers

    pieces = unigram_count.sentencepiece_pieces(path)
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces, *((f"<0x{i:02X}>", 0.0) for i in range(256))], 0, True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    v.unknown = min(0.0, *(s for _, s in pieces)) - 10.0
    for x in [x for x in ODD if x] + prose(5):
        assert v.count(x) == len(t.encode(x, add_special_tokens=False).ids), x[:40]
    v = unigram_count.Vocabulary(pieces)
    docs = frame(spark, ODD + prose(10))
    for r, t in zip(unigram_count.token_counts(docs, path).orderBy("doc_id").collect(), ODD + prose(10)):
        assert r["n_tokens"] == (v.solve((" " + t).replace(" ", "▁"))[1] if t else 0)


# ---- pipeline --------------------------------------------------------------------------------------------------------------------
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    texts = near_copies(4, 3, 4, 1) + prose(30, 77) + [None, "", "12 34"]
    items = prose(2, 99, 30)
    texts.append(prose(1, 98)[0] + " " + items[0])
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[20], (None, prose(1, 97)[0], "en", None, 3)]
    spark.createDataFrame(rows, EMPTY).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r["doc_id"] for r in docs.collect()})
        if name == "near_duplicates":
            assert docs.where("doc_id = 20").count() == 1
    lettered = {i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)} | {None}
    firsts = {root for i, n, root in brute_components([(i, texts[i]) for i in sorted(lettered - {None})], 5, 80)} | {None}
    assert kept[0] == lettered and kept[1] == firsts and kept[2] == firsts - {len(texts) - 1} and kept[3] <= kept[2]
    out = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    assert [r["start"] for r in out] == list(itertools.accumulate([0, *(r["n_tokens"] for r in out[:-1])]))
    assert {r["doc_id"] for r in out} == kept[3]


def test_word_pattern_equals_bytes_split(spark):
    texts = ["a b c", "\x1c x\x0b y\x85z", "", " "]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(F.regexp_count("t", F.lit(WORD))).collect()
    assert [r[0] for r in found] == [len(t.encode().split()) for t in texts]


# ---- packing -------------------------------------------------------------------------------------------------------------------
def slow_squares(batches, room):
    """The rule by its definition: every choice's sum of squares over all gaps, one piece a batch."""
    open_, opened = dict.fromkeys(range(1, room + 1), 0), 0
    for length, n in batches:
        assert n == 1
        best = None
        for gap in [g for g in range(length, room) if open_[g]] + [room]:
            then = dict(open_)
            if gap < room:
                then[gap] -= 1
            if gap > length:
                then[gap - length] += 1
            key = (sum(v * v for g, v in then.items() if g < room), gap)
            if best is None or key < best[0]:
                best = (key, gap, then)
        opened, open_ = opened + (best[1] == room), best[2]
    return opened


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=60))
def test_squares_follow_the_definition(lengths):
    room = 24
    counts = np.bincount(np.array(lengths, int), minlength=room + 1)
    slots, opened = packing.sum_of_squares(counts, room)
    rest = np.append(counts[:room], 0)
    assert opened == slow_squares(list(packing._batches(rest, packing.BATCHES, packing.SEED)) if rest.any() else [], room) + counts[room]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=30, max_size=30), st.sampled_from([7, 50, 1 << 17]))
def test_slots_hold_every_piece_once(counts, most):
    room = len(counts)
    counts = np.array([0, *counts])
    slots, opened = packing.sum_of_squares(counts, room, most)
    filled = {}
    for length, rank, n, first, offset in slots.tolist():
        for k in range(n) if n < 50 else (0, n - 1):
            filled.setdefault(first + k, []).append((offset, length))
    for length in range(1, room + 1):
        own = slots[slots[:, 0] == length]
        assert own[:, 2].sum() == counts[length] and (own[:, 1] == np.cumsum(own[:, 2]) - own[:, 2]).all()
    assert (slots[:, 2] * slots[:, 0]).sum() == (counts * np.arange(room + 1)).sum() and opened >= (counts * np.arange(room + 1)).sum() / room
    assert all(0 <= f < opened and max(o + n for o, n in x) <= room for f, x in filled.items())


def test_packed_documents(spark):
    from tokenizers import Tokenizer

    path, room = tokenizer_path("word_bpe_49k.json"), 64
    t = Tokenizer.from_file(path)
    texts = [*ODD, *prose(60, 8, 30), "one two " * 5000]
    docs = frame(spark, texts).withColumnsRenamed({"score": "sequence_id", "copies": "local"})
    docs = docs.unionByName(docs.where("doc_id = 4")).unionByName(docs.where("doc_id = 10").withColumn("doc_id", F.lit(None).cast("long")))
    pieces = Scratch(spark, "test").write(packing.cut_pieces(docs, path, 1, room), "pieces")
    packed = packing.pack(pieces, room).collect()
    expected = []
    for i, x in [*enumerate(texts), (4, texts[4]), (None, texts[10])]:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        expected += [(i, k // room, k, ids[k : k + room].tobytes()) for k in range(0, len(ids), room)]
    assert sorted(map(str, expected)) == sorted(str((r["doc_id"], r["piece"], r["start"], bytes(r["ids"]))) for r in packed)
    by_sequence = {}
    for r in packed:
        assert r["length"] == len(r["ids"]) // 4
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], bytes(r["ids"])))
    for own in by_sequence.values():
        own.sort()
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in itertools.pairwise(own)) and sum(x[1] for x in own) <= room
    total = sum(len(e[3]) // 4 for e in expected)
    assert len(by_sequence) <= -(-total // room) + 2
    built = packing.sequences(packing.pack(pieces, room)).collect()
    assert {r["sequence_id"]: bytes(r["ids"]) for r in built} == {k: b"".join(x[2] for x in own) for k, own in by_sequence.items()}
    assert packing.pack_documents(spark.createDataFrame([], EMPTY), path).count() == 0


# ---- fill in middle --------------------------------------------------------------------------------------------------------------
def slow_middle(doc_id, text):
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle_equals_brute_force(spark, monkeypatch):
    r = random.Random(4)
    texts = ["".join(r.choice(["a", "B", "zz", " ", "é", "日", "\n", "<", "S>", "<S", "🙂", "1", "<P>" if i % 9 == 0 else "-"]) for _ in range(r.randint(0, 60))) for i in range(300)]
    texts += ["x" * 300, "<M>", "<S", *[x or "" for x in ODD]]
    for block in (7, 1 << 20):
        monkeypatch.setattr(fill_in_middle, "BLOCK_BYTES", block)
        raw = [t.encode() for t in texts]
        h = np.array([[int(hashlib.sha256(f"1:{i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)] for i in range(len(texts))])
        n, first, second, prefix, middle = fill_in_middle.cut(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]), h[:, 0], h[:, 1])
        start = 0
        for i, t in enumerate(texts):
            own = slow_middle(i, t)
            assert own[0] == n[i] and own[2:4] in ((None, None), (prefix[i], middle[i]))
            tokens = re.findall("[A-Za-z]+|[^A-Za-z]", t)
            a, b = sorted((int(h[i, 0]) % (len(tokens) + 1), int(h[i, 1]) % (len(tokens) + 1)))
            assert raw[i][: first[i] - start] == "".join(tokens[:a]).encode() and raw[i][: second[i] - start] == "".join(tokens[:b]).encode()
            start += len(raw[i])
    monkeypatch.undo()
    docs = frame(spark, texts).withColumnsRenamed({"score": "form", "copies": "row"})
    docs = docs.unionByName(docs.where("doc_id = 7")).unionByName(docs.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")))
    found = fill_in_middle.restored(fill_in_middle.fill_in_middle(docs)).collect()
    rows = sorted(str((x["doc_id"], x["n"], x["form"], x["prefix_chars"], x["middle_chars"], bytes(x["output"]).decode(), bytes(x["restored"]).decode(), x["row"])) for x in found)
    expected = sorted(str((i, *slow_middle("" if i is None else i, t), t, 1)) for i, t in [*enumerate(texts), (7, texts[7]), (None, texts[9])])
    assert rows == expected and {x["form"] for x in found} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(spark.createDataFrame([], EMPTY)).count() == 0


def test_fill_in_middle_of_a_very_long_text(spark):
    docs = spark.range(2).selectExpr("id as doc_id", "if(id = 0, repeat('x', 20000000), repeat('é1 ab', 2000000)) as text")
    found = {r[0]: tuple(r)[1:] for r in fill_in_middle.fill_in_middle(docs).select("doc_id", "n", F.length("output")).collect()}
    assert found[0][0] == 1 and found[1][0] == 8_000_000 and found[0][1] in (20_000_000, 20_000_009)


# ---- spelling --------------------------------------------------------------------------------------------------------------------
def brute_variants(rows):
    counts = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w, n in counts.items():
        own = sorted((-counts[v], v) for v in counts if near(w, v))
        form[w] = own[0][1] if own and -own[0][0] >= 5 * n else None
        out[w] = len(own)
    last = lambda w: w if form[w] is None else last(form[w])
    return {(w, form[w], last(w), n, out[w], form[w] and counts[form[w]]) for w, n in counts.items()}


def test_variants_equal_brute_force(spark):
    r, texts = random.Random(6), []
    words = ["".join(r.choice("aabcé") for _ in range(r.randint(6, 8))) for _ in range(60)] + ["ÀÉabcd", "ababababab", "x" * 40, "xx×yy÷zz", "Straße"]
    for k in range(400):
        picked = [r.choice(words[: 1 + r.randrange(len(words))]) for _ in range(40)]
        if k % 2:
            picked = [w if r.random() < 0.7 else w[: (c := r.randrange(len(w)))] + r.choice(["", "a", "É", "b" + w[c]]) + w[c + 1 :] for w in picked]
        texts.append(" ".join(w.upper() if r.random() < 0.1 else w for w in picked))
    texts += ["chainaa chainab " * 3, "chainaa chainab " * 3, "chainab chainbb " * 30, "chainbb " * 200]
    texts += [None, "", "1 2 3", *["z" * 50_000] * 5, "z" * 49_999 + "y"]
    docs = frame(spark, texts).withColumnsRenamed({"score": "word", "copies": "n"})
    docs = docs.unionByName(docs.where("doc_id = 7")).unionByName(docs.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")))
    rows = [*enumerate(texts), (7, texts[7]), (None, texts[9])]
    expected = brute_variants(rows)
    found = [tuple(x) for x in spelling.group_variants(docs).collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    assert sum(x[1] is not None for x in found) > 20 and any(x[1] != x[2] for x in found if x[1]), "forms, and forms of forms"
    assert spelling.group_variants(spark.createDataFrame([], EMPTY)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abé", min_size=5, max_size=5), min_size=1, max_size=4, unique=True), st.sampled_from([3, 10, 1 << 18]))
def test_neighbourhoods_are_whole_and_distinct(words, block):
    alphabet = np.array(sorted({ord(c) for w in words for c in w}))
    codes = np.array([list(w.encode("latin-1")) for w in words], np.uint8)
    before, spelling.BLOCK = spelling.BLOCK, block
    try:
        made = [(words[r], k, p, chr(c), h) for row, k, place, code, h_ in spelling.neighbourhood(codes, alphabet) for r, p, c, h in zip(row.tolist(), place.tolist(), code.tolist(), h_.tolist(), strict=True)]
    finally:
        spelling.BLOCK = before
    edits = {w: [] for w in words}
    for w, k, p, c, h in made:
        edits[w].append(w[:p] + ("" if k == spelling.DELETION else c) + w[p + (k != spelling.INSERTION) :])
        assert int(spelling.hashes(np.array([list(edits[w][-1].encode("latin-1"))], np.uint8))[0]) == h
    for w, own in edits.items():
        letters = [chr(c) for c in alphabet]
        whole = {w[:i] + w[i + 1 :] for i in range(5)} | {w[:i] + c + w[i + 1 :] for i in range(5) for c in letters} | {w[:i] + c + w[i:] for i in range(6) for c in letters}
        assert sorted(own) == sorted(whole - {w})


# ---- very long texts -------------------------------------------------------------------------------------------------------------
def test_long_benchmark_items(spark):
    """An item of 200,000 words and one of a single word of a million letters; the documents hold one of them, with other words around it."""
    long, single = " ".join(prose(5000, 77)), "x" * 1_000_000
    benchmark = spark.createDataFrame([(1, long), (2, single), (3, prose(1, 78)[0])], "item_id long, text string")
    docs = spark.createDataFrame([(10, "so " + long + " it is"), (11, "the word " + single), (12, prose(1, 79, 3000)[0]), (13, long[: len(long) // 3])], "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"], r["coverage"]) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    assert found == {(10, 1, 1.0), (11, 2, 1.0)}


def test_counts_of_an_unbroken_text_take_little_memory():
    import tracemalloc

    v = unigram_count.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    assert v.count("ab" * 500) == v.solve("\u2581" + "ab" * 500)[1]
    text = "xyzzy" * 60_000
    tracemalloc.start()
    v.count(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20
