"""Every registered query of the subpackage over one small folder of tables: columns, rules, odd rows, and its result by SQL or by brute force."""

import hashlib
import itertools
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.llm import decontaminate, language_id, mixing, quality
from attestry.llm.queries import ORACLES, QUERIES, WORD, tokenizer_path
from tests.llm.test_operators import brute_components, brute_tiles, near_copies, prose, slow_adpcm

COLUMNS = {
    "op1_quality": ["doc_id", "held_out", "score", "predicted"],
    "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_token_planes": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op4_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op5_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op6_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op7_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op8_decontaminate": ["doc_id", "item_id", "coverage", "tiles"],
    "op9_telephony": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op10_unigram_count": ["doc_id", "n_tokens"],
    "op11_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op12_fill_in_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
    "op13_spelling": ["word", "form", "root", "n", "n_near", "form_n"],
}
LINE = "A line that many documents have, and it is long enough to count."


def documents():
    r = random.Random(12)
    items = prose(3, 99, 30)
    texts = near_copies(3, 3, 5, 3) + prose(25, 41, 30) + [None, "", " ", "one", "é" * 9, "日本語 テスト", "word " * 40_000, prose(1, 7)[0]]
    texts += [f"{prose(1, 200 + i, 12)[0]}\n  {LINE.upper() if i % 2 else LINE}\t\nend {i}" for i in range(6)]
    texts += [prose(1, 98)[0] + " " + items[0], " ".join(items[1].split()[15:] + prose(1, 97, 9)[0].split() + items[1].split()[:15]), items[2][:60]]
    texts += [texts[40], texts[40]]  # equal texts under other ids
    rows = [(i, t, ["en", "de", None][i % 3], [f"s{i % 4}", None][i % 7 == 0], len(t or ""), "clash", "clash", "clash") for i, t in enumerate(texts)]
    r.shuffle(rows)
    return rows, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    rows, items = documents()
    kind = "doc_id long, text string, lang string, source string, n_chars long, stats string, text_hash string, node string"
    spark.createDataFrame(rows, kind).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(7, None, "x"), (8, "", "x"), (None, "never seen " * 9, "x")], "item_id long, text string, seed string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([(d[0], d[0] % 2, 0, "x") for d in rows if d[0] % 5] + [(9999, 1, 0, "x")], "doc_id long, quality int, toxic int, score string").write.parquet(f"{where}/labels.parquet")
    big = "<p>ä</p>" * 200
    pages = [(1, "u", big), (5, None, big), (3, "http://b", big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", "z" * 1000), (8, "u", "y" * 999 + "é")]
    spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string").write.parquet(f"{where}/pages.parquet")
    return str(where)


@pytest.fixture(scope="module")
def found(spark, folder):
    return {name: [tuple(r) for r in f(spark, folder).select(*COLUMNS[name]).collect()] for name, f in QUERIES.items()}


@pytest.fixture(scope="module")
def docs():
    return {r[0]: r for r in documents()[0]}


def test_columns_and_rows(spark, folder, found, docs):
    assert set(QUERIES) == set(COLUMNS)
    for name, rows in found.items():
        if name not in ("op4_warc", "op8_decontaminate", "op13_spelling"):
            assert sorted(r[0] for r in rows if name != "op11_packing" or r[1] == 0) == sorted(docs), name


def test_queries_survive_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "benchmark", "labels", "pages"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, f in QUERIES.items():
        got = f(spark, str(tmp_path))
        assert got.columns[: len(COLUMNS[name])] == COLUMNS[name] and got.count() == 0, name


def test_held_out_rows_are_not_learned_from(spark, folder, found, docs):
    for name, mod, rest in (("op1_quality", 3, 1), ("op2_language_id", 4, 2)):
        assert all(r[1] == (zlib.crc32(str(r[0]).encode()) % mod == rest) for r in found[name])
    assert all(0 <= s <= 1 and p == (s >= 0.5) for _, _, s, p in found["op1_quality"])
    # another label or language of a held-out row changes nothing
    d = spark.read.parquet(f"{folder}/documents.parquet")
    held = lambda mod, rest: F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest
    other = f"{folder}/../other"
    d.withColumn("lang", F.when(held(4, 2), "xx").otherwise(F.col("lang"))).write.mode("overwrite").parquet(f"{other}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    labels.withColumn("quality", F.when(held(3, 1), 1 - F.col("quality")).otherwise(F.col("quality"))).write.mode("overwrite").parquet(f"{other}/labels.parquet")
    for name in ("op1_quality", "op2_language_id"):
        assert sorted(map(tuple, QUERIES[name](spark, other).select(*COLUMNS[name]).collect())) == sorted(found[name])


def test_language_by_brute_force(found, docs):
    p = language_id.Profiles()
    learn = {i: d for i, d in docs.items() if zlib.crc32(str(i).encode()) % 4 != 2 and d[1] is not None and d[2]}
    sums = {lang: sum(p.bundle([d[1]])[0] for d in learn.values() if d[2] == lang) for lang in sorted({d[2] for d in learn.values()})}
    for i, _, lang, score in found["op2_language_id"]:
        v = p.bundle([docs[i][1] or ""])[0]
        if not v.any():
            assert (lang, score) == ("und", 0.0)
            continue
        cosines = {k: round(float(v @ s / np.linalg.norm(v) / np.linalg.norm(s)), 6) for k, s in sums.items()}
        assert cosines[lang] >= max(cosines.values()) - 2e-6 and abs(score - min(1.0, max(0.0, cosines[lang]))) < 2e-6


def test_queries_equal_their_sql(folder, found):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    for name, sql in ORACLES.items():
        assert sorted(map(str, found[name])) == sorted(map(str, c.execute(f"select {', '.join(COLUMNS[name])} from ({sql})").fetchall()))
    assert sum(r[2] for r in found["op5_line_dedup"]) == 5


def test_mixing_sizes_and_targets(found, docs):
    size = {i: len(re.findall(WORD, d[1] or "")) for i, d in docs.items()}
    own = {}
    for i, d in docs.items():
        own[d[3]] = own.get(d[3], 0) + size[i]
    names = sorted(k for k in own if k is not None) + [None]
    # shares by weight of one and a half times all words; what is above twice its size goes back to the others
    target, left, active = dict.fromkeys(names, 0.0), 1.5 * sum(own.values()), list(names)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    while active:
        share = {k: left * weight[k] / sum(weight[a] for a in active) for k in active}
        over = [k for k in active if share[k] > 2 * own[k]]
        target |= share if not over else {k: 2.0 * own[k] for k in over}
        left -= sum(2 * own[k] for k in over)
        active = [k for k in active if k not in over] if over else []
    taken = dict.fromkeys(names, 0)
    for i, n, source_size, goal, took in found["op6_mixing"]:
        assert n == size[i] and source_size == own[docs[i][3]] and abs(goal - target[docs[i][3]]) < 1e-6 and took in (0, n, 2 * n)
        taken[docs[i][3]] += took
    for k in names:
        room = [size[i] for i, d in docs.items() if d[3] == k and size[i]]
        assert abs(taken[k] - target[k]) <= (max(room) if max(room) > 1000 else max(min(room), 0.02 * target[k]))  # a source with one huge text can't come nearer
    assert mixing.water_fill([own[k] for k in names], [weight[k] for k in names], 1.5 * sum(own.values())) == pytest.approx([target[k] for k in names])


def test_jaccard_equals_brute_force(found, docs):
    assert set(found["op7_jaccard_join"]) == brute_components([(i, d[1]) for i, d in docs.items()], 4, 85)


def test_leaks_equal_brute_force(found, docs):
    items, expected = documents()[1], set()
    for (i, d), (k, item) in itertools.product(docs.items(), enumerate(items)):
        words, own = decontaminate.words_of(item), decontaminate.words_of(d[1])
        if len(own) < 2000 and d[1]:
            share = brute_tiles(words, own, decontaminate.MIN_MATCH) / len(words)
            if share >= decontaminate.COVERAGE:
                expected.add((i, k, round(share, 6)))
    assert {r[:3] for r in found["op8_decontaminate"]} == expected and len(expected) == 2


def test_tokens_equal_the_libraries(found, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    at = 0
    for i, start, n, crc in sorted(found["op3_token_planes"]):
        ids = np.array([*t.encode(docs[i][1] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (start, n, crc) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += n


def test_pieces_tile_their_documents_and_sequences(found, docs):
    from tokenizers import Tokenizer

    t, pieces, places = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), {}, {}
    for doc_id, piece, start, length, crc, sequence, offset in found["op11_packing"]:
        pieces.setdefault(doc_id, {})[piece] = (start, length, crc)
        places.setdefault(sequence, []).append((offset, length))
    for i, own in pieces.items():
        ids = np.array([*t.encode(docs[i][1] or "", add_special_tokens=False).ids, 1], "<u4")
        assert own == {k: (at, len(x := ids[at : at + 4096]), zlib.crc32(x.tobytes())) for k, at in enumerate(range(0, len(ids), 4096))}
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in itertools.pairwise(own)) and sum(own[-1]) <= 4096
    assert len(places) <= -(-sum(n for own in places.values() for _, n in own) // 4096) + 1


def test_quality_by_brute_force(found, docs):
    """The same model from least squares on whole matrices, and the isotonic curve as the largest of least means."""
    crc = lambda t: zlib.crc32(t.encode())
    ids = [i for i in sorted(docs) if i % 5 and crc(str(i)) % 3 != 1]
    x = np.array([quality.statistics((docs[i][1] or "").encode()) for i in ids])
    y, fold = np.array([i % 2 for i in ids], float), np.array([crc(f"fold{i}") % quality.FOLDS for i in ids])
    mean, spread = x.mean(0), np.maximum(np.where(x.std(0) == 0, 1.0, x.std(0)), 1e-6)
    r = np.random.default_rng(quality.SEED)
    w, b = r.standard_normal((x.shape[1], quality.FEATURES)) / np.sqrt(x.shape[1]), r.uniform(0, 2 * np.pi, quality.FEATURES)
    lift = lambda s: np.hstack([np.sqrt(2 / quality.FEATURES) * np.cos(np.clip((s - mean) / spread, -6, 6) @ w + b), np.ones((len(s), 1))])
    ridge = np.hstack([np.sqrt(quality.RIDGE) * np.eye(quality.FEATURES), np.zeros((quality.FEATURES, 1))])
    solve = lambda keep: np.linalg.lstsq(np.vstack([lift(x[keep]), ridge]), np.concatenate([y[keep], np.zeros(quality.FEATURES)]), rcond=None)[0]
    raw = np.array([(lift(x[k : k + 1]) @ solve(fold != fold[k]))[0] for k in range(len(ids))])
    bins = np.clip(((raw + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    at = np.unique(bins)
    place, n, sums = (at + 0.5) / quality.BINS * 2 - 0.5, np.array([(bins == k).sum() for k in at]), np.array([y[bins == k].sum() for k in at])
    part = lambda i, j: sums[i : j + 1].sum() / n[i : j + 1].sum()
    level = np.array([max(min(part(i, j) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]).round(12)
    curve = [(np.average(place[level == v], weights=n[level == v]), v) for v in np.unique(level)]
    whole = solve(np.ones(len(ids), bool))
    for i, _, score, _ in found["op1_quality"]:
        own = (lift(np.array([quality.statistics((docs[i][1] or "").encode())])) @ whole)[0]
        assert abs(score - np.interp(own, *zip(*curve, strict=True))) < 2e-4, i


def test_telephony_by_brute_force(found, docs):
    """Every column from the text alone: samples by the rules of the codings, one at a time."""
    def mulaw(code):
        code = ~code & 0xFF
        size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
        return -size if code & 0x80 else size

    def alaw(code):
        code ^= 0x55
        segment, low = code >> 4 & 7, (code & 15) << 4
        size = low + 8 if segment == 0 else low + 264 << segment - 1
        return size if code & 0x80 else -size

    for i, n_bytes, size, sha, tail, media_bytes, media_sha, feature in found["op9_telephony"]:
        raw = (docs[i][1] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (n_bytes, size, sha, tail) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        head = struct.pack("<HHIIHHH", 7, 1, 8000, 8000, 1, 8, 0)
        body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"fact" + struct.pack("<II", 4, len(payload)) + b"data" + struct.pack("<I", len(payload)) + payload
        media = b"RIFF" + struct.pack("<I", len(body)) + body
        assert (media_bytes, media_sha) == (len(media), hashlib.sha256(media).hexdigest())
        if len(payload) < 20_000:
            own = [mulaw(c) for c in payload]
            ends = [sum(v * v for v in slow_adpcm(payload[k : k + 64])) for k in range(0, len(payload), 64)]
            pcm = struct.pack(f"<{len(own)}h", *own)
            expected = f"samples={len(own)};energy={sum(v * v for v in own)};crossings={sum((a < 0) != (b < 0) for a, b in itertools.pairwise(own))};peak={max(map(abs, own))}"
            assert feature == f"{expected};alaw={sum(alaw(c) ** 2 for c in payload)};adpcm={sum(ends)};pcm={len(own)}:{zlib.crc32(pcm):08x}"


def test_unigram_counts_by_the_library(found, docs):
    from tokenizers import Tokenizer, models, normalizers

    from attestry.llm import unigram_count

    pieces = unigram_count.sentencepiece_pieces(tokenizer_path("piece_bpe_32k.model"))
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces, *((f"<0x{k:02X}>", 0.0) for k in range(256))], 0, True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("\u2581"), normalizers.Replace(" ", "\u2581")])
    for i, n in found["op10_unigram_count"]:
        text = docs[i][1]
        if not text or len(text) < 3000:
            assert n == (len(t.encode(text, add_special_tokens=False).ids) if text else 0), i
