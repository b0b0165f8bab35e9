"""Invariants: shuffled catalogues, noise, totality of decisions, unit round trips, stores, files, streaming."""

import difflib
import json
import random
import threading

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestry import __main__ as cli
from attestry.functions import text, units
from attestry.operators import catalog, decide, registry, retrieve, trace
from attestry.operators.review import ReviewError, ReviewStore, StaleRevision
from attestry.plans import domain
from attestry.sources import files
from attestry.streaming.resolve import resolve_stream

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_decisions_do_not_depend_on_order_or_noise(spark):
    q, c = domain.requests(spark, SF).limit(60).cache(), domain.catalog(spark, SF)
    plain = rows(decide.decide(q, c))
    assert plain == rows(decide.decide(q.repartition(3), c.orderBy(F.rand(3)).repartition(7)))
    noise = c.withColumns({k: F.concat(F.lit("noise "), k) for k in ("source_id", "material_name", "alias", "base_entity_id")})
    assert plain == rows(decide.decide(q, c.unionByName(noise)))
    assert {r[1] for r in plain} <= set(decide.STATUSES) and len(plain) == 60


def test_unit_pairs_round_trip(spark):
    names = spark.createDataFrame([(k,) for k, *_ in units.ACTIVITY], "u string").withColumn("s", units.activity_unit("u"))
    both = names.select(F.col("u").alias("a"), F.col("s").alias("x"), F.explode(F.array(*[F.lit(k) for k, *_ in units.ACTIVITY])).alias("b"))
    both = both.withColumn("y", units.activity_unit("b"))
    there, back = units.activity_plan("x", "y"), units.activity_plan("y", "x")
    for m, n, r in both.select(there["multiplier"], back["multiplier"], there["reason"]).collect():
        assert (m is None) == (r is not None)
        assert m is None or abs(m * n - 1) < 1e-9


@settings(max_examples=60, deadline=None)
@given(st.text("abcde ", max_size=12), st.text("abcde ", max_size=12))
def test_indel_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert text._lcs(a, b) == table[-1][-1]


def test_unicode_folding_and_numbers(spark):
    df = spark.createDataFrame([("Ｓtraße－９９％",), (None,)], "t string")
    assert [r[0] for r in df.select(text.normalize_unicode(F.col("t"))).collect()] == ["strasse 99%", None]
    found = spark.createDataFrame([("alumina 99.5% 0~1 mm GB/T 175 grade 85",)], "t string").select(text.numeric_tokens("t")).first()[0]
    assert {(r["value"], r["role"]) for r in found} >= {(99.5, "percent"), (85.0, "label"), (0.0, "range")}


def test_registry_prefers_long_matches_without_overlap(spark):
    names = spark.createDataFrame([("hot rolled steel sheet",), ("steely",), ("",)], "name string")
    rules = spark.createDataFrame([("a", "steel", "active"), ("b", "rolled steel", "active"), ("c", "sheet", "active"), ("d", "hot", "draft")], "rule_id string, alias string, status string")
    found = registry.match_rules(names, rules)
    assert rows(found.select("name", "rule_id")) == [("hot rolled steel sheet", "b"), ("hot rolled steel sheet", "c")]
    assert rows(registry.best_rule(found)) == [("hot rolled steel sheet", "b")]


def test_registry_equals_brute_force(spark):
    own = [("r", "ring"), ("s", "steel"), ("t", "anvil"), ("u", "热轧"), ("v", "a.b"), ("w", "ring ring"), ("x", "-"), ("y", "😀"), ("z", "bolt"), ("q", "steel"), ("p", "😀y"), ("o", "steel-steel"), ("n", "钢"), ("m", "钢a")]
    r = random.Random(4)
    names = ["string ring", "steel/bolt, steel", "blue anvil, red", "热轧steel板", "热轧板", "a.b a.b", "ring ring ring", "--", "steely", "x😀y", "blue-steel, steel bar steel", "钢", "金属钢x", "钢板 钢", "x钢ab", "不锈钢", "钢纤维"]
    names += ["".join(r.choice([*[a for _, a in own], " ", "-", "x", "热", ", ", "板", "金属"]) for _ in range(r.randint(1, 7))) for _ in range(60)]

    def brute(name):
        edge = lambda i: not (0 <= i < len(name) and name[i].isascii() and name[i].isalnum())
        beside = lambda i: len(name) == 1 or name[:i].endswith("金属") or name[i + 1 :].startswith(registry.SINGLE_AFTER)
        fits = lambda a, i: (len(a) > 1 or beside(i)) if any("一" <= c <= "鿿" for c in a) else edge(i - 1) and edge(i + len(a))
        found = [(-len(a), i, k) for k, a in own for i in range(len(name)) if name.startswith(a, i) and fits(a, i)]
        kept = []
        for n, i, k in sorted(found):
            if all(i >= j - m or j >= i - n for m, j, _ in kept):
                kept.append((n, i, k))
        return {(name, k, i, -n) for n, i, k in kept}

    rules = spark.createDataFrame([(i, a, "active") for i, a in own], "rule_id string, alias string, status string")
    found = {tuple(x) for x in registry.match_rules(spark.createDataFrame([(n,) for n in [*names, "", names[0]]], "name string"), rules).collect()}
    assert found == set().union(*map(brute, names)) and ("blue-steel, steel bar steel", "q", 12, 5) in found


def test_lexical_observations_equal_brute_force(spark):
    r = random.Random(6)
    names = ["abcdefg", "axbxcxdxexfxg", "axbcyde", "abzcdwe", "a", "b", "ab", "ba", "a b", "steel bar", "bar steel", "steal bar", "铝 锭", "锭 铝", "铝锭", "铝", "钢 x 5+", "5+ 铝 x", "c++ 钢"]
    names += ["".join(r.choice("abcd ") for _ in range(r.randint(1, 12))).strip() or "x" for _ in range(70)]
    names = sorted({" ".join(n.split()) for n in names})
    df = spark.createDataFrame([(n,) for n in names], "n string")

    def score(a, b):
        f = lambda t: set(t.split()) | {t[i : i + 2] for i in range(len(t) - 1)}
        both = f(a) | f(b)
        return round(max(len(f(a) & f(b)) / len(both) if both else 0.0, text._lcs(a, b) / (len(a) + len(b))), 6)

    admitted = [(names[3], names[4]), (names[0], names[0])]
    expected = set()
    for a in names:
        own = sorted(((-score(a, b), b) for b in names if (a, b) not in admitted and score(a, b) >= 0.35))[:5]
        expected |= {(a, b, -s) for s, b in own}
    found = retrieve.lexical_observations(df, df, "n", "n", "n", "n", spark.createDataFrame(admitted, "a_id string, b_id string"))
    assert {(x["a_id"], x["b_id"], x["score"]) for x in found.collect()} == expected


def test_chain_detects_a_change(spark):
    events = spark.createDataFrame([("r", i, f"e{i}") for i in range(6)], "k string, n int, body string")
    links = trace.chain(events, "k", ["n"], trace.entry_text("body"))
    assert rows(trace.verify(links).select("gapless", "linked", "hashed")) == [(True, True, True)]
    broken = links.withColumn("content", F.when(F.col("revision") == 3, "other").otherwise(F.col("content")))
    assert rows(trace.verify(broken).select("linked", "hashed")) == [(True, False)]


def test_review_store_compare_and_set():
    store = ReviewStore()
    store.save("r", "recommendation_ready", "PRIMARY_RECOMMENDATION", "c")
    with pytest.raises(StaleRevision):
        store.decide("r", 9, True)
    wins, losses = [], []

    def go(k):
        try:
            wins.append(store.decide("r", 1, True, reason=str(k)))
        except ReviewError:
            losses.append(k)

    threads = [threading.Thread(target=go, args=(k,)) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(wins) == 1 and len(losses) == 7
    assert store.lock("r") == store.lock("r")
    store.save("s", "recommendation_ready", "REFERENCE_ONLY", "c")
    with pytest.raises(ReviewError):
        store.decide_latest("s", approve=True)
    assert store.decide_latest("s", approve=True, mode="override", reason="seen")["approve"]


def test_review_log_survives(tmp_path):
    path = str(tmp_path / "log")
    store = ReviewStore(path)
    store.save("r", "recommendation_ready", "PRIMARY_RECOMMENDATION", "c")
    store.save("s", "unresolved", "", None)
    store.decide("r", 1, True)
    with open(path, "ab") as log:
        log.write(b'{"request_id": "t", "entr')  # a crash in the middle of a line
    again = ReviewStore(path)
    assert again.revision("r") == 2 and again.decide("r", 2, True) and again.lock("r")["candidate"] == "c"
    with pytest.raises(ReviewError):
        again.revision("t")
    assert ReviewStore(path).lock("r") == again.lock("r")
    damaged = open(path, "rb").read().replace(b"unresolved", b"unresolvex")
    open(path, "wb").write(damaged)
    with pytest.raises(ReviewError):
        ReviewStore(path)


def test_command_line(spark, tmp_path):
    domain.requests(spark, SF).limit(15).write.parquet(str(tmp_path / "q"))
    domain.catalog(spark, SF).write.parquet(str(tmp_path / "c"))
    domain.flows(spark, SF).write.parquet(str(tmp_path / "f"))
    cli.main(["resolve", str(tmp_path / "q"), str(tmp_path / "c"), str(tmp_path / "out"), "--flows", str(tmp_path / "f")], spark)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 15
    with pytest.raises(SystemExit):
        cli.main(["query", "nothing", SF, str(tmp_path / "x")], spark)


def test_json_and_matching_blocks(spark):
    df = spark.createDataFrame([('{"a": [{"b": 1}, [2, 3, 4]], "a": 2}', "abcd efgh", "efgh abcd"), ("[]", "", ""), ("no json", "x", "y"), (None, None, "y")], "t string, a string, b string")
    shape = [tuple(r) for r in df.select(text.json_complexity(F.col("t")).alias("x")).select("x.*").collect()]
    assert shape == [(0 + 1, 1, 0), (0, 0, 0), (None, None, None), (None, None, None)]
    assert [r[0] for r in df.select(text.all_keys(F.col("t"))).collect()] == [["a"], [], [], []]
    score = [r[0] for r in df.select(text.challenge_score(F.coalesce("a", F.lit("")), F.col("b"))).collect()]
    ratio = difflib.SequenceMatcher(None, "abcd efgh", "efgh abcd", autojunk=False).ratio()
    assert score[0] == pytest.approx(0.75 * ratio + 0.25) and score[1] == 1.0 and score[2] == 0.0


def test_catalog_files(spark, tmp_path):
    body = {"catalog_version": "1", "database": {"name": "d", "sha256": "x"}, "records": [{"record_id": "a", "name": "n", "primary_value": 1.5, "primary_unit": "kg", "source_quality_status": "VERIFIED"}, {"code": "b", "name": "m", "primary_value": "bad", "primary_unit": ""}]}
    (tmp_path / "c.json").write_text(json.dumps(body))
    good, bad = catalog.split_valid(files.read_catalog(spark, str(tmp_path / "c.json")))
    assert [(r["record_id"], r["value"]) for r in good.collect()] == [("a", 1.5)]
    assert [r["reasons"] for r in bad.collect()] == [["primary_value_missing_or_invalid", "primary_unit_missing", "record_validation_failed"]]
    (tmp_path / "cases.jsonl").write_text('{"case_id": "1", "q": "x"}\n\n{"case_id": "1", "q": "y"}\n')
    cases = files.read_cases(spark, str(tmp_path / "cases.jsonl"), "case_id string, q string")
    assert cases.count() == 2 and rows(files.repeated_keys(cases, "case_id")) == [("1", 2)]
    decisions = spark.createDataFrame([("r", ["a", "b"]), ("s", [])], "request_id string, ids array<string>")
    files.write_bundle(decisions, "ids", str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out/candidates")).count() == 3
    assert files.manifest(spark, str(tmp_path / "c.json")).first()["bytes"] == len(json.dumps(body))
    files.write_energy({"quota": decisions}, f"file://{tmp_path}/energy")
    files.write_energy({"quota": decisions.limit(1)}, f"file://{tmp_path}/energy")
    assert files.read_energy(spark, f"file://{tmp_path}/energy", ["quota"])["quota"].count() == 1
    (tmp_path / "energy").rename(tmp_path / "energy.old")  # as if a writer had stopped between its renames
    assert files.read_energy(spark, f"file://{tmp_path}/energy", ["quota"])["quota"].count() == 1


def test_stream_equals_batch(spark, tmp_path):
    q, c = domain.requests(spark, SF).limit(20).withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp")), domain.catalog(spark, SF)
    q.unionByName(q).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "in"))
    resolve_stream(stream, c, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    own = spark.read.parquet(str(tmp_path / "in")).drop("at").dropDuplicates(["request_id"])
    assert rows(spark.read.parquet(str(tmp_path / "out")).drop("batch")) == rows(decide.decide(own, c))
