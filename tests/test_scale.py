"""Selection, as-of merge, containment, digests and identities against brute force, with bounds set so low that every step is taken."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from attestry.functions.text import normal_sql
from attestry.operators import asof, evaluate, identity, proxy, score, trace


def test_quantiles_equal_sorted_lists(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "FEW", 40)
    monkeypatch.setattr(evaluate, "BUCKETS", 8)
    r = random.Random(5)
    groups = {"one": [3.5], "same": [2.0] * 500, "wide": [r.choice([-1, 1]) * 10 ** r.uniform(-300, 300) for _ in range(700)], "near": [1.0 + k * 2**-52 for k in range(900)], "skew": [r.choice([0.0, 0.0, 0.0, 1e-9, 5.0, 5.0, r.random()]) for _ in range(1500)], None: [float(k) for k in range(333)]}
    rows = [(g, v) for g, own in groups.items() for v in own] + [("one", None), ("one", math.nan), ("skew", math.inf), ("void", None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double")
    ranks = {"first": "0", "third": "floor((n - 1) / 3.0)", "last": "n - 1", "p95": "floor((n - 1) * 0.95D + 0.5D)"}
    found = {x["g"]: x for x in evaluate.selected(df, ["g"], "v", ranks).collect()}
    assert set(found) == set(groups)
    for g, own in groups.items():
        own, n = sorted(own), len(own)
        assert found[g]["n"] == n and [found[g][k] for k in ranks] == [own[0], own[int((n - 1) / 3.0)], own[-1], own[math.floor((n - 1) * 0.95 + 0.5)]], g
    assert evaluate.percentiles(df.limit(0), ["g"], "v", 0.95).count() == 0


def test_neighbours_equal_brute_force(spark):
    r = random.Random(8)
    anchors = {(s, v): f"{s}{v}" for s in "abc" for v in {round(r.uniform(-5, 30), r.choice([0, 1, 2])) for _ in range(25)}}
    wanted = [(r.choice("abcd"), round(r.uniform(-40, 60), r.choice([0, 1]))) for _ in range(300)] + [(None, 1.0), ("a", None)]
    a = spark.createDataFrame([(s, v, x) for (s, v), x in anchors.items()] + [(None, 2.0, "x"), ("a", None, "y")], "s string, v double, item string")
    for width in (1.0, 7.0, 1000.0):
        found = {(x["s"], x["v"]): (x["below"] and x["below"]["at"], x["above"] and x["above"]["at"], x["below"] and x["below"]["item"]) for x in asof.neighbours(spark.createDataFrame(wanted, "s string, v double"), a, ["s"], "v", width).collect()}
        expected = {}
        for s, v in wanted:
            if s is not None and v is not None:
                own = [x for k, x in anchors if k == s]
                low, high = max((x for x in own if x <= v), default=None), min((x for x in own if x >= v), default=None)
                expected[s, v] = (low, high, anchors.get((s, low)))
        assert found == expected


def test_containment_equals_brute_force(spark):
    r = random.Random(2)
    text = lambda n: "".join(r.choice("abc 铝") for _ in range(n))
    hays, needles = [text(r.randint(0, 12)) for _ in range(200)], [text(r.randint(0, 5)) for _ in range(80)] + ["zz", None]
    found = {tuple(x) for x in proxy.contained(spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame([(x,) for x in [*hays, None]], "hay string")).collect()}
    assert found == {(n, h) for n in needles if n for h in hays if n in h}


def test_table_digest_is_a_tree(spark):
    rows = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(300)]
    df = spark.createDataFrame([(x,) for x in rows + rows[:3]], "d string")
    level = sorted((x, x) for x in rows + rows[:3])
    for k in trace.LEVELS:
        groups = {}
        for key, d in level:
            groups.setdefault(key[:k], []).append((key, d))
        level = sorted((key, hashlib.sha256(":".join(d for _, d in sorted(own)).encode()).hexdigest()) for key, own in groups.items())
    assert [tuple(x) for x in trace.table_digest(df.orderBy(F.rand(1)), F.col("d")).collect()] == [(level[0][1], 303)]
    assert [x["rows"] for x in trace.table_digest(df.limit(0), F.col("d")).collect()] == [0]


MATERIALS = "rule_id string, status string, aliases array<string>, entity_id string, entity_type string, head_material string, family string, category string, formula string, product_entity_id string, product_family_id string, route string, confidence double, constituents array<string>"


@pytest.fixture(scope="module")
def registry(spark):
    def rule(rule_id, aliases, entity, kind="ELEMENTAL_METAL", head="x", product=None, family=None, parts=(), route=None, status="active"):
        return (rule_id, status, aliases, entity, kind, head, f"{head}_products", "metal", None, product, family, route, 0.9, list(parts))

    materials = [
        rule("m.steel", ["steel", "钢"], "mat.iron", head="steel"), rule("m.al", ["aluminium", "铝"], "mat.element.aluminium", head="aluminium", family="family.aluminium_products"),
        rule("m.primary", ["primary aluminium"], "mat.element.aluminium", head="aluminium", product="mat.product.primary_aluminium", family="family.aluminium_products", route="primary"),
        rule("m.mgo", ["magnesia", "mgo"], "mat.mgo", "OXIDE", "magnesia"), rule("m.sic", ["silicon carbide", "sic"], "mat.sic", "CHEMICAL_COMPOUND", "sic"), rule("m.zm", ["zircon mullite"], "mat.zm", "COMPOSITE", "zm", parts=("mat.z", "mat.m")),
        rule("m.gate", ["sliding gate"], "mat.gate", "PRODUCT_FAMILY", "gate"), rule("m.draft", ["unobtainium"], "mat.draft", status="draft"),
    ]
    processes = [("p.fused", "active", ["fused", "电熔"], "fusion"), ("p.fused2", "active", ["fused magnesia"], "magnesia fusion"), ("p.off", "draft", ["cast"], "casting")]
    forms = [("f.fiber", "active", ["fiber", "纤维"], "fiber"), ("f.brick", "active", ["brick"], "brick")]
    schemas = [("g.mgo", "active", 10, ["mat.mgo"], "component.MgO", [90.0, 95.0, 97.0], []), ("g.label", "active", 20, ["mat.mgo"], "component.MgO", [78.0], ["ar"])]
    return identity.Registry(
        spark.createDataFrame(materials, MATERIALS), spark.createDataFrame(processes, "rule_id string, status string, aliases array<string>, process string"), spark.createDataFrame(forms, "rule_id string, status string, aliases array<string>, product_form string"),
        spark.createDataFrame(schemas, "schema_id string, status string, priority int, entity_ids array<string>, basis string, labels array<double>, prefixes array<string>"),
    )


def test_identities(spark, registry):
    names = [
        ("Primary Aluminium ingot", None, None, None), ("aluminium", None, None, None), ("铝锭", None, None, None), ("含铝物", None, None, None), ("MgO-SiC brick", None, None, None), ("zircon mullite", None, None, None), ("sliding gate", None, None, None), ("unobtainium", None, None, "cast"),
        ("steel fiber", None, None, None), ("steel fiber copper plated", None, None, None), ("AISI 446 steel fiber", None, None, None), ("fused magnesia 97", None, None, None), ("fused magnesia F90 2024", None, "MgO ≥ 95 %", None), ("magnesia 90 97", None, None, None), ("magnesia ar78", None, None, None), ("magnesia 80", None, None, None), ("钢纤维", "Fiber", None, "电熔"), (None, None, None, None),
    ]
    found = {x["material_name"]: x for x in identity.resolve(spark.createDataFrame(names + names[:3], "material_name string, product_form string, composition string, production_process string"), registry).collect()}
    assert len(found) == len(names)
    at = lambda name, *fields: tuple(found[name][f] for f in fields)
    assert at("Primary Aluminium ingot", "base_entity_id", "product_entity_id", "route", "allowed_products") == ("mat.element.aluminium", "mat.product.primary_aluminium", "primary", ["mat.product.primary_aluminium"])
    assert at("aluminium", "product_entity_id", "allowed_products", "intent_aliases") == (None, ["mat.product.primary_aluminium", "mat.product.secondary_aluminium"], ["铝"])
    assert at("铝锭", "base_entity_id", "outcome") == ("mat.element.aluminium", "RESOLVED") and at("含铝物", "base_entity_id", "outcome") == (None, "UNKNOWN")
    assert at("MgO-SiC brick", "base_entity_id", "entity_type", "resolved_form", "constituents") == ("composite:mat.mgo+mat.sic", "COMPOSITE", "brick", ["mat.mgo", "mat.sic"])
    assert at("zircon mullite", "base_entity_id", "proof") == ("composite:mat.m+mat.z", "COMPOSITE_CONSTITUENTS")
    assert at("sliding gate", "unresolved", "base_entity_id") == (["product_variant"], "mat.gate") and at("unobtainium", "outcome", "resolved_process") == ("UNKNOWN", "cast")
    assert at("steel fiber", "unresolved") == (["steel_fiber_type", "steel_grade_or_family", "surface_coating", "application"],) and at("steel fiber copper plated", "unresolved", "surface_coating") == ([], "copper")
    assert at("AISI 446 steel fiber", "unresolved", "grade", "application", "material_family") == (["manufacturing_route", "alloy_grade"], "aisi 446", "high_temperature_refractory", "ferritic_stainless_steel")
    assert at("fused magnesia 97", "grade", "grade_value", "resolved_process", "process_rule") == ("g.mgo:97", 97.0, "magnesia fusion", "p.fused2")
    name = "fused magnesia F90 2024"
    assert at(name, "grade", "grade_kind", "intent_aliases") == ("g.mgo:95", "explicit_composition", []) and [(t["role"], t["raw"].strip()) for t in found[name]["numeric_tokens"]] == [("grit_size", "f90"), ("year", "2024")]
    assert at("magnesia 90 97", "grade", "unresolved") == (None, ["numeric_grade_basis"]) and at("magnesia 80", "grade", "unresolved") == (None, ["numeric_grade_basis"]) and at("magnesia ar78", "grade") == ("g.label:78",)
    assert at("钢纤维", "base_entity_id", "resolved_form", "resolved_process") == ("mat.iron", "fiber", "fusion") and at(None, "outcome", "canonical_name") == ("UNKNOWN", "")


def test_stated_ids_stay(spark, registry):
    df = spark.createDataFrame([(1, "aluminium", None, None), (2, "aluminium", "mat.other", None), (3, "aluminium", None, "p.own"), (4, "no such", None, None)], "id int, material_name string, base_entity_id string, product_entity_id string")
    df = df.withColumns({k: F.lit(None).cast("string") for k in ("product_form", "composition", "production_process")})
    found = {x["id"]: (x["base_entity_id"], x["product_entity_id"], x["allowed_products"]) for x in identity.identified(df, identity.resolve(df, registry)).collect()}
    both = ["mat.product.primary_aluminium", "mat.product.secondary_aluminium"]
    assert found == {1: ("mat.element.aluminium", None, both), 2: ("mat.other", None, []), 3: ("mat.element.aluminium", "p.own", ["p.own"]), 4: (None, None, [])}


def test_material_score_reads_aliases(spark):
    words = "array('x')"
    df = spark.sql(f"select * from values ('a', array('b c'), 'b c'), ('a', array('b'), 'b c'), ('a', array('q'), 'b c'), ('b c d', array(), 'b c') as t(q_norm, q_alias_norms, c_norm)").selectExpr("*", f"{words} as q_t_material", "array('y') as c_t_material", "cast(null as string) as q_base_entity_id", "'e' as c_base_entity_id")
    assert [x[0] for x in df.select(F.expr(score.material_score())).collect()] == [1.0, 0.8, 0.0, 0.8]


def test_classes(spark):
    df = spark.createDataFrame([("ore of tin", "", "quarried"), ("blank", "ABS plastic", ""), ("铝 fused", None, None), ("x", "Oak", None), (None, None, None)], "n string, c string, p string").selectExpr(*[f"{normal_sql(k)} as {k}" for k in "ncp"])
    assert [(x["family"], x["category"]) for x in df.select(F.expr(proxy.material_class("n", "c", "p")).alias("k")).select("k.*").collect()] == [("natural minerals", "natural_mineral"), ("polymers", "synthetic_chemical"), ("metals", "metal"), ("oak", "unknown"), ("unknown", "unknown")]


def test_decisions_as_sets_equal_the_store(spark):
    """Random saves, decisions and locks one after another in the review store, and all at once as a table."""
    from attestry.operators import decisions
    from attestry.operators.review import ReviewError, ReviewStore, StaleRevision

    said = {"exists": "run_exists", "no run": "no_run", "another decision": "another_decision", "nothing selectable": "nothing_selectable", "a reference needs": "override_required", "assumptions": "acceptance_required", "only an approved": "not_approved"}
    r, store, rows, expected = random.Random(4), ReviewStore(), [], {}
    for seq in range(1500):
        request, kind = f"r{r.randrange(150)}", r.choice(["save", "decide", "decide", "decide", "lock"])
        status, tier, candidate = r.choice(["recommendation_ready", "reference_review_required", "unresolved"]), r.choice(["PRIMARY_RECOMMENDATION", "REFERENCE_ONLY", "USABLE_WITH_ASSUMPTIONS"]), r.choice(["c1", "c2", "c2", "c2", None])
        wanted, approve, mode, accepted, reason = r.choice([1, 1, 1, 2]), r.random() < 0.7, r.choice(["standard", "override"]), r.random() < 0.6, r.choice(["", "why"])
        rows.append((request, seq, kind, status, tier, candidate, wanted, approve, mode, accepted, reason))
        try:
            before = store.revision(request) if kind != "save" else 0
            if kind == "save":
                store.save(request, status, tier, candidate)
            elif kind == "decide":
                store.decide(request, wanted, approve, mode, accepted, reason)
            else:
                store.lock(request)
            after = store.revision(request)
            expected[seq] = ("applied", after) if after > before else ("replayed", None)
        except StaleRevision:
            expected[seq] = ("stale", None)
        except ReviewError as e:
            expected[seq] = (next(v for k, v in said.items() if k in str(e)), None)
    df = spark.createDataFrame(rows, "request_id string, seq int, kind string, status string, tier string, candidate string, expected int, approve boolean, mode string, accepted boolean, reason string")
    assert {x["seq"]: (x["outcome"], x["revision"]) for x in decisions.played(df.orderBy(F.rand(2))).collect()} == expected
    assert {v for v, _ in expected.values()} == {*said.values(), "applied", "replayed", "stale"}
    assert {x["request_id"]: x["revision"] for x in decisions.states(df).collect()} == {k: len(run.trace) for k, run in store._runs.items()}
    assert decisions.played(df.limit(0)).count() == 0
