"""The evaluation harness: cases, decisions as classes, challenge, sealed and acceptance metrics, verdicts, findings, generators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.text import compact_label
from attestry.operators.evaluate import rate

# Severities of failed checks; ranks of source tiers.
SEVERITY = {"decision_accuracy": "HIGH", "top_1": "HIGH", "recall_5": "HIGH", "forbidden": "CRITICAL", "boundary": "CRITICAL", "subject": "CRITICAL", "errors": "CRITICAL"}
TIER_RANKS = {"reviewed_formal": 0, "official_current": 10, "structured_current": 20, "historical": 100}


def decision_class(status: Column, ids: Column) -> Column:
    """error, more_input, abstain or retrieve."""
    return F.when(status == "error", "error").when(status == "more_input_needed", "more_input").when(F.size(ids) == 0, "abstain").otherwise("retrieve")


def candidate_class(expected: Column, acceptable: Column, forbidden: Column, candidate: Column) -> Column:
    return F.when((expected == "retrieve") & F.array_contains(acceptable, candidate), "acceptable").when(F.array_contains(forbidden, candidate), "forbidden").otherwise("unlisted")


def returned(cases: DataFrame) -> DataFrame:
    """One row a returned candidate with its place and class. cases: case_id, expected, acceptable, forbidden, observed, …"""
    rows = cases.select("*", F.posexplode("observed").alias("place", "source_id")).drop("observed")
    return rows.withColumn("class", candidate_class(F.col("expected"), F.col("acceptable"), F.col("forbidden"), F.col("source_id")))


def challenge_metrics(cases: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: counts of returned candidates by class and violation, decision accuracy, recall and reciprocal rank over the retrieval cases.

    cases also has status, boundary and subject_type as the request states them; catalog has source_id, boundary and subject_type.
    """
    c = catalog.select("source_id", F.col("boundary").alias("own_boundary"), F.col("subject_type").alias("own_subject"))
    rows = returned(cases).join(c, "source_id", "left")
    listed = rows.agg(F.count("*").alias("returned"), *[F.count_if(F.col("class") == k).alias(k) for k in ("acceptable", "forbidden", "unlisted")], F.count_if(F.col("own_boundary") != F.col("boundary")).alias("boundary_violations"), F.count_if(F.col("own_subject") != F.col("subject_type")).alias("subject_violations"), F.count_if(F.col("own_subject").isNull()).alias("unknown_ids"))
    place = F.array_min(F.filter(F.transform("acceptable", lambda a: F.array_position("observed", a)), lambda p: p > 0))
    wanted = F.col("expected") == "retrieve"
    observed = decision_class(F.col("status"), F.col("observed"))
    per = cases.withColumns({"place": place, "decision": observed})
    hit = lambda k: rate(F.count_if(wanted & (F.col("place") <= k)), F.count_if(wanted))
    whole = per.agg(F.count("*").alias("cases"), rate(F.count_if(F.col("decision") == F.col("expected")), F.count("*")).alias("decision_accuracy"), hit(1).alias("recall_1"), hit(3).alias("recall_3"), hit(5).alias("recall_5"), F.avg(F.when(wanted, F.coalesce(1.0 / F.col("place"), F.lit(0.0)))).alias("mrr"), F.count_if(F.col("decision") == "error").alias("errors"))
    return whole.join(F.broadcast(listed))  # one row each


def sealed_metrics(results: DataFrame) -> DataFrame:
    """One row over results (answerable, passed, top_1, recall, abstained, escaped, replayed, dimension, http_status): rates by kind of case, violations by dimension."""
    share = lambda test, of: F.coalesce(rate(F.count_if(of & test), F.count_if(of)), F.lit(0.0))
    asked = F.col("answerable")
    return results.agg(
        F.count("*").alias("cases"), F.count_if(asked).alias("answerable"), F.count_if("passed").alias("passed"), share(F.col("top_1"), asked).alias("top_1"), share(F.col("recall"), asked).alias("recall"), share(F.col("abstained"), ~asked).alias("abstention"),
        *[F.count_if((F.col("dimension") == d) & F.col("escaped")).alias(f"{d}_violations") for d in ("boundary", "subject", "unit")], F.count_if("escaped").alias("escapes"), share(F.col("replayed"), F.lit(True)).alias("replay"), F.count_if(F.col("http_status") >= 500).alias("unhandled"),
    )


def acceptance_metrics(results: DataFrame) -> DataFrame:
    """One row of micro-averages over results (recalled, candidates, wrong, abstention_correct, expected_more_input, status, evidence_sum, evidence_count): null without a denominator."""
    more, asked = F.col("expected_more_input"), F.col("status") == "more_input_needed"
    return results.agg(
        F.count("*").alias("cases"), rate(F.count_if("recalled"), F.count("recalled")).alias("recall_at_5"), F.coalesce(rate(F.sum("wrong"), F.sum("candidates")), F.lit(0.0)).alias("wrong_rate"), rate(F.count_if("abstention_correct"), F.count("abstention_correct")).alias("abstention_rate"),
        rate(F.count_if(more & asked), F.count_if(more)).alias("more_input_recall"), rate(F.count_if(~more & ~asked), F.count_if(~more)).alias("more_input_specificity"), rate(F.sum("evidence_sum"), F.sum("evidence_count")).alias("evidence_completeness"), F.count_if(F.col("status") == "error").alias("errors"),
    )


def case_passed() -> Column:
    """Verdict of a case: equal status, nothing forbidden among what can be selected, references only shown for review, the wanted first id, one acceptable id, a whole trace."""
    chosen = F.array_union("primary", "reviewable")
    first = F.col("expected_top").isNull() | F.coalesce(F.get("primary", F.lit(0)) == F.col("expected_top"), F.lit(False))
    return (
        (F.col("status") == F.col("expected_status")) & ~F.arrays_overlap("forbidden", chosen) & (F.size(F.array_except("references", "reviewable")) == 0) & first
        & ((F.size("acceptable") == 0) | F.arrays_overlap("acceptable", chosen)) & F.col("trace_complete")
    )


def replay_signature(*columns: str) -> Column:
    """Digest of what must not change when a request is resolved again."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def replays(first: DataFrame, second: DataFrame, key: str, *columns: str) -> DataFrame:
    """Keys with whether both runs say the same; a run that lacks the key doesn't."""
    a, b = (df.select(key, replay_signature(*columns).alias(n)) for df, n in ((first, "a"), (second, "b")))
    return a.join(b, key, "full_outer").select(key, F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same"))


def alias_baseline(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """The plain retriever that others are measured against: equal compact labels of names or aliases. requests: request_id, name; catalog: source_id, name, aliases."""
    c = catalog.select("source_id", F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), compact_label))).alias("label")).where("label <> ''")
    q = requests.groupBy("request_id").agg(F.collect_set(compact_label(F.col("name"))).alias("labels"))
    # both sides are distinct, and a pair counts at the first label that it has in common: no pairs are kept to be compared
    c = c.groupBy("source_id").agg(F.collect_set("label").alias("own"))
    met = q.select("request_id", "labels", F.explode("labels").alias("label")).join(c.select("source_id", "own", F.explode("own").alias("label")).hint("merge"), "label")
    return met.where("label = array_min(array_intersect(labels, own))").select("request_id", "source_id")


def findings(checks: DataFrame) -> DataFrame:
    """Open findings of failed checks (metric, ok) with their severity; HIGH for checks without one."""
    known = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return checks.where(~F.coalesce("ok", F.lit(False))).select(F.concat(F.lit("FINDING-"), F.upper("metric")).alias("finding"), F.coalesce(F.try_element_at(known, F.col("metric")), F.lit("HIGH")).alias("severity"), F.lit("OPEN").alias("state"))


def evidence_presence(fields: list[str]) -> Column:
    """Share of fields that hold more than blanks."""
    out = F.lit(0)
    for f in fields:
        out = out + F.when(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) != "", 1).otherwise(0)
    return out / len(fields)


def evidence_gate(reasons: Column, required: Column, evidence_id: Column, steps: Column, has_candidates: Column) -> Column:
    """What became of unit evidence. ``reasons``, ``required`` and ``steps`` are arrays."""
    wanted = F.array_contains(reasons, "UNIT_CONVERSION_EVIDENCE_REQUIRED")
    return (
        F.when(wanted, F.when(F.array_contains(required, "unit_conversion_evidence"), "required").otherwise("missing_diagnostic"))
        .when(evidence_id.isNotNull() & has_candidates, F.when(F.array_contains(steps, evidence_id), "passed").otherwise("missing_lineage"))
        .otherwise("not_applicable")
    )


def tier_rank(tier: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in TIER_RANKS.items() for x in kv]), tier)


def readiness(components: DataFrame) -> DataFrame:
    """Per group of components (system, required, healthy): not_ready without a required one, degraded without an optional one, else ready."""
    per = components.groupBy("system").agg(F.count_if(F.col("required") & ~F.col("healthy")).alias("missing_required"), F.count_if(~F.col("required") & ~F.col("healthy")).alias("missing_optional"))
    return per.withColumn("status", F.when(F.col("missing_required") > 0, "not_ready").when(F.col("missing_optional") > 0, "degraded").otherwise("ready"))


#: Perturbations of a case: name and what changes in the request.
TEMPLATES = {"plain": {}, "other_year": {"year": 1901}, "other_place": {"geography": "NOWHERE"}, "no_unit": {"quantity_unit": "stone"}, "no_boundary": {"boundary": "use phase"}}


def generated_cases(records: DataFrame) -> DataFrame:
    """Every record under every template: case id, request columns, what is expected. records: source_id, material_name, geography, year, boundary, quantity_unit."""
    rows = None
    for name, change in TEMPLATES.items():
        own = records.select(F.concat_ws(":", "source_id", F.lit(name)).alias("case_id"), "source_id", "material_name", *[F.lit(change[c]).cast(t).alias(c) if c in change else F.col(c) for c, t in (("geography", "string"), ("year", "int"), ("boundary", "string"), ("quantity_unit", "string"))], F.lit("retrieve" if not change else "abstain").alias("expected"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


def scale_catalog(spark: SparkSession, n: int, target: str = "target") -> DataFrame:
    """``n`` noise records and one target, for throughput runs; made where it is read, not on the driver."""
    noise = spark.range(n).select(F.concat(F.lit("N-"), F.col("id").cast("string")).alias("source_id"), F.concat(F.lit("noise material "), F.sha2(F.col("id").cast("string"), 256)).alias("material_name"), (1.0 + F.col("id") % 97 / 100.0).alias("factor_value"))
    return noise.unionByName(spark.range(1).select(F.lit("T-0").alias("source_id"), F.lit(target).alias("material_name"), F.lit(1.5).alias("factor_value")))
