"""Catalogue hygiene: per-record diagnostics, strict fields, policy inheritance, set operations, perturbation, material classes, accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.text import blank, normalize, word_contains


def diagnose(raw: DataFrame) -> DataFrame:
    """raw: record_id, name, primary_value (text), primary_unit, source_quality_status. Adds ``value`` and the ordered ``reasons``; bad rows never fail the scan."""
    value = F.col("primary_value").cast("string").try_cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    reasons = F.array_compact(F.array(
        F.when(~F.coalesce(finite, F.lit(False)), F.lit("primary_value_missing_or_invalid")),
        F.when(blank(F.col("primary_unit")), F.lit("primary_unit_missing")),
        F.when(blank(F.col("record_id")) | blank(F.col("name")), F.lit("record_identity_missing")),
        F.when((F.coalesce(finite, F.lit(False)) & (value < 0)) | ~F.coalesce(F.col("source_quality_status").isin("VERIFIED", "NEEDS_REVIEW", "REJECTED"), F.lit(False)), F.lit("record_validation_failed")),
    ))
    return raw.withColumns({"value": F.when(finite, value), "reasons": reasons})


def split_valid(diagnosed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return diagnosed.where(F.size("reasons") == 0), diagnosed.where(F.size("reasons") > 0)


def unknown_fields(json_text: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that the closed schema doesn't know."""
    return F.array_sort(F.array_except(F.json_object_keys(json_text), F.array(*map(F.lit, allowed))))


def inherit(records: DataFrame, policies: DataFrame, key: str, field: str) -> DataFrame:
    """The record's own value, else the only distinct value that matching policies give; several values are a conflict.

    policies: policy_id, match_key (null: all), field value in ``value``. Keyed and general policies are two equi-joins, not a theta join.
    """
    keyed = policies.where("match_key is not null").groupBy("match_key").agg(F.collect_set("value").alias("_k"))
    general = policies.where("match_key is null").agg(F.collect_set("value").alias("_g"))  # one row
    none = F.array().cast("array<string>")
    both = records.join(keyed, records[key] == keyed["match_key"], "left").join(F.broadcast(general)).withColumn("_v", F.array_distinct(F.concat(F.coalesce("_k", none), F.coalesce("_g", none))))
    conflict = F.col(field).isNull() & (F.size("_v") > 1)
    return both.withColumns({"inherited": F.coalesce(F.col(field), F.when(F.size("_v") == 1, F.get("_v", F.lit(0)))), "conflict": conflict}).drop("_k", "_g", "_v", "match_key")


def perturb(catalog: DataFrame, key: str, patch: dict[str, Column], noise: int) -> DataFrame:
    """The catalogue with patched columns and ``noise`` renamed copies of every record."""
    patched = catalog.withColumns(patch).withColumn("copy", F.lit(0))
    copies = catalog.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(noise)))).withColumn(key, F.concat_ws("-noise-", key, F.col("copy").cast("string")))
    return patched.unionByName(copies)


def accounting(name: Column) -> Column:
    """Array of (role, module): what an input counts as, with A1 for materials and A3 for energy and process inputs."""
    own = normalize(name)
    item = lambda role, module, pattern: F.when(own.rlike(pattern), F.struct(F.lit(role).alias("role"), F.lit(module).alias("module")))
    found = F.array_compact(F.array(item("energy_input", "A3", "(electric|power|fuel|gas|steam)"), item("transport_input", "A2", "(truck|rail|ship|freight)"), item("waste_output", "A3", "(waste|scrap|slag)")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.struct(F.lit("raw_material").alias("role"), F.lit("A1").alias("module"))))


def approval_rule(status: Column, tier: Column, mode: Column, accepted: Column, reason: Column) -> Column:
    """What a human decision may do with a recommendation."""
    return (
        F.when(status == "approved", "already_decided")
        .when(~status.isin("recommendation_ready", "reference_review_required"), "not_selectable")
        .when((tier == "REFERENCE_ONLY") & (mode != "override"), "override_required")
        .when((tier == "REFERENCE_ONLY") & blank(reason), "reason_required")
        .when((tier == "USABLE_WITH_ASSUMPTIONS") & ~F.coalesce(accepted, F.lit(False)), "acceptance_required")
        .otherwise("allowed")
    )


def effective_policies(policies: DataFrame, day: str) -> DataFrame:
    """Policies whose inclusive window holds ``day``; malformed dates never do."""
    ok = lambda c: F.when(F.col(c).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.col(c).try_cast("date"))
    start, end, d = ok("effective_from"), ok("effective_until"), F.lit(day).cast("date")
    return policies.where((start <= d) & (F.col("effective_until").isNull() | (end >= d)))


def keep_newest(df: DataFrame, order: list[str], size: str, max_rows: int, max_bytes: int) -> DataFrame:
    """Newest rows first while both bounds hold (oldest-first eviction of a bounded report store). The sum runs over ``max_rows`` rows at most."""
    from pyspark.sql.window import Window

    newest = [F.desc(c) for c in order]
    rows = df.orderBy(*newest).limit(max_rows)  # a top-k by partition, then one of its results
    upto = F.sum(size).over(Window.orderBy(*newest).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_upto", upto).where(F.col("_upto") <= max_bytes).drop("_upto")
