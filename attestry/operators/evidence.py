"""Joins that assemble process evidence: quotas with fallback, profiles, emissions, unique generic values, scoped parameters, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Parts into which rows of one key are split, so that one key isn't one task.
PARTS = 32


#: Rows that one list holds at most.
LISTED = 64


def listed(rows: DataFrame, keys: list[str], parts: int = PARTS) -> DataFrame:
    """Rows of equal keys and equal ``_part`` in lists of at most ``LISTED``: (keys, _part, rows); the part is a hash of the row."""
    split = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("int"))
    kept = [c for c in rows.columns if c not in keys]
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*kept))
    per = split.withColumn("_list", F.floor((place - 1) / LISTED)).groupBy(*keys, "_part", "_list")
    return per.agg(F.collect_list(F.struct(*kept)).alias("rows")).drop("_list")


def spread_join(requests: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """An equi-join on few keys of many rows each: rows of a key are split by hash into ``PARTS``, which the requests meet one by one.

    Lists of rows are joined, and set out afterwards: a pair of lists stands for up to ``LISTED`` squared rows of the result.
    """
    every = listed(requests, keys, 4).withColumnRenamed("rows", "_asking").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    both = every.hint("merge").join(listed(rows, keys).withColumnRenamed("rows", "_rows").hint("merge"), [*keys, "_part"])
    return both.select(*keys, "_rows", F.inline("_asking")).select(*keys, *[c for c in requests.columns if c not in keys], F.inline("_rows"))


def quota_with_fallback(requests: DataFrame, quotas: DataFrame) -> DataFrame:
    """By canonical product, else by (head material, process); more than one match of the winning kind is ambiguous.

    requests: edge_id, product, head, process; quotas: record_id, product, head, process, value.
    """
    by_product = quotas.groupBy("product").agg(F.count("*").alias("n1"), F.min("record_id").alias("r1"), F.min_by("value", "record_id").alias("v1"))
    by_route = quotas.groupBy("head", "process").agg(F.count("*").alias("n2"), F.min("record_id").alias("r2"), F.min_by("value", "record_id").alias("v2"))
    both = requests.join(by_product, "product", "left").join(by_route, ["head", "process"], "left")
    n = F.coalesce("n1", "n2", F.lit(0))
    return both.select("edge_id", F.when(n == 1, F.coalesce("r1", "r2")).alias("record_id"), F.when(n == 1, F.when(F.col("n1").isNotNull(), F.col("v1")).otherwise(F.col("v2"))).alias("value"), F.when(n == 0, "none").when(n > 1, "ambiguous").when(F.col("n1").isNotNull(), "product").otherwise("route").alias("matched_by"))


def profiles(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """Runtime-eligible, active profiles of a (head, process) at the wanted levels, without duplicates marked ambiguous."""
    usable = rows.where("active and runtime_eligible and not (allocation_status like '%AMBIGUOUS_DUPLICATE%')")
    wanted = requests.select("*", F.explode(F.array_distinct("levels")).alias("quota_level"))
    return spread_join(wanted, usable, ["head", "process", "quota_level"])


def emission_sum(rows: DataFrame) -> DataFrame:
    """Per edge: sum of emissions, whether all are eligible, whether any is zero, names in order; several products are an error."""
    return rows.groupBy("edge_id").agg(F.sum("value").alias("total"), F.bool_and("eligible").alias("all_eligible"), F.bool_or(F.col("value") == 0).alias("any_zero"), F.array_join(F.array_sort(F.collect_list("emission")), ";").alias("names"), (F.count_distinct("product") > 1).alias("several_products"))


def unique_value(rows: DataFrame) -> DataFrame:
    """Groups of ``name`` that hold exactly one distinct (value, unit)."""
    return rows.groupBy("name").agg(F.count_distinct("value", "unit").alias("versions"), F.min("value").alias("value"), F.min("unit").alias("unit"), F.count("*").alias("rows")).where("versions = 1").drop("versions")


def scoped_parameters(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Parameters whose four scope keys match; a blank reference id matches every reference."""
    wanted = edges.withColumn("scope_ref", F.explode(F.expr("array_distinct(array_compact(array('', reference_id)))")))
    return spread_join(wanted, rows, ["ref_head", "ref_process", "target_head", "target_process", "scope_ref"])


def merge_evidence(branches: list[DataFrame]) -> DataFrame:
    """Branches in order of precedence (edge_id, name, value, id); the first branch that has a name wins, within it the smallest id."""
    rows = None
    for k, b in enumerate(branches):
        b = b.select("edge_id", "name", "value", "id", F.lit(k).alias("branch"))
        rows = b if rows is None else rows.unionByName(b)
    w = Window.partitionBy("edge_id", "name").orderBy("branch", "id")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def duplicate_parameters(rows: DataFrame) -> DataFrame:
    """Every row with how many rows of its edge have its name, and whether that makes the name ambiguous."""
    copies = F.count("*").over(Window.partitionBy("edge_id", "name"))
    return rows.withColumn("copies", copies).withColumn("ambiguous", F.col("copies") > 1)


def process_evidence(requests: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence for (reference record, target material), and for the target process where the evidence names one.

    requests: edge_id, reference_id, target_material, target_process; evidence: id, reference_id, target_material, target_process, value.
    """
    e = evidence.select("id", "reference_id", "target_material", F.coalesce("target_process", F.lit("")).alias("only_process"), "value")
    wanted = requests.select("edge_id", "reference_id", "target_material", F.explode(F.expr("array_distinct(array_compact(array('', target_process)))")).alias("only_process"))
    return spread_join(wanted, e, ["reference_id", "target_material", "only_process"]).select("edge_id", "id", "value")


def inclusion_proof(rows: DataFrame) -> DataFrame:
    """Per edge: whether the record or any scoped evidence proves that the reference factor includes the process. rows: edge_id, source_flag, evidence_flag."""
    return rows.groupBy("edge_id").agg(F.bool_or(F.coalesce("source_flag", F.lit(False)) | F.coalesce("evidence_flag", F.lit(False))).alias("included"))


def emission_observation(value: Column, trigger: Column, note: Column) -> Column:
    """blank, explicit_zero, trigger_conflict or value."""
    return F.when(value.isNull() & (F.coalesce(note, F.lit("")) == ""), "blank").when(F.coalesce(trigger, F.lit(False)) & (F.coalesce(value, F.lit(0.0)) == 0), "trigger_conflict").when(value == 0, "explicit_zero").when(value.isNull(), "blank").otherwise("value")


def profile_against_quota(profile: DataFrame, quota: DataFrame, keys: list[str]) -> DataFrame:
    """Per profile row: difference to the only matching quota, or that there is none or more than one."""
    per = quota.groupBy(*keys).agg(F.count("*").alias("matches"), F.min("value").alias("quota"))
    return profile.join(per, keys, "left").withColumns({"outcome": F.when(F.col("matches").isNull(), "none").when(F.col("matches") > 1, "ambiguous").otherwise("compared"), "difference": F.when(F.col("matches") == 1, F.col("value") - F.col("quota"))})
