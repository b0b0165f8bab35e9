"""Evaluation: retrieval metrics, precision and recall, explicit denominators, percentiles, gates, overlays, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry.operators.tables import Steps


def retrieval_metrics(cases: DataFrame) -> DataFrame:
    """cases: expected, observed (arrays in rank order), group. Recall at 1, 3, 5 and mean reciprocal rank."""
    hit = lambda k: F.avg(F.when(F.arrays_overlap("expected", F.slice("observed", 1, k)), 1.0).otherwise(0.0))
    places = F.array_min(F.filter(F.transform("expected", lambda e: F.array_position("observed", e)), lambda p: p > 0))
    return cases.groupBy("group").agg(F.count("*").alias("cases"), hit(1).alias("recall_1"), hit(3).alias("recall_3"), hit(5).alias("recall_5"), F.avg(F.coalesce(1.0 / places, F.lit(0.0))).alias("mrr"))


def rate(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def prf(df: DataFrame, by: list[str], expected: Column, observed: Column) -> DataFrame:
    tp, fp, fn = F.count_if(expected & observed), F.count_if(~expected & observed), F.count_if(expected & ~observed)
    return df.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn")).withColumns({"precision": rate(F.col("tp"), F.col("tp") + F.col("fp")), "recall": rate(F.col("tp"), F.col("tp") + F.col("fn")), "f1": rate(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


#: Buckets of one step of a selection, and how many distinct rows of an interval are looked at one by one.
BUCKETS, FEW = 4096, 100_000


def selected(df: DataFrame, by: list[str], value: str, ranks: dict[str, str]) -> DataFrame:
    """``by``, n and for every name the value at its rank (from 0, as a text over the count ``n``), exactly, for groups of any size.

    Intervals that hold the wanted ranks are narrowed: each step counts their rows in ``BUCKETS`` parts and keeps the part with the rank. No task sorts
    or holds a group; an interval of at most ``FEW`` rows is ranked by its distinct values. The first step cuts at equal distances of the logarithm
    (with the sign), which spreads values of all magnitudes, later ones at equal distances. Nulls, NaN and infinities are left out.
    """
    steps = Steps(df.sparkSession)
    rows = df.select(F.struct(*by).alias("g"), F.col(value).cast("double").alias("v")).where("abs(v) < double('infinity')")
    groups = steps.cut(rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.expr(x).cast("long").alias("rank")) for k, x in ranks.items()]))
    left = groups.select("g", "n", "low", "high", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside"), wanted.alias("w")).select("g", "n", "low", "high", "before", "inside", "w.name", "w.rank")
    left, form = steps.cut(left), "signum({0}) * log1p(abs({0}))"
    while not left.where(f"inside > {FEW} and low < high").isEmpty():
        spans = left.where(f"inside > {FEW} and low < high").select("g", "low", "high").distinct()
        part = f"least({BUCKETS - 1}, int({BUCKETS} * (({form.format('v')}) - {form.format('low')}) / ({form.format('high')} - {form.format('low')})))"
        counts = rows.join(spans, "g").where("v between low and high").groupBy("g", "low", "high", F.expr(part).alias("b")).agg(F.count("*").alias("c"), F.min("v").alias("low_b"), F.max("v").alias("high_b"))
        upto = F.sum("c").over(Window.partitionBy("g", "low", "high").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # BUCKETS rows at most
        parts = counts.withColumn("upto", upto).withColumnsRenamed({"g": "g_b", "low": "was_low", "high": "was_high"})
        met = (F.col("g") == F.col("g_b")) & (F.col("low") == F.col("was_low")) & (F.col("high") == F.col("was_high")) & F.expr("rank - before < upto and rank - before >= upto - c")
        found = left.join(parts, met, "left")
        left = steps.cut(found.select("g", "n", F.coalesce("low_b", "low").alias("low"), F.coalesce("high_b", "high").alias("high"), F.expr("before + coalesce(upto - c, 0L)").alias("before"), F.coalesce("c", "inside").alias("inside"), "name", "rank"))
        form = "{0}"
    spans = left.where("low < high").select("g", "low", "high").distinct()
    counts = rows.join(spans, "g").where("v between low and high").groupBy("g", "low", "high", "v").agg(F.count("*").alias("c"))
    counts = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("g", "low", "high").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)))  # FEW rows at most
    last = counts.withColumnsRenamed({"g": "g_b", "low": "was_low", "high": "was_high"})
    met = (F.col("g") == F.col("g_b")) & (F.col("low") == F.col("was_low")) & (F.col("high") == F.col("was_high")) & F.expr("rank - before < upto and rank - before >= upto - c")
    found = left.join(last, met, "left").select("g", "n", "name", F.coalesce("v", "low").alias("v"))
    return found.groupBy("g", "n").pivot("name", list(ranks)).agg(F.first("v")).select("g.*", "n", *ranks)


def percentiles(df: DataFrame, by: list[str], value: str, p: float) -> DataFrame:
    """Three definitions: linear interpolation, nearest rank by ceiling, rounded index; and the median."""
    at, mid = f"(n - 1) * {p!r}D", "(n - 1) * 0.5D"
    ranks = {"l0": f"floor({at})", "l1": f"ceil({at})", "m0": f"floor({mid})", "m1": f"ceil({mid})", "nearest_rank": f"greatest(0, ceil({p!r}D * n) - 1)", "rounded_index": f"floor({at} + 0.5D)"}
    between = lambda low, high, x: f"{low} + ({high} - {low}) * (({x}) - floor({x}))"
    found = selected(df, by, value, ranks)
    return found.select(*by, F.expr(between("l0", "l1", at)).alias("linear"), "nearest_rank", F.expr(between("m0", "m1", mid)).alias("median"), "rounded_index")


def release_gate(metrics: DataFrame, thresholds: list[tuple[str, float, str]]) -> DataFrame:
    """(metric, bound, 'min' or 'max') checks on a one-row frame, as rows; ``passed`` is the conjunction."""
    checks = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(b).alias("bound"), F.coalesce(F.col(m) >= b if kind == "min" else F.col(m) <= b, F.lit(False)).alias("ok")) for m, b, kind in thresholds])
    return metrics.select(F.explode(checks).alias("c"), F.forall(checks, lambda c: c["ok"]).alias("passed")).select("c.*", "passed")


def fixed_domain_counts(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """A count for every value of the domain, 0 included."""
    spark = df.sparkSession
    names = spark.createDataFrame([(i, d) for i, d in enumerate(domain)], f"place int, {column} string")
    return names.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, "place", F.coalesce("n", F.lit(0)).alias("n"))


def first_match(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for name, test in reversed(rules):
        out = F.when(test, name).otherwise(out)
    return out


def compare_runs(baseline: DataFrame, candidate: DataFrame, metrics: list[str]) -> DataFrame:
    """Differences by metric of two one-row frames."""
    long = lambda df, name: df.select([F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], metrics, "metric", name)
    return long(baseline, "baseline").join(long(candidate, "candidate"), "metric").withColumn("delta", F.col("candidate") - F.col("baseline"))


def overlay(results: DataFrame, adjudications: DataFrame, key: str, bound: str) -> DataFrame:
    """Adjudicated expectation over the raw one, only where the adjudication is bound to the same content."""
    a = adjudications.select(key, F.col(bound).alias("_bound"), F.col("effective").alias("_effective"))
    both = results.join(a, key, "left")
    same = F.col("_bound") == F.col(bound)
    return both.withColumns({"effective": F.when(F.coalesce(same, F.lit(False)), F.coalesce("_effective", "raw")).otherwise(F.col("raw")), "stale": F.col("_bound").isNotNull() & ~F.coalesce(same, F.lit(False))}).drop("_bound", "_effective")


def paired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Both, only left or only right."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("l").isNull(), "right_only").when(F.col("r").isNull(), "left_only").otherwise("both").alias("side"))
