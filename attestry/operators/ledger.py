"""What a resolver hands out besides decisions: projections, ledgers, lineage, checks on sets of records, rules and parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.text import blank, normalize
from attestry.operators.qualify import GATES
from attestry.operators.trace import fingerprint, table_digest

#: Columns of a decision that may leave the house.
PUBLIC = ("request_id", "status", "follow_up", "reasons", "first_source", "required_fields")
#: Gaps that a direct use of a record can't have.
PRIMARY_GAPS = ("REFERENCE_FLOW", "PROCESS_VARIANT", "GRADE_COMPOSITION", "MATERIAL_ABSENT")


def scan(catalog: DataFrame, source_types: tuple[str, ...] | None = None) -> DataFrame:
    """Records of the wanted types (all without any)."""
    return catalog.where(F.col("source_type").isin(*source_types)) if source_types is not None else catalog


def alias_list(text: Column) -> Column:
    """Distinct normal forms of aliases that come as a JSON list or separated by commas, without blanks, in order."""
    listed = F.coalesce(F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>")), F.split(F.coalesce(text, F.lit("")), ","))
    return F.array_distinct(F.filter(F.transform(listed, normalize), lambda a: a != ""))


def public_view(decisions: DataFrame) -> DataFrame:
    """Decisions cut down to the public columns; whatever else there is stays inside."""
    return decisions.select(*[c for c in PUBLIC if c in decisions.columns])


def made_by_steps() -> Column:
    """Whether a step other than units made a candidate."""
    return (F.col("steps") > 0) | ~F.col("resolution_type").isin("direct_exact", "direct_alias", "unit_converted")


def total_holds() -> Column:
    """Whether the total of a candidate can be worked out again."""
    again = F.col("factor") * F.col("resolved_quantity") * F.col("impact")
    return F.when(F.col("total").isNull() | again.isNull(), F.col("total").isNull() & again.isNull()).otherwise(F.abs(again - F.col("total")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("total")))


def lineage(pool: DataFrame) -> DataFrame:
    """Candidates that a step made: from which record, by how many steps, under which assumptions, and whether their total can be worked out again."""
    return pool.where(made_by_steps()).select(F.col("q_request_id").alias("request_id"), "candidate_id", F.col("c_source_id").alias("source_id"), "resolution_type", "steps", F.array_join("assumptions", "|").alias("assumptions"), total_holds().alias("total_holds"))


def admission_limits() -> Column:
    """What keeps a record from formal admission, in a fixed order."""
    note = lambda test, text: F.when(test, F.lit(text))
    no_boundary = blank(F.col("c_boundary")) & blank(F.col("c_boundary_modules"))
    return F.array_compact(F.array(note(F.col("c_year").isNull(), "source year is unspecified"), note(F.col("c_geography").isNull(), "source geography is unspecified"), note(blank(F.col("c_declared_product")), "formal_admission_incomplete:declared_product"), note(no_boundary, "formal_admission_incomplete:boundary")))


def directly_usable(gaps: Column) -> Column:
    return ~F.exists(gaps, lambda g: g["type"].isin(*PRIMARY_GAPS))


def capped_tier(tier: Column, gapped: Column) -> Column:
    """Candidates of a request that has gaps of its own are references at most."""
    return F.when(gapped, F.lit("REFERENCE_ONLY")).otherwise(tier)


def with_relations(matches: DataFrame, relations: DataFrame) -> DataFrame:
    """Matched rules (name, rule_id) with the ids of typed relations that start at them. relations: rule_id, relation_id."""
    per = relations.groupBy("rule_id").agg(F.array_sort(F.collect_set("relation_id")).alias("relations"))
    return matches.join(per, "rule_id", "left").withColumn("relations", F.coalesce("relations", F.array().cast("array<string>")))


def known(rows: DataFrame, catalog: DataFrame, key: str = "source_id") -> DataFrame:
    return rows.join(catalog.select(key).distinct(), key, "left_semi")


def unknown(rows: DataFrame, catalog: DataFrame, key: str = "source_id") -> DataFrame:
    return rows.join(catalog.select(key).distinct(), key, "left_anti")


def unrecorded(exclusions: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """Exclusions that the ledger doesn't have yet, each once."""
    return exclusions.join(recorded.select(*keys), keys, "left_anti").dropDuplicates(keys)


def best_assignments(rows: DataFrame) -> DataFrame:
    """One row a (subject, role, module): a quantified one before others, then the earliest. rows: subject, role, module, quantified, place, value."""
    order = F.struct(~F.col("quantified"), F.col("place"))
    return rows.groupBy("subject", "role", "module").agg(F.min_by(F.struct("quantified", "place", "value"), order).alias("x")).select("subject", "role", "module", "x.*")


def canonical_set(values: Column) -> Column:
    """A set as the sorted JSON texts of its members."""
    return F.array_sort(F.array_distinct(F.transform(values, lambda v: F.to_json(F.struct(v.alias("v"))))))


def first_schema(names: DataFrame, schemas: DataFrame) -> DataFrame:
    """Per entity the schema of the highest priority, then the smallest id. names: entity_id; schemas: schema_id, priority, entity_ids, status."""
    rows = schemas.where("status = 'active'").withColumn("entity_id", F.explode("entity_ids"))
    return names.join(rows, "entity_id").groupBy("entity_id").agg(F.min_by("schema_id", F.struct(-F.col("priority"), F.col("schema_id"))).alias("schema_id"))


def union_parameters(repositories: list[DataFrame]) -> DataFrame:
    """Parameters (edge_id, name, value) of several repositories; ``conflict`` marks names that more than one row of an edge has."""
    rows = repositories[0]
    for r in repositories[1:]:
        rows = rows.unionByName(r)
    return rows.groupBy("edge_id", "name").agg(F.count("*").alias("rows"), F.min("value").alias("value"), (F.count("*") > 1).alias("conflict"))


def missing_of(required: Column, have: Column) -> Column:
    """What of ``required`` isn't there; empty for a subset."""
    return F.array_sort(F.array_except(required, have))


def diagnostics(qualified: DataFrame) -> DataFrame:
    """The ledger of gates that didn't pass: one row a (request, class of records, gate), with the ids ``c_members`` (and ``q_members`` of classes of requests)."""
    rows = "array(" + ", ".join(f"struct('{g}' as gate, g_{g} as status)" for g in GATES) + ")"
    return qualified.select(*[c for c in ("q_request_id", "q_members", "c_members") if c in qualified.columns], F.expr(f"inline(filter({rows}, g -> g.status <> 'pass'))"))


def anchors(rows: DataFrame, digest: str = "sha256") -> DataFrame:
    """One row a database digest, the smallest name first."""
    return rows.groupBy(digest).agg(F.min("name").alias("name"), F.count("*").alias("uses"))


def registry_digest(tables: dict[str, DataFrame]) -> DataFrame:
    """One digest over all rule tables, whatever the order of their rows."""
    rows = None
    for name, df in sorted(tables.items()):
        own = df.select(F.concat_ws("\x1f", F.lit(name), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(df.columns)]).alias("entry"))
        rows = own if rows is None else rows.unionByName(own)
    return table_digest(rows, fingerprint("entry"))
