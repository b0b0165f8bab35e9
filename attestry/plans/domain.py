"""A deterministic catalogue and request set over the star-schema tables. The two statements run unchanged on Spark and on other engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators.identity import Registry

CATALOG_SQL = """
select 'P-' || cast(p_partkey as string) as source_id, p_name || ' ' || p_brand || ' ' || p_type as material_name,
  p_brand || ' ' || p_name || ' ' || p_type || case when p_size % 3 = 0 then ', ' || upper(p_name) || '/' || p_size || ',,' || p_name || '-' || p_size else '' end as alias, p_retailprice / 1000.0 as factor_value,
  case p_size % 9 when 0 then 'kgCO2e/kg' when 1 then 'kg CO2-eq/t' when 2 then 'gCO2e/kg' when 3 then 'kgCO2e/kWh' when 4 then 'kgCO2e per tkm' when 5 then 'kgCO2e/t product' when 6 then 'points/kg' when 7 then 'kgCO2e/Nm3' else 'kgCO2e / m3' end as factor_unit,
  case p_size % 9 when 0 then 'emission_limit' when 1 then 'unclassified' when 2 then 'energy_factor' when 3 then 'epd_indicator' else 'lifecycle_factor' end as factor_kind,
  case p_type when 'ECONOMY' then 'raw_material' when 'SMALL' then 'finished_product' when 'MEDIUM' then 'energy' when 'PROMO' then 'transport' when 'STANDARD' then 'raw_material' else 'unknown' end as subject_type,
  case split_part(p_name, ' ', 1) when 'blue' then 'Primary' when 'red' then 'secondary recycling' else split_part(p_name, ' ', 1) end as production_process, split_part(p_name, ' ', 2) as product_form,
  case when p_size % 5 = 0 then cast(p_size as string) || '%' end as composition,
  case when p_size % 7 = 0 then cast(null as int) else 2015 + p_size % 10 end as year,
  case p_partkey % 5 when 0 then 'AFRICA' when 1 then 'AMERICA' when 2 then 'ASIA' when 3 then 'EUROPE' else cast(null as string) end as geography,
  p_brand as series_id, 'prov-' || cast(p_partkey % 3 as string) as provider, 50 + p_size as grade,
  case p_size % 4 when 0 then 'A1' when 1 then 'A2' when 2 then 'A1-A3' else 'cradle-to-gate' end as boundary,
  case p_size % 8 when 3 then 'A3|A1|A2' when 5 then 'a2' end as boundary_modules,
  case when p_size % 11 = 0 then 'NEEDS_REVIEW' when p_size % 13 = 0 then 'REJECTED' else 'VERIFIED' end as source_quality_status,
  p_size % 17 <> 0 as admission_eligible,
  case p_size % 10 when 0 then cast(null as string) when 1 then 'GWP-fossil' when 2 then 'gwp-total' else 'GWP-total' end as indicator,
  case p_size % 12 when 0 then cast(null as string) when 1 then 'other product' else p_name || ' ' || p_brand || ' ' || p_type end as declared_product,
  p_name || '|' || p_brand as base_entity_id, case when p_size % 4 = 0 then cast(null as string) else p_type end as product_entity_id,
  case p_partkey % 5 when 0 then 'supplier' when 1 then 'local_database' when 2 then 'epd' when 3 then 'literature' else 'external_database' end as source_type,
  p_partkey % 2 = 0 as verified, p_partkey % 3 = 0 as audited, case when p_size % 15 = 0 then 'none' else md5(p_name) || md5(p_brand) end as document_sha256,
  cast(p_size % 3 as int) * 50 as priority_rank
from part
"""

REQUEST_SQL = """
select 'R-' || cast(o.o_orderkey as string) as request_id,
  case when o.o_orderkey % 4 = 3 then p.p_brand || ' ' || p.p_name || ' ' || p.p_type else p.p_name || ' ' || p.p_brand || ' ' || p.p_type end as material_name,
  case when o.o_orderkey % 11 = 0 then p.p_name || ' ' || cast(1 + o.o_orderkey % 50 as string) || ', spare' when o.o_orderkey % 11 = 1 then p.p_name || ' ' || p.p_brand || ' ECONOMY' end as aliases,
  l.quantity as quantity, case o.o_orderkey % 8 when 0 then 'kg' when 1 then 't' when 2 then 'kWh' when 3 then 'piece' when 4 then 'lb' when 5 then 'stone' when 6 then 'm3' else 'Nm3' end as quantity_unit,
  case when o.o_orderkey % 7 = 0 then 'kgCO2e/t' end as target_factor_unit,
  case o.o_orderstatus when 'O' then 'A1' when 'F' then 'cradle-to-gate' else 'A2' end as boundary,
  case when o.o_orderkey % 3 = 0 then cast(null as int) else 2015 + cast(o.o_orderkey % 10 as int) end as year,
  case o.o_orderkey % 9 when 0 then 'ASIA' when 1 then 'EUROPE' else cast(null as string) end as geography,
  case when o.o_orderkey % 5 = 0 then split_part(p.p_name, ' ', 1) end as production_process,
  case when o.o_orderkey % 8 = 0 then split_part(p.p_name, ' ', 2) end as product_form, case when o.o_orderkey % 12 = 0 then cast(45 + o.o_orderkey % 60 as string) || '%' end as composition,
  case when o.o_orderkey % 3 = 1 then 'Nm3' end as evidence_source, case when o.o_orderkey % 3 = 1 then 'm3' end as evidence_target, case when o.o_orderkey % 3 = 1 then 0.95 end as evidence_multiplier,
  case o.o_orderkey % 10 when 0 then 'raw_material' when 1 then 'energy' else 'unknown' end as subject_type,
  p.p_name || '|' || p.p_brand as base_entity_id, case when o.o_orderkey % 2 = 0 then p.p_type end as product_entity_id,
  1 + cast(o.o_orderkey % 5 as int) as top_k
from orders o join (select l_orderkey, min(l_partkey) as partkey, sum(l_quantity) as quantity from lineitem group by l_orderkey) l on o.o_orderkey = l.l_orderkey
join part p on p.p_partkey = l.partkey
"""


#: Scenarios of pieces, and process parameters of records.
FLOW_SQL = "select p_name || ' ' || p_brand || ' ' || p_type as material, 'piece' as unit, 'F-' || cast(p_partkey as string) as record_id, case when p_size % 5 = 0 then 0.0 else p_size / 10.0 end as mass_per_unit from part where p_size % 3 = 0"
EDGE_SQL = """select '{0}' || cast(p_partkey as string) as edge_id, p_retailprice / 500.0 as base_factor, p_size % 6 <> 0 as includes_process, p_size % 19 = 0 as ambiguous,
  cast(100 + p_size * 4 as double) as reference_total_energy_kgce_per_t, cast(0.25 as double) as reference_electricity_share, cast(0.75 as double) as reference_natural_gas_share,
  cast(80 + p_size * 3 as double) as target_total_energy_kgce_per_t, case when p_size % 13 = 0 then cast(0.75 as double) else cast(0.5 as double) end as target_electricity_share, cast(0.5 as double) as target_natural_gas_share,
  cast(0.125 as double) as electricity_kgce_per_kwh, cast(0.5 as double) as electricity_ef_kgco2e_per_kwh, case when p_size % 17 = 0 then cast(0 as double) else cast(1.25 as double) end as natural_gas_kgce_per_nm3, cast(2.0 as double) as natural_gas_ef_kgco2e_per_nm3,
  case when p_size % 4 = 0 then cast(0.25 as double) end as reference_additional_process, case when p_size % 8 = 0 then cast(0.5 as double) when p_size % 8 = 4 then cast(0.125 as double) when p_size % 23 = 0 then cast(0.5 as double) end as target_additional_process from part"""


#: Records and requests of another kind: half the records name no entity but a family, and a half of the requests a material that no record is called.
FAMILY_CATALOG_SQL = f"""select source_id, material_name, alias, factor_value, factor_unit, factor_kind, subject_type, production_process, product_form, composition, year, geography, series_id, provider, grade, boundary, boundary_modules, source_quality_status, admission_eligible, indicator, declared_product,
  case when grade % 2 = 0 then base_entity_id end as base_entity_id, product_entity_id, source_type, verified, audited, document_sha256, priority_rank, case when split_part(split_part(material_name, ' ', 2), ' ', 1) in ('bolt', 'gear') then 'Metals / parts' when split_part(material_name, ' ', 2) in ('plate', 'rod') then 'manufactured-minerals' when split_part(material_name, ' ', 2) = 'ring' then 'Polymers' end as family, 'of ' || provider as material_class from ({CATALOG_SQL})"""
FAMILY_REQUEST_SQL = f"""select request_id, case when kind = 1 then 'special steel item' when kind = 2 then 'fused ' || split_part(material_name, ' ', 2) || ' block' when kind = 4 then 'Polymer sheet, ' || split_part(material_name, ' ', 1) else material_name end as material_name, case when kind in (1, 2, 4) then null else aliases end as aliases,
  quantity, quantity_unit, target_factor_unit, boundary, year, geography, production_process, product_form, composition, evidence_source, evidence_target, evidence_multiplier, subject_type, case when kind in (1, 2, 4) then null else base_entity_id end as base_entity_id, case when kind in (1, 2, 4) then null else product_entity_id end as product_entity_id, top_k
from (select *, cast(split_part(request_id, '-', 2) as bigint) % 6 as kind from ({REQUEST_SQL}))"""

#: Rule tables over the names of ``part``: entities by name and brand, products by name, families by noun, a composite, a metal; and names to resolve.
_NOUN = "split_part(p_name, ' ', 2)"
MATERIAL_RULES_SQL = f"""
select distinct 'a.' || p_name || '|' || p_brand as rule_id, 'active' as status, array(p_name || ' ' || p_brand, p_brand || ' ' || p_name) as aliases, p_name || '|' || p_brand as entity_id, 'ENGINEERED_MATERIAL' as entity_type, {_NOUN} as head_material,
  {_NOUN} || '_products' as family, 'manufactured_mineral' as category, cast(null as string) as formula, cast(null as string) as product_entity_id, 'family.' || {_NOUN} as product_family_id, cast(null as string) as route, cast(0.9 as double) as confidence, cast(array() as array<string>) as constituents from part
union all select distinct 'p.' || p_name, 'active', array(p_name, replace(p_name, ' ', '')), 'ent.' || {_NOUN}, case when p_name like 'hot %' then 'ALLOY' else 'ENGINEERED_MATERIAL' end, {_NOUN}, {_NOUN} || '_products', 'metal', cast(null as string), 'prod.' || p_name, 'family.' || {_NOUN}, case when p_name like 'old %' then 'secondary_recycling' end, cast(0.8 as double), cast(array() as array<string>) from part
union all select distinct 'f.' || {_NOUN}, 'active', array({_NOUN}), 'ent.' || {_NOUN}, 'PRODUCT_FAMILY', {_NOUN}, {_NOUN} || '_products', 'metal', cast(null as string), cast(null as string), 'family.' || {_NOUN}, cast(null as string), cast(0.7 as double), cast(array() as array<string>) from part
union all select distinct 'c.' || p_name, 'active', array(p_name), 'mix.' || p_name, 'COMPOSITE', {_NOUN}, 'mixed', 'metal', cast(null as string), 'prod.mix.' || p_name, 'family.mixed', cast(null as string), cast(0.6 as double), array('ent.' || {_NOUN}, 'ent.filler') from part where p_name like 'large %'
union all select distinct 'd.' || p_brand, 'draft', array(p_brand), 'ent.draft', 'ALLOY', 'draft', 'draft', 'metal', cast(null as string), cast(null as string), cast(null as string), cast(null as string), cast(0.5 as double), cast(array() as array<string>) from part
union all select distinct 's.steel', 'active', array('steel', '钢'), 'mat.element.iron', 'ELEMENTAL_METAL', 'steel', 'steel_products', 'metal', 'Fe', cast(null as string), 'family.steel', cast(null as string), cast(0.9 as double), cast(array() as array<string>) from part
union all select distinct 's.aluminium', 'active', array('aluminium'), 'mat.element.aluminium', 'ELEMENTAL_METAL', 'aluminium', 'aluminium_products', 'metal', 'Al', cast(null as string), 'family.aluminium_products', cast(null as string), cast(0.9 as double), cast(array() as array<string>) from part
"""
PROCESS_RULES_SQL = "select distinct 'x.' || split_part(p_name, ' ', 1) as rule_id, 'active' as status, array(split_part(p_name, ' ', 1)) as aliases, split_part(p_name, ' ', 1) || ' rolling' as process from part where p_name like 'hot %' or p_name like 'cold %'"
FORM_RULES_SQL = "select distinct 'y.' || p_type as rule_id, 'active' as status, array(lower(p_type), lower(p_type) || ' form') as aliases, lower(p_type) as product_form from part union all select distinct 'y.fiber', 'active', array('fiber', 'fibre', '纤维'), 'fiber' from part"
SCHEMA_SQL = f"select distinct 'grade.' || {_NOUN} as schema_id, 'active' as status, 10 as priority, array('ent.' || {_NOUN}) as entity_ids, 'component.' || {_NOUN} as basis, array(cast(70 as double), cast(80 as double), cast(90 as double), cast(95 as double)) as labels, cast(array() as array<string>) as prefixes from part union all select distinct 'label.' || {_NOUN}, 'active', 20, array('ent.' || {_NOUN}), 'component.' || {_NOUN}, array(cast(85 as double), cast(92 as double)), array('wfa', 'ar') from part where p_name like 'old %'"
NAMED_SQL = f"""
select p_partkey as id, case p_size % 16 when 0 then p_name when 1 then p_name || ' ' || p_brand || ' ' || p_type when 2 then p_name || ' and ring' when 3 then {_NOUN} || ' / ' || lower(p_type) || ' form' when 4 then p_name || ' ' || p_size
  when 5 then p_name || ' ' || (60 + p_size) || '%' when 6 then 'F80 ' || p_name when 7 then p_name || ' 20mm 25kg 2024' when 8 then 'steel fiber ' || p_size when 9 then 'steel fibre copper plated' when 10 then 'heat steel 446 fiber' when 11 then 'aluminium metal'
  when 12 then p_name || ' SiC ' || p_size when 13 then p_name || ' wfa-' || (80 + p_partkey % 20) || ' alloy' when 14 then 'unknown thing ' || p_size else '钢纤维 ' || p_name || ' 70 80' end as material_name,
  case when p_partkey % 3 = 0 then p_type end as product_form, case when p_partkey % 5 = 0 then p_size || '%' when p_partkey % 5 = 1 then 'grade ' || p_size end as composition, case when p_partkey % 4 = 0 then split_part(p_name, ' ', 1) when p_partkey % 4 = 1 then 'as cast' end as production_process
from part
"""


def frame(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """A statement over the named tables; it sees them as views that last as long as it takes to read it.

    Joins of tables are merged: the planner would take one for small by the size of its file, which says little of its rows, and send it over the driver.
    """
    for name in names:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        (rows.hint("merge") if len(names) > 1 else rows).createOrReplaceTempView(name)
    try:
        return spark.sql(sql)
    finally:
        for name in names:
            spark.catalog.dropTempView(name)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, CATALOG_SQL, "part")


def catalog_with_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some records twice, and some ids that stand for two different records."""
    c = catalog(spark, sf_dir)
    return c.unionByName(c.where("grade % 23 = 0")).unionByName(c.where("grade % 19 = 0").withColumn("factor_value", F.col("factor_value") + 1))


def family_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, FAMILY_CATALOG_SQL, "part")


def requests(spark: SparkSession, sf_dir: str, sql: str = REQUEST_SQL) -> DataFrame:
    q = frame(spark, sf_dir, sql, "part", "orders", "lineitem")
    evidence = F.when(F.col("evidence_source").isNotNull(), F.struct(F.col("evidence_source").alias("source_canonical_unit"), F.col("evidence_target").alias("target_canonical_unit"), F.col("evidence_multiplier").cast("double").alias("multiplier")))
    return q.withColumn("unit_conversion_evidence", evidence).drop("evidence_source", "evidence_target", "evidence_multiplier")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, FLOW_SQL, "part")


def edges(spark: SparkSession, sf_dir: str, prefix: str = "P-") -> DataFrame:
    return frame(spark, sf_dir, EDGE_SQL.format(prefix), "part")


def registry(spark: SparkSession, sf_dir: str) -> Registry:
    return Registry(*(frame(spark, sf_dir, sql, "part") for sql in (MATERIAL_RULES_SQL, PROCESS_RULES_SQL, FORM_RULES_SQL, SCHEMA_SQL)))


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, NAMED_SQL, "part")
