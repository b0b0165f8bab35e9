"""Queries over the resolver's own operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry.operators import decide as D
from attestry.operators import evaluate as E
from attestry.operators import evidence as V
from attestry.operators import qualify as Q
from attestry.operators import retrieve as R
from attestry.operators import score as S
from attestry.operators import trace as X
from attestry.operators import transform as T
from attestry.plans import domain
from attestry.plans.oracle_core import CORE, GAP_TEXT, STEPPED

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Columns that no gate or channel asks for; and those that no score asks for. Of requests: that no gate, and no score, asks for.
UNGATED = ("factor_value", "verified", "audited", "priority_rank", "series_id", "provider", "grade", "source_type", "production_process", "product_form", "composition")
UNSCORED = ("factor_value", "series_id", "provider", "grade", "priority_rank")
RANKED = tuple(c for c in UNSCORED if c != "priority_rank")
UNSCORED_ASKED = ("quantity", "top_k")
UNGATED_ASKED = (*UNSCORED_ASKED, "production_process", "composition")


def gated(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of requests that gates and channels don't tell apart; of their form gates ask whether there is one."""
    return R.alike(R.stated(domain.requests(spark, sf), "product_form"), *UNGATED_ASKED)


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of classes of requests with classes of records, for the gates."""
    return R.retrieve(gated(spark, sf), R.classes(domain.catalog(spark, sf), *UNGATED))


def named(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of classes of requests with classes of records that have their names and entities in common: all that channels ask for."""
    return R.retrieve(R.alike(R.bare(domain.requests(spark, sf))), R.classes(R.bare(domain.catalog(spark, sf))))


def counted(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of classes of requests with kinds of records, and how many records each stands for."""
    return R.retrieve(gated(spark, sf), R.counted(domain.catalog(spark, sf), *UNGATED))


def candidates(spark: SparkSession, sf: str, apart: tuple[str, ...] = UNSCORED, asked: tuple[str, ...] | None = None) -> DataFrame:
    """Candidates before any step but units, by class of record, and by class of requests that differ in the columns ``asked`` at most, if these are given."""
    q = domain.requests(spark, sf)
    return S.candidates(Q.qualify(R.retrieve(q if asked is None else R.alike(q, *asked), R.classes(domain.catalog(spark, sf), *apart), fit=True)))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates by classes of requests and records that scores don't tell apart."""
    return candidates(spark, sf, asked=UNSCORED_ASKED)


def ranked(found: DataFrame, *more: str, most: str | None = None) -> DataFrame:
    """Candidates of classes of records, the first ``most`` records of each, with their place; classes of requests are ranked once."""
    keys = S.rank_keys()[:-2]  # the ids come last
    own = R.own_records(found, F.struct(*[F.expr(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("_key"), "strength", *more, most=most)
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("q_request_id").orderBy("_key", "c_source_id")))


def ids(*more):
    return [F.col("q_request_id").alias("request_id"), F.col("c_source_id").alias("source_id"), *more]


@query(CORE + "select request_id, source_id, rank, round(factor, 6) as factor, round(total, 4) as total, score from ranked where channel = 'exact' and rank <= top_k")
def exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    own = ranked(candidates(spark, sf, ("series_id", "provider", "grade")), "factor", "total", "score", "channel", "q_top_k", most="greatest(0, least(50, q_top_k))")
    found = S.top_k(own).where("channel = 'exact'")
    return found.select(ids("rank", F.round("factor", 6).alias("factor"), F.round("total", 4).alias("total"), "score"))


@query(CORE + "select request_id, source_id from pair where channel = 'synonym'")
def alias_join(spark: SparkSession, sf: str) -> DataFrame:
    return R.members(named(spark, sf).where("channel = 'synonym'")).select(ids())


@query(CORE + "select request_id, source_id, channel from pair")
def channel_precedence(spark: SparkSession, sf: str) -> DataFrame:
    return R.members(named(spark, sf), "channel").select(ids("channel"))


@query(CORE + "select request_id, source_id, g_identity, g_kind, g_subject, g_quality, g_indicator, g_declared, g_boundary, g_unit, g_geography, g_year from judged")
def gates(spark: SparkSession, sf: str) -> DataFrame:
    names = [f"g_{g}" for g in Q.GATES]
    return R.members(Q.qualify(hits(spark, sf)), *names).select(ids(*names))


@query(CORE + "select request_id, source_id, exclusions, nullif(split_part(exclusions, '|', 1), '') as primary_exclusion, exclusions = '' as eligible from qual")
def qualification(spark: SparkSession, sf: str) -> DataFrame:
    return R.members(Q.qualify(hits(spark, sf)), F.array_join("exclusions", "|").alias("exclusions"), "primary_exclusion", "eligible").select(ids("exclusions", "primary_exclusion", "eligible"))


@query(CORE + "select request_id, source_id, d_material, d_process, d_form, d_composition, d_geography, d_time, d_boundary, score, coverage from scored where exclusions = '' and (bridge or u_dim = t_dim)")
def dimension_scores(spark: SparkSession, sf: str) -> DataFrame:
    names = [*(f"d_{k}" for k in S.DIRECT), "score", "coverage"]
    return R.members(scored(spark, sf), *names).select(ids(*names))


@query(CORE + f"select request_id, source_id, {GAP_TEXT} as gaps, round(severity, 6) as severity from strong")
def gap_analysis(spark: SparkSession, sf: str) -> DataFrame:
    text = F.array_join(F.transform("gaps", lambda g: F.concat(g["type"], F.lit(":"), F.round(g["severity"], 6).cast("string"))), "|")
    return R.members(scored(spark, sf), text.alias("gaps"), F.round("severity", 6).alias("severity")).select(ids("gaps", "severity"))


@query(CORE + "select request_id, source_id, concat_ws('|', case when gap_0 is not null or gap_1 is not null then 'unit_scale' end, case when gap_2 is not null then 'reference_flow' end, case when gap_3 is not null or gap_4 is not null then 'process_variant' end, case when gap_5 is not null or gap_6 is not null then 'grade_composition' end, case when gap_7 is not null then 'class_aware_proxy' end) as plan from strong")
def resolution_plan(spark: SparkSession, sf: str) -> DataFrame:
    return R.members(scored(spark, sf), F.array_join(S.resolution_plan("gaps"), "|").alias("plan")).select(ids("plan"))


@query(CORE + "select request_id, source_id, resolution_type, strength, tier from strong")
def strength_tier(spark: SparkSession, sf: str) -> DataFrame:
    return R.members(scored(spark, sf), "resolution_type", "strength", "tier").select(ids("resolution_type", "strength", "tier"))


@query(CORE + "select request_id, source_id, rank, strength from ranked")
def rank_full(spark: SparkSession, sf: str) -> DataFrame:
    return R.own_requests(ranked(candidates(spark, sf, RANKED, UNSCORED_ASKED))).select(ids("rank", "strength"))


@query(CORE + ", two as (select request_id, max(case when rank = 1 then strength end) as first, max(case when rank = 2 then strength end) as second, max(case when rank = 1 then coverage end) as coverage from ranked where rank <= 2 group by request_id), m as (select *, greatest(0.0, first - coalesce(second, first)) as raw from two), v as (select *, cast(0.65 as double) * first + cast(0.20 as double) * coverage + cast(0.15 as double) * least(1.0, raw / cast(0.20 as double)) as exact from m) select request_id, round(raw, 6) as margin, round(exact, 9) as confidence, case when round(exact, 6) >= 0.80 then 'high' when round(exact, 6) >= 0.65 then 'medium' else 'low' end as level from v")
def confidence_margin(spark: SparkSession, sf: str) -> DataFrame:
    per = R.own_requests(S.confidence(ranked(candidates(spark, sf, RANKED, UNSCORED_ASKED), "coverage", most="2")))
    return per.select(F.col("q_request_id").alias("request_id"), "margin", F.round("confidence_exact", 9).alias("confidence"), "level")


_AMBIGUOUS = ", vague as (select request_id, concat_ws('|', case when bool_or(q_process is null) and count(distinct nullif(c_process, '')) > 1 then 'production_process' end, case when bool_or(q_form is null) and count(distinct nullif(c_form, '')) > 1 then 'product_form' end, case when bool_or(q_geography is null) and count(distinct nullif(c_geography, '')) > 1 then 'geography' end, case when bool_or(q_year is null) and count(distinct c_year) > 1 then 'year' end) as ambiguous from ranked where not hard group by request_id)"


@query(CORE + _AMBIGUOUS + " select request_id, ambiguous from vague")
def ambiguity(spark: SparkSession, sf: str) -> DataFrame:
    return D.ambiguity(candidates(spark, sf)).select(F.col("q_request_id").alias("request_id"), F.array_join("ambiguous", "|").alias("ambiguous"))


_CODES = "concat_ws('|', case when bool_or(contains(exclusions, 'UNIT_SYNTAX_UNSUPPORTED')) then 'UNIT_SYNTAX_UNSUPPORTED' end, case when bool_or(contains(exclusions, 'CATALOG_FACTOR_UNIT_INVALID')) then 'CATALOG_FACTOR_UNIT_INVALID' end, case when bool_or(contains(exclusions, 'UNIT_DIMENSION_MISMATCH')) then 'UNIT_DIMENSION_MISMATCH' end, case when bool_or(contains(exclusions, 'UNIT_CONVERSION_EVIDENCE_REQUIRED')) then 'UNIT_CONVERSION_EVIDENCE_REQUIRED' end, case when bool_or(g_quality = 'unknown' and c_status = 'VERIFIED' and not regexp_full_match(coalesce(c_hash, ''), '[0-9a-f]{64}')) then 'SOURCE_DOCUMENT_HASH_REQUIRED' end)"
_REASONS = f", why as (select request_id, {_CODES} as reasons from qual group by request_id)"


@query(CORE + _REASONS + " select request_id, reasons from why where reasons <> ''")
def reason_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return R.own_requests(D.reason_rollup(Q.qualify(counted(spark, sf)))).select(F.col("q_request_id").alias("request_id"), "reasons")


@query(CORE + "select request_id, count(*) as hits, count(*) filter (channel = 'exact') as exact, count(*) filter (channel = 'synonym') as synonym, count(*) filter (channel = 'related') as related, count(*) filter (exclusions = '') as eligible from qual group by request_id")
def funnel(spark: SparkSession, sf: str) -> DataFrame:
    return R.own_requests(D.funnel(Q.qualify(counted(spark, sf)))).withColumnRenamed("q_request_id", "request_id")


def prepared(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return D.prepared(domain.requests(spark, sf), domain.catalog_with_duplicates(spark, sf), domain.flows(spark, sf), domain.edges(spark, sf))


def admitted_classes(spark: SparkSession, sf: str) -> DataFrame:
    """What is admitted, by classes of requests and of records."""
    return D.admitted(*D.prepared_classes(domain.requests(spark, sf), domain.catalog_with_duplicates(spark, sf), domain.flows(spark, sf), domain.edges(spark, sf)))


@query(STEPPED + "select request_id, source_id, candidate_id, round(factor, 9) as factor, round(resolved_quantity, 6) as resolved_quantity, resolution_type, score, steps_3 as steps, assumed as assumptions, method as grade_method, case when not asked or adjusted then null when edge_id is null then 'parameter_missing' when x_dim <> 'MASS' then 'reference_unit' when edge_reason is not null then edge_reason else 'negative_upstream' end as process_reason from p8 where not flow_missing and (steps_3 > 0 or asked or graded)")
def resolution_steps(spark: SparkSession, sf: str) -> DataFrame:
    """What flows, routes and grades made of the candidates that asked for them."""
    asked = F.expr("pooled and (steps > 0 or process_reason is not null or resolution_type = 'process_adjusted' or grade_method is not null)")
    said = {"factor": "round(factor, 9)", "resolution_type": "resolution_type", "score": "score", "steps": "steps", "assumptions": "size(assumptions)", "grade_method": "grade_method", "process_reason": "process_reason"}
    told = D.set_out(admitted_classes(spark, sf).where(asked), said, {"quantity_then": "round(resolved_quantity, 6)"}, "resolved:")
    return told.select("request_id", "source_id", "candidate_id", "factor", F.col("quantity_then").alias("resolved_quantity"), *list(said)[1:])


_SUBJECT = "bool_or(q_subject = 'unknown' and (coalesce(c_kind, '') in ('energy_factor', 'combustion_factor', 'transport_factor') or c_subject in ('energy', 'transport', 'process', 'waste')))"
_GAPPED = ", routed as (select request_id, count(distinct case own_process when 'primary' then 'primary' when 'secondary recycling' then 'secondary' end) filter (q_base is not null and q_product is null and not flow_missing) > 1 as route_gap, bool_or(flow_missing) as flow_wanted from p8 group by request_id), subjects as (select request_id, " + _SUBJECT + " as subject_gap from qual group by request_id), gapped as (select s.request_id, subject_gap, coalesce(route_gap, false) as route_gap, coalesce(flow_wanted, false) as flow_wanted from subjects s left join routed r on r.request_id = s.request_id)"


@query(STEPPED + _GAPPED + " select p.request_id, source_id, candidate_id, rank, resolution_type, round(factor, 9) as factor, round(total, 6) as total, strength, case when subject_gap or route_gap then 'REFERENCE_ONLY' else tier end as tier, hard from pool p join gapped g on g.request_id = p.request_id")
def candidate_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates after their steps, ranked."""
    q, c = prepared(spark, sf)
    return D.candidate_pool(D.admitted(q, c), D.subject_gaps(q, c)).select(ids("candidate_id", "rank", "resolution_type", F.round("factor", 9).alias("factor"), F.round("total", 6).alias("total"), "strength", "tier", "hard"))


@query(STEPPED + _GAPPED + " select request_id, concat_ws('|', case when subject_gap then 'subject_type' end, case when route_gap then 'route' end) as gaps from gapped where subject_gap or route_gap")
def request_gaps(spark: SparkSession, sf: str) -> DataFrame:
    q = R.prepare_requests(D.with_flows(gated(spark, sf), domain.flows(spark, sf)).withColumn("flows", F.slice("flows", 1, 1)))  # whether there is any
    c = R.prepare_catalog(R.single(domain.catalog_with_duplicates(spark, sf)))
    return R.own_requests(D.request_gaps(D.unscored(q, c), D.subject_gaps(q, c))).select(F.col("q_request_id").alias("request_id"), F.array_join("gaps", "|").alias("gaps"))


@query(f"with one as ({domain.CATALOG_SQL}) select source_id, case when grade % 23 = 0 then 3 else 2 end as copies from one where grade % 19 = 0")
def external_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return D.external_conflicts(domain.catalog_with_duplicates(spark, sf))


@query(STEPPED + _GAPPED + ", vague as (select request_id, " + ", ".join(f"max(case when {q} is null then 1 else 0 end) = 1 and count(distinct {c}) > 1 as x_{f}" for f, q, c in (("production_process", "q_process", "nullif(c_process, '')"), ("product_form", "q_form", "nullif(c_form, '')"), ("geography", "q_geography", "nullif(c_geography, '')"), ("year", "q_year", "c_year"))) + f" from pool where not hard group by request_id), why as (select request_id, {_CODES} as early, bool_or(contains(exclusions, 'CONFLICTING_DUPLICATE_SOURCE_ID')) as conflict, count(*) as hits, count(*) filter (exclusions = '') as eligible from qual group by request_id)" + """, own as (
  select request_id, count(*) as candidates, count(*) filter (not hard and tier <> 'REFERENCE_ONLY') as selectable, count(*) filter (not hard and tier = 'REFERENCE_ONLY') as reviewable, count(*) filter (hard) as rejected, bool_or(coalesce(gap_3, 0) >= 0.8) as process_conflict, bool_or(gap_5 is not null or gap_6 is not null) as grade_conflict,
    min_by(source_id, rank) filter (not hard and tier <> 'REFERENCE_ONLY') as first_source, min_by(resolution_type, rank) filter (not hard and tier <> 'REFERENCE_ONLY') as first_type, min_by(coalesce(total, -1), rank) filter (not hard and tier <> 'REFERENCE_ONLY') as first_total from pool group by request_id
), a as (
  select q.request_id, u.key is null or t.raw is null as bad_unit, q.quantity_unit, coalesce(hits, 0) as hits, coalesce(eligible, 0) as eligible, coalesce(conflict, false) as conflict, coalesce(early, '') as early0, coalesce(candidates, 0) as candidates, coalesce(selectable, 0) as selectable, coalesce(reviewable, 0) as reviewable, coalesce(rejected, 0) as rejected,
    coalesce(process_conflict, false) as process_conflict, coalesce(grade_conflict, false) as grade_conflict, first_source, first_type, nullif(first_total, -1) as first_total, coalesce(subject_gap, false) as subject_gap, coalesce(route_gap, false) as route_gap, coalesce(flow_wanted, false) as flow_wanted,
    coalesce(x_production_process, false) as xp, coalesce(x_product_form, false) as xf, coalesce(x_geography, false) as xg, coalesce(x_year, false) as xy
  from qn q left join unit u on u.key = lower(q.quantity_unit) left join tunit t on t.raw = q.target_unit left join why w on w.request_id = q.request_id left join own o on o.request_id = q.request_id left join vague v on v.request_id = q.request_id left join gapped g on g.request_id = q.request_id
), b as (
  select *, subject_gap or route_gap as gap, case when bad_unit and not contains(early0, 'UNIT_SYNTAX_UNSUPPORTED') then concat_ws('|', 'UNIT_SYNTAX_UNSUPPORTED', nullif(early0, '')) else early0 end as early,
    case when subject_gap or route_gap then '' else concat_ws('|', case when xp then 'production_process' end, case when xf then 'product_form' end, case when xg then 'geography' end, case when xy then 'year' end) end as ambiguous from a
), c as (
  select *, concat_ws('|', case when subject_gap then 'subject_type' end, case when route_gap then 'route' end, case when flow_wanted and not gap then case lower(quantity_unit) when 'piece' then 'mass_per_piece|dimensions+density' when 'm3' then 'density' else 'mass_per_' || lower(quantity_unit) end end, nullif(ambiguous, '')) as required,
    concat_ws('|', nullif(early, ''), case when hits > 0 and eligible = 0 and early = '' and not gap then 'ADMISSION_REJECTED' end, case when conflict then 'CONFLICTING_DUPLICATE_SOURCE_ID' end, case when grade_conflict then 'GRADE_SPECIFICATION_CONFLICT' end,
      case when not gap and xp then 'PROCESS_REQUIRED' end, case when not gap and xf then 'PRODUCT_FORM_REQUIRED' end, case when not gap and xg then 'GEOGRAPHY_REQUIRED' end, case when not gap and xy then 'YEAR_REQUIRED' end) as reasons, selectable > 0 and ambiguous = '' and not gap and not bad_unit as ready, not bad_unit and (reviewable > 0 or (ambiguous <> '' and selectable > 0)) as shown from b
)
select request_id, reasons, required as required_fields, hits, eligible, candidates, rejected, case when ready then first_source end as first_source, case when ready then first_type end as first_type, case when ready then round(first_total, 6) end as first_total,
  case when ready then 'recommendation_ready' when contains(reasons, 'EVIDENCE_REQUIRED') then 'more_input_needed' when contains(reasons, 'UNIT_SYNTAX') or contains(reasons, 'UNIT_DIMENSION') or contains(reasons, 'CATALOG_FACTOR') or conflict then 'unresolved' when required <> '' then 'more_input_needed' when shown then 'reference_review_required' when process_conflict then 'process_model_required' when grade_conflict then 'unresolved' when rejected > 0 then 'process_model_required' when hits > 0 and eligible = 0 then 'unresolved' else 'supplier_data_required' end as status,
  case when ready then null when contains(reasons, 'EVIDENCE_REQUIRED') then 'more_input' when contains(reasons, 'UNIT_SYNTAX') or contains(reasons, 'UNIT_DIMENSION') then 'unresolved' when contains(reasons, 'CATALOG_FACTOR') or conflict then 'data_governance' when required <> '' then 'more_input' when shown then 'data_governance' when process_conflict then 'process_model' when grade_conflict then 'data_governance' when rejected > 0 then 'process_model' when hits > 0 and eligible = 0 then 'data_governance' else 'supplier_data' end as follow_up from c""")
def terminal_status(spark: SparkSession, sf: str) -> DataFrame:
    found = D.decide(domain.requests(spark, sf), domain.catalog_with_duplicates(spark, sf), domain.flows(spark, sf), domain.edges(spark, sf))
    return found.withColumn("first_total", F.round("first_total", 6))


# ---- transformations --------------------------------------------------------------------------------------------------------
def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_CAT = f"with cat as ({domain.CATALOG_SQL}), req as ({domain.REQUEST_SQL}) "
@query(_CAT + f", flow as ({domain.FLOW_SQL}) select request_id as activity_id, record_id, round(case when mass_per_unit > 0 then quantity * mass_per_unit end, 6) as mass, round(case when mass_per_unit > 0 then quantity * mass_per_unit * 2.5 end, 6) as total, case when not coalesce(mass_per_unit > 0, false) then 'mass_per_' || quantity_unit end as required from req left join flow on material_name = material and quantity_unit = unit where quantity_unit in ('piece', 'lb')")
def reference_flow(spark: SparkSession, sf: str) -> DataFrame:
    acts = domain.requests(spark, sf).where("quantity_unit in ('piece', 'lb')").select(F.col("request_id").alias("activity_id"), F.col("material_name").alias("material"), F.col("quantity_unit").alias("unit"), "quantity", F.lit(2.5).alias("factor"))
    return T.reference_flow(acts, domain.flows(spark, sf)).select("activity_id", "record_id", F.round("mass", 6).alias("mass"), F.round("total", 6).alias("total"), "required")


_GRADE = "tgt as (select 'T-' || cast(p_partkey as varchar) as target_id, p_brand as series_id, 45.0 + cast(p_partkey % 130 as double) / 2.0 as grade from part), anchor as (select series_id, source_id, cast(grade as double) as g, factor_value as f from cat where grade % 4 <> 1), one as (select series_id, g, min(source_id) as sid, min_by(f, source_id) as f from anchor where g > 0 and g <= 100 group by series_id, g), near as (select t.target_id, t.series_id, t.grade, max(case when g <= t.grade then g end) as low, min(case when g >= t.grade then g end) as high from tgt t left join one o on o.series_id = t.series_id group by all), pick as (select n.*, l.sid as lsid, l.f as lf, h.sid as hsid, h.f as hf, (select min_by(sid, (abs(o.g - n.grade), sid)) from one o where o.series_id = n.series_id) as nsid, (select min_by(f, (abs(o.g - n.grade), sid)) from one o where o.series_id = n.series_id) as nf from near n left join one l on l.series_id = n.series_id and l.g = n.low left join one h on h.series_id = n.series_id and h.g = n.high)"


@query(_CAT + ", " + _GRADE + " select target_id, series_id, case when low = high then 'exact' when low is not null and high is not null then 'interpolated' when nsid is not null then 'nearest' else 'none' end as method, round(case when low = high then lf when low is not null and high is not null then lf + (grade - low) / (high - low) * (hf - lf) else nf end, 6) as factor, case when low = high then lsid when low is not null and high is not null then lsid || '+' || hsid else nsid end as source from pick")
def grade_resolution(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    targets = part.select(F.concat(F.lit("T-"), F.col("p_partkey").cast("string")).alias("target_id"), F.col("p_brand").alias("series_id"), (45.0 + (F.col("p_partkey") % 130).cast("double") / 2.0).alias("grade"))
    anchors = domain.catalog(spark, sf).where("grade % 4 <> 1").select("series_id", "source_id", F.col("grade").cast("double").alias("grade"), F.col("factor_value").alias("factor"))
    return T.grade(targets, anchors).select("target_id", "series_id", "method", F.round("factor", 6).alias("factor"), "source")


@query(_CAT + "select source_id, series_id, lag(source_id) over w as below, lead(source_id) over w as above from cat window w as (partition by series_id order by grade, source_id)")
def grade_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return T.nearest_anchors(domain.catalog(spark, sf).select("source_id", "series_id", "grade")).drop("grade")


@query(f"with e as ({domain.EDGE_SQL.format('E-')})" + """, r as (select *, reference_total_energy_kgce_per_t * reference_electricity_share / electricity_kgce_per_kwh * electricity_ef_kgco2e_per_kwh / 1000.0 + case when natural_gas_kgce_per_nm3 > 0 then reference_total_energy_kgce_per_t * reference_natural_gas_share / natural_gas_kgce_per_nm3 * natural_gas_ef_kgco2e_per_nm3 / 1000.0 end + coalesce(reference_additional_process, 0) as ref,
  target_total_energy_kgce_per_t * target_electricity_share / electricity_kgce_per_kwh * electricity_ef_kgco2e_per_kwh / 1000.0 + case when natural_gas_kgce_per_nm3 > 0 then target_total_energy_kgce_per_t * target_natural_gas_share / natural_gas_kgce_per_nm3 * natural_gas_ef_kgco2e_per_nm3 / 1000.0 end + coalesce(target_additional_process, 0) as tgt from e),
x as (select *, case when ambiguous then 'duplicate_parameter' when (reference_additional_process is null) <> (target_additional_process is null) then 'additional_process_one_sided' when natural_gas_kgce_per_nm3 <= 0 then 'parameter_not_positive' when abs(target_electricity_share + target_natural_gas_share - 1.0) > 1e-6 then 'shares_do_not_sum_to_one' when not includes_process then 'inclusion_not_proved' when base_factor - ref < -1e-12 then 'negative_upstream' end as reason from r)
select edge_id, reason, round(case when reason is null then greatest(0.0, base_factor - ref) + tgt else base_factor end, 6) as factor, case when reason is null then 'process_adjusted' else 'unadjusted_process_proxy' end as method from x""")
def process_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    return T.process_rebuild(domain.edges(spark, sf, "E-")).select("edge_id", "reason", F.round("factor", 6).alias("factor"), "method")


@query("select 'E-' || cast(p_partkey as varchar) as edge_id, case when v >= 0 then round(v, 6) end as factor, case when v < 0 then 'negative_result' when v is null then 'parameter_missing' end as reason from (select p_partkey, p_retailprice / 1000.0 - p_size / 25.0 + case when p_size % 9 <> 0 then p_size / 50.0 end + 0.0 as v from part)")
def process_delta(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    edges = p.select(F.concat(F.lit("E-"), F.col("p_partkey").cast("string")).alias("edge_id"), (F.col("p_retailprice") / 1000.0).alias("base_factor"), (F.col("p_size") / 25.0).alias("removed"), F.when(F.col("p_size") % 9 != 0, F.col("p_size") / 50.0).alias("added"), F.lit(None).cast("double").alias("other"))
    return T.process_delta(edges).select("edge_id", F.round("factor", 6).alias("factor"), "reason")


@query("with p as (select 'E-' || cast(p_partkey % 500 as varchar) as edge_id, case p_size % 3 when 0 then 'reference_electricity_share' when 1 then 'target_electricity_share' else 'reference_additional_process' end as name, p_retailprice as value from part) select edge_id, max(case when name = 'reference_electricity_share' then value end) as a, max(case when name = 'target_electricity_share' then value end) as b, max(case when name = 'reference_additional_process' then value end) as c, count(*) > count(distinct name) as ambiguous from p group by edge_id")
def parameter_pivot(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    name = F.when(F.col("p_size") % 3 == 0, "reference_electricity_share").when(F.col("p_size") % 3 == 1, "target_electricity_share").otherwise("reference_additional_process")
    rows = p.select(F.concat(F.lit("E-"), (F.col("p_partkey") % 500).cast("string")).alias("edge_id"), name.alias("name"), F.col("p_retailprice").alias("value"))
    return T.pivot_parameters(rows).select("edge_id", F.col("reference_electricity_share").alias("a"), F.col("target_electricity_share").alias("b"), F.col("reference_additional_process").alias("c"), "ambiguous")


# ---- evidence ---------------------------------------------------------------------------------------------------------------
_QUOTA = "select 'K-' || cast(p_partkey as {str}) as record_id, p_name || p_brand as product, p_brand as head, split_part(p_name, ' ', 1) as process, p_retailprice as value from part where p_size % 10 = 0"
_QREQ = "select 'E-' || cast(p_partkey as {str}) as edge_id, p_name || p_brand as product, p_brand as head, split_part(p_name, ' ', 1) as process from part"


@query(f"with q as ({_QUOTA.format(str='varchar')}), r as ({_QREQ.format(str='varchar')}), a as (select product, count(*) as n1, min(record_id) as r1, min_by(value, record_id) as v1 from q group by product), b as (select head, process, count(*) as n2, min(record_id) as r2, min_by(value, record_id) as v2 from q group by head, process) select edge_id, case when coalesce(n1, n2, 0) = 1 then coalesce(r1, r2) end as record_id, case when coalesce(n1, n2, 0) = 1 then case when n1 is not null then v1 else v2 end end as value, case when coalesce(n1, n2, 0) = 0 then 'none' when coalesce(n1, n2) > 1 then 'ambiguous' when n1 is not null then 'product' else 'route' end as matched_by from r left join a using (product) left join b using (head, process)")
def quota_fallback(spark: SparkSession, sf: str) -> DataFrame:
    run = lambda q: domain.frame(spark, sf, q.format(str="string"), "part")
    return V.quota_with_fallback(run(_QREQ), run(_QUOTA))


@query("select s_nationkey as edge_id, sum(s_acctbal) as total, bool_and(s_suppkey % 7 <> 0) as all_eligible, bool_or(s_acctbal = 0) as any_zero, string_agg(s_name, ';' order by s_name) as names, count(distinct s_suppkey % 3) > 1 as several_products from supplier group by s_nationkey")
def emission_sum(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("edge_id"), F.col("s_acctbal").alias("value"), (F.col("s_suppkey") % 7 != 0).alias("eligible"), F.col("s_name").alias("emission"), (F.col("s_suppkey") % 3).alias("product"))
    return V.emission_sum(s)


@query("select p_name || p_brand as name, min(cast(p_size as double)) as value, min(p_type) as unit, count(*) as rows from part group by 1 having count(distinct (p_size, p_type)) = 1")
def generic_unique(spark: SparkSession, sf: str) -> DataFrame:
    return V.unique_value(table(spark, sf, "part").select(F.concat("p_name", "p_brand").alias("name"), F.col("p_size").cast("double").alias("value"), F.col("p_type").alias("unit")))


_SCOPE = "select p_partkey as id, p_brand as ref_head, p_type as ref_process, p_name as name, case when p_size % 2 = 0 then '' else cast(p_size as {str}) end as scope_ref, p_retailprice as value from part"


@query(f"with s as ({_SCOPE.format(str='varchar')}), e as (select p_partkey as edge, p_brand as ref_head, p_type as ref_process, cast(p_size as varchar) as reference_id from part where p_size > 25) select edge, id, value from e join s using (ref_head, ref_process) where scope_ref = '' or scope_ref = reference_id")
def scoped_parameters(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    rows = domain.frame(spark, sf, _SCOPE.format(str="string"), "part").withColumns({"target_head": F.lit("t"), "target_process": F.lit("p")})
    edges = part.where("p_size > 25").select(F.col("p_partkey").alias("edge"), F.col("p_brand").alias("ref_head"), F.col("p_type").alias("ref_process"), F.col("p_size").cast("string").alias("reference_id"), F.lit("t").alias("target_head"), F.lit("p").alias("target_process"))
    return V.scoped_parameters(edges, rows.drop("name")).select("edge", "id", "value")


@query("with b as (select p_partkey % 300 as edge_id, p_brand as name, p_retailprice as value, p_partkey as id, case when p_size % 4 = 0 then 0 else 1 end as branch from part) select edge_id, name, value, id, branch from (select *, row_number() over (partition by edge_id, name order by branch, id) as r from b) where r = 1")
def evidence_merge(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "part").select((F.col("p_partkey") % 300).alias("edge_id"), F.col("p_brand").alias("name"), F.col("p_retailprice").alias("value"), F.col("p_partkey").alias("id"), "p_size")
    return V.merge_evidence([b.where("p_size % 4 = 0"), b.where("p_size % 4 <> 0")])


@query("with q as (select p_brand as head, p_size as level, count(*) as matches, min(p_retailprice) as quota from part where p_size % 3 = 0 and p_type = 'SMALL' group by all) select p_partkey as id, case when matches is null then 'none' when matches > 1 then 'ambiguous' else 'compared' end as outcome, case when matches = 1 then round(p_retailprice - quota, 6) end as difference from part left join q on head = p_brand and level = p_size")
def profile_quota(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    keys = lambda d: d.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("head"), F.col("p_size").alias("level"), F.col("p_retailprice").alias("value"))
    return V.profile_against_quota(keys(p), keys(p.where("p_size % 3 = 0 and p_type = 'SMALL'")), ["head", "level"]).select("id", "outcome", F.round("difference", 6).alias("difference"))


@query("select p_partkey as id, case when v is null and note = '' then 'blank' when trig and coalesce(v, 0) = 0 then 'trigger_conflict' when v = 0 then 'explicit_zero' when v is null then 'blank' else 'value' end as kind from (select p_partkey, case when p_size % 5 = 0 then 0.0 when p_size % 5 <> 1 then p_retailprice end as v, p_size % 4 = 0 as trig, case when p_size % 2 = 0 then 'x' else '' end as note from part)")
def emission_observation(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    value = F.when(size % 5 == 0, 0.0).when(size % 5 != 1, F.col("p_retailprice"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), V.emission_observation(value, size % 4 == 0, F.when(size % 2 == 0, "x").otherwise("")).alias("kind"))


# ---- traces -----------------------------------------------------------------------------------------------------------------
def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def _chain(spark: SparkSession, sf: str) -> DataFrame:
    return X.chain(_events(spark, sf), "user_id", ["ts", "event_id"], X.entry_text("event_id", "event_type"))


_CHAIN = "with recursive e as (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as revision from events), c as (select user_id, revision, event_id, repeat('0', 64) as previous_hash, sha256(repeat('0', 64) || '|' || event_id || chr(31) || event_type) as entry_hash from e where revision = 1 union all select e.user_id, e.revision, e.event_id, c.entry_hash, sha256(c.entry_hash || '|' || e.event_id || chr(31) || e.event_type) from c join e on e.user_id = c.user_id and e.revision = c.revision + 1)"


@query(_CHAIN + " select user_id as key, revision, event_id, previous_hash, entry_hash from c")
def hash_chain(spark: SparkSession, sf: str) -> DataFrame:
    return _chain(spark, sf).select("key", "revision", "event_id", "previous_hash", "entry_hash")


@query(_CHAIN + ", d as (select user_id, case when event_id % 61 = 0 then revision + 1 else revision end as revision, event_id, case when event_id % 41 = 0 then 'forged' else event_type end as event_type, case when event_id % 53 = 0 then repeat('f', 64) else previous_hash end as previous_hash, entry_hash from c join e using (user_id, revision, event_id)), v as (select *, row_number() over w as place, coalesce(lag(entry_hash) over w, repeat('0', 64)) as before, sha256(previous_hash || '|' || event_id || chr(31) || event_type) as own from d window w as (partition by user_id order by revision, event_id)) select user_id as key, count(*) as entries, bool_and(place = revision) as gapless, bool_and(before = previous_hash) as linked, bool_and(own = entry_hash) as hashed from v group by user_id")
def trace_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Verification of chains of which some are damaged: forged contents, cut links, skipped revisions."""
    c, n = _chain(spark, sf), F.col("event_id")
    forged = F.when(n % 41 == 0, F.concat_ws("\x1f", n.cast("string"), F.lit("forged"))).otherwise(F.col("content"))
    damaged = c.withColumns({"content": forged, "previous_hash": F.when(n % 53 == 0, F.lit("f" * 64)).otherwise(F.col("previous_hash")), "revision": F.when(n % 61 == 0, F.col("revision") + 1).otherwise(F.col("revision"))})
    return X.verify(damaged, ["event_id"])


@query("select event_id, sha256(string_agg(sha256(event_type), ':') over (partition by user_id order by ts, event_id)) as prefix from events")
def trace_prefix(spark: SparkSession, sf: str) -> DataFrame:
    own = _events(spark, sf).withColumn("d", F.sha2("event_type", 256))
    return X.prefix_digest(own, "user_id", ["ts", "event_id"], "d").select("event_id", "prefix")


@query("select user_id, event_type, max_by(event_id, (ts, event_id)) as event_id, count(*) as entries from events group by user_id, event_type")
def trace_latest(spark: SparkSession, sf: str) -> DataFrame:
    return X.latest(_events(spark, sf), ["user_id", "event_type"], ["ts", "event_id"], "event_id")


@query("with a as (select distinct user_id, event_type || '-' || cast(event_id % 4 as varchar) as item from events where coalesce(value, 0) < 50), b as (select distinct user_id, event_type || '-' || cast(event_id % 4 as varchar) as item from events where not coalesce(value, 0) < 50), u as (select user_id from a union select user_id from b) select user_id, coalesce((select string_agg(item, ',' order by item) from (select item from b where b.user_id = u.user_id except select item from a where a.user_id = u.user_id)), '') as added, coalesce((select string_agg(item, ',' order by item) from (select item from a where a.user_id = u.user_id except select item from b where b.user_id = u.user_id)), '') as removed from u")
def trace_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Every event is on one side: low values and high ones."""
    e = _events(spark, sf).withColumn("item", F.concat_ws("-", "event_type", (F.col("event_id") % 4).cast("string")))
    low = F.coalesce("value", F.lit(0.0)) < 50
    return X.difference(e.where(low), e.where(~low), "user_id", "item")


@query(_CAT + "select request_id, sha256(concat_ws(chr(31), request_id, coalesce(material_name, ''), coalesce(cast(cast(quantity as bigint) as varchar), ''), coalesce(quantity_unit, ''), coalesce(boundary, ''), coalesce(cast(year as varchar), ''))) as fingerprint, sha256(concat_ws(chr(31), lower(material_name), coalesce(quantity_unit, ''))) as business from req")
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    q = domain.requests(spark, sf).withColumns({"amount": F.col("quantity").cast("long"), "low": F.lower("material_name")})
    return q.select("request_id", X.fingerprint("request_id", "material_name", "amount", "quantity_unit", "boundary", "year").alias("fingerprint"), X.fingerprint("low", "quantity_unit").alias("business"))


#: The tree over the row digests ``d``, level by level.
TREE = ", l8 as (select substr(d, 1, 8) as k, sha256(string_agg(d, ':' order by d)) as d, count(*) as n from d group by 1)" + "".join(f", l{k} as (select substr(k, 1, {k}) as k, sha256(string_agg(d, ':' order by k)) as d, sum(n) as n from l{k + 2} group by 1)" for k in (6, 4, 2)) + " select sha256(string_agg(d, ':' order by k)) as digest, cast(sum(n) as bigint) as rows from l2"


@query(_CAT + ", d as (select sha256(source_id || chr(31) || material_name) as d from cat)" + TREE)
def catalog_digest(spark: SparkSession, sf: str) -> DataFrame:
    return X.table_digest(domain.catalog(spark, sf), X.fingerprint("source_id", "material_name"))


@query("select event_id, last_value(case when event_id % 5 = 0 then event_type end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as filled from events")
def forward_fill(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).withColumn("label", F.when(F.col("event_id") % 5 == 0, F.col("event_type")))
    return X.forward_fill(e, ["user_id"], ["ts", "event_id"], "label").select("event_id", F.col("label_filled").alias("filled"))


@query("select event_id, sum(case when event_type = 'click' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as segment from events")
def segment_ids(spark: SparkSession, sf: str) -> DataFrame:
    return X.segments(_events(spark, sf), ["user_id"], ["ts", "event_id"], F.col("event_type") == "click").select("event_id", "segment")


# ---- evaluation -------------------------------------------------------------------------------------------------------------
@query("select lang as lang, count(*) filter (quality = 1 and n_chars >= 500) as tp, count(*) filter (quality <> 1 and n_chars >= 500) as fp, count(*) filter (quality = 1 and n_chars < 500) as fn, round(count(*) filter (quality = 1 and n_chars >= 500) / nullif(count(*) filter (n_chars >= 500), 0), 9) as precision, round(count(*) filter (quality = 1 and n_chars >= 500) / nullif(count(*) filter (quality = 1), 0), 9) as recall, round(2 * count(*) filter (quality = 1 and n_chars >= 500) / nullif(2 * count(*) filter (quality = 1 and n_chars >= 500) + count(*) filter (quality <> 1 and n_chars >= 500) + count(*) filter (quality = 1 and n_chars < 500), 0), 9) as f1 from labels join documents using (doc_id) group by lang")
def precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    found = E.prf(both, ["lang"], F.col("quality") == 1, F.col("n_chars") >= 500)
    return found.select("lang", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(_CAT + ", m as (select request_id, case when quantity > 100 then 'large' else 'small' end as g, (select min(r) from (select row_number() over (order by source_id) as r, factor_value from cat c where c.base_entity_id = req.base_entity_id) where factor_value >= 1.2) as place from req) select g as \"group\", count(*) as cases, round(avg(case when place <= 1 then 1.0 else 0.0 end), 9) as recall_1, round(avg(case when place <= 3 then 1.0 else 0.0 end), 9) as recall_3, round(avg(case when place <= 5 then 1.0 else 0.0 end), 9) as recall_5, round(avg(coalesce(1.0 / place, 0.0)), 9) as mrr from m group by g")
def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    per = domain.catalog(spark, sf).groupBy("base_entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("source_id", "factor_value"))), lambda x: x["source_id"]).alias("observed"), F.collect_list(F.when(F.col("factor_value") >= 1.2, F.col("source_id"))).alias("expected"))
    cases = domain.requests(spark, sf).select("base_entity_id", F.when(F.col("quantity") > 100, "large").otherwise("small").alias("group")).join(per, "base_entity_id")
    return E.retrieval_metrics(cases).select("group", "cases", *[F.round(c, 9).alias(c) for c in ("recall_1", "recall_3", "recall_5", "mrr")])


@query("with s as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null), r as (select event_type, min(value) filter (i = cast(floor((n - 1) * 0.95 + 0.5) as bigint)) as rounded_index from s group by event_type) select e.event_type, round(quantile_cont(value, 0.95), 9) as linear, quantile_disc(value, 0.95) as nearest_rank, round(median(value), 9) as median, any_value(rounded_index) as rounded_index from events e join r using (event_type) group by e.event_type")
def percentiles_three(spark: SparkSession, sf: str) -> DataFrame:
    found = E.percentiles(_events(spark, sf), ["event_type"], "value", 0.95)
    return found.select("event_type", F.round("linear", 9).alias("linear"), "nearest_rank", F.round("median", 9).alias("median"), "rounded_index")


@query("with m as (select avg(quality) as quality, avg(toxic) as toxic, count(*) as n from labels), c as (select 'quality' as metric, quality as value, 0.8 as bound, quality >= 0.8 as ok from m union all select 'toxic', toxic, 0.1, toxic <= 0.1 from m union all select 'n', n, 100, n >= 100 from m) select metric, round(value, 9) as value, cast(bound as double) as bound, ok, bool_and(ok) over () as passed from c")
def release_gate(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "labels").agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"), F.count("*").alias("n"))
    return E.release_gate(m, [("quality", 0.8, "min"), ("toxic", 0.1, "max"), ("n", 100.0, "min")]).withColumn("value", F.round("value", 9))


@query("with d(event_type, place) as (values ('click', 0), ('view', 1), ('purchase', 2), ('refund', 3), ('never', 4)) select d.event_type, d.place, count(e.event_id) as n from d left join events e using (event_type) group by all")
def category_counter(spark: SparkSession, sf: str) -> DataFrame:
    return E.fixed_domain_counts(_events(spark, sf), "event_type", ["click", "view", "purchase", "refund", "never"])


@query("select case when value is null then 'missing' when value < 10 then 'low' when event_type = 'purchase' then 'purchase' when value > 90 then 'high' else 'other' end as class, count(*) as n from events group by 1")
def badcase_classify(spark: SparkSession, sf: str) -> DataFrame:
    rules = [("missing", F.col("value").isNull()), ("low", F.col("value") < 10), ("purchase", F.col("event_type") == "purchase"), ("high", F.col("value") > 90)]
    return _events(spark, sf).select(E.first_match(rules, "other").alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@query("with a as (select avg(quality) as quality, avg(toxic) as toxic from labels where doc_id % 2 = 0), b as (select avg(quality) as quality, avg(toxic) as toxic from labels where doc_id % 2 = 1) select 'quality' as metric, round(a.quality, 9) as baseline, round(b.quality, 9) as candidate, round(b.quality - a.quality, 9) as delta from a, b union all select 'toxic', round(a.toxic, 9), round(b.toxic, 9), round(b.toxic - a.toxic, 9) from a, b")
def run_compare(spark: SparkSession, sf: str) -> DataFrame:
    own = lambda k: table(spark, sf, "labels").where(F.col("doc_id") % 2 == k).agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"))
    return E.compare_runs(own(0), own(1), ["quality", "toxic"]).select("metric", *[F.round(c, 9).alias(c) for c in ("baseline", "candidate", "delta")])


@query("select d.doc_id, case when l.doc_id is not null and d.n_chars % 3 = d.doc_id % 3 then coalesce(l.quality, d.n_chars % 2) else d.n_chars % 2 end as effective, l.doc_id is not null and d.n_chars % 3 <> d.doc_id % 3 as stale from documents d left join labels l on l.doc_id = d.doc_id")
def adjudication_overlay(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 2).alias("raw"), (F.col("n_chars") % 3).alias("digest"))
    a = table(spark, sf, "labels").select("doc_id", (F.col("doc_id") % 3).alias("digest"), F.col("quality").cast("long").alias("effective"))
    return E.overlay(d, a, "doc_id", "digest").select("doc_id", "effective", "stale")


@query("select coalesce(d.doc_id, l.doc_id) as doc_id, case when d.doc_id is null then 'right_only' when l.doc_id is null then 'left_only' else 'both' end as side from (select doc_id from documents) d full join labels l on l.doc_id = d.doc_id")
def pairing_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    return E.paired(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")
