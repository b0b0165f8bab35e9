"""The resolver's semantics a second time, as one chain of SQL views over the star-schema tables, for differential checks."""

from __future__ import annotations

from attestry.functions.units import ACTIVITY, IMPACT
from attestry.plans.domain import CATALOG_SQL, EDGE_SQL, FLOW_SQL, REQUEST_SQL


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[\\[\\](){{}}/_|,;:·\\-–—]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def _dim(q: str, c: str) -> str:
    """Score of one dimension; for the domain's values, words never form a strict subset or a partial overlap except through equality tests below."""
    a, b = _norm(f"coalesce(cast({q} as varchar), '')"), _norm(f"coalesce(cast({c} as varchar), '')")
    ta, tb = (f"list_filter(list_distinct(regexp_extract_all({x}, '[a-z0-9]+')), lambda t: length(t) > 1)" for x in (a, b))
    inter = f"len(list_intersect({ta}, {tb}))"
    union = f"(len({ta}) + len({tb}) - {inter})"
    return f"case when {a} = '' or {b} = '' then 0.5 when {a} = {b} then 1.0 when len({ta}) > 0 and len({tb}) > 0 and ({inter} = len({ta}) or {inter} = len({tb})) then 0.8 when len({ta}) > 0 and len({tb}) > 0 and {inter} / {union} >= 0.35 then 0.65 else 0.0 end"


def _blank(x: str) -> str:
    return f"({x} is null or trim(cast({x} as varchar)) = '')"


UNITS = "unit(key, canonical, dimension, ratio, evidence) as (values " + ", ".join(f"('{k}', '{c}', '{d}', cast({r!r} as double), {str(e).lower()})" for k, c, d, r, e in ACTIVITY) + ")"
IMPACTS = "impact(key, ratio) as (values " + ", ".join(f"('{k}', cast({r!r} as double))" for k, r in IMPACT) + ")"


def _factor(name: str, column: str, source: str) -> str:
    """A view that parses the distinct values of a factor-unit column."""
    return f"""
{name}_raw as (select distinct {column} as raw from {source} where {column} is not null),
{name}_split as (select raw,
  case when regexp_matches(raw, '^\\s*.+?\\s*/\\s*.+?\\s*$') then regexp_extract(raw, '^\\s*(.+?)\\s*/\\s*(.+?)\\s*$', 1) else regexp_extract(raw, '(?i)^\\s*(.+?)\\s+per\\s+(.+?)\\s*$', 1) end as top,
  case when regexp_matches(raw, '^\\s*.+?\\s*/\\s*.+?\\s*$') then regexp_extract(raw, '^\\s*(.+?)\\s*/\\s*(.+?)\\s*$', 2) else regexp_extract(raw, '(?i)^\\s*(.+?)\\s+per\\s+(.+?)\\s*$', 2) end as bottom from {name}_raw),
{name} as (select s.raw, i.ratio as impact, case when regexp_matches(lower(replace(bottom, ' ', '')), 'product$') then 'product' end as qualifier, u.canonical, u.dimension, u.ratio, u.evidence
  from {name}_split s join impact i on i.key = replace(replace(lower(top), '-', ''), ' ', '')
  join unit u on u.key = replace(replace(replace(regexp_replace(lower(replace(bottom, ' ', '')), 'product$', ''), '*', ''), '·', ''), '.', ''))"""


_D = {"process": ("q.production_process", "c.production_process"), "form": ("q.product_form", "c.product_form"), "composition": ("q.composition", "c.composition"), "geography": ("q.geography", "c.geography"), "boundary": ("q.boundary", "c.boundary")}
_P = {"material": ("q_name", "c_name"), "process": ("q_process", "c_process"), "form": ("q_form", "c_form"), "composition": ("q_composition", "c_composition"), "geography": ("q_geography", "c_geography"), "time": ("q_year", "c_year"), "boundary": ("q_boundary", "c_boundary")}
_W = {"material": 0.25, "process": 0.20, "form": 0.10, "composition": 0.15, "geography": 0.10, "time": 0.10, "boundary": 0.10}
_MODULES = "case regexp_replace(lower(trim({0})), '\\s+', '-', 'g') when 'a1' then 'A1' when 'a2' then 'A2' when 'a3' then 'A3' when 'a1-a3' then 'A1|A2|A3' when 'cradle-to-gate' then 'A1|A2|A3' end"


def _differ(k: str) -> str:
    q, c = _P[k]
    return f"not {_blank(q)} and not {_blank(c)} and {_norm(f'cast({q} as varchar)')} <> {_norm(f'cast({c} as varchar)')}"


def _absent(k: str) -> str:
    q, c = _P[k]
    return f"not {_blank(q)} and {_blank(c)}"


_EXCLUDE = [
    ("base_entity_id_mismatch", "coalesce(q_base <> c_base, false)"), ("product_entity_id_mismatch", "q_product is not null and c_product is not null and q_product <> c_product"), ("product_entity_id_missing", "q_product is not null and c_product is null"),
    ("factor_kind_mismatch", "g_kind = 'mismatch'"), ("subject_type_mismatch", "g_subject <> 'pass' and (q_subject <> 'unknown' or c_kind in ('energy_factor', 'combustion_factor', 'transport_factor') or c_subject in ('energy', 'transport', 'process', 'waste'))"),
    ("source_quality_not_admissible", "g_quality <> 'pass'"), ("indicator_mismatch", "g_indicator = 'mismatch'"), ("declared_product_mismatch", "g_declared = 'mismatch' and channel <> 'proxy'"), ("boundary_mismatch", "g_boundary = 'mismatch'"),
    ("geography_mismatch", "g_geography = 'mismatch'"), ("year_mismatch", "g_year = 'mismatch'"), ("unit_qualifier_requires_validation", "unproved"),
    ("CATALOG_FACTOR_UNIT_INVALID", "g_unit = 'mismatch' and plan_reason = 'CATALOG_FACTOR_UNIT_INVALID'"), ("UNIT_SYNTAX_UNSUPPORTED", "g_unit = 'mismatch' and plan_reason = 'UNIT_SYNTAX_UNSUPPORTED'"), ("UNIT_DIMENSION_MISMATCH", "g_unit = 'mismatch' and plan_reason = 'UNIT_DIMENSION_MISMATCH'"),
    ("UNIT_CONVERSION_EVIDENCE_REQUIRED", "g_unit = 'mismatch' and plan_reason = 'UNIT_CONVERSION_EVIDENCE_REQUIRED'"), ("CONFLICTING_DUPLICATE_SOURCE_ID", "c_conflict"),
]
_GAPS = [
    ("UNIT_SCALE", "0.1", "replace(lower(c_factor_unit), ' ', '') <> replace(lower(q_target_unit), ' ', '') and c_dim = t_dim"),
    ("UNIT_SCALE", "0.1", "u_canonical <> n_canonical and u_dim = n_dim"), ("REFERENCE_FLOW", "1.0", "u_canonical <> n_canonical and u_dim <> n_dim"),
    ("PROCESS_VARIANT", "0.8", _differ("process")), ("PROCESS_VARIANT", "0.5", _absent("process")), ("GRADE_COMPOSITION", "0.7", _differ("composition")), ("GRADE_COMPOSITION", "0.5", _absent("composition")),
    ("MATERIAL_ABSENT", "1.0", f"channel = 'proxy' or channel = 'related' and not (({_differ('process')}) or ({_absent('process')}) or ({_differ('composition')}) or ({_absent('composition')}))"),
    ("BOUNDARY", "0.7", _differ("boundary")), ("BOUNDARY", "0.4", _absent("boundary")), ("GEOGRAPHY", "1.0", _differ("geography")), ("GEOGRAPHY", "0.5", _absent("geography")),
    ("TEMPORAL", "case when abs(q_year - c_year) <= 3 then 0.3 else least(1.0, 0.5 + (abs(q_year - c_year) - 3) / 14.0) end", "q_year is not null and c_year is not null and q_year <> c_year"), ("TEMPORAL", "0.5", "q_year is not null and c_year is null"),
    ("FORM", "0.5", _differ("form")), ("FORM", "0.3", _absent("form")),
]
_SEV = [f"case when {test} then cast({s} as double) end as gap_{i}" for i, (_, s, test) in enumerate(_GAPS)]
_OF = lambda kind: [f"gap_{i}" for i, g in enumerate(_GAPS) if g[0] == kind]
GAP_SUM = " + ".join(f"coalesce(gap_{i}, 0.0)" for i in range(len(_GAPS)))
GAP_TEXT = "concat_ws('|', " + ", ".join(f"case when gap_{i} is not null then '{k}:' || cast(round(gap_{i}, 6) as varchar) end" for i, (k, _, _) in enumerate(_GAPS)) + ")"
_QUALITY = "case c_source_type when 'supplier' then least(0.95, 0.55 + case when c_verified then 0.15 else 0.0 end + case when c_audited then 0.15 else 0.0 end + case when " + f"not {_blank('c_boundary')}" + " then 0.10 else 0.0 end) when 'local_database' then 0.9 when 'epd' then 0.9 when 'literature' then 0.7 when 'external_database' then 0.75 else 0.6 end"
HARD = f"(coalesce(gap_3, 0) >= 0.8 or {_OF('GRADE_COMPOSITION')[0]} is not null or {_OF('GRADE_COMPOSITION')[1]} is not null)"

def coverage_sql(weights: dict[str, float]) -> str:
    return "round((" + " + ".join(f"case when not {_blank(_P[k][0])} and not {_blank(_P[k][1])} then cast({w} as double) else cast(0 as double) end" for k, w in weights.items()) + f") / cast({sum(weights.values())!r} as double), 6)"


_PAIR = """
  select request_id, source_id, 'exact' as channel from same
  union all select request_id, source_id, 'synonym' from (select * from named except select * from same)
  union all select request_id, source_id, 'related' from (
    select q.request_id, c.source_id from qn q join cn c on q.base_entity_id = c.base_entity_id where q.product_entity_id is null or q.product_entity_id = c.product_entity_id
    except (select * from named union select * from same))
"""


def _core(conflict: str, catalog: str = CATALOG_SQL, requests: str = REQUEST_SQL, pair: str = _PAIR, score: str = "", coverage: str = "", kind: str = "", prefix: str = "resolved:") -> str:
    """The chain up to ranked candidates; ``conflict`` tells which ids stand for several records. ``pair`` are the hits, the rest what proxies have of their own."""
    score = score or "round(" + " + ".join(f"cast({w} as double) * d_{k}" for k, w in _W.items()) + ", 6)"
    coverage = coverage or coverage_sql(_W)
    kind = kind or "case when channel = 'synonym' then 'direct_alias' when channel = 'related' then 'class_generic_proxy' when not bridge and replace(lower(c_factor_unit), ' ', '') <> replace(lower(q_target_unit), ' ', '') then 'unit_converted' else 'direct_exact' end"
    return f"""
with {UNITS}, {IMPACTS},
cat as (select *, {conflict} as conflict from ({catalog})), req as ({requests}),
cn as (select *, {_norm('material_name')} as norm from cat),
qn as (select *, {_norm('material_name')} as norm, coalesce(target_factor_unit, 'kgCO2e/' || quantity_unit) as target_unit from req),
ca as (select distinct source_id, {_norm('x')} as a from (select source_id, unnest(string_split(alias, ',')) as x from cat) where {_norm('x')} <> ''),
qa as (select distinct request_id, {_norm('x')} as a from (select request_id, unnest(string_split(aliases, ',')) as x from req where aliases is not null) where {_norm('x')} <> ''),
qal as (select request_id, list(a) as names from qa group by request_id),
named as (
  select q.request_id, c.source_id from qn q join ca c on q.norm = c.a union select q.request_id, c.source_id from qa q join cn c on q.a = c.norm union select q.request_id, c.source_id from qa q join ca c on q.a = c.a
),
same as (select q.request_id, c.source_id from qn q join cn c on q.norm = c.norm),
pair as ({pair}),{_factor('cunit', 'factor_unit', 'cat')},{_factor('tunit', 'target_unit', 'qn')},
hit as (
  select p.request_id, p.source_id, p.channel, q.material_name as q_name, q.norm as q_norm, q.quantity, q.quantity_unit, q.target_factor_unit as q_target, q.target_unit as q_target_unit, q.boundary as q_boundary, q.year as q_year, q.geography as q_geography,
    q.production_process as q_process, q.product_form as q_form, q.composition as q_composition, q.subject_type as q_subject, q.base_entity_id as q_base, q.product_entity_id as q_product, q.top_k, q.evidence_source, q.evidence_target, q.evidence_multiplier,
    c.material_name as c_name, c.norm as c_norm, c.factor_value, c.factor_unit as c_factor_unit, c.factor_kind as c_kind, c.subject_type as c_subject, c.production_process as c_process, c.product_form as c_form, c.composition as c_composition, c.year as c_year, c.geography as c_geography,
    c.boundary as c_boundary, c.boundary_modules as c_modules, c.source_quality_status as c_status, c.admission_eligible as c_admitted, c.indicator as c_indicator, c.declared_product as c_declared, c.base_entity_id as c_base, c.product_entity_id as c_product, c.source_type as c_source_type, c.verified as c_verified, c.audited as c_audited, c.document_sha256 as c_hash, c.priority_rank as c_priority, c.conflict as c_conflict, c.series_id as c_series, c.provider as c_provider,
    cu.impact as c_impact, cu.qualifier as c_qualifier, cu.canonical as c_canonical, cu.dimension as c_dim, cu.ratio as c_ratio, cu.evidence as c_ev, tu.evidence as t_ev, tu.impact as t_impact, tu.canonical as t_canonical, tu.dimension as t_dim, tu.ratio as t_ratio,
    u.canonical as u_canonical, u.dimension as u_dim, u.ratio as u_ratio, coalesce(qal.names, []) as q_aliases,
    {', '.join(f'{_dim(q, c)} as d_{k}' for k, (q, c) in _D.items())}
  from pair p join qn q on q.request_id = p.request_id join cn c on c.source_id = p.source_id
  left join cunit cu on cu.raw = c.factor_unit left join tunit tu on tu.raw = q.target_unit left join unit u on u.key = lower(q.quantity_unit) left join qal on qal.request_id = q.request_id
),
planned as (
  select *, case when c_dim is null then 'CATALOG_FACTOR_UNIT_INVALID' when t_dim is null then 'UNIT_SYNTAX_UNSUPPORTED' when c_dim <> t_dim then 'UNIT_DIMENSION_MISMATCH' when c_dim = 'VOLUME' and c_ev <> t_ev and not coalesce(evidence_source = c_canonical and evidence_target = t_canonical, false) then 'UNIT_CONVERSION_EVIDENCE_REQUIRED' end as plan_reason,
    case when c_dim = t_dim then c_impact / t_impact / (case when c_canonical = t_canonical then 1.0 when c_dim = 'VOLUME' and c_ev <> t_ev then case when evidence_source = c_canonical and evidence_target = t_canonical then cast(evidence_multiplier as double) end else c_ratio / t_ratio end) end as multiplier,
    coalesce(q_target is null and c_dim = 'MASS' and (t_dim = 'COUNT' or (t_dim = 'VOLUME' and not {_blank('q_form')})), false) as bridge,
    case when {_blank('c_declared')} then 'unknown' when {_norm('c_declared')} = q_norm or channel = 'synonym' then 'pass' else 'mismatch' end as declared_first,
    {_MODULES.format('q_boundary')} as wanted,
    (select string_agg(m, '|' order by m) from (select distinct upper(trim(m)) as m from unnest(string_split(coalesce(c_modules, ''), '|')) as t(m)) where m <> '') as observed
  from hit
),
gated as (
  select *, c_qualifier is not null and declared_first <> 'pass' as unproved,
    case when coalesce(q_base <> c_base, false) or (q_product is not null and c_product is not null and q_product <> c_product) or (q_product is not null and c_product is null) then 'mismatch' else 'pass' end as g_identity,
    case when c_kind = 'emission_limit' then 'mismatch' when c_kind in ('lifecycle_factor', 'epd_indicator', 'derived_proxy_factor', 'energy_factor', 'combustion_factor', 'transport_factor') then 'pass' else 'unknown' end as g_kind,
    case when c_kind = 'energy_factor' and c_subject <> 'energy' then 'mismatch' when c_kind = 'energy_factor' and q_subject = 'unknown' then 'unknown'
      when q_subject = 'unknown' and c_subject in ('energy', 'transport', 'process', 'waste') then 'unknown' when q_subject <> 'unknown' and c_subject <> 'unknown' and q_subject <> c_subject then 'mismatch' when c_subject = 'unknown' then 'unknown' else 'pass' end as g_subject,
    case when not c_admitted or c_status = 'REJECTED' then 'mismatch' when c_status = 'NEEDS_REVIEW' then 'unknown' when not regexp_full_match(coalesce(c_hash, ''), '[0-9a-f]{{64}}') then 'unknown' else 'pass' end as g_quality,
    case when c_indicator in ('GWP-total', 'gwp-total') then 'pass' when {_blank('c_indicator')} then 'unknown' else 'mismatch' end as g_indicator,
    case when wanted is null then 'mismatch' when observed is not null then case when observed = wanted then 'pass' else 'mismatch' end when coalesce(c_boundary, '') <> '' then case when lower(c_boundary) = lower(q_boundary) or (wanted = 'A1|A2|A3' and lower(c_boundary) in ('a1-a3', 'cradle-to-gate')) then 'pass' else 'mismatch' end else 'unknown' end as g_boundary,
    case when {_blank('q_geography')} or {_blank('c_geography')} then 'unknown' when q_geography = c_geography then 'pass' else 'mismatch' end as g_geography,
    case when q_year is null or c_year is null then 'unknown' when q_year = c_year then 'pass' else 'mismatch' end as g_year
  from planned
),
judged as (
  select *, case when unproved and {_blank('c_declared')} then 'mismatch' else declared_first end as g_declared,
    case when plan_reason in ('CATALOG_FACTOR_UNIT_INVALID', 'UNIT_SYNTAX_UNSUPPORTED') then 'mismatch' when unproved then 'unknown' when bridge or plan_reason is null then 'pass' else 'mismatch' end as g_unit
  from gated
),
qual as (select *, concat_ws('|', {', '.join(f"case when {t} then '{k}' end" for k, t in _EXCLUDE)}) as exclusions from judged),
dims as (
  select *, case when channel = 'proxy' or q_base = c_base or q_norm = c_norm or list_contains(q_aliases, c_norm) then 1.0 when contains(c_norm, q_norm) or contains(q_norm, c_norm) or len(list_filter(q_aliases, lambda a: contains(c_norm, a) or contains(a, c_norm))) > 0 then 0.8 else {_dim('q_name', 'c_name')} end as d_material,
    case when q_year is null and c_year is null then 1.0 when q_year is null or c_year is null then 0.5 when q_year = c_year then 1.0 when abs(q_year - c_year) <= 3 then 0.8 when abs(q_year - c_year) <= 10 then 0.5 else 0.2 end as d_time,
    case when bridge then c_canonical else t_canonical end as n_canonical, case when bridge then c_dim else t_dim end as n_dim
  from qual
),
scored as (
  select *, {score} as score, {coverage} as coverage,
    {', '.join(_SEV)}
  from dims
),
cand as (
  select *, {GAP_SUM} as severity, {kind} as resolution_type,
    case when bridge then factor_value else factor_value * multiplier end as factor, case when not bridge then quantity * (case when u_canonical = t_canonical then 1.0 else u_ratio / t_ratio end) end as resolved_quantity
      , '{prefix}' || source_id as candidate_id
  from scored where exclusions = '' and (bridge or u_dim = t_dim)
),
{_ranked('strong', 'ranked', 'cand', 'case when resolution_type = \'unit_converted\' then 1 else 0 end', '0')}
"""


_TYPE_RANK = "case resolution_type when 'direct_exact' then 0 when 'direct_alias' then 1 when 'unit_converted' then 2 when 'reference_flow_converted' then 3 when 'process_adjusted' then 4 when 'grade_exact_anchor' then 4 when 'grade_interpolated' then 5 when 'grade_proxy' then 6 when 'unadjusted_process_proxy' then 7 when 'class_technical_proxy' then 8 else 9 end"


def _ranked(strong: str, ranked: str, source: str, steps: str, assumptions: str) -> str:
    """Totals, strength, tier and place of the candidates in ``source``."""
    return f"""{strong} as (
  select *, factor * resolved_quantity * case when bridge then c_impact else t_impact end as total,
    round(least(1.0, greatest(0.0, cast(0.45 as double) * score + cast(0.30 as double) * coverage + cast(0.15 as double) * cast({_QUALITY} as double) + cast(0.10 as double) * greatest(0.0, 1.0 - cast(0.12 as double) * ({steps}) - cast(0.06 as double) * ({assumptions})) - least(0.25, cast(0.05 as double) * severity))), 6) as strength,
    case when {_blank('c_declared')} or ({_blank('c_boundary')} and {_blank('c_modules')}) or c_kind not in ('lifecycle_factor', 'epd_indicator', 'derived_proxy_factor', 'energy_factor', 'combustion_factor', 'transport_factor') or c_indicator is null or c_indicator not in ('GWP-total', 'gwp-total') or score < 0.65 then 'REFERENCE_ONLY'
      when resolution_type in ('direct_exact', 'direct_alias', 'unit_converted') then case when greatest({', '.join(f'coalesce(gap_{i}, 0.0)' for i in range(len(_GAPS)))}) >= 0.5 then 'USABLE_WITH_ASSUMPTIONS' else 'PRIMARY_RECOMMENDATION' end
      when resolution_type = 'grade_exact_anchor' then 'PRIMARY_RECOMMENDATION' when resolution_type in ('reference_flow_converted', 'process_adjusted', 'grade_interpolated', 'class_technical_proxy') then 'USABLE_WITH_ASSUMPTIONS' else 'REFERENCE_ONLY' end as tier,
    {_TYPE_RANK} as type_rank, greatest({', '.join(f'coalesce({g}, 0.0)' for g in _OF('GEOGRAPHY') + _OF('TEMPORAL'))}) as app_worst, {HARD} as hard
  from {source}
),
{ranked} as (
  select *, row_number() over (partition by request_id order by type_rank, case when app_worst = 0 then 0 when app_worst >= 0.5 then 2 else 1 end, app_worst, coalesce(c_priority, 100), strength desc, score desc, coverage desc, {assumptions}, source_id, candidate_id) as rank from {strong}
)
"""


CORE = _core("false")

_ROUTE_EDGES = f"edge0 as ({EDGE_SQL.format('P-')}), edge1 as (select *, " + ", ".join(
    f"{side}_total_energy_kgce_per_t * {side}_electricity_share / electricity_kgce_per_kwh * electricity_ef_kgco2e_per_kwh / 1000.0 + case when natural_gas_kgce_per_nm3 > 0 then {side}_total_energy_kgce_per_t * {side}_natural_gas_share / natural_gas_kgce_per_nm3 * natural_gas_ef_kgco2e_per_nm3 / 1000.0 end + coalesce({side}_additional_process, 0) as {side}_route"
    for side in ("reference", "target")
) + """ from edge0), edge as (select edge_id, reference_route, target_route, case when ambiguous then 'duplicate_parameter' when (reference_additional_process is null) <> (target_additional_process is null) then 'additional_process_one_sided' when natural_gas_kgce_per_nm3 <= 0 then 'parameter_not_positive' when abs(target_electricity_share + target_natural_gas_share - 1.0) > 1e-6 then 'shares_do_not_sum_to_one' when not includes_process then 'inclusion_not_proved' end as reason from edge1)"""
_MEMBER = f"""member as (
  select c.source_id, c.series_id, c.provider, {_norm('c.production_process')} as process, u.dimension, coalesce((select string_agg(m, '|' order by m) from (select distinct upper(trim(m)) as m from unnest(string_split(coalesce(c.boundary_modules, ''), '|')) as t(m)) where m <> ''), {_MODULES.format('c.boundary')}, '') as modules,
    cast(c.grade as double) as grade, c.factor_value * u.impact / u.ratio as base, {_norm('c.declared_product')} as declared
  from cat c join cunit u on u.raw = c.factor_unit
  where c.admission_eligible and c.source_quality_status = 'VERIFIED' and regexp_full_match(coalesce(c.document_sha256, ''), '[0-9a-f]{{64}}') and c.indicator in ('GWP-total', 'gwp-total') and c.factor_kind in ('lifecycle_factor', 'epd_indicator', 'derived_proxy_factor', 'energy_factor', 'combustion_factor', 'transport_factor') and c.grade > 0 and c.grade <= 100 and not c.conflict and not {_blank('c.declared_product')}
)"""
_SAME = "m.series_id = s.c_series and m.provider = s.c_provider and m.process = s.own_process and m.dimension = s.c_dim and m.modules = coalesce(s.observed, s.own_modules, '') and (contains(m.declared, s.own_declared) or contains(s.own_declared, m.declared))"

def stepped(core: str, prefix: str = "resolved:") -> str:
    """A chain of hits, then flows, routes, grades, and the pool."""
    return core + f""", {_ROUTE_EDGES}, {_MEMBER},
flow as (select {_norm('material')} as norm, record_id, cast(mass_per_unit as double) as mass from ({FLOW_SQL}) where mass_per_unit > 0),
p1 as (select c.* exclude (candidate_id), f.record_id, f.mass, bridge and f.record_id is null as flow_missing, case when bridge then c_dim else t_dim end as x_dim, case when bridge then c_ratio else t_ratio end as x_ratio, case when bridge then c_impact else t_impact end as x_impact from cand c left join flow f on c.bridge and f.norm = c.q_norm and c.u_canonical = 'item'),
p2 as (select p1.* replace (case when mass is not null then quantity * mass / c_ratio else resolved_quantity end as resolved_quantity, case when mass is not null then 'reference_flow_converted' else resolution_type end as resolution_type, case when mass is null then gap_2 end as gap_2),
    '{prefix}' || source_id || case when record_id is not null then ':' || record_id else '' end as candidate_1, case when mass is not null then 1 else 0 end + case when resolution_type = 'unit_converted' then 1 else 0 end as steps_1, not flow_missing and (gap_3 is not null or gap_4 is not null) as asked, factor * x_impact / x_ratio - e.reference_route as upstream, e.edge_id as edge_id, e.reason as edge_reason, e.target_route from p1 left join edge e on e.edge_id = p1.source_id),
p3 as (select *, asked and edge_id is not null and x_dim = 'MASS' and edge_reason is null and upstream >= -1e-12 as adjusted from p2),
p4 as (select * replace (case when adjusted then (greatest(0.0, upstream) + target_route) * x_ratio / x_impact else factor end as factor, case when adjusted then round(score + cast(0.2 as double) * (1 - d_process), 6) else score end as score, case when adjusted then 'process_adjusted' when asked then 'unadjusted_process_proxy' else resolution_type end as resolution_type, case when not adjusted then gap_3 end as gap_3, case when not adjusted then gap_4 end as gap_4),
    steps_1 + case when adjusted then 1 else 0 end as steps_2, not flow_missing and (gap_5 is not null or gap_6 is not null) as graded, {_norm("coalesce(cast(c_process as varchar), '')")} as own_process, {_MODULES.format('c_boundary')} as own_modules, coalesce(nullif({_norm("coalesce(c_declared, '')")}, ''), c_norm) as own_declared, try_cast(replace(q_composition, '%', '') as double) as raw_grade from p3),
p5 as (select *, case when graded and raw_grade > 0 and raw_grade <= 100 then raw_grade end as q_grade from p4),
p6 as (select s.*, (select max(m.grade) from member m where {_SAME} and m.grade <= s.q_grade) as lower_grade, (select min(m.grade) from member m where {_SAME} and m.grade >= s.q_grade) as upper_grade, (select min_by(m.base, (abs(m.grade - s.q_grade), m.source_id)) from member m where {_SAME} and s.q_grade is not null) as near_base from p5 s),
p7 as (select s.*, (select min_by(m.base, m.source_id) from member m where {_SAME} and m.grade = s.lower_grade) as low_base, (select min_by(m.base, m.source_id) from member m where {_SAME} and m.grade = s.upper_grade) as high_base, case when not graded then null when lower_grade = upper_grade then 'exact' when lower_grade is not null and upper_grade is not null then 'interpolated' else 'nearest' end as method from p6 s),
p8 as (select * replace (case when graded then coalesce(case method when 'exact' then low_base when 'interpolated' then low_base + (q_grade - lower_grade) / (upper_grade - lower_grade) * (high_base - low_base) else near_base end * x_ratio / x_impact, factor) else factor end as factor, case method when 'exact' then 'grade_exact_anchor' when 'interpolated' then 'grade_interpolated' when 'nearest' then 'grade_proxy' else resolution_type end as resolution_type, case when coalesce(method, '') not in ('exact', 'interpolated') then gap_5 end as gap_5, case when coalesce(method, '') not in ('exact', 'interpolated') then gap_6 end as gap_6),
    candidate_1 || case method when 'exact' then ':grade-exact' when 'interpolated' then ':grade-interpolated' when 'nearest' then ':grade-proxy' else '' end as candidate_id, steps_2 + case when method = 'interpolated' then 1 else 0 end as steps_3, case when method in ('interpolated', 'nearest') then 1 else 0 end as assumed from p7),
p9 as (select * replace ({GAP_SUM} as severity) from p8 where not flow_missing),
{_ranked('strong2', 'pool', 'p9', 'steps_3', 'assumed')}"""


#: The whole resolver, with duplicates in the catalogue.
STEPPED = stepped(_core("grade % 19 = 0"))
