"""Queries over identity resolution, the late proxy branch and decisions as events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import decide as D
from attestry.operators import decisions as E
from attestry.operators import identity as I
from attestry.operators import retrieve as R
from attestry.plans import domain
from attestry.operators import score as S
from attestry.operators.tables import Steps
from attestry.plans.oracle_core import CORE, _core, _norm, coverage_sql, stepped
from attestry.queries import query


def duck(sql: str) -> str:
    """A statement of ``domain`` with the array constructors of the other engine."""
    return sql.replace("cast(array() as array<string>)", "cast([] as varchar[])").replace("array(", "list_value(")


#: Regular expressions without lookaround; a group takes what counts, the rest is the context.
_ROLES = [
    ("grit_size", r"(?:^|[^a-z0-9])([fp]\s*-?\s*[0-9]{2,3})(?:[^0-9]|$)"), ("model_code", r"(?:^|[^a-z0-9])((?:t|ct|ca)\s*-?\s*[0-9]{1,4})(?:[^0-9]|$)"),
    ("year", r"(?:^|[^0-9])(20[0-9]{2})(?:[^0-9]|$)"), ("particle_size", r"([0-9]+(?:\.[0-9]+)?\s*(?:mm|cm|um|mesh))\b"), ("packaging", r"([0-9]+(?:\.[0-9]+)?\s*kg)"),
]
_PERCENT = r"(?:(mgo|al2o3|sic|al|si)\s*)?(?:>=|≤|<=|≥|>|=)?\s*([0-9]+(?:\.[0-9]+)?)\s*%"
_FORMULA = r"(?:^|[^a-z0-9])(mgo|al2o3|sic|al|si)\s*(?:>=|≤|<=|≥|>|=)?\s*([0-9]+(?:\.[0-9]+)?)(?:[^a-z0-9.]|$)"
_BASIS = "case {0} when 'mgo' then 'component.MgO' when 'al2o3' then 'component.Al2O3' when 'sic' then 'component.SiC' when 'al' then 'element.Al' when 'si' then 'element.Si' end"


def _spans(names: str, aliases: str, guard: str) -> str:
    """name, rule_id, start, size of all places of aliases: all substrings of the lengths that occur."""
    return f"""(
  select s.name, a.rule_id, s.start, s.size from (select name, start, size, substr(name, start + 1, size) as part from (select name, unnest(range(0, length(name))) as start from {names}) cross join (select distinct length(alias) as size from {aliases}) where start + size <= length(name)) s
  join {aliases} a on a.alias = s.part
  where case when regexp_matches(a.alias, '[一-鿿]') then {guard} else not regexp_matches(substr(' ' || s.name || ' ', s.start + 1, 1) || substr(' ' || s.name || ' ', s.start + s.size + 2, 1), '[0-9A-Za-z]') end
)"""


_SINGLE = "length(a.alias) > 1 or length(s.name) = 1 or s.name[s.start - 1:s.start] = '金属' or regexp_matches(s.name[s.start + 2:], '^(纤维|卷|材|板|丝|锭|粉|管)')"


def _graded(text: str, key: str, prefix: str) -> str:
    """CTEs that end in <prefix>_grade(key columns, tokens, value, kind, schema_id, open) for a text and the entity of its name."""
    steps, last = [], f"{prefix}_0 as (select distinct {text} as t, base_entity_id as e, {text} as m, cast([] as varchar[]) as tokens from who where {text} is not null)"
    for i, (role, pattern) in enumerate(_ROLES):
        steps.append(last)
        last = f"{prefix}_{i + 1} as (select t, e, regexp_replace(m, '{pattern}', '#', 'g') as m, list_concat(tokens, list_transform(regexp_extract_all(m, '{pattern}', 1), lambda x: '{role}:' || x)) as tokens from {prefix}_{i})"
    number = lambda p, k: f"try_cast(nullif(regexp_extract(m, '{p}', {k}), '') as double)"
    return ", ".join([*steps, last]) + f""",
{prefix}_fit as (
  select p.t, p.e, count(*) as n, min(x) as value, min(b.schema_id) as schema_id from (select t, e, cast(unnest(regexp_extract_all(replace(m, ' ', '  '), '(?:^|[^a-z0-9.])([0-9][0-9](?:\\.[0-9]+)?)(?:[^a-z0-9.]|$)', 1)) as double) as x from {prefix}_{len(_ROLES)}) p
  join bare b on b.e = p.e and list_contains(b.labels, p.x) group by p.t, p.e
),
{prefix}_like as (select distinct t, e from (select t, e, cast(unnest(regexp_extract_all(replace(m, ' ', '  '), '(?:^|[^a-z0-9.])([0-9][0-9](?:\\.[0-9]+)?)(?:[^a-z0-9.]|$)', 1)) as double) as x from {prefix}_{len(_ROLES)}) where x in (70, 80, 90)),
{prefix}_label as (
  select t, e, value, schema_id from (select p.t, p.e, s.schema_id, s.labels, try_cast(nullif(regexp_extract(p.m, '(?:^|[^a-z0-9])' || s.prefix || '\\s*-?\\s*([0-9]{{2}}(?:\\.[0-9]+)?)(?:[^0-9]|$)', 1), '') as double) as value from {prefix}_{len(_ROLES)} p join labelled s on s.e = p.e) where list_contains(labels, value)
),
{prefix}_read as (
  select p.t, p.e, tokens, {number(_PERCENT, 2)} as percent, coalesce({_BASIS.format(f"regexp_extract(m, '{_PERCENT}', 1)")}, b.basis) as percent_basis, b.schema_id as bare_id, {number(_FORMULA, 2)} as formula, {_BASIS.format(f"regexp_extract(m, '{_FORMULA}', 1)")} as formula_basis,
    l.value as label, l.schema_id as label_id, f.value as loose, f.schema_id as loose_id, coalesce(f.n, 0) as n, k.t is not null as alike
  from {prefix}_{len(_ROLES)} p left join bare b on b.e = p.e left join {prefix}_label l on l.t = p.t and l.e = p.e left join {prefix}_fit f on f.t = p.t and f.e = p.e left join {prefix}_like k on k.t = p.t and k.e is not distinct from p.e
),
{prefix}_grade as (
  select t, e, tokens, case when percent > 0 and percent <= 100 and percent_basis is not null then percent when formula > 0 and formula <= 100 then formula when label is not null then label when n = 1 then loose end as value,
    case when percent > 0 and percent <= 100 and percent_basis is not null then coalesce(bare_id, 'explicit.' || percent_basis || '/v1') when formula > 0 and formula <= 100 then 'explicit.' || formula_basis || '/v1' when label is not null then label_id when n = 1 then loose_id end as schema_id,
    not (percent > 0 and percent <= 100 and percent_basis is not null) is true and (formula > 0 and formula <= 100) is not true and label is null and (n > 1 or (n = 0 and alike)) as open
  from {prefix}_read
)""".replace("not (percent > 0 and percent <= 100 and percent_basis is not null) is true", "(percent > 0 and percent <= 100 and percent_basis is not null) is not true")


_IDENTITY = f"""
with mr as ({duck(domain.MATERIAL_RULES_SQL)}), pr as ({duck(domain.PROCESS_RULES_SQL)}), fr as ({duck(domain.FORM_RULES_SQL)}), gs as ({duck(domain.SCHEMA_SQL)}),
own as (select distinct material_name, product_form, composition, production_process from ({domain.NAMED_SQL})),
n as (select *, {_norm('material_name')} as value, nullif({_norm("coalesce(product_form, '')")}, '') as fv, nullif({_norm("coalesce(composition, '')")}, '') as cv, nullif({_norm("coalesce(production_process, '')")}, '') as pv from own),
ma as (select distinct rule_id, {_norm('x')} as alias from (select rule_id, unnest(aliases) as x from mr where status = 'active')),
pa as (select distinct rule_id, {_norm('x')} as alias from (select rule_id, unnest(aliases) as x from pr where status = 'active')),
fa as (select distinct rule_id, {_norm('x')} as alias from (select rule_id, unnest(aliases) as x from fr where status = 'active')),
v as (select distinct value as name from n), said as (select value as name from n union select pv from n where pv is not null union select fv from n where fv is not null),
met as (select name, list_sort(list({{'a': -size, 'b': start, 'c': rule_id}})) as ms from {_spans('v', 'ma', _SINGLE)} group by name),
packed as (select name, list_reduce(list_transform(ms, lambda m: [m]), lambda k, x: case when len(list_filter(k, lambda y: x[1].b < y.b - y.a and y.b < x[1].b - x[1].a)) > 0 then k else list_concat(k, x) end) as kept from met),
placed as (select name, m.c as rule_id, min(m.b) as start from (select name, unnest(kept) as m from packed) group by all),
ordered as (select p.name, p.start, r.* from placed p join mr r on r.rule_id = p.rule_id),
parts as (select name, list_sort(list(distinct x)) as parts from (select name, unnest(case when len(constituents) > 0 then constituents else [entity_id] end) as x from ordered) where x is not null group by name),
summary as (select name, count(*) as c, string_agg(rule_id, '|' order by start, rule_id) as rules, min_by(rule_id, start) as first_rule, min_by(rule_id, start) filter (entity_type = 'COMPOSITE') as explicit from ordered group by name),
entity as (
  select s.*, p.parts, (s.explicit is not null or s.c > 1) and len(p.parts) >= 2 as composed, r.entity_id, r.entity_type as own_type, r.category as own_category, r.family, r.product_entity_id as own_product, r.product_family_id as own_family, x.product_entity_id as mixed_product, r.route, r.head_material as own_head
  from summary s left join parts p on p.name = s.name left join mr r on r.rule_id = coalesce(s.explicit, case when s.c = 1 then s.first_rule end) left join mr x on x.rule_id = s.explicit
),
who as (
  select n.*, case when composed then 'composite:' || array_to_string(parts, '+') else entity_id end as base_entity_id, case when composed then mixed_product else own_product end as product_entity_id, case when composed then 'family.composite_materials' else coalesce(own_family, family) end as product_family_id,
    case when composed then 'COMPOSITE' else coalesce(own_type, 'UNKNOWN') end as entity_type, case when composed then 'manufactured_mineral' else coalesce(own_category, 'unknown') end as category, case when composed or own_type is not null then 'RESOLVED' else 'UNKNOWN' end as outcome, coalesce(rules, '') as rules, route, case when composed then 'composite' else own_head end as head
  from n left join entity e on e.name = n.value
),
process as (select name, min_by(p.process, (-size, s.rule_id)) as process from {_spans('said', 'pa', 'true')} s join pr p on p.rule_id = s.rule_id group by name),
form as (select name, min_by(f.product_form, (-size, s.rule_id)) as form from {_spans('said', 'fa', 'true')} s join fr f on f.rule_id = s.rule_id group by name),
bare as (select unnest(entity_ids) as e, schema_id, basis, labels from gs where len(prefixes) = 0), labelled as (select unnest(entity_ids) as e, schema_id, labels, unnest(prefixes) as prefix from gs),
{_graded('value', 'value', 'nm')}, {_graded('cv', 'cv', 'gv')},
whole as (
  select w.*, coalesce(p1.process, p2.process, pv) as process, coalesce(f1.form, f2.form, fv) as form, coalesce(g.value, m.value) as grade_value, coalesce(g.schema_id, m.schema_id) as grade_schema, array_to_string(m.tokens, '|') as tokens, m.open,
    contains(w.value, '446') as heat, contains(w.value, 'copper plated') as plated
  from who w left join process p1 on p1.name = w.value left join process p2 on p2.name = w.pv left join form f1 on f1.name = w.value left join form f2 on f2.name = w.fv
  left join nm_grade m on m.t = w.value and m.e is not distinct from w.base_entity_id left join gv_grade g on g.t = w.cv and g.e is not distinct from w.base_entity_id
)
"""


@query(_IDENTITY + """
select material_name, product_form, composition, production_process, outcome, base_entity_id, product_entity_id, product_family_id, entity_type, category, rules, process, form, tokens, grade_value,
  case when grade_value is not null then grade_schema || ':' || regexp_replace(cast(grade_value as varchar), '\\.0$', '') when head = 'steel' and heat then 'AISI 446 / UNS S44600' end as grade,
  concat_ws('|', case when entity_type = 'PRODUCT_FAMILY' and product_entity_id is null then 'product_variant' when head = 'steel' and form = 'fiber' and not heat and not plated then 'steel_fiber_type|steel_grade_or_family|surface_coating|application' when head = 'steel' and form = 'fiber' and heat and process is null then 'manufacturing_route' end,
    case when grade_value is null and open then 'numeric_grade_basis' end) as unresolved,
  case when product_entity_id is not null then product_entity_id when base_entity_id = 'mat.element.aluminium' and product_family_id = 'family.aluminium_products' then 'mat.product.primary_aluminium|mat.product.secondary_aluminium' else '' end as allowed,
  case when entity_type = 'COMPOSITE' then entity_type when regexp_matches(value, '金属|\\bmetal\\b') then 'ELEMENTAL_METAL' when regexp_matches(value, '合金|\\balloy\\b') then 'ALLOY' else entity_type end as hint
from whole""")
def identity_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct way in which ``part`` is named, against rule tables made from it."""
    found = I.resolve(domain.named(spark, sf), domain.registry(spark, sf))
    joined = lambda c: F.array_join(c, "|")
    return found.select(
        *I.KEYS, "outcome", "base_entity_id", "product_entity_id", "product_family_id", "entity_type", "category", joined("rule_ids").alias("rules"), F.col("resolved_process").alias("process"), F.col("resolved_form").alias("form"),
        joined(F.transform("numeric_tokens", lambda t: F.concat(t["role"], F.lit(":"), F.trim(t["raw"])))).alias("tokens"), "grade_value", "grade", joined("unresolved").alias("unresolved"), joined("allowed_products").alias("allowed"), F.col("entity_type_hint").alias("hint"),
    )


@query(CORE + """, resolved as (
  select request_id, source_id, 'exact' as channel from same union all select request_id, source_id, 'synonym' from (select * from named except select * from same)
  union all select request_id, source_id, 'related' from (select q.request_id, c.source_id from qn q join cn c on q.base_entity_id = c.base_entity_id except (select * from named union select * from same))
) select r.request_id, r.source_id, channel, q.base_entity_id as base_entity_id from resolved r join qn q on q.request_id = r.request_id""")
def identity_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Channels of requests and records that state no entity: the rules of names and brands find the ids that the tables have."""
    bare = lambda df: df.drop("base_entity_id", "product_entity_id")
    q, c = D.with_identities(bare(domain.requests(spark, sf)), bare(domain.catalog(spark, sf)), domain.registry(spark, sf))
    found = R.members(R.retrieve(R.alike(R.bare(q)), R.classes(R.bare(c))), "channel", "q_base_entity_id")
    return found.select(F.col("q_request_id").alias("request_id"), F.col("c_source_id").alias("source_id"), "channel", F.col("q_base_entity_id").alias("base_entity_id"))


_RECORDS, _REQUESTS = domain.FAMILY_CATALOG_SQL, domain.FAMILY_REQUEST_SQL
_CLASS = "struct_pack(family := case when regexp_matches({n} || '/' || {c}, 'steel|metal|aluminium|aluminum|copper') then 'metals' when regexp_matches({n} || '/' || {c}, 'polymer|plastic|resin') then 'polymers' when regexp_matches({n} || '/' || {p}, 'fused|sintered|calcined') then 'manufactured minerals' when regexp_matches({n} || '/' || {p}, 'mining|quarried|ore') then 'natural minerals' when regexp_matches({n} || '/' || {c}, 'glass|ceramic') then 'inorganics' else coalesce(nullif({c}, ''), 'unknown') end, category := case when regexp_matches({n} || '/' || {c}, 'steel|metal|aluminium|aluminum|copper') then 'metal' when regexp_matches({n} || '/' || {c}, 'polymer|plastic|resin') then 'synthetic_chemical' when regexp_matches({n} || '/' || {p}, 'fused|sintered|calcined') then 'manufactured_mineral' when regexp_matches({n} || '/' || {p}, 'mining|quarried|ore') then 'natural_mineral' when regexp_matches({n} || '/' || {c}, 'glass|ceramic') then 'manufactured_mineral' else 'unknown' end)"
_OWN_CLASS = _CLASS.format(n=_norm("coalesce(q_name, '')"), c=_norm("coalesce(q_composition, '')"), p=_norm("coalesce(q_process, '')"))
_ROUTES = "count(distinct case own_process when 'primary' then 'primary' when 'secondary recycling' then 'secondary' end) filter (q_base is not null and q_product is null and not flow_missing) > 1"
_ASK_SUBJECT = "bool_or(q_subject = 'unknown' and (coalesce(c_kind, '') in ('energy_factor', 'combustion_factor', 'transport_factor') or c_subject in ('energy', 'transport', 'process', 'waste')))"
#: What the first pass leaves: requests without gaps of their own that have no candidate or only another material's.
_NEEDS = f"""needs as materialized (
  with a as ({stepped(_core("false", _RECORDS, _REQUESTS))} select q.request_id, coalesce(subject_gap, false) or coalesce(route_gap, false) or coalesce(flow_wanted, false) as gapped, coalesce(n, 0) as n, coalesce(absent, false) as absent from req q
    left join (select request_id, {_ASK_SUBJECT} as subject_gap from qual group by request_id) s on s.request_id = q.request_id left join (select request_id, {_ROUTES} as route_gap, bool_or(flow_missing) as flow_wanted from p8 group by request_id) r on r.request_id = q.request_id
    left join (select request_id, count(*) as n, bool_or(gap_7 is not null) as absent from pool group by request_id) p on p.request_id = q.request_id)
  select request_id from a where not gapped and (n = 0 or absent)
)"""
_CLASSED = _CLASS.format(n=_norm("q.material_name"), c=_norm("coalesce(q.composition, '')"), p=_norm("coalesce(q.production_process, '')"))
_HAYS = f"{_norm("c.material_name || ' ' || c.material_class || ' ' || coalesce(c.family, '')")}"
_PROXIES = f"""
  select q.request_id, c.source_id, 'proxy' as channel from (select request_id, norm, {_CLASSED} as class from qn q where request_id in (select request_id from needs)) q join (select source_id, {_HAYS} as hay from cn c) c on contains(c.hay, q.norm) or contains(c.hay, q.class.family)
"""


def _by_category(of) -> str:
    return f"case ({_OWN_CLASS}).category " + " ".join(f"when '{k}' then {of(w)}" for k, w in S.PROXY.items() if k != "default") + f" else {of(S.PROXY['default'])} end"


_SCORED = _by_category(lambda w: "round(" + " + ".join(f"cast({v!r} as double) * d_{k}" for k, v in w.items()) + ", 6)")
_LATE = stepped(_core("false", _RECORDS, _REQUESTS, _PROXIES, _SCORED, _by_category(coverage_sql), "case when d_process >= 0.65 then 'class_technical_proxy' else 'class_generic_proxy' end", "proxy:"), "proxy:")


@query(f"with {_NEEDS} select * from ({_LATE} select request_id, source_id, candidate_id, resolution_type, score, coverage, strength, tier, hard, round(factor, 9) as factor, round(total, 9) as total from pool)")
def late_proxies(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates by material class of the requests that the first pass leaves without one, after their steps."""
    steps = Steps(spark)
    q, c = (steps.cut(side) for side in D.prepared_classes(domain.requests(spark, sf, _REQUESTS), domain.family_catalog(spark, sf), domain.flows(spark, sf), domain.edges(spark, sf)))
    found = D.late_candidates(steps.cut(D.wanting(q, c)), c)
    # a pair of classes is told once, its totals once a request, and only then are records set out
    said = {k: k for k in ("resolution_type", "score", "coverage", "strength", "tier", "hard", "factor", "impact")} | {"shown": "round(factor, 9)"}
    told = D.set_out(found, said, {"total": "round(factor * resolved_quantity * impact, 9)"}, "proxy:")
    return told.select("request_id", "source_id", "candidate_id", "resolution_type", "score", "coverage", "strength", "tier", "hard", F.col("shown").alias("factor"), "total")


# ---- decisions as events -----------------------------------------------------------------------------------------------------
_EVENTS = """select cast(user_id as string) || '/' || cast(event_id % 20 as string) as request_id, ts, event_id, case event_type when 'signup' then 'save' when 'error' then 'lock' else 'decide' end as kind,
  case event_id % 7 when 0 then 'unresolved' when 1 then 'reference_review_required' else 'recommendation_ready' end as status, case event_id % 3 when 0 then 'REFERENCE_ONLY' when 1 then 'USABLE_WITH_ASSUMPTIONS' else 'PRIMARY_RECOMMENDATION' end as tier,
  case when event_id % 11 <> 0 then 'P-' || cast(event_id as string) end as candidate, cast(case when event_id % 5 = 0 then 2 else 1 end as int) as expected, event_type <> 'click' as approve, case when value > 20 then 'override' else 'standard' end as mode,
  value > 10 as accepted, case when event_type = 'view' then 'seen' else '' end as reason from events"""
_PLAYED = f"""
with e as ({_EVENTS}), s as (select request_id, min((ts, event_id)) as seq from e where kind = 'save' group by 1), run as (select e.request_id, s.seq, e.status, e.tier, e.candidate from e join s on s.request_id = e.request_id and (e.ts, e.event_id) = s.seq),
told as (select e.*, (e.ts, e.event_id) as seq, r.seq as run_seq, case when not approve then null when r.status = 'unresolved' or r.candidate is null then 'nothing_selectable' when r.tier = 'REFERENCE_ONLY' and (mode <> 'override' or reason = '') then 'override_required' when r.tier = 'USABLE_WITH_ASSUMPTIONS' and not coalesce(accepted, false) then 'acceptance_required' end as refusal from e left join run r on r.request_id = e.request_id),
d as (select request_id, min(seq) as seq from told where kind = 'decide' and seq > run_seq and expected = 1 and refusal is null group by 1), dec as (select t.request_id, t.seq, t.approve, t.mode, t.accepted, t.reason from told t join d on d.request_id = t.request_id and t.seq = d.seq),
l as (select t.request_id, min(t.seq) as seq from told t join dec on dec.request_id = t.request_id where t.kind = 'lock' and t.seq > dec.seq and dec.approve group by 1),
played as (
  select t.request_id, t.event_id, t.kind, t.candidate, t.approve, case when kind = 'save' then case when t.seq = run_seq then 'applied' else 'run_exists' end when run_seq is null or t.seq < run_seq then 'no_run'
    when kind = 'decide' then case when t.seq = dec.seq then 'applied' when t.seq > dec.seq then case when t.approve = dec.approve and t.mode is not distinct from dec.mode and coalesce(t.accepted, false) = coalesce(dec.accepted, false) and t.reason = dec.reason then 'replayed' else 'another_decision' end when t.expected <> 1 then 'stale' else refusal end
    else case when t.seq = l.seq then 'applied' when t.seq > l.seq then 'replayed' else 'not_approved' end end as outcome
  from told t left join dec on dec.request_id = t.request_id left join l on l.request_id = t.request_id
)
"""


def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    return domain.frame(spark, sf, _EVENTS, "events").withColumn("seq", F.struct("ts", "event_id"))


@query(_PLAYED + "select event_id, request_id, kind, outcome, case when outcome = 'applied' then case kind when 'save' then 1 when 'decide' then 2 else 3 end end as revision from played")
def decision_events(spark: SparkSession, sf: str) -> DataFrame:
    """What every event comes to: saves, decisions at a stated revision, repeated and contrary ones, locks."""
    return E.played(_decisions(spark, sf)).select("event_id", "request_id", "kind", "outcome", "revision")


@query(_PLAYED + "select request_id, max(case kind when 'save' then 1 when 'decide' then 2 else 3 end) filter (outcome = 'applied') as revision, case max(case kind when 'save' then 1 when 'decide' then 2 else 3 end) filter (outcome = 'applied') when 3 then 'locked' when 1 then 'open' else case when bool_or(approve) filter (outcome = 'applied' and kind = 'decide') then 'approved' else 'rejected' end end as state, max(candidate) filter (outcome = 'applied' and kind = 'save') as candidate, count(*) filter (outcome <> 'applied') as refused from played group by request_id having count(*) filter (outcome = 'applied') > 0")
def decision_states(spark: SparkSession, sf: str) -> DataFrame:
    return E.states(_decisions(spark, sf))
