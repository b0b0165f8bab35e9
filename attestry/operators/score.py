"""Dimension scores, weighted score, evidence coverage, gaps, plan execution, strength, tier and confidence of candidates.

Formulas are texts of expressions over the joined frame, so that a whole stage is parsed and analysed at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry.functions.text import prepared_score
from attestry.functions.units import activity_plan, factor_plan
from attestry.operators.qualify import LIFECYCLE, OPERATIONAL, _blank, _in

# Weights of the seven dimensions for direct hits and proxies by material category; source quality by type; type order.
DIRECT = {"material": 0.25, "process": 0.20, "form": 0.10, "composition": 0.15, "geography": 0.10, "time": 0.10, "boundary": 0.10}
PROXY = {
    "default": {"material": 0.10, "process": 0.25, "form": 0.15, "composition": 0.20, "geography": 0.10, "time": 0.10, "boundary": 0.10},
    "natural_mineral": {"material": 0.15, "process": 0.25, "form": 0.15, "composition": 0.15, "geography": 0.10, "time": 0.10, "boundary": 0.10},
    "manufactured_mineral": {"material": 0.10, "process": 0.30, "form": 0.10, "composition": 0.20, "geography": 0.10, "time": 0.10, "boundary": 0.10},
    "synthetic_chemical": {"material": 0.20, "process": 0.25, "form": 0.05, "composition": 0.25, "geography": 0.10, "time": 0.05, "boundary": 0.10},
}
QUALITY = {"supplier": 0.55, "local_database": 0.9, "epd": 0.9, "literature": 0.7, "external_database": 0.75}
TYPES = {"direct_exact": 0, "direct_alias": 1, "unit_converted": 2, "reference_flow_converted": 3, "process_adjusted": 4, "grade_exact_anchor": 4, "grade_interpolated": 5, "grade_proxy": 6, "unadjusted_process_proxy": 7, "class_technical_proxy": 8, "class_generic_proxy": 9}
MIN_SCORE = 0.65
DIRECT_TYPES = ("direct_exact", "direct_alias", "unit_converted")
PAIRS = {"material": ("q_material_name", "c_material_name"), "process": ("q_production_process", "c_production_process"), "form": ("q_product_form", "c_product_form"), "composition": ("q_composition", "c_composition"), "geography": ("q_geography", "c_geography"), "time": ("q_year", "c_year"), "boundary": ("q_boundary", "c_boundary")}
#: The least gap severity that forbids a selection, by type.
HARD = "((g.type = 'PROCESS_VARIANT' and g.severity >= 0.8D) or g.type = 'GRADE_COMPOSITION')"


def lookup(values: dict, key: str, default) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then {v!r}{'D' if isinstance(v, float) else ''}" for k, v in values.items()) + f" else {default!r}{'D' if isinstance(default, float) else ''} end"


def time_score(q: str = "q_year", c: str = "c_year") -> str:
    return f"case when {q} is null and {c} is null then 1D when {q} is null or {c} is null then 0.5D when {q} = {c} then 1D when abs({q} - {c}) <= 3 then 0.8D when abs({q} - {c}) <= 10 then 0.5D else 0.2D end"


def material_score() -> str:
    """1 for the same entity, or the record's name among the request's names (its own and its aliases); 0.8 if one of these holds the other."""
    inside = lambda n: f"({n} <> '' and (instr(c_norm, {n}) > 0 or instr({n}, c_norm) > 0))"
    return f"case when q_base_entity_id = c_base_entity_id or q_norm = c_norm or array_contains(q_alias_norms, c_norm) then 1D when {inside('q_norm')} or exists(q_alias_norms, a -> {inside('a')}) then 0.8D else {prepared_score('q_norm', 'c_norm', 'q_t_material', 'c_t_material')} end"


def _where(test: str | None, cols: dict[str, str]) -> dict[str, Column]:
    """Expressions that are worked out only where ``test`` holds."""
    return {k: F.expr(f"if({test}, {x}, null)" if test else x) for k, x in cols.items()}


def with_dimensions(df: DataFrame, test: str | None = None, proxy: bool = False) -> DataFrame:
    """The seven dimensions; a proxy has been found by its class, so its material counts in full."""
    cols = {f"d_{k}": prepared_score(f"q_n_{q[2:]}", f"c_n_{c[2:]}", f"q_t_{q[2:]}", f"c_t_{c[2:]}") for k, (q, c) in PAIRS.items() if k not in ("material", "time")}
    return df.withColumns(_where(test, cols | {"d_material": "1D" if proxy else material_score(), "d_time": time_score()}))


def weighted_score(weights: dict[str, float] = DIRECT) -> str:
    return "round(" + " + ".join(f"{w!r}D * d_{k}" for k, w in weights.items()) + ", 6)"


def proxy_score(category: str) -> str:
    """The score under the weights of the material category."""
    return f"case {category} " + " ".join(f"when '{k}' then {weighted_score(w)}" for k, w in PROXY.items() if k != "default") + f" else {weighted_score(PROXY['default'])} end"


def proxy_coverage(category: str) -> str:
    """The evidence coverage under the weights of the material category."""
    return f"case {category} " + " ".join(f"when '{k}' then {evidence_coverage(w)}" for k, w in PROXY.items() if k != "default") + f" else {evidence_coverage(PROXY['default'])} end"


def evidence_coverage(weights: dict[str, float] = DIRECT) -> str:
    both = lambda k: f"not {_blank(PAIRS[k][0])} and not {_blank(PAIRS[k][1])}"
    return "round((" + " + ".join(f"if({both(k)}, {w!r}D, 0D)" for k, w in weights.items()) + f") / {sum(weights.values())!r}D, 6)"


def missing_evidence() -> str:
    """Names of the fields that either side lacks, in a fixed order."""
    sides = [(f"missing_{side}_{k}", c) for k, pair in PAIRS.items() for side, c in zip(("target", "source"), pair, strict=True)]
    return "array_compact(array(" + ", ".join(f"if({_blank(c)}, '{name}', null)" for name, c in sides) + "))"


def _plain(c: str) -> str:
    return f"replace(lower({c}), ' ', '')"


def _different(k: str) -> str:
    q, c = (f"{side}_n_{PAIRS[k][0][2:]}" for side in "qc")
    return f"({q} is not null and {c} is not null and {q} <> {c})"


def _absent(k: str) -> str:
    q, c = (f"{side}_n_{PAIRS[k][0][2:]}" for side in "qc")
    return f"({q} is not null and {c} is null)"


#: Whether a candidate is another material than the wanted one.
ABSENT = f"(channel = 'proxy' or channel = 'related' and not ({' or '.join(f(k) for k in ('process', 'composition') for f in (_different, _absent))}))"


def gaps() -> str:
    """Ordered gaps (type, severity) of a candidate."""
    later = "if(abs(q_year - c_year) <= 3, 0.3D, least(1D, 0.5D + (abs(q_year - c_year) - 3) / 14D))"
    target = lambda field: f"if(flow_bridge, c_unit.{field}, t_unit.{field})"
    other = f"q_unit.canonical <> {target('canonical')}"
    rows = [
        ("UNIT_SCALE", "0.1D", f"{_plain('c_factor_unit')} <> {_plain('q_target_unit')} and c_unit.dimension = t_unit.dimension"),
        ("UNIT_SCALE", "0.1D", f"{other} and q_unit.dimension = {target('dimension')}"), ("REFERENCE_FLOW", "1D", f"{other} and q_unit.dimension <> {target('dimension')}"),
        ("PROCESS_VARIANT", "0.8D", _different("process")), ("PROCESS_VARIANT", "0.5D", _absent("process")), ("GRADE_COMPOSITION", "0.7D", _different("composition")), ("GRADE_COMPOSITION", "0.5D", _absent("composition")),
        ("MATERIAL_ABSENT", "1D", ABSENT),
        ("BOUNDARY", "0.7D", _different("boundary")), ("BOUNDARY", "0.4D", _absent("boundary")), ("GEOGRAPHY", "1D", _different("geography")), ("GEOGRAPHY", "0.5D", _absent("geography")),
        ("TEMPORAL", later, "q_year is not null and c_year is not null and q_year <> c_year"), ("TEMPORAL", "0.5D", "q_year is not null and c_year is null"), ("FORM", "0.5D", _different("form")), ("FORM", "0.3D", _absent("form")),
    ]
    return "array_compact(array(" + ", ".join(f"if({t}, struct('{k}' as type, {s} as severity), null)" for k, s, t in rows) + "))"


#: Steps in the planner's order and the gap that asks for each.
STEPS = [("unit_scale", "UNIT_SCALE"), ("reference_flow", "REFERENCE_FLOW"), ("process_variant", "PROCESS_VARIANT"), ("grade_composition", "GRADE_COMPOSITION"), ("class_aware_proxy", "MATERIAL_ABSENT")]


def resolution_plan(gap_column: str) -> Column:
    return F.expr("array_compact(array(" + ", ".join(f"if(exists({gap_column}, g -> g.type = '{kind}'), '{step}', null)" for step, kind in STEPS) + "))")


def source_quality() -> str:
    base = lookup(QUALITY, "c_source_type", 0.6)
    return f"if(c_source_type = 'supplier', least(0.95D, {base} + if(c_verified, 0.15D, 0D) + if(c_audited, 0.15D, 0D) + if({_blank('c_boundary')}, 0D, 0.1D)), {base})"


def strength(score: str, coverage: str, quality: str, steps: str, assumptions: str, severity: str) -> str:
    signal = f"greatest(0D, 1D - 0.12D * ({steps}) - 0.06D * ({assumptions}))"
    total = f"0.45D * {score} + 0.3D * {coverage} + 0.15D * ({quality}) + 0.1D * {signal} - least(0.25D, 0.05D * {severity})"
    return f"round(least(1D, greatest(0D, {total})), 6)"


def tier(least_score: float = MIN_SCORE) -> str:
    incomplete = f"{_blank('c_declared_product')} or ({_blank('c_boundary')} and {_blank('c_boundary_modules')})"
    usable = ("reference_flow_converted", "process_adjusted", "grade_interpolated", "class_technical_proxy")
    return (
        f"case when {incomplete} or not coalesce(c_factor_kind in {_in([*LIFECYCLE, *OPERATIONAL])}, false) or not coalesce(c_indicator in ('GWP-total', 'gwp-total'), false) or score < {least_score!r}D then 'REFERENCE_ONLY' "
        f"when resolution_type in {_in(DIRECT_TYPES)} then if(exists(gaps, g -> g.severity >= 0.5D), 'USABLE_WITH_ASSUMPTIONS', 'PRIMARY_RECOMMENDATION') "
        f"when resolution_type = 'grade_exact_anchor' then 'PRIMARY_RECOMMENDATION' when resolution_type in {_in(usable)} then 'USABLE_WITH_ASSUMPTIONS' else 'REFERENCE_ONLY' end"
    )


#: What makes a qualified hit a candidate: its quantity reaches the target unit, or a reference flow may take it there.
ADMITTED = "eligible and (flow_bridge or q_unit.dimension = t_unit.dimension)"


def valued(df: DataFrame, test: str | None = None, proxy: bool = False) -> DataFrame:
    """Hits with dimensions, score, coverage, gaps, the converted factor and the quantity in its unit; null where ``test`` doesn't hold.

    A ``proxy`` is weighed by its class' category; it is a technical one if its process is comparable, else a generic one.
    """
    df = with_dimensions(df, test, proxy)
    plans = {"moved": activity_plan("q_unit", "t_unit", "q_unit_conversion_evidence"), "plan": factor_plan("c_unit", "t_unit", "q_unit_conversion_evidence")}
    df = df.withColumns({k: F.when(F.expr(test), v) if test else v for k, v in plans.items()})
    kind = f"case when channel = 'synonym' then 'direct_alias' when channel = 'related' then 'class_generic_proxy' when not flow_bridge and {_plain('c_factor_unit')} <> {_plain('q_target_unit')} then 'unit_converted' else 'direct_exact' end"
    cols = {"factor": "if(flow_bridge, c_factor_value, c_factor_value * plan.multiplier)", "resolved_quantity": "if(flow_bridge, null, q_quantity * moved.multiplier)", "impact": "if(flow_bridge, c_unit.impact, t_unit.impact)", "score": weighted_score(), "coverage": evidence_coverage(), "resolution_type": kind, "gaps": gaps()}
    if proxy:
        cols |= {"score": proxy_score("q_class.category"), "coverage": proxy_coverage("q_class.category"), "resolution_type": "if(d_process >= 0.65D, 'class_technical_proxy', 'class_generic_proxy')"}
    df = df.withColumns(_where(test, cols)).drop("moved", "plan")
    return df.withColumns({"steps": F.expr("if(resolution_type = 'unit_converted', 1, 0)"), "assumptions": F.expr("cast(array() as array<string>)"), "candidate_id": F.expr(f"concat('{'proxy' if proxy else 'resolved'}:', c_source_id)")})


def finished(df: DataFrame, least_score: float = MIN_SCORE) -> DataFrame:
    """Totals, severity, strength and tier, after all steps."""
    df = df.withColumns({"total": F.expr("factor * resolved_quantity * impact"), "severity": F.expr("aggregate(gaps, 0D, (a, g) -> a + g.severity)"), "hard": F.expr(f"exists(gaps, g -> {HARD})")})
    return df.withColumns(_where("score is not null", {"strength": strength("score", "coverage", source_quality(), "steps", "size(assumptions)", "severity"), "tier": tier(least_score)}))


def candidates(qualified: DataFrame, least_score: float = MIN_SCORE) -> DataFrame:
    """Eligible hits whose quantity reaches the target unit, with converted values, scores, gaps, strength and tier, before any step but units."""
    return finished(valued(qualified.where(ADMITTED)), least_score)


def applicability() -> tuple[str, str]:
    """Class (0 to 2) and size of the largest geography or time gap."""
    worst = "coalesce(array_max(transform(filter(gaps, g -> g.type in ('GEOGRAPHY', 'TEMPORAL')), g -> g.severity)), 0D)"
    return f"case when not exists(gaps, g -> g.type in ('GEOGRAPHY', 'TEMPORAL')) then 0 when {worst} >= 0.5D then 2 else 1 end", worst


def rank_keys() -> list[str]:
    """The nine keys, all ascending."""
    kind, worst = applicability()
    return [lookup(TYPES, "resolution_type", 9), kind, worst, "coalesce(c_priority_rank, 100)", "-strength", "-score", "-coverage", "size(assumptions)", "c_source_id", "candidate_id"]


def rank(df: DataFrame) -> DataFrame:
    """Candidates with their place under the nine keys (and the candidate id)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("q_request_id").orderBy(*[F.expr(k) for k in rank_keys()])))


def top_k(ranked: DataFrame, most: int = 50) -> DataFrame:
    """The first ``q_top_k`` of each request; the constant bound lets the window keep a limited group."""
    return ranked.where((F.col("rank") <= most) & (F.col("rank") <= F.col("q_top_k")))


def confidence(ranked: DataFrame) -> DataFrame:
    """Per request (or class of requests): confidence of the first candidate from its strength, coverage and the margin to the second."""
    per = ranked.where("rank <= 2").groupBy(*[c for c in ("q_request_id", "q_members") if c in ranked.columns]).agg(F.max(F.when(F.col("rank") == 1, F.col("strength"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("strength"))).alias("second"), F.max(F.when(F.col("rank") == 1, F.col("coverage"))).alias("coverage"))
    margin = F.greatest(F.lit(0.0), F.col("first") - F.coalesce("second", "first"))
    exact = 0.65 * F.col("first") + 0.20 * F.col("coverage") + 0.15 * F.least(F.lit(1.0), margin / 0.20)
    return per.withColumns({"margin": F.round(margin, 6), "confidence_exact": exact, "confidence": F.round(exact, 6)}).withColumn("level", F.when(F.col("confidence") >= 0.80, "high").when(F.col("confidence") >= 0.65, "medium").otherwise("low"))
