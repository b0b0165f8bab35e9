"""Qualification gates on a joined (request, record) frame: a status column each, and the ordered exclusion codes.

Statuses are the words pass, mismatch and unknown, never null; what an unknown means depends on the gate. Gates are texts of expressions: the whole
set is parsed and analysed at once. What a gate asks of one side alone is a column of that side, so that a pair costs a few comparisons.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.units import CATALOG, EVIDENCE, SYNTAX, factor_reason
from attestry.functions.units import MISMATCH as MISMATCHED

PASS, MISMATCH, UNKNOWN = "pass", "mismatch", "unknown"
# Operational kinds with their subjects; other kinds that count as lifecycle factors; subjects a request must confirm.
OPERATIONAL = {"energy_factor": "energy", "combustion_factor": "energy", "transport_factor": "transport"}
LIFECYCLE = ("lifecycle_factor", "epd_indicator", "derived_proxy_factor")
NON_MATERIAL = ("energy", "transport", "process", "waste")
GATES = ("identity", "kind", "subject", "quality", "indicator", "declared", "boundary", "unit", "geography", "year")




def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _blank(x: str) -> str:
    return f"({x} is null or trim(cast({x} as string)) = '')"


#: What an operational kind needs as its subject, null for other kinds.
_NEEDED = "case c_factor_kind " + " ".join(f"when '{k}' then '{v}'" for k, v in OPERATIONAL.items()) + " end"
#: Entity codes: entities must not differ; a related hit needs both entities.
_IDENTITY = [
    ("base_entity_id_mismatch", "q_base_entity_id <> c_base_entity_id"),
    ("identity_proof_missing", "channel = 'related' and (q_base_entity_id is null or c_base_entity_id is null)"),
    ("product_entity_id_mismatch", "q_product_entity_id <> c_product_entity_id"),
    ("product_entity_id_missing", "q_product_entity_id is not null and c_product_entity_id is null"),
]


def identity_gate() -> str:
    return f"case when {' or '.join(f'coalesce({t}, false)' for _, t in _IDENTITY)} then 'mismatch' when c_base_entity_id is not null or channel in ('exact', 'synonym') then 'pass' else 'unknown' end"


# ---- what gates say of one side alone, worked out once a row before any join ------------------------------------------------------
def kind_gate() -> str:
    return f"case when c_factor_kind = 'emission_limit' then 'mismatch' when c_factor_kind in {_in([*LIFECYCLE, *OPERATIONAL])} then 'pass' else 'unknown' end"


def quality_gate() -> str:
    return "case when not c_admission_eligible or c_source_quality_status = 'REJECTED' then 'mismatch' when c_source_quality_status = 'NEEDS_REVIEW' or not c_hashed then 'unknown' else 'pass' end"


def indicator_gate() -> str:
    return f"case when c_indicator in ('GWP-total', 'gwp-total') then 'pass' when {_blank('c_indicator')} then 'unknown' else 'mismatch' end"


def _stated(x: str) -> str:
    return f"if({_blank(x)}, null, cast({x} as string))"


#: Gates that read a prepared record alone, and what the others compare.
RECORD_GATES = {
    "c_s_kind": kind_gate(), "c_s_quality": quality_gate(), "c_s_indicator": indicator_gate(), "c_needed": _NEEDED, "c_ordinary": f"not (coalesce(c_factor_kind, '') in {_in(OPERATIONAL)} or coalesce(c_subject_type, '') in {_in(NON_MATERIAL)})",
    "c_geo": _stated("c_geography"), "c_yr": _stated("c_year"),
}


def of_request(q: DataFrame) -> DataFrame:
    """Prepared requests with what gates compare, and whether a factor by mass may serve them over a reference flow."""
    bridge = f"q_target_factor_unit is null and (t_unit.dimension = 'COUNT' or (t_unit.dimension = 'VOLUME' and not {_blank('q_product_form')}))"
    return q.withColumns({"q_geo": F.expr(_stated("q_geography")), "q_yr": F.expr(_stated("q_year")), "q_bridges": F.expr(f"coalesce({bridge}, false)")})


# ---- gates on the pair ---------------------------------------------------------------------------------------------------------
def subject_gate() -> str:
    return (
        "case when c_needed is not null and c_subject_type <> c_needed then 'mismatch' when c_needed is not null and q_subject_type = 'unknown' then 'unknown' "
        f"when q_subject_type = 'unknown' and c_subject_type in {_in(NON_MATERIAL)} then 'unknown' when q_subject_type <> 'unknown' and c_subject_type <> 'unknown' and q_subject_type <> c_subject_type then 'mismatch' "
        "when c_subject_type = 'unknown' then 'unknown' else 'pass' end"
    )


def declared_gate() -> str:
    """Before the rule on product qualifiers."""
    return "case when c_declared_norm is null then 'unknown' when c_declared_norm = q_norm or channel = 'synonym' then 'pass' else 'mismatch' end"


def boundary_gate() -> str:
    same = "(c_boundary_key = q_boundary_key or (q_modules = 'A1|A2|A3' and c_boundary_key in ('a1-a3', 'a1–a3', 'cradle-to-gate')))"
    return f"case when q_modules is null then 'mismatch' when c_modules is not null then if(c_modules = q_modules, 'pass', 'mismatch') when c_boundary_key = '' then 'unknown' when {same} then 'pass' else 'mismatch' end"


def value_gate(q: str, c: str) -> str:
    """Of stated values: null is unknown."""
    return f"case when {q} is null or {c} is null then 'unknown' when {q} = {c} then 'pass' else 'mismatch' end"


_DIFFERENT = lambda q, c: f"coalesce({q} <> {c}, false)"
#: Codes in their order, and when they exclude a pair; ``unit_reason`` is the code of the conversion, ``unit_unproved`` a product qualifier without proof.
_UNIT = "not unit_unproved and not flow_bridge"
CODES = {
    **{k: f"coalesce({t}, false)" for k, t in _IDENTITY},
    "factor_kind_mismatch": "c_s_kind = 'mismatch'",
    "subject_type_mismatch": f"{subject_gate()} <> 'pass' and (q_subject_type <> 'unknown' or not c_ordinary)",
    "source_quality_not_admissible": "c_s_quality <> 'pass'",
    "indicator_mismatch": "c_s_indicator = 'mismatch'",
    "declared_product_mismatch": "channel <> 'proxy' and if(unit_unproved and c_declared_norm is null, true, declared_first = 'mismatch')",
    "boundary_mismatch": f"{boundary_gate()} = 'mismatch'",
    "geography_mismatch": _DIFFERENT("q_geo", "c_geo"),
    "year_mismatch": _DIFFERENT("q_yr", "c_yr"),
    "unit_qualifier_requires_validation": "unit_unproved",
    CATALOG: f"unit_reason <=> '{CATALOG}'",
    SYNTAX: f"unit_reason <=> '{SYNTAX}'",
    MISMATCHED: f"unit_reason <=> '{MISMATCHED}' and {_UNIT}",
    EVIDENCE: f"unit_reason <=> '{EVIDENCE}' and {_UNIT}",
    "CONFLICTING_DUPLICATE_SOURCE_ID": "c_conflict",
}
_BIT = {code: 1 << i for i, code in enumerate(CODES)}


def excluded(code: str) -> str:
    """Whether ``code`` excludes the hit, as the text of an expression over ``excluded_by``."""
    return f"(excluded_by & {_BIT[code]}L) <> 0"


def qualify(hits: DataFrame) -> DataFrame:
    """Hits with gate columns ``g_*``, ``excluded_by`` (a bit a code), ``exclusions``, ``primary_exclusion`` and ``eligible``.

    A mass factor for a count, or for a volume of a stated form, passes the unit gate when the target was derived: the reference flow is resolved later.
    Codes are kept as bits; their texts are made only where they are shown.
    """
    hits = hits.withColumns({"unit_reason": factor_reason("c_unit", "t_unit", "q_unit_conversion_evidence"), "declared_first": F.expr(declared_gate())})
    hits = hits.withColumns({"flow_bridge": F.expr(f"q_bridges and coalesce(c_unit.dimension = 'MASS' and unit_reason = '{MISMATCHED}', false)"), "unit_unproved": F.expr("c_unit.qualifier is not null and declared_first <> 'pass'")})
    hits = hits.withColumn("excluded_by", F.expr(" + ".join(f"if({t}, {_BIT[k]}L, 0L)" for k, t in CODES.items())))
    shown = {
        "g_identity": identity_gate(), "g_kind": "c_s_kind", "g_subject": subject_gate(), "g_quality": "c_s_quality", "g_indicator": "c_s_indicator", "g_boundary": boundary_gate(), "g_geography": value_gate("q_geo", "c_geo"), "g_year": value_gate("q_yr", "c_yr"),
        "g_declared": "if(unit_unproved and c_declared_norm is null, 'mismatch', declared_first)",
        "g_unit": f"case when unit_reason in ('{CATALOG}', '{SYNTAX}') then 'mismatch' when unit_unproved then 'unknown' when flow_bridge or unit_reason is null then 'pass' else 'mismatch' end",
        "exclusions": "array_compact(array(" + ", ".join(f"if({excluded(k)}, '{k}', null)" for k in CODES) + "))",
        "primary_exclusion": "case " + " ".join(f"when {excluded(k)} then '{k}'" for k in CODES) + " end", "eligible": "excluded_by = 0",
    }
    return hits.withColumns({k: F.expr(v) for k, v in shown.items()})
