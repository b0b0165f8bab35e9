"""Unit syntax and conversion plans over two small constant maps. Arguments are column names or SQL expressions; each function makes one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYNTAX, CATALOG, MISMATCH, EVIDENCE = "UNIT_SYNTAX_UNSUPPORTED", "CATALOG_FACTOR_UNIT_INVALID", "UNIT_DIMENSION_MISMATCH", "UNIT_CONVERSION_EVIDENCE_REQUIRED"
# Activity units (key, canonical name, dimension, ratio to the dimension's base, needs evidence).
ACTIVITY = [
    ("g", "g", "MASS", 0.001, False), ("kg", "kg", "MASS", 1.0, False), ("t", "t", "MASS", 1000.0, False), ("tonne", "tonne", "MASS", 1000.0, False), ("lb", "lb", "MASS", 0.45359237, False),
    ("kwh", "kWh", "ENERGY", 1.0, False), ("mwh", "MWh", "ENERGY", 1000.0, False), ("mj", "MJ", "ENERGY", 1 / 3.6, False), ("gj", "GJ", "ENERGY", 1000 / 3.6, False),
    ("m3", "m3", "VOLUME", 1.0, False), ("m³", "m3", "VOLUME", 1.0, False), ("l", "L", "VOLUME", 0.001, False), ("nm3", "Nm3", "VOLUME", 1.0, True), ("nm³", "Nm3", "VOLUME", 1.0, True),
    ("m2", "m2", "AREA", 1.0, False), ("m²", "m2", "AREA", 1.0, False), ("tkm", "tkm", "TRANSPORT_WORK", 1.0, False), ("kgkm", "kgkm", "TRANSPORT_WORK", 0.001, False),
    ("item", "item", "COUNT", 1.0, False), ("count", "item", "COUNT", 1.0, False), ("piece", "item", "COUNT", 1.0, False), ("pcs", "item", "COUNT", 1.0, False), ("bag", "item", "COUNT", 1.0, False), ("roll", "item", "COUNT", 1.0, False),
]
# Impact units and their ratio to kgCO2e; suffixes that qualify a reference product.
IMPACT = [("kgco2e", 1.0), ("kgco2eq", 1.0), ("gco2e", 0.001), ("tco2e", 1000.0)]
QUALIFIERS = ("product", "produit", "产品")


def _sql(value) -> str:
    return str(value).lower() if isinstance(value, bool) else f"double({value!r})" if isinstance(value, float) else "'" + value.replace("'", "''") + "'"


_UNITS = "map(" + ", ".join(f"{_sql(k)}, named_struct('canonical', {_sql(c)}, 'dimension', {_sql(d)}, 'ratio', {_sql(r)}, 'evidence', {_sql(e)})" for k, c, d, r, e in ACTIVITY) + ")"
_IMPACTS = "map(" + ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in IMPACT) + ")"
#: What stands between the halves of a factor unit: a slash, the word per, or per right after a carbon dioxide equivalent.
_BETWEEN = r"(?i)\s*/\s*|\s+per\s+|(?<=co[2₂]e|co[2₂]eq|co[2₂]-eq)per"


def _bare(x: str) -> str:
    """Lower case without blanks and multiplication marks, and without brackets around the whole."""
    key = f"regexp_replace(lower({x}), r'[\\s*·.]+', '')"
    return f"if(length(regexp_extract({key}, r'^\\(*', 0)) = length(regexp_extract({key}, r'\\)*$', 0)), btrim({key}, '()'), {key})"


def _unit(x: str) -> str:
    return f"try_element_at({_UNITS}, {_bare(x)})"


def activity_unit(x: str) -> Column:
    """struct(canonical, dimension, ratio, evidence) of a column or SQL expression, null if unsupported."""
    return F.expr(_unit(x))


def factor_unit(x: str) -> Column:
    """struct(impact, qualifier, canonical, dimension, ratio, evidence); null if either half is unsupported.

    The text is split once; a qualifier of the reference product is cut off the second half, and both halves are looked up. Lambdas name what has
    been found so far, so that no step is written out twice.
    """
    halves = f"array(split(trim({x}), r'{_BETWEEN}', 2))"
    bottom = f"transform({halves}, h -> struct(try_element_at({_IMPACTS}, translate({_bare('get(h, 0)')}, '₂-', '2')) as impact, {_bare('get(h, 1)')} as bottom))"
    cut = f"transform({bottom}, b -> struct(b.impact as impact, b.bottom as bottom, nullif(regexp_extract(b.bottom, '({'|'.join(QUALIFIERS)})$', 1), '') as qualifier))"
    unit = f"transform({cut}, c -> struct(c.impact as impact, c.qualifier as qualifier, {_unit("substr(c.bottom, 1, length(c.bottom) - length(coalesce(c.qualifier, '')))")} as unit))"
    fields = ", ".join(f"u.unit.{k} as {k}" for k in ("canonical", "dimension", "ratio", "evidence"))
    return F.expr(f"get(transform({unit}, u -> if(u.impact is not null and u.unit is not null, struct(u.impact as impact, u.qualifier as qualifier, {fields}), null)), 0)")


def _steps(s: str, t: str, e: str | None) -> tuple[str, str]:
    """Reason and multiplier of a step between two parsed units."""
    conditioned = f"({s}.dimension = 'VOLUME' and {t}.dimension = 'VOLUME' and {s}.evidence <> {t}.evidence)"
    given = f"if({e}.source_canonical_unit = {s}.canonical and {e}.target_canonical_unit = {t}.canonical, {e}.multiplier, null)" if e else "cast(null as double)"
    reason = f"case when {s} is null or {t} is null then '{SYNTAX}' when {s}.dimension <> {t}.dimension then '{MISMATCH}' when {s}.canonical <> {t}.canonical and {conditioned} and {given} is null then '{EVIDENCE}' end"
    return reason, f"case when {s}.canonical = {t}.canonical then double(1) when {conditioned} then {given} else {s}.ratio / {t}.ratio end"


def activity_plan(source: str, target: str, evidence: str | None = None) -> Column:
    """struct(multiplier, reason) between parsed units. ``evidence`` names a struct(source_canonical_unit, target_canonical_unit, multiplier), null without any."""
    reason, value = _steps(source, target, evidence)
    return F.expr(f"struct(if(({reason}) is null, {value}, null) as multiplier, {reason} as reason)")


def factor_reason(source: str, target: str, evidence: str | None = None) -> Column:
    """Why a factor of one parsed unit can't be given in another, null if it can; an unsupported source unit has the catalogue's own code."""
    reason, _ = _steps(source, target, evidence)
    return F.expr(f"case when {source} is null then '{CATALOG}' when {target} is null then '{SYNTAX}' else {reason} end")


def factor_plan(source: str, target: str, evidence: str | None = None) -> Column:
    """struct(multiplier, reason) between parsed factor units (see ``factor_reason``)."""
    reason, value = _steps(source, target, evidence)
    reason = f"case when {source} is null then '{CATALOG}' when {target} is null then '{SYNTAX}' else {reason} end"
    return F.expr(f"struct(if(({reason}) is null, {source}.impact / {target}.impact / ({value}), null) as multiplier, {reason} as reason)")
