"""Text functions: normalization, tokens, bigrams and set similarity as column expressions.

``normalize`` is native and folds case with ``lower``; ``normalize_unicode`` adds NFKC and full case folding, for which Spark has no
built-in, in one Arrow UDF meant for distinct strings.
"""

from __future__ import annotations

import difflib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that separate words: brackets, slash, underscore, bar, comma, semicolon, colon, middle dot and dashes (no backslash).
SEPARATORS = r"[\[\](){}/_|,;:·\-–—]+"
# Spellings of a product form that mean the same.
FORM_SYNONYMS = {"纤维": "fiber", "fibre": "fiber", "钢纤维": "fiber"}


def normalize(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), SEPARATORS, " "), r"\s+", " "))


def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def fold_unicode(text: Column) -> Column:
    return F.pandas_udf(_folded, "string")(text)


def normalize_unicode(text: Column) -> Column:
    return normalize(fold_unicode(text))


def normalization_rules(text: Column) -> Column:
    """Names of the native rules that change a text, in their order."""
    low = F.lower(text)
    apart = F.regexp_replace(low, SEPARATORS, " ")
    return F.array_compact(F.array(F.when(low != text, F.lit("casefold")), F.when(apart != low, F.lit("separators")), F.when(F.trim(F.regexp_replace(apart, r"\s+", " ")) != apart, F.lit("whitespace"))))


def blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value.cast("string")) == "")


def tokens(text: Column) -> Column:
    """Distinct Latin words and numbers of more than one character."""
    found = F.regexp_extract_all(normalize(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.array_distinct(F.filter(found, lambda t: F.length(t) > 1))


def bigrams(text: Column) -> Column:
    n = F.length(text)
    return F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(text, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Share of the union that two arrays have in common; 0 for two empty ones."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def dimension_score(wanted: Column, observed: Column) -> Column:
    """1 if equal, 0.5 if either is blank, 0.8 for a subset of words, 0.65 for a Jaccard of 0.35 or more, else 0."""
    q, o = normalize(F.coalesce(wanted.cast("string"), F.lit(""))), normalize(F.coalesce(observed.cast("string"), F.lit("")))
    a, b = tokens(q), tokens(o)
    filled = (F.size(a) > 0) & (F.size(b) > 0)
    subset = (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
    return F.when((q == "") | (o == ""), 0.5).when(q == o, 1.0).when(filled & subset, 0.8).when(filled & (jaccard(a, b) >= 0.35), 0.65).otherwise(0.0)


def normal_sql(x: str) -> str:
    """``normalize`` as the text of an expression."""
    return f"trim(regexp_replace(regexp_replace(lower({x}), r'{SEPARATORS}', ' '), r'\\s+', ' '))"


def words_sql(x: str) -> str:
    """``tokens`` of a normal form as the text of an expression; null has none."""
    return f"array_distinct(filter(regexp_extract_all(coalesce({x}, ''), '([a-z0-9]+)', 1), t -> length(t) > 1))"


def prepared_score(q: str, o: str, q_words: str, o_words: str) -> str:
    """``dimension_score`` of normal forms (null if blank) and their words, which a caller has computed once a row, as the text of an expression."""
    filled = f"size({q_words}) > 0 and size({o_words}) > 0"
    subset = f"(size(array_except({q_words}, {o_words})) = 0 or size(array_except({o_words}, {q_words})) = 0)"
    share = f"size(array_intersect({q_words}, {o_words})) / size(array_union({q_words}, {o_words}))"
    return f"case when {q} is null or {o} is null then 0.5D when {q} = {o} then 1D when {filled} and {subset} then 0.8D when {filled} and {share} >= 0.35D then 0.65D else 0D end"


def word_contains(text: Column, word: Column) -> Column:
    """Containment at word boundaries for Latin words, anywhere for other scripts; both normalized."""
    latin = word.rlike("^[ -~]+$")
    return F.when(latin, F.instr(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), word, F.lit(" "))) > 0).otherwise(F.instr(text, word) > 0)


def canonical_form(form: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in FORM_SYNONYMS.items() for x in kv])
    own = normalize(form)
    return F.coalesce(F.try_element_at(known, own), F.nullif(own, F.lit("")))


#: A token of the bearer scheme: letters, digits and -._~+/ once or more, then any number of = (RFC 6750, section 2.1).
TOKEN68 = r"[0-9A-Za-z._~+/-]+=*"
#: Texts to hide, in this order, and their marks: values of authorization fields, bearer tokens, URLs, loopback, private and link-local addresses.
REDACTIONS = [
    (r"(?i)\b(authorization)[ \t]*[:=][^\r\n,;]*", "$1: [redacted]"),
    (rf"(?i)\b(bearer) +{TOKEN68}", "$1 [redacted]"),
    (r"https?://[^ \t\r\n\"'<>]+", "[url]"),
    (r"\b(?:10|127|192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))(?:\.[0-9]{1,3}){2,3}\b", "[address]"),
    (r"(?i)\b(?:f[cd][0-9a-f]{2}|fe[89ab][0-9a-f]):[0-9a-f:]+", "[address]"),
]


def redact(text: Column) -> Column:
    for pattern, mark in REDACTIONS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def camel_words(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " "))


def grade_percent(text: Column) -> Column:
    """The first percentage in (0, 100]."""
    value = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?<![0-9])([0-9]+(?:\.[0-9]+)?)\s*%", 1).try_cast("double")
    return F.when((value > 0) & (value <= 100), value)


def first_year(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(20[0-9]{2})", 1).try_cast("int")


def coefficient_range(text: Column) -> Column:
    """Smallest and largest number in a text."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1), lambda x: x.cast("double"))
    return F.struct(F.array_min(found).alias("low"), F.array_max(found).alias("high"))


_NEGATIVE = [("range", r"\d+(?:\.\d+)?\s*~\s*\d+(?:\.\d+)?"), ("dimension", r"\d+(?:\.\d+)?\s*(?:mm|cm|um|μm|mesh|目)\b"), ("year", r"\b(?:19|20)\d{2}\b"), ("standard", r"\b(?:gb|iso|en|astm)(?:/t)?\s*\d+"), ("ratio", r"\d+\s*:\s*\d+"), ("temperature", r"\d+(?:\.\d+)?\s*(?:°c|℃)"), ("model", r"\b[a-z]{2,}-?\d+[a-z]+\b"), ("count", r"\d+\s*(?:pcs|pieces?|bags?|rolls?)\b"), ("mass", r"\d+(?:\.\d+)?\s*(?:kg|g|t|lb)\b")]


def _numbers(text: pd.Series) -> pd.Series:
    def one(t: str | None) -> list[dict]:
        out, used = [], []
        low = unicodedata.normalize("NFKC", t or "").casefold()

        def take(start: int, end: int, value: str, role: str) -> None:
            if all(end <= a or start >= b for a, b in used):
                used.append((start, end))
                out.append({"start": start, "end": end, "value": float(value), "role": role})

        for role, pattern in _NEGATIVE:
            for m in re.finditer(pattern, low):
                take(m.start(), m.end(), re.search(r"\d+(?:\.\d+)?", m[0])[0], role)
        for m in re.finditer(r"(\d+(?:\.\d+)?)\s*%", low):
            take(m.start(), m.end(), m[1], "percent" if 0 < float(m[1]) <= 100 else "other")
        for m in re.finditer(r"(?<![\d.])\d+(?:\.\d+)?(?![\d.])", low):
            take(m.start(), m.end(), m[0], "label" if 0 < float(m[0]) <= 100 else "other")
        return sorted(out, key=lambda x: x["start"])

    return text.map(one)


def numeric_tokens(text: Column | str) -> Column:
    """Numbers of a name with their role; contexts that aren't grades claim their span first, then percentages, then labels."""
    return F.pandas_udf(_numbers, "array<struct<start:int,end:int,value:double,role:string>>")(text)


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit row at a time."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        m = places.get(c, 0)
        row = (row + (row & m) | row & ~m) & full
    return len(a) - bin(row).count("1")


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([1.0 if not x and not y else 2 * _lcs(x, y) / (len(x) + len(y)) for x, y in zip(a.fillna(""), b.fillna(""), strict=True)], dtype=float)


def indel_ratio(a: Column, b: Column) -> Column:
    """2 * LCS / (length of both); 1 for two empty texts."""
    return F.pandas_udf(_ratio, "double")(a, b)


def pieces(text: Column) -> Column:
    """Distinct words of a normalized text, split at blanks whatever their script, and its pairs of neighbours."""
    return F.array_union(F.filter(F.split(text, " "), lambda w: w != ""), bigrams(text))


def lexical_score(a: Column, b: Column) -> Column:
    """The larger of the Jaccard of ``pieces`` and half the indel ratio; both texts normalized."""
    return F.greatest(jaccard(pieces(a), pieces(b)), 0.5 * indel_ratio(a, b))


def material_terms(text: Column) -> Column:
    """Words of three letters or more outside the CJK block, and all pairs of neighbours among its characters."""
    own = normalize(F.coalesce(text, F.lit("")))
    words = F.filter(F.split(own, " "), lambda w: F.length(w) >= 3)
    cjk = F.regexp_replace(own, "[^\u4e00-\u9fff]", "")
    return F.array_distinct(F.concat(words, bigrams(cjk)))


def plain_label(text: Column) -> Column:
    """Words of digits, Latin letters and CJK characters, one blank between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^0-9a-z\u3400-\u9fff]+", " "))


def compact_label(text: Column) -> Column:
    """``plain_label`` without the blanks, for the narrower CJK block."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^0-9a-z\u4e00-\u9fff]+", "")


def discovery_fold(text: Column) -> Column:
    """Hyphens and underscores as blanks, one blank between words."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), "-_", "  "), r"\s+", " "))


#: Identifiers that may be repeated in answers and logs.
SAFE_ID = "^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"


def safe_id(value: Column, fallback: Column) -> Column:
    """The caller's identifier if it is harmless, else ``fallback`` (an opaque one)."""
    own = F.trim(F.coalesce(value, F.lit("")))
    return F.when(own.rlike(SAFE_ID), own).otherwise(fallback)


def _walk(value, depth: int = 0):
    """Every (key or None, value, depth) of a parsed JSON text."""
    yield None, value, depth
    for key, child in value.items() if isinstance(value, dict) else ((None, x) for x in value) if isinstance(value, list) else ():
        if key is not None:
            yield key, child, depth + 1
        yield from _walk(child, depth + 1)


def _parse(t: str | None):
    try:
        return json.loads(t or "null")
    except ValueError:
        return None


def all_keys(text: Column) -> Column:
    """Distinct keys of a JSON text at any depth, sorted; texts that aren't JSON have none."""
    return F.pandas_udf(lambda s: s.map(lambda t: sorted({k for k, _, _ in _walk(_parse(t)) if k is not None})), "array<string>")(text)


def json_complexity(text: Column) -> Column:
    """struct(depth, records, longest): how deep a JSON text nests, how many objects it has, and its longest list; null if it isn't JSON."""
    def one(t: str | None):
        if t is None or (_parse(t) is None and t.strip() != "null"):
            return None
        nodes = [(v, d) for k, v, d in _walk(_parse(t)) if k is None]
        return {"depth": max(d for _, d in nodes), "records": sum(isinstance(v, dict) for v, _ in nodes), "longest": max((len(v) for v, _ in nodes if isinstance(v, list)), default=0)}

    return F.pandas_udf(lambda s: pd.DataFrame([one(t) or {"depth": None, "records": None, "longest": None} for t in s], columns=["depth", "records", "longest"]).astype("Int64"), "depth long, records long, longest long")(text)


def challenge_score(a: Column, b: Column) -> Column:
    """Three parts of the matching-blocks ratio and one of the words' Jaccard."""
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p, q, autojunk=False).ratio() for p, q in zip(x.fillna(""), y.fillna(""), strict=True)], dtype=float)

    words = lambda t: F.array_distinct(F.split(t, " "))
    return 0.75 * F.pandas_udf(ratio, "double")(a, b) + 0.25 * jaccard(words(a), words(b))
