"""Queries over text, units, catalogue hygiene, registry and set operations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import text as X
from attestry.functions import units as U
from attestry.operators import catalog as C
from attestry.operators import proxy as P
from attestry.operators import qualify as Q
from attestry.operators import registry as G
from attestry.operators import retrieve as R
from attestry.plans import domain
from attestry.plans.oracle_core import CORE, UNITS, _norm
from attestry.queries import query, table
from attestry.sources import files as S

_CAT = f"with cat as ({domain.CATALOG_SQL}), req as ({domain.REQUEST_SQL}) "
_TOK = "list_filter(list_distinct(regexp_extract_all({0}, '[a-z0-9]+')), lambda t: length(t) > 1)"
_BIG = "case when length({0}) >= 2 then list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))) else [] end"


@query(f"select page_id, {_norm('html')} as norm from pages")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.normalize(F.col("html")).alias("norm"))


_WIDE = "'ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ０１２３４５６７８９（）', 'abcdefghijklmnopqrstuvwxyz0123456789()'"
_STYLED = "p_name || case p_size % 4 when 0 then ' Straße' when 1 then ' ＳＴＥＥＬ（' || translate(cast(p_size as {0}), '0123456789', '０１２３４５６７８９') || '）' when 2 then ' ﬁbre ½' else ' Größe ² ǅ' end"


@query(f"with r as (select p_partkey as id, {_STYLED.format('varchar')} as raw from part) select id, replace(replace(replace(replace(lower(translate(replace(raw, 'ǅ', 'dž'), {_WIDE})), 'ß', 'ss'), 'ﬁ', 'fi'), '½', '1⁄2'), '²', '2') as folded from r")
def normalize_unicode(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.fold_unicode(F.expr(_STYLED.format("string"))).alias("folded"))


_AB = f"ab as (select p_partkey as id, {_norm('p_name')} as a, {_norm('p_brand || p_type')} as b from part)"


@query(f"with {_AB}, s as (select id, {_TOK.format('a')} as ta, {_TOK.format('b')} as tb, {_BIG.format('a')} as ba, {_BIG.format('b')} as bb from ab) select id, len(ta) as words, len(ba) as pairs, array_to_string(list_sort(ta), '|') as token_list, round(len(list_intersect(ba, bb)) / (len(ba) + len(bb) - len(list_intersect(ba, bb))), 9) as jaccard from s")
def token_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.normalize(F.col("p_name")).alias("a"), X.normalize(F.concat("p_brand", "p_type")).alias("b"))
    a, b = X.bigrams(F.col("a")), X.bigrams(F.col("b"))
    return p.select("id", F.size(X.tokens(F.col("a"))).alias("words"), F.size(a).alias("pairs"), F.array_join(F.array_sort(X.tokens(F.col("a"))), "|").alias("token_list"), F.round(X.jaccard(a, b), 9).alias("jaccard"))


_PRIVATE = "text || ' [Authorization: Basic ' || lang || 'x==; bearer abc.DEF-' || doc_id || '=, see https://h.example/' || doc_id || '?k=1 at 10.1.2.' || doc_id % 256 || ' or 11.1.2.3, 172.16.' || doc_id % 9 || '.1, 172.40.0.1, fd00:1::' || doc_id % 10 || ', fe80::1, 2001:db8::1]'"


def _redaction_sql() -> str:
    """The redactions as DuckDB writes them: groups by backslash instead of dollar."""
    out = _PRIVATE
    for pattern, mark in X.REDACTIONS:
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{mark.replace('$', chr(92))}', 'g')"
    return out


@query(f"select doc_id, {_redaction_sql()} as redacted from documents")
def redaction(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts, each with a tail of what must go and what must stay."""
    return table(spark, sf, "documents").select("doc_id", X.redact(F.expr(_PRIVATE)).alias("redacted"))


@query("select p_partkey as id, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') as slug, case when p_size % 5 = 0 and p_size <= 100 and p_size > 0 then cast(p_size as double) end as grade, case when p_size % 3 = 0 then 2000 + p_size end as year, cast(p_size as double) as low, cast(p_size + 1.5 as double) as high from part")
def parse_text(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    p = table(spark, sf, "part")
    both = X.coefficient_range(F.concat(size, F.lit(" to "), (F.col("p_size") + 1.5).cast("string")))
    return p.select(F.col("p_partkey").alias("id"), X.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), X.grade_percent(F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("purity "), size, F.lit(" %")))).alias("grade"), X.first_year(F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("since "), (F.col("p_size") + 2000).cast("string")))).alias("year"), both["low"].alias("low"), both["high"].alias("high"))


@query()
def numeric_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Roles of the numbers in distinct names; a sequential span masking that SQL can't express."""
    names = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", F.concat(F.col("p_size").cast("string"), F.lit("%")), F.lit("0~1 mm GB 175 2024")).alias("name")).distinct()
    return names.select("name", F.explode(X.numeric_tokens("name")).alias("t")).select("name", "t.start", "t.end", "t.value", "t.role")


@query(f"with {UNITS}, raw as (select distinct upper(quantity_unit) || ' ' as raw from ({domain.REQUEST_SQL})) select raw, canonical, dimension, round(ratio, 9) as ratio, evidence from raw left join unit on key = lower(trim(raw))")
def unit_parse(spark: SparkSession, sf: str) -> DataFrame:
    raw = domain.requests(spark, sf).select(F.concat(F.upper("quantity_unit"), F.lit(" ")).alias("raw")).distinct()
    u = F.col("u")
    return raw.withColumn("u", U.activity_unit("raw")).select("raw", u["canonical"].alias("canonical"), u["dimension"].alias("dimension"), F.round(u["ratio"], 9).alias("ratio"), u["evidence"].alias("evidence"))


@query(CORE + "select distinct c_factor_unit, q_target_unit, round(multiplier, 12) as multiplier, plan_reason as reason from planned")
def unit_plan(spark: SparkSession, sf: str) -> DataFrame:
    units = ("quantity_unit", "target_factor_unit", "unit_conversion_evidence")
    q = R.bare(domain.requests(spark, sf), *units).drop("request_id").distinct().withColumn("request_id", F.lit(""))
    hits = R.retrieve(q, R.counted(R.bare(domain.catalog(spark, sf), "factor_unit"))).select("c_factor_unit", "q_target_unit", "c_unit", "t_unit", "q_unit_conversion_evidence").distinct()
    plan = U.factor_plan("c_unit", "t_unit", "q_unit_conversion_evidence")
    return hits.select("c_factor_unit", "q_target_unit", F.round(plan["multiplier"], 12).alias("multiplier"), plan["reason"].alias("reason")).distinct()


_EVIDENCE = "select p_partkey as id, case p_size % 6 when 0 then 'Nm3' when 1 then 'm3' when 2 then 'L' when 3 then 'kg' when 4 then ' nm3' else 't' end as a, case p_partkey % 4 when 0 then 'm3' when 1 then 'Nm3' when 2 then 'kg' else 'l' end as b, case when p_size % 5 < 2 then 'Nm3' when p_size % 5 < 4 then 'm3' end as s, case when p_size % 7 < 4 then 'm3' else 'Nm3' end as t, 0.9 + p_size / 100.0 as m from part"


@query(f"with {UNITS}, e as ({_EVIDENCE}), u as (select e.*, x.canonical as ca, x.dimension as da, x.ratio as ra, y.canonical as cb, y.dimension as db, y.ratio as rb, x.dimension = 'VOLUME' and y.dimension = 'VOLUME' and x.evidence <> y.evidence as conditioned from e left join unit x on x.key = lower(trim(a)) left join unit y on y.key = lower(trim(b))), r as (select *, case when da <> db then 'UNIT_DIMENSION_MISMATCH' when ca <> cb and conditioned and not coalesce(s = ca and t = cb, false) then 'UNIT_CONVERSION_EVIDENCE_REQUIRED' end as reason from u) select id, round(case when reason is not null then null when ca = cb then 1.0 when conditioned then m else ra / rb end, 12) as multiplier, reason from r")
def unit_evidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = domain.frame(spark, sf, _EVIDENCE, "part").withColumns({"u": U.activity_unit("a"), "v": U.activity_unit("b"), "e": F.expr("if(s is null, null, struct(s as source_canonical_unit, t as target_canonical_unit, double(m) as multiplier))")})
    plan = U.activity_plan("u", "v", "e")
    return rows.select("id", F.round(plan["multiplier"], 12).alias("multiplier"), plan["reason"].alias("reason"))


_RAW = "select case when p_size % 23 = 0 then null else 'P-' || cast(p_partkey as {0}) end as record_id, p_name as name, case p_size % 6 when 0 then null when 1 then 'n/a' when 2 then '-1' else cast(p_size as {0}) end as primary_value, case when p_size % 7 = 0 then ' ' else 'kg' end as primary_unit, case when p_size % 29 = 0 then 'ODD' else 'VERIFIED' end as source_quality_status, p_partkey as id from part"


@query(f"with r as ({_RAW.format('varchar')}), v as (select *, try_cast(primary_value as double) as value from r) select id, value, concat_ws('|', case when value is null then 'primary_value_missing_or_invalid' end, case when trim(primary_unit) = '' then 'primary_unit_missing' end, case when record_id is null then 'record_identity_missing' end, case when coalesce(value < 0, false) or source_quality_status <> 'VERIFIED' then 'record_validation_failed' end) as reasons from v")
def catalog_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    raw = domain.frame(spark, sf, _RAW.format("string"), "part")
    return C.diagnose(raw).select("id", "value", F.array_join("reasons", "|").alias("reasons"))


@query(_CAT + ", pol(policy_id, match_key, value) as (values ('a', 'prov-0', 'EUROPE'), ('b', 'prov-1', 'ASIA'), ('c', 'prov-1', 'AFRICA'), ('d', null, 'ASIA')), v as (select c.source_id, c.geography, list_distinct(list(p.value)) as vs from cat c join pol p on p.match_key = c.provider or p.match_key is null group by all) select source_id, coalesce(geography, case when len(vs) = 1 then vs[1] end) as inherited, geography is null and len(vs) > 1 as conflict from v")
def policy_inheritance(spark: SparkSession, sf: str) -> DataFrame:
    pol = spark.createDataFrame([("a", "prov-0", "EUROPE"), ("b", "prov-1", "ASIA"), ("c", "prov-1", "AFRICA"), ("d", None, "ASIA")], "policy_id string, match_key string, value string")
    return C.inherit(domain.catalog(spark, sf), pol, "provider", "geography").select("source_id", "inherited", "conflict")


_WINDOWS = "select p_partkey as policy_id, '20' || cast(20 + p_size % 8 as {0}) || case p_size % 3 when 0 then '-06-' when 1 then '-7-' else '-11-' end || cast(10 + p_size % 21 as {0}) as effective_from, case when p_partkey % 3 > 0 then '20' || cast(22 + p_partkey % 7 as {0}) || case p_partkey % 5 when 0 then '-02-' when 1 then '-13-' else '-06-' end || cast(10 + p_partkey % 22 as {0}) end as effective_until from part"


@query(f"with w as ({_WINDOWS.format('varchar')}), d as (select *, regexp_full_match(effective_from, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') as f_ok, regexp_full_match(effective_until, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') as u_ok, try_cast(effective_from as date) as f, try_cast(effective_until as date) as u from w) select policy_id from d where f_ok and f <= date '2024-06-30' and (effective_until is null or (u_ok and u >= date '2024-06-30'))")
def policy_window(spark: SparkSession, sf: str) -> DataFrame:
    """Windows with malformed and impossible dates among them."""
    rows = domain.frame(spark, sf, _WINDOWS.format("string"), "part")
    return C.effective_policies(rows, "2024-06-30").select("policy_id")


@query("with r as (select 'K-' || cast(p_partkey % 1500 as varchar) as id, p_name as body from part) select id, count(*) as copies, min(body) as body from r group by id having count(distinct body) = 1")
def dedupe_conflict(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.concat(F.lit("K-"), (F.col("p_partkey") % 1500).cast("string")).alias("id"), F.col("p_name").alias("body")).withColumn("digest", F.sha2("body", 256))
    return R.conflict_free(rows, "id", "digest").select("id", "copies", "body")


@query(_CAT + "select source_id, factor_value, 0 as copy from (select source_id, factor_value * 2 as factor_value from cat) union all select source_id || '-noise-' || cast(k as varchar), factor_value, k from cat, (values (1), (2)) n(k)")
def perturbation(spark: SparkSession, sf: str) -> DataFrame:
    c = domain.catalog(spark, sf).select("source_id", "factor_value")
    return C.perturb(c, "source_id", {"factor_value": F.col("factor_value") * 2}, 2)


_CLASSED = "select s_suppkey as id, lower(s_name) || case s_suppkey % 7 when 0 then ' stainless steel' when 1 then ' iron ore' when 2 then ' sand' when 3 then ' 电熔 block' when 4 then ' resin' when 5 then ' 玻璃' else ' wood' end as name, case s_suppkey % 5 when 0 then '99% copper' when 1 then 'polymer blend' when 2 then 'ceramic' when 3 then 'oak' end as composition, case s_suppkey % 3 when 0 then 'sintered' when 1 then 'quarried' end as process from supplier"


@query(f"with s as ({_CLASSED}), t as (select id, name, coalesce(composition, '') as c, name || ' / ' || coalesce(composition, '') as nc, name || ' / ' || coalesce(process, '') as np from s) select id, name, case when regexp_matches(nc, 'steel|metal|alumin(i)?um|copper|钢|金属|铝|铜') then 'metals' when regexp_matches(nc, 'polymer|plastic|resin') then 'polymers' when regexp_matches(np, 'fused|sintered|calcined|电熔|烧结|煅烧') then 'manufactured minerals' when regexp_matches(np, 'mining|quarried|ore|矿|开采') then 'natural minerals' when regexp_matches(nc, 'glass|ceramic|玻璃|陶瓷|硅酸铝') then 'inorganics' when c <> '' then c else 'unknown' end as family, case when regexp_matches(nc, 'steel|metal|alumin(i)?um|copper|钢|金属|铝|铜') then 'metal' when regexp_matches(nc, 'polymer|plastic|resin') then 'synthetic_chemical' when regexp_matches(np, 'fused|sintered|calcined|电熔|烧结|煅烧') then 'manufactured_mineral' when regexp_matches(np, 'mining|quarried|ore|矿|开采') then 'natural_mineral' when regexp_matches(nc, 'glass|ceramic|玻璃|陶瓷|硅酸铝') then 'manufactured_mineral' else 'unknown' end as category from t")
def material_class(spark: SparkSession, sf: str) -> DataFrame:
    """Classes by what stands in the name, the composition or the process."""
    s = domain.frame(spark, sf, _CLASSED, "supplier")
    return s.select("id", F.expr(P.material_class("name", "composition", "process")).alias("c")).select("id", "c.name", "c.family", "c.category")


@query(_CAT + ", r as (select distinct production_process as class_name, product_form as family from cat) select class_name || '/' || family as request_id, source_id from r join cat c on contains(lower(c.material_name), lower(r.class_name)) or contains(lower(c.material_name), lower(family)) or contains(lower(c.series_id), lower(family))")
def proxy_contains(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose name or family holds a request's class or family anywhere."""
    c = domain.catalog(spark, sf)
    wanted = c.select(F.col("production_process").alias("class_name"), F.col("product_form").alias("family")).distinct().withColumn("request_id", F.concat_ws("/", "class_name", "family"))
    return P.class_proxies(wanted, c.select("source_id", "material_name", F.lit(None).cast("string").alias("class"), F.col("series_id").alias("family_name")))


@query("with n as (select s_suppkey as id, case s_suppkey % 4 when 0 then 'steel scrap' when 1 then 'electric steam' when 2 then 'truck fuel' else 'clay' end as w from supplier), e as (select id, 'energy_input' as role, 'A3' as module from n where regexp_matches(w, '(electric|power|fuel|gas|steam)') union all select id, 'transport_input', 'A2' from n where regexp_matches(w, '(truck|rail|ship|freight)') union all select id, 'waste_output', 'A3' from n where regexp_matches(w, '(waste|scrap|slag)')) select * from e union all select id, 'raw_material', 'A1' from n where id not in (select id from e)")
def accounting_roles(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array(*map(F.lit, ["steel scrap", "electric steam", "truck fuel", "clay"]))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(C.accounting(F.get(words, (F.col("s_suppkey") % 4).cast("int")))).alias("a"))
    return s.select("id", "a.role", "a.module")


_RULES = [("r-blue-anvil", "blue anvil"), ("r-blue", "blue"), ("r-anvil", "anvil"), ("r-ring", "ring"), ("r-cog", "bolt"), ("r-bolt", "bolt"), ("r-red-gear", "red gear")]


_NAMED = "case p_size % 4 when 0 then lower(p_name) when 1 then lower(p_name) || ' ' || lower(p_name) when 2 then replace(lower(p_name), ' ', '-') else 'string ring,' || lower(p_name) || '/bolt' end"


@query("with r(rule_id, alias) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in _RULES) + f"), n as (select distinct {_NAMED} as name from part), spot as (select name, unnest(range(0, length(name))) as start from n), m as (select name, rule_id, start, length(alias) as size from spot join r on substr(name, start + 1, length(alias)) = alias where not regexp_matches(substr(' ' || name || ' ', start + 1, 1) || substr(' ' || name || ' ', start + length(alias) + 2, 1), '[0-9A-Za-z]'))" + ", k as (select m.* from m where not exists (select 1 from m o where o.name = m.name and (o.size > m.size or (o.size = m.size and (o.start, o.rule_id) < (m.start, m.rule_id))) and o.start < m.start + m.size and m.start < o.start + o.size)) select name, rule_id, start, size from k")
def rule_match(spark: SparkSession, sf: str) -> DataFrame:
    """Names with repeated, hyphenated and punctuated aliases."""
    rules = spark.createDataFrame([(a, b, "active") for a, b in _RULES] + [("r-off", "widget", "draft")], "rule_id string, alias string, status string")
    return G.match_rules(table(spark, sf, "part").select(F.expr(_NAMED).alias("name")), rules)


@query()
def lexical_top5(spark: SparkSession, sf: str) -> DataFrame:
    """Lexical observations between distinct names and distinct names with types; the indel ratio has no SQL form. Equal first words with the type ECONOMY count as admitted."""
    names = table(spark, sf, "part").select(X.normalize(F.col("p_name")).alias("n")).distinct()
    other = table(spark, sf, "part").select(X.normalize(F.concat_ws(" ", "p_name", "p_type")).alias("n"), X.normalize(F.col("p_name")).alias("a_id"), "p_type").distinct()
    admitted = other.where("p_type = 'ECONOMY'").select("a_id", F.col("n").alias("b_id"))
    return R.lexical_observations(names, other.select("n").distinct(), "n", "n", "n", "n", admitted)


_FEATURES = "list_distinct(list_concat({0}, {1}))".format(_TOK.format("{0}"), _BIG.format("{0}"))


@query("with n as (select distinct " + _norm("p_name") + " as a from part), o as (select distinct " + _norm("p_brand || ' ' || p_type") + " as b from part), f as (select a, b, " + _FEATURES.format("a") + " as fa, " + _FEATURES.format("b") + " as fb from n, o), s as (select a, b, len(list_intersect(fa, fb)) as c, len(fa) as x, len(fb) as y from f) select a, b, round(c / (x + y - c), 6) as jaccard from s where c > 0 and round(c / (x + y - c), 6) >= 0.05")
def lexical_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """The part of the lexical score that SQL can express, over every pair that shares a feature."""
    a = table(spark, sf, "part").select(X.normalize(F.col("p_name")).alias("a")).distinct().withColumn("fa", F.array_union(X.tokens(F.col("a")), X.bigrams(F.col("a"))))
    b = table(spark, sf, "part").select(X.normalize(F.concat_ws(" ", "p_brand", "p_type")).alias("b")).distinct().withColumn("fb", F.array_union(X.tokens(F.col("b")), X.bigrams(F.col("b"))))
    pairs = a.withColumn("f", F.explode("fa")).join(b.withColumn("f", F.explode("fb")), "f").select("a", "b", "fa", "fb").distinct()
    return pairs.select("a", "b", F.round(X.jaccard(F.col("fa"), F.col("fb")), 6).alias("jaccard")).where("jaccard >= 0.05")


@query("select p_partkey as id, level, value from (select p_partkey, p_size as level_1, p_size + 1 as level_2, p_size + 2 as level_3 from part) unpivot (value for level in (level_1, level_2, level_3))")
def unpivot_levels(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("level_1"), (F.col("p_size") + 1).alias("level_2"), (F.col("p_size") + 2).alias("level_3"))
    return p.unpivot(["id"], ["level_1", "level_2", "level_3"], "level", "value")


@query(_CAT + ", d as (select r.request_id, c.source_id from req r left join cat c on c.base_entity_id = r.base_entity_id and c.grade > 80) select request_id, case when source_id is not null then row_number() over (partition by request_id order by source_id) - 1 end as place, source_id as candidate from d")
def candidate_explode(spark: SparkSession, sf: str) -> DataFrame:
    per = domain.catalog(spark, sf).where("grade > 80").groupBy("base_entity_id").agg(F.array_sort(F.collect_list("source_id")).alias("ids"))
    found = domain.requests(spark, sf).select("request_id", "base_entity_id").join(per.hint("merge"), "base_entity_id", "left").drop("base_entity_id")
    return S.exploded_candidates(found, "ids")


@query(_CAT + "select source_id, field, value from (select source_id, cast(factor_unit as varchar) as factor_unit, cast(grade as varchar) as grade, cast(boundary as varchar) as boundary from cat) unpivot (value for field in (factor_unit, grade, boundary))")
def vertical_fields(spark: SparkSession, sf: str) -> DataFrame:
    return S.vertical(domain.catalog(spark, sf), "source_id", ["factor_unit", "grade", "boundary"])


@query(_CAT + ", m as (select source_id, boundary, (select string_agg(x, '|' order by x) from (select distinct upper(trim(t)) as x from unnest(string_split(coalesce(boundary_modules, ''), '|')) as u(t)) where x <> '') as listed from cat), w(wanted, modules) as (values ('A1', 'A1'), ('A2', 'A2'), ('A3', 'A3'), ('A1-A3', 'A1|A2|A3'), ('Cradle-to-Gate', 'A1|A2|A3'), ('use phase', null)) select source_id, wanted, case when modules is null then 'mismatch' when listed is not null then case when listed = modules then 'pass' else 'mismatch' end when lower(boundary) = lower(wanted) or (modules = 'A1|A2|A3' and lower(boundary) in ('a1-a3', 'cradle-to-gate')) then 'pass' else 'mismatch' end as status from m, w")
def boundary_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The boundary gate of every record against every boundary that a request may name, and one that it may not."""
    c = R.prepare_catalog(domain.catalog(spark, sf)).select("c_source_id", "c_boundary_key", "c_modules")
    wanted = c.withColumn("q_boundary", F.explode(F.array(*map(F.lit, ["A1", "A2", "A3", "A1-A3", "Cradle-to-Gate", "use phase"])))).withColumns({"q_modules": R.boundary_modules("q_boundary"), "q_boundary_key": F.expr(R.boundary_key("q_boundary"))})
    return wanted.select(F.col("c_source_id").alias("source_id"), F.col("q_boundary").alias("wanted"), F.expr(Q.boundary_gate()).alias("status"))


@query("select p_partkey as id, case when st = 'approved' then 'already_decided' when st not in ('recommendation_ready', 'reference_review_required') then 'not_selectable' when tier = 'REFERENCE_ONLY' and mode <> 'override' then 'override_required' when tier = 'REFERENCE_ONLY' and reason = '' then 'reason_required' when tier = 'USABLE_WITH_ASSUMPTIONS' and not acc then 'acceptance_required' else 'allowed' end as verdict from (select p_partkey, case p_size % 4 when 0 then 'approved' when 1 then 'unresolved' when 2 then 'recommendation_ready' else 'reference_review_required' end as st, case p_size % 3 when 0 then 'REFERENCE_ONLY' when 1 then 'USABLE_WITH_ASSUMPTIONS' else 'PRIMARY_RECOMMENDATION' end as tier, case when p_size % 5 < 3 then 'override' else 'standard' end as mode, p_size % 7 < 3 as acc, case when p_size % 2 = 0 then '' else 'why' end as reason from part)")
def approval_rules(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_size")
    status = F.when(n % 4 == 0, "approved").when(n % 4 == 1, "unresolved").when(n % 4 == 2, "recommendation_ready").otherwise("reference_review_required")
    tier = F.when(n % 3 == 0, "REFERENCE_ONLY").when(n % 3 == 1, "USABLE_WITH_ASSUMPTIONS").otherwise("PRIMARY_RECOMMENDATION")
    verdict = C.approval_rule(status, tier, F.when(n % 5 < 3, "override").otherwise("standard"), n % 7 < 3, F.when(n % 2 == 0, "").otherwise("why"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), verdict.alias("verdict"))


@query("with f as (select p_partkey as id, list_filter(['name', 'record_id', case when p_size % 3 = 0 then 'bogus' end, case when p_size % 4 = 0 then 'Name' end, case when p_size % 5 = 0 then 'zone_' || cast(p_size % 7 as varchar) end], lambda k: k is not null) as keys from part), u as (select id, list_sort(list_filter(keys, lambda k: k not in ('record_id', 'name'))) as u from f) select id, array_to_string(u, '|') as unknown from u where len(u) > 0")
def strict_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Records as JSON text, some of them with fields that the closed schema doesn't know."""
    n = F.col("p_size")
    keys = F.array_compact(F.array(F.lit("name"), F.lit("record_id"), F.when(n % 3 == 0, F.lit("bogus")), F.when(n % 4 == 0, F.lit("Name")), F.when(n % 5 == 0, F.concat(F.lit("zone_"), (n % 7).cast("string")))))
    body = F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: F.concat(F.lit('"'), k, F.lit('": [1, {"inner": 2}]'))), ", "), F.lit("}"))
    found = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), C.unknown_fields(body, ["record_id", "name"]).alias("u")).where(F.size("u") > 0)
    return found.select("id", F.array_join("u", "|").alias("unknown"))


@query(_CAT + "select source_id, sha256('{\"boundary\":' || case when boundary is null then 'null' else '\"' || boundary || '\"' end || ',\"composition\":' || case when composition is null then 'null' else '\"' || composition || '\"' end || ',\"source_id\":\"' || source_id || '\"}') as digest from cat")
def canonical_digest(spark: SparkSession, sf: str) -> DataFrame:
    return domain.catalog(spark, sf).select("source_id", S.canonical_digest("source_id", "composition", "boundary").alias("digest"))


@query(CORE + ", one as (select request_id, count(*) as n from pair where channel = 'exact' group by 1), d as (select q.request_id, s.strategy, count(p.source_id) as n from qn q cross join (values ('exact'), ('synonym'), ('related')) s(strategy) left join pair p on p.request_id = q.request_id and p.channel = s.strategy group by all) select request_id, strategy, case when n = 0 then 'no_match' when n = 1 then 'matched' else 'candidate_set' end as outcome from d")
def link_attempts(spark: SparkSession, sf: str) -> DataFrame:
    q, c = R.alike(R.bare(domain.requests(spark, sf))), domain.catalog(spark, sf)
    counts = R.retrieve(q.drop("members"), R.counted(R.bare(c))).groupBy("q_request_id").agg(*[F.sum(F.when(F.col("channel") == s, F.col("c_copies")).otherwise(0)).alias(s) for s in R.CHANNELS])
    wide = R.told(counts, q, "left").fillna(0)
    long = wide.unpivot(["q_request_id"], list(R.CHANNELS), "strategy", "n")
    return long.select(F.col("q_request_id").alias("request_id"), "strategy", F.when(F.col("n") == 0, "no_match").when(F.col("n") == 1, "matched").otherwise("candidate_set").alias("outcome"))


@query("select source_id, row_number() over (partition by g order by source_id) as place, round(1.0 / (60 + row_number() over (partition by g order by source_id)), 12) as position_score from (select 'P-' || cast(p_partkey as varchar) as source_id, p_brand as g from part)")
def position_score(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    rows = table(spark, sf, "part").select(F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("source_id"), F.col("p_brand").alias("g"))
    place = F.row_number().over(Window.partitionBy("g").orderBy("source_id"))
    return rows.select("source_id", place.alias("place"), F.round(1.0 / (60 + place), 12).alias("position_score"))


@query("select event_id from (select event_id, row_number() over (order by ts desc, event_id desc) as n, sum(length(props)) over (order by ts desc, event_id desc rows between unbounded preceding and current row) as b from events) where n <= 500 and b <= 20000")
def eviction(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "ts", F.length("props").alias("size"))
    return C.keep_newest(e, ["ts", "event_id"], "size", 500, 20_000).select("event_id")
