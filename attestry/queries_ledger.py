"""Queries over projections, ledgers and the evaluation harness, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import text as X
from attestry.operators import decide as D
from attestry.operators import harness as H
from attestry.operators import ledger as L
from attestry.operators import qualify as Q
from attestry.operators import retrieve as R
from attestry.plans import domain
from attestry.plans.oracle_core import CORE, STEPPED, _norm
from attestry.queries import TREE, admitted_classes, hits, ids, query, scored, table

_CAT = f"with cat as ({domain.CATALOG_SQL}) "


# ---- projections and ledgers ------------------------------------------------------------------------------------------------
@query(_CAT + "select source_id, source_type from cat where source_type in ('epd', 'supplier')")
def memory_scan(spark: SparkSession, sf: str) -> DataFrame:
    return L.scan(domain.catalog(spark, sf), ("epd", "supplier")).select("source_id", "source_type")


_ALIASES = "case p_size % 4 when 0 then '[\"' || p_name || '\", \"' || p_brand || '/X\", \" \"]' when 1 then p_name || ' , ' || upper(p_name) || ',,' || p_type when 2 then '' end"


@query(f"with r as (select p_partkey as id, {_ALIASES} as raw from part), l as (select id, case when trim(raw) like '[%' then from_json(raw, '[\"VARCHAR\"]') else string_split(coalesce(raw, ''), ',') end as items from r), u as (select id, place, {_norm('x')} as a from l, unnest(items) with ordinality as t(x, place)), d as (select id, a, min(place) as place from u where a <> '' group by id, a), j as (select id, string_agg(a, '|' order by place) as aliases from d group by id) select r.id, coalesce(aliases, '') as aliases from r left join j on j.id = r.id")
def alias_list(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(L.alias_list(F.expr(_ALIASES)), "|").alias("aliases"))


@query(STEPPED + "select request_id, candidate_id, source_id, resolution_type, steps_3 as steps, case method when 'interpolated' then 'anchors of one series' when 'nearest' then 'nearest grade unchanged' else '' end as assumptions, true as total_holds from pool where steps_3 > 0 or resolution_type not in ('direct_exact', 'direct_alias', 'unit_converted')")
def lineage(spark: SparkSession, sf: str) -> DataFrame:
    said = {k: k for k in ("resolution_type", "steps", "factor", "impact")} | {"assumptions": "array_join(assumptions, '|')"}
    told = D.set_out(admitted_classes(spark, sf).where(F.expr("pooled") & L.made_by_steps()), said, {"total": "factor * resolved_quantity * impact"}, "resolved:")
    return told.select("request_id", "candidate_id", "source_id", "resolution_type", "steps", "assumptions", L.total_holds().alias("total_holds"))


@query(_CAT + "select source_id, concat_ws('|', case when year is null then 'source year is unspecified' end, case when geography is null then 'source geography is unspecified' end, case when coalesce(declared_product, '') = '' then 'formal_admission_incomplete:declared_product' end, case when coalesce(boundary, '') = '' and coalesce(boundary_modules, '') = '' then 'formal_admission_incomplete:boundary' end) as limits from cat")
def admission_limits(spark: SparkSession, sf: str) -> DataFrame:
    c = domain.catalog(spark, sf)
    return c.select(*[F.col(k).alias(f"c_{k}") for k in c.columns]).select(F.col("c_source_id").alias("source_id"), F.array_join(L.admission_limits(), "|").alias("limits"))


@query(CORE + "select request_id, source_id, gap_2 is null and gap_3 is null and gap_4 is null and gap_5 is null and gap_6 is null and gap_7 is null as usable from strong")
def directly_usable(spark: SparkSession, sf: str) -> DataFrame:
    return R.members(scored(spark, sf), L.directly_usable(F.col("gaps")).alias("usable")).select(ids("usable"))


_GATE_ROWS = " union all ".join(f"select request_id, source_id, '{g}' as gate, g_{g} as status from judged where g_{g} <> 'pass'" for g in Q.GATES)


@query(CORE + _GATE_ROWS)
def diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return R.members(L.diagnostics(Q.qualify(hits(spark, sf))), "gate", "status").select(ids("gate", "status"))


_RELATED = [("blue", "rel-1"), ("blue", "rel-2"), ("red", "rel-1")]


@query("with m as (select distinct split_part(p_name, ' ', 1) as rule_id, p_brand as name from part), r(rule_id, relation_id) as (values ('blue', 'rel-1'), ('blue', 'rel-2'), ('red', 'rel-1')) select m.rule_id, m.name, coalesce(string_agg(relation_id, ',' order by relation_id), '') as relations from m left join r using (rule_id) group by all")
def rule_relations(spark: SparkSession, sf: str) -> DataFrame:
    matches = table(spark, sf, "part").select(F.split("p_name", " ")[0].alias("rule_id"), F.col("p_brand").alias("name")).distinct()
    return L.with_relations(matches, spark.createDataFrame(_RELATED, "rule_id string, relation_id string")).withColumn("relations", F.array_join("relations", ","))


@query("select doc_id, quality, true as known from labels where doc_id in (select doc_id from documents where lang = 'en') union all select doc_id, quality, false from labels where doc_id not in (select doc_id from documents where lang = 'en')")
def label_membership(spark: SparkSession, sf: str) -> DataFrame:
    labels, docs = table(spark, sf, "labels").select("doc_id", "quality"), table(spark, sf, "documents").where("lang = 'en'")
    return L.known(labels, docs, "doc_id").withColumn("known", F.lit(True)).unionByName(L.unknown(labels, docs, "doc_id").withColumn("known", F.lit(False)))


@query("select distinct event_type, user_id from events where value > 50 and (event_type, user_id) not in (select event_type, user_id from events where value < 10)")
def unrecorded(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", "user_id", "value")
    return L.unrecorded(e.where("value > 50").select("event_type", "user_id"), e.where("value < 10"), ["event_type", "user_id"])


@query("with r as (select p_brand as subject, p_type as role, case when p_size % 2 = 0 then 'A1' else 'A3' end as module, p_size % 7 = 0 as quantified, p_partkey as place, p_retailprice as value from part) select subject, role, module, quantified, place, value from (select *, row_number() over (partition by subject, role, module order by quantified desc, place) as n from r) where n = 1")
def best_assignments(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    n = F.col("p_size")
    return L.best_assignments(p.select(F.col("p_brand").alias("subject"), F.col("p_type").alias("role"), F.when(n % 2 == 0, "A1").otherwise("A3").alias("module"), (n % 7 == 0).alias("quantified"), F.col("p_partkey").alias("place"), F.col("p_retailprice").alias("value")))


@query("select p_brand as brand, string_agg(distinct '{\"v\":\"' || p_type || '\"}', ';' order by '{\"v\":\"' || p_type || '\"}') as members from part group by p_brand")
def canonical_set(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.collect_list("p_type").alias("types"))
    return per.select("brand", F.array_join(L.canonical_set(F.col("types")), ";").alias("members"))


@query("with s as (select 'S-' || p_partkey as schema_id, p_size % 5 as priority, p_brand as entity_id, case when p_size % 3 = 0 then 'draft' else 'active' end as status from part), n as (select distinct p_brand as entity_id from part) select entity_id, schema_id from (select s.*, row_number() over (partition by entity_id order by priority desc, schema_id) as r from s where status = 'active') join n using (entity_id) where r = 1")
def first_schema(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    schemas = p.select(F.concat(F.lit("S-"), F.col("p_partkey").cast("string")).alias("schema_id"), (F.col("p_size") % 5).alias("priority"), F.array("p_brand").alias("entity_ids"), F.when(F.col("p_size") % 3 == 0, "draft").otherwise("active").alias("status"))
    return L.first_schema(p.select(F.col("p_brand").alias("entity_id")).distinct(), schemas)


@query("with a as (select p_partkey % 400 as edge_id, p_type as name, p_retailprice as value from part) select edge_id, name, count(*) as rows, min(value) as value, count(*) > 1 as conflict from a group by all")
def union_parameters(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select((F.col("p_partkey") % 400).alias("edge_id"), F.col("p_type").alias("name"), F.col("p_retailprice").alias("value"))
    return L.union_parameters([p.where("value < 1000"), p.where("value >= 1000")])


@query("with h as (select p_brand as brand, list(distinct p_type) as have from part where p_size > 45 group by p_brand) select brand, array_to_string(list_sort(list_filter(['ECONOMY', 'PROMO', 'SMALL', 'RARE'], lambda t: not list_contains(have, t))), '|') as missing from h")
def required_subset(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "part").where("p_size > 45").groupBy(F.col("p_brand").alias("brand")).agg(F.collect_set("p_type").alias("have"))
    return per.select("brand", F.array_join(L.missing_of(F.array(*map(F.lit, ["ECONOMY", "PROMO", "SMALL", "RARE"])), F.col("have")), "|").alias("missing"))


@query("select sha256(p_brand) as sha256, min(p_name) as name, count(*) as uses from part group by 1")
def database_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return L.anchors(table(spark, sf, "part").select(F.sha2("p_brand", 256).alias("sha256"), F.col("p_name").alias("name")))


@query("with e as (select 'forms' || chr(31) || p_type || chr(31) || p_size as entry from part union all select 'materials' || chr(31) || p_brand || chr(31) || p_name from part), d as (select sha256(entry) as d from e)" + TREE)
def registry_digest(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return L.registry_digest({"materials": p.select(F.col("p_brand").alias("alias"), F.col("p_name").alias("rule")), "forms": p.select(F.col("p_type").alias("form"), F.col("p_size").alias("rule"))})


@query("select event_type, count(*) as n, count(distinct sha256(user_id || chr(31) || event_type)) as requests from events group by event_type")
def category_requests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct(F.sha2(F.concat_ws("\x1f", F.col("user_id").cast("string"), "event_type"), 256)).alias("requests"))


# ---- texts ----------------------------------------------------------------------------------------------------------------
@query("select doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^0-9a-z\u3400-\u9fff]+', ' ', 'g')) as plain, regexp_replace(lower(coalesce(text, '')), '[^0-9a-z\u4e00-\u9fff]+', '', 'g') as compact, trim(regexp_replace(translate(lower(coalesce(text, '')), '-_', '  '), '\\s+', ' ', 'g')) as folded from documents")
def label_forms(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", X.plain_label(t).alias("plain"), X.compact_label(t).alias("compact"), X.discovery_fold(t).alias("folded"))


_MIXED = "p_name || ' ' || case p_size % 3 when 0 then '热轧钢板' when 1 then 'al 钢' else 'steel-bar x' end"


@query(f"with r as (select p_partkey as id, {_norm(_MIXED)} as own from part), c as (select id, own, regexp_replace(own, '[^\u4e00-\u9fff]', '', 'g') as cjk from r), t as (select id, list_distinct(list_concat(list_filter(string_split(own, ' '), lambda w: length(w) >= 3), case when length(cjk) >= 2 then list_transform(range(1, length(cjk)), lambda i: substr(cjk, i, 2)) else [] end)) as terms from c) select id, array_to_string(list_sort(terms), '|') as terms from t")
def material_terms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.array_sort(X.material_terms(F.expr(_MIXED))), "|").alias("terms"))


@query("select page_id, case when regexp_full_match(trim(url), '[A-Za-z0-9][A-Za-z0-9._:-]{0,127}') then trim(url) else 'page-' || page_id end as id from pages union all select p_partkey, case when regexp_full_match(trim(p_brand), '[A-Za-z0-9][A-Za-z0-9._:-]{0,127}') then trim(p_brand) else 'part-' || p_partkey end from part")
def safe_ids(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", X.safe_id(F.col("url"), F.concat(F.lit("page-"), F.col("page_id").cast("string"))).alias("id"))
    return pages.unionByName(table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), X.safe_id(F.col("p_brand"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string"))).alias("id")))


_DEEP = "'{\"a\": [{\"name\": \"' || p_name || '\"}' || case when p_size % 2 = 0 then ', {\"list\": [1, 2, 3]}' else '' end || '], \"b' || p_size % 3 || '\": {\"c\": null}' || case when p_size % 5 = 0 then ',' else '' end || '}'"


@query(f"with r as (select p_partkey as id, {_DEEP} as raw, p_size % 5 = 0 as broken, p_size % 2 = 0 as listed, p_size % 3 as b from part) select id, case when broken then '' else array_to_string(list_sort(list_filter(['a', 'b' || b, 'c', 'name', case when listed then 'list' end], lambda k: k is not null)), '|') end as keys, case when not broken then case when listed then 4 else 3 end end as depth, case when not broken then 3 + case when listed then 1 else 0 end end as records, case when not broken then case when listed then 3 else 1 end end as longest from r")
def json_shape(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr(_DEEP).alias("raw"))
    own = p.withColumn("x", X.json_complexity(F.col("raw")))
    return own.select("id", F.array_join(X.all_keys(F.col("raw")), "|").alias("keys"), "x.depth", "x.records", "x.longest")


@query()
def challenge_score(spark: SparkSession, sf: str) -> DataFrame:
    """The matching-blocks ratio has no SQL form; tests hold it against the library."""
    p = table(spark, sf, "part").select(X.plain_label(F.col("p_name")).alias("a"), X.plain_label(F.concat_ws(" ", "p_brand", "p_name")).alias("b")).distinct()
    return p.select("a", "b", F.round(X.challenge_score(F.col("a"), F.col("b")), 9).alias("score"))


# ---- harness --------------------------------------------------------------------------------------------------------------
_EXPECTED = "case p_size % 6 when 0 then 'abstain' when 1 then 'more_input' else 'retrieve' end"
_STATUS = "case p_partkey % 11 when 0 then 'more_input_needed' when 1 then 'error' else 'ok' end"
_CASES = f"cases as (select p_partkey as case_id, p_brand as category, {_EXPECTED} as expected, {_STATUS} as status, list_transform(list_filter([0, 1, 2, 3], lambda i: i < p_size % 4), lambda i: 'P-' || (p_partkey + i * 7)) as observed, ['P-' || (p_partkey + 7 * (p_size % 3))] as acceptable, case when p_size % 5 < 2 then ['P-' || (p_partkey + 14)] else [] end as forbidden, case p_size % 3 when 0 then 'A1' when 1 then 'A2' else 'A1-A3' end as boundary, case p_size % 2 when 0 then 'raw_material' else 'energy' end as subject_type from part)"
_DECISION = "case when status = 'error' then 'error' when status = 'more_input_needed' then 'more_input' when len(observed) = 0 then 'abstain' else 'retrieve' end"


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    name = "concat('P-', cast(p_partkey + {} as string))"
    cols = {"case_id": "p_partkey", "category": "p_brand", "expected": _EXPECTED, "status": _STATUS, "observed": f"transform(filter(array(0, 1, 2, 3), i -> i < p_size % 4), i -> {name.format('i * 7')})", "acceptable": f"array({name.format('7 * (p_size % 3)')})", "forbidden": f"if(p_size % 5 < 2, array({name.format('14')}), cast(array() as array<string>))", "boundary": "case p_size % 3 when 0 then 'A1' when 1 then 'A2' else 'A1-A3' end", "subject_type": "case p_size % 2 when 0 then 'raw_material' else 'energy' end"}
    return table(spark, sf, "part").select(*[F.expr(v).alias(k) for k, v in cols.items()])


@query(f"with {_CASES} select case_id, {_DECISION} as decision from cases")
def decision_classes(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, sf).select("case_id", H.decision_class(F.col("status"), F.col("observed")).alias("decision"))


@query(f"with {_CASES}, r as (select *, unnest(observed) as source_id from cases) select case_id, source_id, case when expected = 'retrieve' and list_contains(acceptable, source_id) then 'acceptable' when list_contains(forbidden, source_id) then 'forbidden' else 'unlisted' end as class from r")
def candidate_classes(spark: SparkSession, sf: str) -> DataFrame:
    return H.returned(_cases(spark, sf)).select("case_id", "source_id", "class")


@query(_CAT + f", {_CASES}, r as (select *, unnest(observed) as source_id from cases), k as (select r.*, case when expected = 'retrieve' and list_contains(acceptable, r.source_id) then 'acceptable' when list_contains(forbidden, r.source_id) then 'forbidden' else 'unlisted' end as class, c.boundary as own_boundary, c.subject_type as own_subject from r left join cat c on c.source_id = r.source_id), l as (select count(*) as returned, count(*) filter (class = 'acceptable') as acceptable, count(*) filter (class = 'forbidden') as forbidden, count(*) filter (class = 'unlisted') as unlisted, count(*) filter (own_boundary <> boundary) as boundary_violations, count(*) filter (own_subject <> subject_type) as subject_violations, count(*) filter (own_subject is null) as unknown_ids from k), p as (select *, {_DECISION} as decision, list_position(observed, acceptable[1]) as spot from cases), w as (select count(*) as cases, round(count(*) filter (decision = expected) / count(*), 9) as decision_accuracy, round(count(*) filter (expected = 'retrieve' and spot between 1 and 1) / count(*) filter (expected = 'retrieve'), 9) as recall_1, round(count(*) filter (expected = 'retrieve' and spot between 1 and 3) / count(*) filter (expected = 'retrieve'), 9) as recall_3, round(count(*) filter (expected = 'retrieve' and spot between 1 and 5) / count(*) filter (expected = 'retrieve'), 9) as recall_5, round(avg(case when spot >= 1 then 1.0 / spot else 0.0 end) filter (expected = 'retrieve'), 9) as mrr, count(*) filter (decision = 'error') as errors from p) select * from w, l")
def challenge_metrics(spark: SparkSession, sf: str) -> DataFrame:
    found = H.challenge_metrics(_cases(spark, sf), domain.catalog(spark, sf))
    return found.withColumns({c: F.round(c, 9) for c in ("decision_accuracy", "recall_1", "recall_3", "recall_5", "mrr")})


_SEALED = "select p_size % 3 <> 0 as answerable, p_size % 4 <> 0 as passed, p_size % 5 <> 0 as top_1, p_size % 7 <> 0 as recall, p_size % 2 = 0 as abstained, p_size % 11 = 0 as escaped, p_size % 13 <> 0 as replayed, case p_size % 5 when 0 then 'boundary' when 1 then 'subject' when 2 then 'unit' else 'none' end as dimension, case when p_size = 50 then 500 else 200 end as http_status from part"


@query(f"with r as ({_SEALED}) select count(*) as cases, count(*) filter (answerable) as answerable, count(*) filter (passed) as passed, round(count(*) filter (answerable and top_1) / count(*) filter (answerable), 9) as top_1, round(count(*) filter (answerable and recall) / count(*) filter (answerable), 9) as recall, round(count(*) filter (not answerable and abstained) / count(*) filter (not answerable), 9) as abstention, count(*) filter (dimension = 'boundary' and escaped) as boundary_violations, count(*) filter (dimension = 'subject' and escaped) as subject_violations, count(*) filter (dimension = 'unit' and escaped) as unit_violations, count(*) filter (escaped) as escapes, round(count(*) filter (replayed) / count(*), 9) as replay, count(*) filter (http_status >= 500) as unhandled from r")
def sealed_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return H.sealed_metrics(domain.frame(spark, sf, _SEALED, "part")).withColumns({c: F.round(c, 9) for c in ("top_1", "recall", "abstention", "replay")})


_ACCEPTED = "select case when p_size % 4 > 0 then p_size % 3 = 0 end as recalled, p_size % 5 as candidates, p_size % 5 % 2 as wrong, case when p_size % 6 = 0 then p_size % 4 = 0 end as abstention_correct, p_size % 7 = 0 as expected_more_input, case p_partkey % 5 when 0 then 'more_input_needed' when 1 then 'error' else 'ok' end as status, p_size / 100.0 as evidence_sum, p_size % 5 as evidence_count from part"


@query(f"with r as ({_ACCEPTED}) select count(*) as cases, round(count(*) filter (recalled) / count(recalled), 9) as recall_at_5, round(sum(wrong) / sum(candidates), 9) as wrong_rate, round(count(*) filter (abstention_correct) / count(abstention_correct), 9) as abstention_rate, round(count(*) filter (expected_more_input and status = 'more_input_needed') / count(*) filter (expected_more_input), 9) as more_input_recall, round(count(*) filter (not expected_more_input and status <> 'more_input_needed') / count(*) filter (not expected_more_input), 9) as more_input_specificity, round(sum(evidence_sum) / sum(evidence_count), 9) as evidence_completeness, count(*) filter (status = 'error') as errors from r")
def acceptance_metrics(spark: SparkSession, sf: str) -> DataFrame:
    found = H.acceptance_metrics(domain.frame(spark, sf, _ACCEPTED, "part"))
    return found.withColumns({c: F.round(c, 9) for c in ("recall_at_5", "wrong_rate", "abstention_rate", "more_input_recall", "more_input_specificity", "evidence_completeness")})


@query(f"with {_CASES}, v as (select *, case when status = 'error' then 'error' else 'done' end as s, case when len(observed) > 0 then observed[1:1] else [] end as prim, case when len(observed) > 1 then observed[2:] else [] end as rev from cases) select case_id, s = case when expected = 'abstain' then 'error' else 'done' end and len(list_intersect(forbidden, list_concat(prim, rev))) = 0 and (category not like '%3' or len(list_filter(forbidden, lambda f: not list_contains(rev, f))) = 0) and (category not like '%1' or coalesce(prim[1] = acceptable[1], false)) and len(list_intersect(acceptable, list_concat(prim, rev))) > 0 as passed from v")
def case_verdict(spark: SparkSession, sf: str) -> DataFrame:
    c = _cases(spark, sf)
    none = F.array().cast("array<string>")
    v = c.select("case_id", F.when(F.col("status") == "error", "error").otherwise("done").alias("status"), F.when(F.col("expected") == "abstain", "error").otherwise("done").alias("expected_status"), F.slice("observed", 1, 1).alias("primary"), F.when(F.size("observed") > 1, F.slice("observed", 2, 9)).otherwise(none).alias("reviewable"), "forbidden", F.when(F.col("category").endswith("3"), F.col("forbidden")).otherwise(none).alias("references"), "acceptable", F.when(F.col("category").endswith("1"), F.get("acceptable", F.lit(0))).alias("expected_top"), F.lit(True).alias("trace_complete"))
    return v.select("case_id", H.case_passed().alias("passed"))


@query("select coalesce(a.p_partkey, b.p_partkey) as id, coalesce(a.p_size = b.p_size and a.t = b.t, false) as same from (select p_partkey, p_size, p_type as t from part where p_size > 3) a full join (select p_partkey, p_size, case when p_size % 9 = 0 then 'X' else p_type end as t from part where p_size < 48) b using (p_partkey)")
def replay_equality(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), F.col("p_type").alias("t"))
    again = p.where("size < 48").withColumn("t", F.when(F.col("size") % 9 == 0, "X").otherwise(F.col("t")))
    return H.replays(p.where("size > 3"), again, "id", "size", "t")


@query(_CAT + ", l as (select source_id, unnest([material_name, alias]) as n from cat), c as (select distinct source_id, regexp_replace(lower(n), '[^0-9a-z]+', '', 'g') as label from l), q as (select p_partkey as request_id, regexp_replace(lower(p_brand || '_' || p_name || '/' || p_type), '[^0-9a-z]+', '', 'g') as label from part) select distinct request_id, source_id from q join c using (label)")
def alias_baseline(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "part").select(F.col("p_partkey").alias("request_id"), F.expr("p_brand || '_' || p_name || '/' || p_type").alias("name"))
    return H.alias_baseline(q, domain.catalog(spark, sf).select("source_id", F.col("material_name").alias("name"), F.array("alias").alias("aliases")))


@query("with c as (select p_brand as metric, bool_and(p_size > 1) as ok from part group by p_brand union all select 'forbidden', false union all select 'errors', null) select 'FINDING-' || upper(metric) as finding, case metric when 'forbidden' then 'CRITICAL' when 'errors' then 'CRITICAL' else 'HIGH' end as severity, 'OPEN' as state from c where not coalesce(ok, false)")
def dynamic_findings(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "part").groupBy(F.col("p_brand").alias("metric")).agg(F.bool_and(F.col("p_size") > 1).alias("ok"))
    return H.findings(c.unionByName(spark.createDataFrame([("forbidden", False), ("errors", None)], "metric string, ok boolean")))


_FIELDS = ["source_id", "provider", "factor_unit", "factor_kind", "indicator", "declared_product", "boundary", "composition", "document_sha256"]


@query(_CAT + "select source_id, round((" + " + ".join(f"case when trim(coalesce(cast({f} as varchar), '')) <> '' then 1 else 0 end" for f in _FIELDS) + ") / 9.0, 9) as share from cat")
def evidence_presence(spark: SparkSession, sf: str) -> DataFrame:
    return domain.catalog(spark, sf).select("source_id", F.round(H.evidence_presence(_FIELDS), 9).alias("share"))


@query("select p_partkey as id, case when p_size % 4 = 0 then case when p_size % 8 = 0 then 'required' else 'missing_diagnostic' end when p_size % 3 = 0 and p_size % 5 > 0 then case when p_partkey % 2 = 0 then 'passed' else 'missing_lineage' end else 'not_applicable' end as gate from part")
def evidence_gate(spark: SparkSession, sf: str) -> DataFrame:
    p, n = table(spark, sf, "part"), F.col("p_size")
    ev = F.when(n % 3 == 0, F.concat(F.lit("ev-"), n.cast("string")))
    gate = H.evidence_gate(F.when(n % 4 == 0, F.array(F.lit("UNIT_CONVERSION_EVIDENCE_REQUIRED"))).otherwise(F.array(F.lit("OTHER"))), F.when(n % 8 == 0, F.array(F.lit("unit_conversion_evidence"))).otherwise(F.array(F.lit("year"))), ev, F.when(F.col("p_partkey") % 2 == 0, F.array(F.concat(F.lit("ev-"), n.cast("string")))).otherwise(F.array(F.lit("ev-0"))), n % 5 > 0)
    return p.select(F.col("p_partkey").alias("id"), gate.alias("gate"))


@query("select p_partkey as id, case p_size % 5 when 0 then 0 when 1 then 10 when 2 then 20 when 3 then 100 end as rank from part")
def tier_rank(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*map(F.lit, [*H.TIER_RANKS, "unheard_of"]))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), H.tier_rank(F.get(names, F.col("p_size") % 5)).alias("rank"))


@query("with c as (select s_nationkey as system, s_suppkey % 3 = 0 as required, s_acctbal > 500 as healthy from supplier), p as (select system, count(*) filter (required and not healthy) as missing_required, count(*) filter (not required and not healthy) as missing_optional from c group by system) select *, case when missing_required > 0 then 'not_ready' when missing_optional > 0 then 'degraded' else 'ready' end as status from p")
def readiness(spark: SparkSession, sf: str) -> DataFrame:
    return H.readiness(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("system"), (F.col("s_suppkey") % 3 == 0).alias("required"), (F.col("s_acctbal") > 500).alias("healthy")))


@query(_CAT + ", t(name, g, y, b, u) as (values ('plain', null, null, null, null), ('other_year', null, 1901, null, null), ('other_place', 'NOWHERE', null, null, null), ('no_unit', null, null, null, 'stone'), ('no_boundary', null, null, 'use phase', null)) select source_id || ':' || name as case_id, source_id, material_name, coalesce(g, geography) as geography, coalesce(y, year) as year, coalesce(b, boundary) as boundary, coalesce(u, 'kg') as quantity_unit, case when name = 'plain' then 'retrieve' else 'abstain' end as expected from cat, t")
def generated_cases(spark: SparkSession, sf: str) -> DataFrame:
    return H.generated_cases(domain.catalog(spark, sf).select("source_id", "material_name", "geography", "year", "boundary", F.lit("kg").alias("quantity_unit")))


@query("with n as (select count(*) as n from part), r as (select unnest(range(0, n)) as id from n), c as (select 'N-' || id as source_id, 'noise material ' || sha256(cast(id as varchar)) as material_name, 1.0 + id % 97 / 100.0 as factor_value from r union all select 'T-0', 'target', 1.5) select source_id, material_name, round(factor_value, 6) as factor_value from c")
def scale_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return H.scale_catalog(spark, table(spark, sf, "part").count()).withColumn("factor_value", F.round("factor_value", 6))


# ---- resolver parts and evidence ------------------------------------------------------------------------------------------
_SIDES = [("material", "q_name", "c_name"), ("process", "q_process", "c_process"), ("form", "q_form", "c_form"), ("composition", "q_composition", "c_composition"), ("geography", "q_geography", "c_geography"), ("time", "q_year", "c_year"), ("boundary", "q_boundary", "c_boundary")]


@query(CORE + "select request_id, source_id, concat_ws('|', " + ", ".join(f"case when coalesce(trim(cast({c} as varchar)), '') = '' then 'missing_{side}_{k}' end" for k, *pair in _SIDES for side, c in zip(("target", "source"), pair, strict=True)) + ") as missing from hit")
def missing_evidence(spark: SparkSession, sf: str) -> DataFrame:
    from attestry.operators import score as S

    fields = tuple(c.removeprefix("q_") for k, (c, _) in S.PAIRS.items() if k != "material")
    q, c = (R.bare(R.stated(df, *fields), *fields) for df in (domain.requests(spark, sf), domain.catalog(spark, sf)))
    return R.members(R.retrieve(R.alike(q), R.classes(c)), F.array_join(F.expr(S.missing_evidence()), "|").alias("missing")).select(ids("missing"))


_CATEGORY = "case c_source_type when 'epd' then 'natural_mineral' when 'supplier' then 'manufactured_mineral' when 'literature' then 'synthetic_chemical' else 'other' end"


def _proxy_sql() -> str:
    from attestry.operators import score as S

    text = lambda w: "round(" + " + ".join(f"cast({v!r} as double) * d_{k}" for k, v in w.items()) + ", 6)"
    return f"case {_CATEGORY} " + " ".join(f"when '{k}' then {text(w)}" for k, w in S.PROXY.items() if k != "default") + f" else {text(S.PROXY['default'])} end"


@query(CORE + f"select request_id, source_id, {_proxy_sql()} as score from strong")
def proxy_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates scored as proxies, by the weights of their category."""
    from attestry.operators import score as S

    return R.members(scored(spark, sf), F.expr(S.proxy_score(_CATEGORY)).alias("score")).select(ids("score"))


_FORM = "case p_size % 5 when 0 then ' Fibre' when 1 then '纤维' when 2 then '钢纤维' when 3 then '' else upper(p_type) || '_Form' end"


@query(f"with r as (select p_partkey as id, {_FORM} as raw from part) select id, case {_norm('raw')} when 'fibre' then 'fiber' when '纤维' then 'fiber' when '钢纤维' then 'fiber' else nullif({_norm('raw')}, '') end as form, concat_ws('|', case when lower(raw) <> raw then 'casefold' end, case when regexp_replace(lower(raw), '[\\[\\](){{}}/_|,;:·\\-–—]+', ' ', 'g') <> lower(raw) then 'separators' end, case when trim(regexp_replace(regexp_replace(lower(raw), '[\\[\\](){{}}/_|,;:·\\-–—]+', ' ', 'g'), '\\s+', ' ', 'g')) <> regexp_replace(lower(raw), '[\\[\\](){{}}/_|,;:·\\-–—]+', ' ', 'g') then 'whitespace' end) as rules, lower(regexp_replace(regexp_replace('keyOf' || p_type || 'Value' || p_size, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')) as words from r join part on p_partkey = id")
def form_texts(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr(_FORM)
    words = X.camel_words(F.concat(F.lit("keyOf"), "p_type", F.lit("Value"), F.col("p_size").cast("string")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.canonical_form(raw).alias("form"), F.array_join(X.normalization_rules(raw), "|").alias("rules"), words.alias("words"))


_ADDED = "select p_partkey as id, case when p_size % 4 < 2 then p_size / 10.0 end as t_additive_kg_per_t, case when p_size % 3 > 0 then 0.85 end as t_carbon_share, 0.9 as t_oxidation, p_size % 5 = 0 as t_trigger, case when p_size % 7 = 0 then p_size / 100.0 end as t_explicit from part"


@query(f"with a as ({_ADDED}), v as (select *, t_additive_kg_per_t * t_carbon_share * t_oxidation * 44.0 / 12.0 / 1000.0 as triple from a) select id, case when triple is null and t_trigger then null else round(coalesce(triple, t_explicit), 9) end as value, case when triple is null and t_trigger then 'process_emission_incomplete' end as error from v")
def additional_values(spark: SparkSession, sf: str) -> DataFrame:
    from attestry.operators import transform as T

    rows = domain.frame(spark, sf, _ADDED, "part")
    rows = rows.select("id", "t_trigger", *[F.col(c).cast("double").alias(c) for c in rows.columns if c not in ("id", "t_trigger")]).withColumn("x", T.additional_value("t"))
    return rows.select("id", F.round("x.value", 9).alias("value"), "x.error")


_PARAMS = "select p_partkey as id, p_partkey % 300 as edge_id, p_type as name, p_size % 9 = 0 as source_flag, case when p_size % 2 = 0 then p_size % 11 = 0 end as evidence_flag from part"


@query(f"with r as ({_PARAMS}) select id, count(*) over (partition by edge_id, name) as copies, count(*) over (partition by edge_id, name) > 1 as ambiguous from r")
def duplicate_parameters(spark: SparkSession, sf: str) -> DataFrame:
    from attestry.operators import evidence as V

    return V.duplicate_parameters(domain.frame(spark, sf, _PARAMS, "part").select("id", "edge_id", "name")).select("id", "copies", "ambiguous")


@query(f"with r as ({_PARAMS}) select edge_id, bool_or(coalesce(source_flag, false) or coalesce(evidence_flag, false)) as included from r group by edge_id")
def inclusion_proof(spark: SparkSession, sf: str) -> DataFrame:
    from attestry.operators import evidence as V

    return V.inclusion_proof(domain.frame(spark, sf, _PARAMS, "part"))


_PROFILE = "select p_partkey as id, p_brand as head, p_type as process, p_size % 6 > 0 as active, p_size % 7 > 0 as runtime_eligible, case when p_size % 10 = 0 then 'X AMBIGUOUS_DUPLICATE' else 'OK' end as allocation_status, p_size % 3 as quota_level from part"


@query(f"with r as ({_PROFILE}) select s_suppkey as edge, id from supplier join r on head = 'Brand#' || (11 + s_suppkey % 5) and process = case s_suppkey % 3 when 0 then 'ECONOMY' when 1 then 'SMALL' else 'PROMO' end where active and runtime_eligible and allocation_status not like '%AMBIGUOUS_DUPLICATE%' and quota_level in (0, s_suppkey % 3)")
def energy_profiles(spark: SparkSession, sf: str) -> DataFrame:
    from attestry.operators import evidence as V

    n = F.col("s_suppkey")
    wanted = table(spark, sf, "supplier").select(n.alias("edge"), F.concat(F.lit("Brand#"), (11 + n % 5).cast("string")).alias("head"), F.when(n % 3 == 0, "ECONOMY").when(n % 3 == 1, "SMALL").otherwise("PROMO").alias("process"), F.array(F.lit(0).cast("long"), (n % 3).cast("long")).alias("levels"))
    rows = domain.frame(spark, sf, _PROFILE, "part").withColumn("quota_level", F.col("quota_level").cast("long"))
    return V.profiles(wanted, rows).select("edge", "id")


_EVID = "select p_partkey as id, p_brand as reference_id, p_type as target_material, case when p_size % 3 > 0 then split_part(p_name, ' ', 1) end as target_process, p_retailprice as value from part where p_size > 20"


@query(f"with e as ({_EVID}), q as (select p_partkey as edge_id, p_brand as reference_id, p_type as target_material, split_part(p_name, ' ', 1) as target_process from part where p_size < 6) select edge_id, id, value from q join e using (reference_id, target_material) where coalesce(e.target_process, '') = '' or e.target_process = q.target_process")
def process_evidence(spark: SparkSession, sf: str) -> DataFrame:
    from attestry.operators import evidence as V

    q = table(spark, sf, "part").where("p_size < 6").select(F.col("p_partkey").alias("edge_id"), F.col("p_brand").alias("reference_id"), F.col("p_type").alias("target_material"), F.split("p_name", " ")[0].alias("target_process"))
    return V.process_evidence(q, domain.frame(spark, sf, _EVID, "part"))


_DOC = "'{\"source_id\": ' || case when p_size % 9 = 0 then 'null' else '\"D-' || p_partkey || '\"' end || ', \"factor_value\": \"' || case p_size % 5 when 0 then '-1' when 1 then 'x' else cast(p_size as string) end || '\", \"factor_unit\": \"' || case when p_size % 4 = 0 then '' else 'kgCO2e/kg' end || '\", \"indicator\": \"' || case when p_size % 7 = 0 then 'ODP' else 'GWP-total' end || '\"' || case when p_size = 13 then '' else '}' end"


@query("select p_partkey as doc, concat_ws('|', case when p_size % 9 = 0 then 'identity' end, case when p_size % 5 < 2 then 'value' end, case when p_size % 4 = 0 then 'unit' end, case when p_size % 7 = 0 then 'indicator' end) as reasons from part where p_size <> 13 union all select p_partkey, 'identity|value|unit|indicator' from part where p_size = 13")
def extracted_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Structured documents, some of them incomplete, invalid or cut short."""
    from attestry.sources import files

    docs = domain.frame(spark, sf, f"select p_partkey as doc, {_DOC} as text from part", "part")
    return files.extract_document(docs).select("doc", F.array_join("reasons", "|").alias("reasons"))


@query("with s as (select p_partkey as id, lower(p_name) as n, lower(p_brand || ' ' || p_type) as a from part), t(term) as (values ('blue bolt'), ('brand#13'), ('small'), ('brand#11 economy extra')) select distinct id from s, t where n = term or a = term or (len(string_split(term, ' ')) >= 2 and (contains(n, term) or contains(a, term))) or (len(string_split(n, ' ')) >= 2 and contains(term, n)) or (len(string_split(a, ' ')) >= 2 and contains(term, a))")
def discovery(spark: SparkSession, sf: str) -> DataFrame:
    from attestry.sources import files

    snapshot = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("material_name"), F.array(F.concat_ws(" ", "p_brand", "p_type")).alias("aliases"))
    return files.discover(snapshot, F.array(*map(F.lit, ["blue bolt", "brand#13", "small", "brand#11 economy extra"]))).select("id")


@query("with c as (select p_name as source_id, p_size as v from part where p_size < 20 union all select p_brand, p_size from part where p_size < 20 union all select p_name, p_size from part where p_size > 45) select source_id, count(*) as copies from c group by 1 having count(*) > 1")
def combined_catalogs(spark: SparkSession, sf: str) -> DataFrame:
    from attestry.sources import files

    p = table(spark, sf, "part")
    own = lambda c, test: p.where(test).select(F.col(c).alias("source_id"), "p_size")
    return files.combined([own("p_name", "p_size < 20"), own("p_brand", "p_size < 20"), own("p_name", "p_size > 45")], "source_id")[1]
