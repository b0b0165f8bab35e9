"""Work on pairs doesn't grow with copies of records, and leaves no candidate out."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from attestry import queries, queries_identity
from attestry.operators import decide, evidence, harness, proxy, qualify, retrieve, score
from attestry.plans import domain

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def copied(catalog, n):
    return catalog.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("source_id", F.concat_ws("/", "source_id", "k")).drop("k")


def pairs(df):
    return sorted(map(tuple, df.select("q_request_id", "c_source_id").collect()))


def test_copies_are_worked_out_once(spark, monkeypatch):
    q, c = domain.requests(spark, SF).where("quantity > 60"), domain.catalog(spark, SF)
    monkeypatch.setattr(retrieve, "MEMBERS", 4)
    once = retrieve.retrieve(q, retrieve.classes(c)).count()
    many = retrieve.retrieve(q, retrieve.classes(copied(c, 4))).cache()
    assert many.count() == once and many.selectExpr("max(size(c_members))").first()[0] == 4
    assert pairs(retrieve.members(many)) == pairs(retrieve.retrieve(q, copied(c, 4)))
    more = retrieve.retrieve(q, retrieve.classes(copied(c, 10)))
    assert more.count() == 3 * once and retrieve.members(more).count() == 10 * once


def test_gates_in_the_join_lose_no_candidate(spark):
    q, c = domain.requests(spark, SF), domain.catalog(spark, SF).withColumns({"boundary": F.expr("case when grade % 7 = 0 then null when grade % 7 = 1 then ' A1-A3' else boundary end"), "boundary_modules": F.expr("case when grade % 3 = 0 then null else boundary_modules end")})
    own = retrieve.retrieve(q, c, fit=True).cache()
    expected = pairs(qualify.qualify(retrieve.retrieve(q, c)).where(score.ADMITTED))
    assert expected and pairs(qualify.qualify(own).where(score.ADMITTED)) == expected
    assert own.count() < retrieve.retrieve(q, c).count() / 20


def test_anchors_do_not_grow_with_copies(spark):
    c = domain.catalog(spark, SF)
    size = lambda df: decide.with_anchors(retrieve.prepare_catalog(df)).selectExpr("max(size(c_anchors))").first()[0]
    assert size(copied(c, 5)) == size(c) > 0


def test_rows_of_one_key_are_several_tasks(spark):
    wanted = spark.createDataFrame([("e", "h", "p", [0, 1, 1])], "edge string, head string, process string, levels array<long>")
    rows = spark.range(400).selectExpr("id", "'h' as head", "'p' as process", "true as active", "true as runtime_eligible", "'OK' as allocation_status", "id % 3 as quota_level")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = evidence.profiles(wanted, rows).select("id", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sorted(r["id"] for r in found) == [k for k in range(400) if k % 3 < 2] and len({r["task"] for r in found}) > 2


def test_pairs_are_not_kept_to_be_compared(spark):
    q = spark.createDataFrame([(1, "a-b"), (1, "c"), (2, ""), (3, None)], "request_id long, name string")
    c = spark.createDataFrame([("x", "A B", ["C", "ab"]), ("x", "c", None), ("y", "?", ["-"])], "source_id string, name string, aliases array<string>")
    assert list(map(tuple, harness.alias_baseline(q, c).collect())) == [(1, "x")]
    wanted = spark.createDataFrame([("r", "red", "gear"), ("r", "red", None), ("s", "", "")], "request_id string, class_name string, family string")
    records = spark.createDataFrame([("x", "red gear", None, None), ("x", "a red one", None, None), ("y", "gear", "g", "f")], "source_id string, material_name string, class string, family_name string")
    assert sorted(map(tuple, proxy.class_proxies(wanted, records).collect())) == [("r", "x"), ("r", "y")]


def test_classes_of_requests_lose_no_request(spark):
    """Requests that are alike are worked out once, beyond what one row of ids holds, and each of them is told; null isn't an empty text."""
    rows = [(f"r{i:03d}", "steel rod", None) for i in range(150)] + [("s0", "steel rod", ""), ("s1", "copper", None)]
    own = retrieve.alike(spark.createDataFrame(rows, "request_id string, material_name string, aliases string"))
    kinds = own.collect()
    assert sorted(len(k["members"]) for k in kinds) == [1, 1, 22, 64, 64] and all(k["request_id"] == k["members"][0] for k in kinds)
    said = own.where("aliases is null and material_name = 'steel rod'").select(F.col("request_id").alias("q_request_id"), F.lit(7).alias("n"))
    assert sorted((r["q_request_id"], r["n"]) for r in retrieve.told(said, own, "left").collect()) == sorted((i, 7 if name == "steel rod" and a is None else None) for i, name, a in rows)


def test_tables_of_requests_are_not_broadcast(spark, tmp_path):
    """Small files may hold many rows: no table that requests are made of goes over the driver."""
    spark.range(50).selectExpr("id as p_partkey", "'red rod' as p_name", "'B' as p_brand", "'T' as p_type", "1 as p_size", "1.0D as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(50).selectExpr("id as o_orderkey", "'O' as o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(50).selectExpr("id as l_orderkey", "id as l_partkey", "1.0D as l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    q, c = domain.requests(spark, str(tmp_path)), domain.catalog(spark, str(tmp_path))
    for found in (q, decide.with_routes(c, domain.edges(spark, str(tmp_path))), decide.with_flows(q, domain.flows(spark, str(tmp_path)))):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 50


def test_copies_of_requests_are_worked_out_once(spark, tmp_path):
    """Orders that differ in nothing but number and quantity add no pairs for gates and scores, and each of them is told."""
    part, orders, lines = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("part", "orders", "lineitem"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    more = F.explode(F.expr("sequence(0, 2)")).alias("k")  # 138600 is a multiple of all that the statements divide a number by
    orders.where("o_orderkey % 5 = 0").select("*", more).withColumn("o_orderkey", F.expr("o_orderkey + k * 138600L")).drop("k").write.parquet(f"{tmp_path}/orders.parquet")
    lines.where("l_orderkey % 5 = 0").select("*", more).withColumns({"l_orderkey": F.expr("l_orderkey + k * 138600L"), "l_quantity": F.expr("l_quantity + k")}).drop("k").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders.where("o_orderkey % 5 = 0").write.parquet(f"{tmp_path}/once/orders.parquet")
    lines.where("l_orderkey % 5 = 0").write.parquet(f"{tmp_path}/once/lineitem.parquet")
    part.write.parquet(f"{tmp_path}/once/part.parquet")
    many, once = str(tmp_path), f"{tmp_path}/once"
    for pairs_of in (queries.hits, queries.counted, queries.scored):
        assert pairs_of(spark, many).count() == pairs_of(spark, once).count() > 0
    for name in ("gates", "funnel", "reason_rollup"):
        assert queries.QUERIES[name](spark, many).count() == 3 * queries.QUERIES[name](spark, once).count() > 0


def test_columns_of_a_pair_are_made_once(spark):
    """What is told of a pair is a row made below the generator of its records, not an expression that every record works out again."""
    pairs = spark.createDataFrame([("q", ["a", "b"], "x")], "q_request_id string, c_members array<string>, text string")
    told = retrieve.own_records(pairs, F.sha2("text", 256).alias("digest"))
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("explode") :]
    assert "inline" in below and "sha2" in below[below.index("inline") :].splitlines()[0] and sorted(r["c_source_id"] for r in told.collect()) == ["a", "b"]


def test_rows_are_joined_as_lists(spark):
    """Pairs of lists meet, not pairs of rows; copies, nulls and rows of keys that the other side lacks are as in a plain join."""
    wanted = spark.range(300).selectExpr("concat('e', id) as edge", "case when id % 3 < 2 then 'h' when id = 2 then null else 'x' end as head", "if(id % 7 = 0, null, id) as more")
    rows = spark.range(500).selectExpr("'h' as head", "id div 2 as id", "if(id % 5 = 0, null, 1.5D) as value").unionByName(spark.sql("select cast(null as string) as head, 1L as id, 2D as value"))
    lists = evidence.listed(wanted, ["head"])
    assert lists.selectExpr("sum(size(rows))").first()[0] == 300 and lists.count() <= 3 * evidence.PARTS
    text = lambda df: sorted(map(str, df.select("head", "edge", "more", "id", "value").collect()))
    assert text(evidence.spread_join(wanted, rows, ["head"])) == text(wanted.join(rows, "head")) != []


def test_conflicts_are_found_from_digests(spark):
    """No task sorts whole records by key before they have moved, and of conflicts nothing but digests is grouped."""
    c = domain.catalog_with_duplicates(spark, SF)
    plan = decide.external_conflicts(c)._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan and "min_by" in retrieve.single(c)._jdf.queryExecution().optimizedPlan().toString()
    own = {r["source_id"]: r["copies"] for r in retrieve.single(c).where("conflict").collect()}
    assert own and own == {r["source_id"]: r["copies"] for r in decide.external_conflicts(c).collect()}
    executed = retrieve.single(c)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" not in executed[executed.index("hashpartitioning") :]


def test_late_proxies_are_worked_out_once(spark, tmp_path, monkeypatch):
    """Copies of requests that differ in number and quantity, and of records, add no pairs to be scored; all of them are told, as the SQL says."""
    part, orders, lines = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("part", "orders", "lineitem"))
    part = part.where("p_partkey % 2 = 0")
    more = F.explode(F.expr("sequence(0, 2)")).alias("k")  # 138600 is a multiple of all that the statements divide a number by
    asked, lines = orders.where("o_orderkey % 6 in (1, 2, 4)"), lines.withColumn("l_partkey", F.expr("l_partkey - l_partkey % 2"))
    for folder, copies in (("once", "k = 0"), ("many", "true")):
        part.select("*", more).where(copies).withColumn("p_partkey", F.expr("p_partkey + k * 138600L")).drop("k").write.parquet(f"{tmp_path}/{folder}/part.parquet")
        asked.select("*", more).where(copies).withColumn("o_orderkey", F.expr("o_orderkey + k * 138600L")).drop("k").write.parquet(f"{tmp_path}/{folder}/orders.parquet")
        lines.select("*", more).where(copies).withColumns({"l_orderkey": F.expr("l_orderkey + k * 138600L"), "l_quantity": F.expr("l_quantity + k / 7")}).drop("k").write.parquet(f"{tmp_path}/{folder}/lineitem.parquet")
    scored, told, finished = {}, {}, score.finished
    for folder in ("once", "many"):
        monkeypatch.setattr(score, "finished", lambda df, *more, at=folder: finished(scored.update({at: df}) or df, *more))
        told[folder] = queries_identity.late_proxies(spark, f"{tmp_path}/{folder}").collect()
        monkeypatch.setattr(score, "finished", finished)
    assert len(told["many"]) == 9 * len(told["once"]) > 0
    assert scored["many"].count() == scored["once"].count() > 0
    db = duckdb.connect()
    for t in ("part", "orders", "lineitem"):
        db.execute(f"create view {t} as select * from '{tmp_path}/many/{t}.parquet/*.parquet'")
    assert sorted(map(tuple, told["many"])) == sorted(db.execute(queries.ORACLES["late_proxies"]).fetchall())


def test_parameters_of_one_scope_are_not_one_task(spark):
    """A scope's rows are split over tasks, and those of another reference don't meet; blank and unknown references are as in a plain join."""
    scope = {"ref_head": F.lit("h"), "ref_process": F.lit("p"), "target_head": F.lit("t"), "target_process": F.lit("p")}
    edges = spark.range(200).selectExpr("id as edge", "case id % 4 when 0 then 'a' when 1 then 'b' when 2 then '' end as reference_id").withColumns(scope)
    rows = spark.range(300).selectExpr("id", "case id % 3 when 0 then '' when 1 then 'a' end as scope_ref", "if(id % 5 = 0, null, 1.5D) as value").withColumns(scope)
    found = evidence.scoped_parameters(edges, rows)
    plain = edges.join(rows, list(scope)).where("scope_ref = '' or scope_ref = reference_id")
    text = lambda df: sorted(map(str, df.select("edge", "id", "value").collect()))
    assert text(found) == text(plain) != []
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "_part" in plan[plan.index("SortMergeJoin") :].splitlines()[0]


@pytest.fixture
def thrice(spark, tmp_path):
    """Folders of the tables with a fifth of the orders, and with three copies of these that differ in number and quantity alone."""
    part, orders, lines = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("part", "orders", "lineitem"))
    more = F.explode(F.expr("sequence(0, 2)")).alias("k")  # 138600 is a multiple of all that the statements divide a number by
    for folder, copies in (("once", "k = 0"), ("many", "true")):
        part.write.parquet(f"{tmp_path}/{folder}/part.parquet")
        orders.where("o_orderkey % 5 = 0").select("*", more).where(copies).withColumn("o_orderkey", F.expr("o_orderkey + k * 138600L")).drop("k").write.parquet(f"{tmp_path}/{folder}/orders.parquet")
        lines.where("l_orderkey % 5 = 0").select("*", more).where(copies).withColumns({"l_orderkey": F.expr("l_orderkey + k * 138600L"), "l_quantity": F.expr("l_quantity + k")}).drop("k").write.parquet(f"{tmp_path}/{folder}/lineitem.parquet")
    return tmp_path


def by_sql(folder, name):
    db = duckdb.connect()
    for t in ("part", "orders", "lineitem"):
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return sorted(db.execute(queries.ORACLES[name]).fetchall())


def told_once(spark, monkeypatch, folder, name, module, step):
    """Rows of the query over three copies are as the SQL's, and what ``step`` works on doesn't grow with them."""
    kept, own = {}, getattr(module, step)
    for at in ("once", "many"):
        monkeypatch.setattr(module, step, lambda df, *more, at=at, **named: own(kept.update({at: df}) or df, *more, **named))
        found = sorted(map(tuple, queries.QUERIES[name](spark, f"{folder}/{at}").collect()))
        monkeypatch.setattr(module, step, own)
        assert found == by_sql(f"{folder}/{at}", name) != []
    assert kept["many"].count() == kept["once"].count() > 0


def test_confidence_is_told_once(spark, thrice, monkeypatch):
    told_once(spark, monkeypatch, thrice, "confidence_margin", score, "confidence")


def test_request_gaps_are_told_once(spark, thrice, monkeypatch):
    told_once(spark, monkeypatch, thrice, "request_gaps", decide, "request_gaps")


@pytest.mark.parametrize("name", ["lineage", "resolution_steps"])
def test_steps_are_told_once(spark, thrice, monkeypatch, name):
    from attestry import queries_ledger  # noqa: F401  registers lineage

    told_once(spark, monkeypatch, thrice, name, decide, "set_out")


def test_digests_do_not_move_with_rows(spark):
    """Rows are digested where they have moved to, so that no shuffle holds the digests; a record goes to few tasks of its material class."""
    plan = retrieve.classes(domain.catalog(spark, SF))._jdf.queryExecution().executedPlan().toString()
    at = plan.index("Exchange")
    assert "sha2" in plan[:at] and "sha2" not in plan[at:] and proxy.PARTS <= 4
