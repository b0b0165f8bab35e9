"""A training-corpus pipeline over ``documents``: five stages, each calling one operator of ``attestry.llm``.

Every stage takes all rows that its predecessor kept, as (spark, docs, sf_dir), and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's rows as Parquet to the shared folder and reads them back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import decontaminate, jaccard_join, language_id, mixing, token_planes
from attestry.llm.common import Scratch, cleared, table, without
from attestry.llm.queries import WORD, tokenizer_path

#: Word n-grams and percentage of the union that near duplicates share.
NEAR_SIZE, NEAR_PERCENT = 5, 80
END_ID = 2


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Profiles of the rows that name their language; documents go whose score with every profile is too low for a text of their length."""
    scratch = Scratch(spark, "language_id")
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*rest).alias("row"), "text", "lang")
    found = scratch.write(language_id.predict(rows, language_id.train(docs.select("text", "lang"))), "found", "snappy")
    kept = found.where(language_id.recognizable(language_id.thresholds(found)))
    return kept.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row with the smallest doc_id stays (then the smallest text hash, then the smallest row); rows without doc_id stay."""
    scratch = Scratch(spark, "near_duplicates")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = scratch.write(jaccard_join.jaccard_components(rows, NEAR_SIZE, NEAR_PERCENT, keep_group=True), "components")
    found = found.where("doc_id is not null and group_id is not null").withColumn("key", F.struct("doc_id", "text_hash"))
    per = found.groupBy("group_id").agg(F.min("key").alias("best"), F.count("*").alias("n")).where("n > 1")
    per = scratch.write(per, "groups")
    marked = found.select("group_id", "key").join(per, "group_id")
    lost = scratch.write(marked.where("key <> best").select("key").distinct(), "lost")
    # the best row's doc_id and text may stand in several rows; one of them stays
    again = scratch.write(marked.where("key = best").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "again")
    key = F.struct(F.col("doc_id"), F.xxhash64("text").alias("text_hash"))
    once = without(without(docs, key, lost), key, again)
    if again.isEmpty():
        return once
    repeated = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key")).join(again, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return once.unionByName(repeated.select("row.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.decontaminate(docs, decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", size.alias("size"), F.array("source").alias("members"))
    mixed = mixing.mix(rows, "doc_id", "size", "members")
    return mixed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all that is left, in ascending doc_id order, read back from their files."""
    return token_planes.token_output(docs, tokenizer_path("word_bpe_49k.json"), END_ID)


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_output", token_stage),
]
#: Neither the profiles, nor the mix, nor the tokenizer can be put in SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's rows are written before its scratch tables and its predecessor's rows go."""
    scratch, before = Scratch(spark, "pipeline"), None
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with cleared():
            docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}", "snappy")
        if before:
            scratch.drop(before)
        before = f"{k}-{name}"
    return docs
