"""The queries opN_<name> and their SQL: thin layers over the operators of this subpackage, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import decontaminate, fill_in_middle, jaccard_join, language_id, line_dedup, mixing, packing, quality, spelling, telephony, token_planes, unigram_count, warc
from attestry.llm.common import Scratch, table

#: One word in the sense of the word-counting operators.
WORD = "[^\\x20\\x09-\\x0D]+"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", held.alias("held_out"), "text")
    labels = table(spark, sf_dir, "labels").where(~held).select("doc_id", F.col("quality").alias("label"))
    return quality.classify(docs, labels)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    learn = docs.where(~held).select("text", "lang")
    return language_id.predict(docs.select("doc_id", held.alias("held_out"), "text"), language_id.train(learn)).select("doc_id", "held_out", "lang_pred", "score")


def op3_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes.token_output(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
with own as (
  select page_id, coalesce(html, '') as payload, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), stored as (
  select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) else page_id end as stored from own
)
select page_id, payload_bytes, payload_digest, case when stored = page_id then 'response' else 'revisit' end as record_type,
  case when stored <> page_id then stored end as refers_to
from stored
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.when(F.col("n_dropped") == 0, F.coalesce("text", F.lit(""))).otherwise(line_dedup.apply_bitmaps("text", "keep_runs"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = """
with lines as (
  select d.doc_id, u.place, u.line, translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from documents d, unnest(string_split(coalesce(d.text, ''), chr(10))) with ordinality as u(line, place)
), common as (
  select key, max(doc_id) as keeper from lines where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), marked as (
  select l.*, c.key is not null and l.doc_id < c.keeper as dropped from lines l left join common c on l.key = c.key
)
select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by place) filter (not dropped), '')) as kept_sha256
from marked group by doc_id
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.array("source").alias("members"))
    docs = Scratch(spark, "mixing").write(docs, "sizes")
    found = mixing.mix(docs, "doc_id", "size", "members")
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.jaccard_components(docs, size=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "coverage", "tiles")


def op9_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.media_round_trip(table(spark, sf_dir, "documents"))


def op10_unigram_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_count.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle.restored(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP12_SQL = """
with own as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as tokens, sha256('1:' || doc_id) as digest from documents
), drawn as (
  select *, len(tokens) as n, cast('0x' || digest[1:8] as bigint) as h1, cast('0x' || digest[9:16] as bigint) as h2,
    cast('0x' || digest[17:24] as bigint) as h3, cast('0x' || digest[25:32] as bigint) as h4
  from own
), placed as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from drawn
), cut as (
  select *, array_to_string(tokens[1:a], '') as prefix, array_to_string(tokens[a + 1:b], '') as middle, array_to_string(tokens[b + 1:], '') as suffix from placed
)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from cut
"""


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


#: Near words meet by what is left of both when one place is taken out: the same place for a replacement, any place against the whole for the rest.
OP13_SQL = """
with recursive steps as (
  select list(c order by i) as crc from (select i, list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end)) as c from range(256) t(i))
), runs as (
  select doc_id, run, count(*) as n from (
    select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents
  ) where length(run) >= 6 group by all
), summed as (
  select run, n, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'), lambda b: cast('0x' || b as bigint))),
    lambda a, b: xor(crc[(xor(a, b) & 255) + 1], a >> 8))) as h
  from runs, steps
), vocabulary as (
  select word, cast(sum(n) as bigint) as n
  from (select case when h % 199 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end as word, n from summed)
  where length(word) >= 6 group by word having sum(n) >= 5
), shorter as (
  select word, n, i, word[:i - 1] || word[i + 1:] as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from vocabulary)
), one_less as (
  select distinct s.word as longer, s.n as longer_n, v.word as shorter, v.n as shorter_n from shorter s join vocabulary v on s.rest = v.word
), near as (
  select a.word, a.n, b.word as near, b.n as near_n from shorter a join shorter b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union all select longer, longer_n, shorter, shorter_n from one_less
  union all select shorter, shorter_n, longer, longer_n from one_less
), ranked as (
  select word, n, near, near_n, count(*) over (partition by word) as n_near, row_number() over (partition by word order by near_n desc, near) as place from near
), best as (
  select word, n_near, case when near_n >= 5 * n then near end as form, case when near_n >= 5 * n then near_n end as form_n from ranked where place = 1
), walk as (
  select word, word as at from vocabulary
  union all select w.word, b.form from walk w join best b on b.word = w.at where b.form is not null
)
select v.word, b.form, w.at as root, v.n, coalesce(b.n_near, 0) as n_near, b.form_n
from vocabulary v left join best b on b.word = v.word join walk w on w.word = v.word left join best e on e.word = w.at
where e.form is null
"""

QUERIES = {
    f.__name__: f
    for f in (op1_quality, op2_language_id, op3_token_planes, op4_warc, op5_line_dedup, op6_mixing, op7_jaccard_join, op8_decontaminate, op9_telephony, op10_unigram_count, op11_packing, op12_fill_in_middle, op13_spelling)
}
ORACLES: dict[str, str] = {"op4_warc": OP4_SQL, "op5_line_dedup": OP5_SQL, "op12_fill_in_middle": OP12_SQL, "op13_spelling": OP13_SQL}
