"""Deduplication of lines over a corpus, in DataFrame operations only.

Each long enough line becomes a 128-bit hash with its document and place. The hashes are range-partitioned (together with a slice of
the document ids, so that one very common line spreads over many tasks), sorted within partitions by document and position, and
streamed once: the first row of every (hash, document) run counts. What a slice has counted is summed by hash, and hashes
found in enough documents name the one document that keeps its lines. Documents get a compressed keep bitmap (its runs of kept
lines) instead of text; ``apply_bitmaps`` turns texts and bitmaps into the remaining text.

Defined cases: null and empty texts are one empty line, which stays; lines of a row without ``doc_id`` stay and count for nothing;
rows that share a ``doc_id`` count as one document for the threshold and each keeps a bitmap of its own text; ties can't occur, since the
keeping document is the largest id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry.llm.common import Scratch, partitions

MIN_CHARS, MIN_DOCS = 40, 5
#: Slices of document ids that one hash is spread over.
SLICES = 64
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines_of(text: str | Column) -> Column:
    return F.split(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """Stripped of ASCII blanks at both ends, A-Z lowered. ``lower`` does that for pure ASCII; ``translate`` for the rest."""
    bare = F.trim(line, F.lit(_BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def keep_bitmaps(scratch: Scratch, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per row of ``docs`` with a dropped line: doc_id, text_hash and ``dropped`` (sorted positions)."""
    hashes = (
        docs.where("doc_id is not null and text is not null")
        .select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(lines_of("text")).alias("place", "line"))
        .where(F.char_length("line") >= min_chars)
        .select("doc_id", "text_hash", "place", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(F.unhex(F.md5(F.col("key").cast("binary"))).alias("h"), "doc_id", "text_hash", "place")
    )
    hashes = scratch.write(hashes, "hashes")
    sliced = hashes.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("int"))
    ordered = sliced.repartitionByRange(partitions(docs.sparkSession), "h", "slice").sortWithinPartitions("h", "slice", F.desc("doc_id"), "place")
    stream = Window.partitionBy("h", "slice").orderBy(F.desc("doc_id"), "place")
    first = ordered.select("h", "slice", "doc_id", F.lag("doc_id").over(stream).alias("before")).where("before is null or before <> doc_id")
    common = first.groupBy("h", "slice").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).groupBy("h").agg(F.sum("n").alias("n"), F.max("last").alias("keeper")).where(F.col("n") >= min_docs)
    common = scratch.write(common.select("h", "keeper"), "common")
    dropped = hashes.join(common.hint("merge"), "h").where(F.col("doc_id") < F.col("keeper"))
    return scratch.write(dropped.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("place")).alias("dropped")), "dropped")


def keep_runs(n_lines: Column, dropped: Column) -> Column:
    """The compressed bitmap: runs (from, length) of kept lines between the sorted dropped positions."""
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(dropped, i - 1) + 1)
    end = lambda i: F.when(i == F.size(dropped), n_lines).otherwise(F.get(dropped, i))
    runs = F.transform(F.sequence(F.lit(0), F.size(dropped)), lambda i: F.struct(start(i).alias("from"), (end(i) - start(i)).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text, n_lines, n_dropped, keep_runs for every row of ``docs`` (doc_id, text)."""
    dropped = keep_bitmaps(Scratch(docs.sparkSession, "line_dedup"), docs.select("doc_id", "text"), min_chars, min_docs)
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.size(lines_of("text")).alias("n_lines"))
    both = own.join(dropped.hint("merge"), ["doc_id", "text_hash"], "left")  # one plan at every size: what is dropped grows with the corpus
    none = F.array().cast("array<int>")
    both = both.select("doc_id", "text", "n_lines", F.coalesce("dropped", none).alias("dropped"))
    return both.select("doc_id", "text", F.col("n_lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), keep_runs(F.col("n_lines"), F.col("dropped")).alias("keep_runs"))


def apply_bitmaps(text: str, runs: str) -> Column:
    """The kept lines of a text, joined by newlines."""
    lines = lines_of(text)
    return F.array_join(F.flatten(F.transform(F.col(runs), lambda r: F.slice(lines, r["from"] + 1, r["length"]))), "\n")
