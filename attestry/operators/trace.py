"""Append-only traces: hash chains, verification, prefixes, latest entries, differences, fingerprints."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GENESIS = "0" * 64


def entry_text(*columns: str) -> Column:
    """What an entry's hash covers besides its predecessor: columns in a fixed order, nulls as empty."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def _ordered(events: DataFrame, key: Column, order: list[str], **more: Column) -> DataFrame:
    """(key, the order's columns, more) with the rows of a key together and in order, as a stream for one pass."""
    return events.select(key.alias("key"), *order, *[c.alias(k) for k, c in more.items()]).repartition("key").sortWithinPartitions("key", *order)


def chain(events: DataFrame, key: str, order: list[str], content: Column) -> DataFrame:
    """Every entry with its revision, previous hash and hash. Sorted partitions are streamed once; only the last hash of the key at hand is carried on."""
    rows = _ordered(events, F.col(key), order, content=content)
    at = len(rows.columns) - 1

    def link(batches):
        held, revision, last = object(), 0, GENESIS
        for b in batches:
            out: tuple[list, list, list] = [], [], []
            for k, text in zip(b.column(0).to_pylist(), b.column(at).to_pylist(), strict=True):
                if k != held:
                    held, revision, last = k, 0, GENESIS
                revision += 1
                own = hashlib.sha256(f"{last}|{text}".encode()).hexdigest()
                for into, x in zip(out, (revision, last, own), strict=True):
                    into.append(x)
                last = own
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out[0], pa.int32()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=[*b.schema.names, "revision", "previous_hash", "entry_hash"])

    kinds = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "revision int, previous_hash string, entry_hash string"])
    return rows.mapInArrow(link, kinds).select("key", "revision", *order, "content", "previous_hash", "entry_hash")


def verify(entries: DataFrame, ties: list[str] = ()) -> DataFrame:
    """Per key: entries, whether revisions have no gap, every entry names its predecessor, and its hash covers its content. ``ties`` order equal revisions."""
    w = Window.partitionBy("key").orderBy("revision", *ties)
    checked = entries.withColumns({"place": F.row_number().over(w), "before": F.coalesce(F.lag("entry_hash").over(w), F.lit(GENESIS))})
    good = F.sha2(F.concat(F.col("previous_hash"), F.lit("|"), F.col("content")), 256) == F.col("entry_hash")
    return checked.groupBy("key").agg(F.count("*").alias("entries"), F.bool_and(F.col("place") == F.col("revision")).alias("gapless"), F.bool_and(F.col("before") == F.col("previous_hash")).alias("linked"), F.bool_and(good).alias("hashed"))


def prefix_digest(events: DataFrame, key: str, order: list[str], digest: str) -> DataFrame:
    """Per entry: SHA-256 of all digests of its key up to and including it, joined by colons; a running digest, so that no prefix is written out."""
    rows = _ordered(events, F.col(key), order, digest=F.col(digest))
    at = len(rows.columns) - 1

    def run(batches):
        held, digests = object(), None
        for b in batches:
            out = []
            for k, d in zip(b.column(0).to_pylist(), b.column(at).to_pylist(), strict=True):
                if k != held:
                    held, digests = k, hashlib.sha256(d.encode())
                else:
                    digests.update(b":" + d.encode())
                out.append(digests.copy().hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "prefix"])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "prefix string"])).withColumnRenamed("key", key)


def latest(events: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value), F.count("*").alias("entries"))


def difference(left: DataFrame, right: DataFrame, key: str, item: str) -> DataFrame:
    """Per key: items only in the right (added) and only in the left (removed)."""
    a = left.groupBy(key).agg(F.collect_set(item).alias("a"))
    b = right.groupBy(key).agg(F.collect_set(item).alias("b"))
    none = F.array().cast(dict(a.dtypes)["a"])
    both = a.join(b, key, "full_outer").withColumns({"a": F.coalesce("a", none), "b": F.coalesce("b", none)})
    return both.select(key, F.array_join(F.array_sort(F.array_except("b", "a")), ",").alias("added"), F.array_join(F.array_sort(F.array_except("a", "b")), ",").alias("removed"))


def fingerprint(*columns: str) -> Column:
    return F.sha2(entry_text(*columns), 256)


#: Lengths of the prefixes by which row digests are brought together, level by level: no list grows with the table until it has 2**40 rows.
LEVELS = (8, 6, 4, 2, 0)


def table_digest(df: DataFrame, row: Column) -> DataFrame:
    """One digest of a table, independent of row order: a tree over the rows' digests, each node the digest of its children in order."""
    own = df.select(row.alias("d"), row.alias("key"), F.lit(1).cast("long").alias("n"))
    for k in LEVELS:
        per = own.groupBy(*[F.substring("key", 1, k).alias("key")] * (k > 0)).agg(F.array_sort(F.collect_list(F.struct("key", "d"))).alias("below"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        own = per.select(*["key"] * (k > 0), F.sha2(F.array_join(F.transform("below", lambda x: x["d"]), ":"), 256).alias("d"), "n")
    return own.select(F.col("d").alias("digest"), F.col("n").alias("rows"))


def forward_fill(df: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(f"{column}_filled", F.last(column, ignorenulls=True).over(w))


def segments(df: DataFrame, keys: list[str], order: list[str], start: Column) -> DataFrame:
    """Running segment number: a new segment begins wherever ``start`` holds."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("segment", F.sum(F.when(start, 1).otherwise(0)).over(w))
