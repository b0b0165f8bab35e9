"""Shared plumbing of the training-data operators: the shared scratch folder, Arrow batch limits and word splitting.

Words everywhere in this subpackage are maximal runs of ``[^\\x20\\x09-\\x0D]``; that is exactly what
``bytes.split()`` yields on UTF-8, and ``bytes.lower()`` folds A-Z only.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch hands to a Python worker at most (a single longer row still passes whole).
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: A bit set has no more than 2**MOST_BITS bits (8 MB), whatever the data.
LEAST_BITS, MOST_BITS = 16, 26
#: Spark's setting that removes an execution's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that very long texts do not add up in a Python worker. A session that asks for less keeps its own limits."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        own = str(spark.conf.get(key))
        if not own.isdecimal() or not 0 < int(own) <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where the session names none (local mode, tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "attestry-shared")
    return found.rstrip("/")


_SCOPES: list[list[Scratch]] = []


@contextmanager
def cleared():
    """Scratch folders that are opened within go at the end: whatever is still needed must be written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for own in _SCOPES.pop():
            own.drop()


class Scratch:
    """Tables in the shared folder that cut lineage: a lost executor costs a re-read, never a recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if _SCOPES:
            _SCOPES[-1].append(self)

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """``df`` as a table; the shuffle files behind it go at once, as nothing reads them again."""
        path, conf = f"{self.root}/{name}", self.spark.conf
        before = conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", codec).mode("overwrite").parquet(path)
        finally:
            conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables (all of them without a name), through Spark's own file system layer."""
        jvm = self.spark.sparkContext._jvm
        for name in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class BitSet:
    """Which longs may be in a set: no false negatives. Its size is bounded; a full one lets everything through."""

    def __init__(self, words: np.ndarray, probes: int = 1):
        self.words, self.mask, self.probes = words, np.int64(len(words) * 64 - 1), probes

    def _holds(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def test(self, values: np.ndarray) -> np.ndarray:
        found = self._holds(values & self.mask)
        for k in range(1, self.probes):
            left = np.flatnonzero(found)
            found[left] = self._holds(values[left] + k * (values[left] >> 32 | 1) & self.mask)
        return found


def bit_set(values: DataFrame, each: int = 16, probes: int = 1, most_bits: int = MOST_BITS):
    """A broadcast ``BitSet`` of one column of (hashed) longs, ``each`` bits a value up to 2**``most_bits``, of which ``probes`` are set and asked for.

    Bits are united in the executors; 2**(``most_bits`` - 6) longs at most reach the driver.
    """
    spark, column = values.sparkSession, values.columns[0]
    bits = min(most_bits, max(LEAST_BITS, (each * values.count()).bit_length()))
    mask = F.lit((1 << bits) - 1)
    low = F.col(column).bitwiseAND(mask)
    if probes > 1:
        step = F.shiftright(F.col(column), 32).bitwiseOR(F.lit(1).cast("long"))
        values = values.select(F.explode(F.array(low, *((low + k * step).bitwiseAND(mask) for k in range(1, probes)))).alias("at"))
    else:
        values = values.select(low.alias("at"))
    words = values.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63L as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(BitSet(out, probes))


def without(docs: DataFrame, key: Column, bad: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``bad`` (one column of the same type; nulls within equal each other).

    Only rows whose key a bit set can't rule out are shuffled for the exact anti-join; the rest of the table isn't moved.
    """
    bits = bit_set(bad.select(F.xxhash64(bad.columns[0])))

    maybe = F.pandas_udf(lambda h: type(h)(bits.value.test(h.to_numpy())), "boolean")  # pandas is imported by the workers that need it alone
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"))
    hit = maybe(F.xxhash64("key"))
    inside = rows.where(hit).join(bad.select(F.col(bad.columns[0]).alias("key")), "key", "left_anti")
    return rows.where(~hit).select("row.*").unionByName(inside.select("row.*"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str):
    """A text column as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
