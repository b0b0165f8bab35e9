"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items become words (letters, digits and underscores, case folded). Seeds are hashes of ``MIN_MATCH`` words in a row
(all words of a shorter item). A bit set of bounded size of the benchmark's seeds keeps all other document seeds from being shuffled;
what passes joins the benchmark's seeds, so the benchmark may be of any size. Seeds travel without texts; a text moves once, if it has a candidate. An item's most frequent seeds are left out of that join as far
as a document that covers the item must have a rarer one too, so a phrase of every document doesn't pair every document with every item.
Pairs whose number of shared seeds could reach the threshold are tiled: running Karp-Rabin looks for matches of a length that shrinks as it
goes, marks the longest first, and no word belongs to two tiles. An item counts as found if its tiles cover ``COVERAGE`` of its words, in
whatever order they stand in the document.

Defined cases: null and empty texts, and items without words, match nothing; an empty benchmark flags nothing; rows that share a ``doc_id``
are told apart by their text; a null ``doc_id`` or ``item_id`` is kept as it is; equal longest matches are taken in order of the item's, then the document's
position; repeated rows of either table don't multiply results; other columns are ignored.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry.llm.common import Scratch, bit_set, bounded_batches, partitions, without

MIN_MATCH, COVERAGE, FIRST_LENGTH = 5, 0.7, 20
#: Bits a value of the bit set of seeds, how many of them are set, and 2**bits at most: one seed in 70,000 passes by chance, up to 20 million seeds.
SEED_BITS, SEED_PROBES, SEED_MOST_BITS = 24, 12, 29
_WORD = re.compile(rb"[0-9a-z_\x80-\xff]+")
_MARKS = re.compile("[\x80-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf -⁯　-〿！-／]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    if not text:
        return []
    return _WORD.findall((text if text.isascii() else _MARKS.sub(" ", text)).lower().encode("utf-8", "surrogatepass"))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse (modulo 2**64), n at least."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            _POWERS[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n - 1, base, np.uint64)]))
    return _POWERS


class Running:
    """Karp-Rabin fingerprints of all runs of any length from one pass: sums of codes times powers of the base (modulo 2**64), shifted back."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        power = _powers(self.n + 1)[0]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power[: self.n])])

    def hashes(self, length: int) -> np.ndarray:
        n = self.n - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = (self.sums[length:] - self.sums[:n]) * _powers(self.n + 1)[1][:n]
        out ^= out >> np.uint64(31)
        return out * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(length)


def codes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.uint64, len(words)) + np.uint64(1)


# ---- tiling ---------------------------------------------------------------------------------------------------------------
def _matches(pattern: np.ndarray, text: np.ndarray, runs: tuple[Running, Running], free_p: np.ndarray, free_t: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Maximal matches of at least ``length`` unmarked words: (length, pattern place, text place)."""
    def starts(codes: np.ndarray, free: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(free)])
        return np.flatnonzero(run[length:] - run[:-length] == length)

    if length > len(pattern) or length > len(text):
        return []
    at_p, at_t = starts(pattern, free_p), starts(text, free_t)
    own = runs[0].hashes(length)[at_p]
    table: dict[int, list[int]] = {}
    for h, i in zip(own.tolist(), at_p.tolist(), strict=True):
        table.setdefault(h, []).append(i)
    hashes = runs[1].hashes(length)[at_t]
    hit = np.isin(hashes, own)
    found, seen = [], set()
    for h, j in zip(hashes[hit].tolist(), at_t[hit].tolist(), strict=True):
        for i in table[h]:
            if (i - 1, j - 1) in seen:  # inside a longer match
                seen.add((i, j))
                continue
            k = 0
            while i + k < len(pattern) and j + k < len(text) and free_p[i + k] and free_t[j + k] and pattern[i + k] == text[j + k]:
                k += 1
            if k >= length:
                seen.add((i, j))
                found.append((k, i, j))
    return found


def tile(item: list[bytes], doc: list[bytes], min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (item place, document place, length) of a greedy string tiling."""
    min_match = min(min_match, len(item))
    if not min_match:
        return []
    ids = {w: i + 1 for i, w in enumerate(dict.fromkeys(item))}
    pattern = np.array([ids[w] for w in item], np.uint64)
    text = np.array([ids.get(w, 0) for w in doc], np.uint64)
    free_p, free_t = np.ones(len(item), bool), text > 0
    tiles, length, runs = [], max(min_match, min(FIRST_LENGTH, len(item))), (Running(pattern), Running(text))
    while True:
        found = _matches(pattern, text, runs, free_p, free_t, length)
        longest = max(found, default=(0,))[0]
        if longest > 2 * length:
            length = longest
            continue
        again = False
        for k, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if free_p[i : i + k].all() and free_t[j : j + k].all():
                free_p[i : i + k] = free_t[j : j + k] = False
                tiles.append((i, j, k))
            else:
                again = True  # what is left of it may still hold a match of this length
        if again:
            continue
        if length == min_match:
            return tiles
        length = max(min_match, length // 2)


# ---- operator -------------------------------------------------------------------------------------------------------------
def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=names)


def items_of(benchmark: DataFrame) -> DataFrame:
    """Distinct items: item_id, item_hash, item."""
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item")).distinct().withColumn("item_hash", F.xxhash64("item"))


def item_seeds(items: DataFrame, min_match: int) -> DataFrame:
    """Of every item its number of words, and its seeds with the number of places of each; the text itself stays behind."""
    def seeds(batches):
        for b in batches:
            for item_id, item_hash, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = words_of(text)
                if words:
                    size = min(min_match, len(words))
                    h, times = np.unique(Running(codes_of(words)).hashes(size), return_counts=True)
                    fixed = [pa.array(np.full(len(h), v, np.int32)) for v in (len(words), size)]
                    yield pa.RecordBatch.from_arrays([pa.array([item_id] * len(h), pa.int64()), pa.array(np.full(len(h), item_hash)), *fixed, pa.array(h.view(np.int64)), pa.array(times.astype(np.int32))], names=["item_id", "item_hash", "n_words", "size", "seed", "times"])

    return items.select("item_id", "item_hash", "item").mapInArrow(seeds, "item_id long, item_hash long, n_words int, size int, seed long, times int")


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, text_hash, item_id, coverage and tiles of every document and item that it contains."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "decontaminate")
    items = items_of(benchmark)
    seeds = scratch.write(item_seeds(items, min_match), "seeds")
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())  # min_match values at most
    bits = bit_set(seeds.select("seed").distinct(), SEED_BITS, SEED_PROBES, SEED_MOST_BITS)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").withColumn("text_hash", F.xxhash64("text"))

    def probe(batches):
        for b in batches:
            rows = []
            for doc, text_hash, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                runs = Running(codes_of(words_of(text)))
                hit = [h[bits.value.test(h)] for h in (runs.hashes(k).view(np.int64) for k in sizes)]
                if any(map(len, hit)):
                    rows.append((doc, text_hash, np.unique(np.concatenate(hit))))
            yield _batch(rows, [pa.int64(), pa.int64(), pa.list_(pa.int64())], ["doc_id", "text_hash", "seeds"])

    hits = scratch.write(docs.select("doc_id", "text_hash", "text").mapInArrow(probe, "doc_id long, text_hash long, seeds array<long>"), "hits")
    own = hits.select("doc_id", "text_hash", F.explode("seeds").alias("seed"))

    # A document that covers an item has seeds of it in this many places; so it has one of those that are left without the most frequent few.
    often = own.groupBy("seed").agg(F.count("*").alias("often"))
    least = F.ceil(coverage * F.col("n_words") / F.col("size") - 1e-9)
    upto = F.sum("times").over(Window.partitionBy("item_id", "item_hash").orderBy(F.desc("often"), "seed").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rare = seeds.join(often, "seed").withColumn("upto", upto).where(F.col("upto") >= least)
    pairs = own.join(rare.select("seed", "item_id", "item_hash"), "seed").select("doc_id", "text_hash", "item_id", "item_hash").distinct()
    pairs = scratch.write(pairs, "pairs")

    # One row with the text of each document that has a candidate, then one an item of it: no text is copied for every pair.
    wanted = scratch.write(pairs.select("doc_id", "text_hash").distinct(), "wanted")
    key = F.xxhash64("doc_id", "text_hash")
    near = bit_set(wanted.select(key), SEED_BITS, SEED_PROBES, SEED_MOST_BITS)
    maybe = F.pandas_udf(lambda h: type(h)(near.value.test(h.to_numpy())), "boolean")
    same = lambda a, b, k, digest: F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) & (F.col(f"{a}.{digest}") == F.col(f"{b}.{digest}"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    texts = docs.where(maybe(key)).alias("d").join(wanted.alias("w"), same("d", "w", "doc_id", "text_hash"), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    texts = texts.select("doc_id", "text_hash", none("long", "item_id"), none("string", "item"), "text")
    asked = pairs.alias("p").join(items.alias("i"), same("p", "i", "item_id", "item_hash")).select("p.doc_id", "p.text_hash", "p.item_id", "i.item", none("string", "text"))
    rows = texts.unionByName(asked).withColumn("of_item", F.col("item").isNotNull()).repartition(partitions(spark), "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "of_item")

    def cover(batches):
        doc: list[bytes] = []
        seen: dict[int, np.ndarray] = {}  # the document's runs of words, by size
        for b in batches:
            out = []
            for doc_id, text_hash, item_id, item, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if item is None:
                    doc, seen = words_of(text), {}
                    continue
                words = words_of(item)
                size = min(min_match, len(words))
                if size not in seen:
                    seen[size] = np.unique(Running(codes_of(doc)).hashes(size))
                # overlapping seeds in tiles of k words: k - size + 1, so at least a share of 1 / size of the words
                if np.isin(Running(codes_of(words)).hashes(size), seen[size]).sum() * size < coverage * len(words):
                    continue
                tiles = tile(words, doc, min_match)
                share = sum(t[2] for t in tiles) / len(words)
                if share >= coverage:
                    out.append((doc_id, text_hash, item_id, round(share, 6), len(tiles)))
            yield _batch(out, [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32()], ["doc_id", "text_hash", "item_id", "coverage", "tiles"])

    found = rows.select("doc_id", "text_hash", "item_id", "item", "text").mapInArrow(cover, "doc_id long, text_hash long, item_id long, coverage double, tiles int")
    leaks = scratch.write(found.distinct(), "leaks")
    scratch.drop("hits", "pairs", "wanted", "seeds")
    return leaks


def decontaminate(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``leaks`` names."""
    bad = leaks.select(F.struct("doc_id", "text_hash").alias("key")).distinct()
    return without(docs, F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")), bad)
