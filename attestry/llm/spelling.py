"""Spelling variants: words of a corpus that differ by one inserted, deleted or replaced code point, by full neighbourhood generation.

All distinct deletions, replacements and insertions of every word over the observed alphabet are candidates; those that equal a word of
the vocabulary are its near words. A candidate never becomes a string: prefix and suffix hashes of the word give the hash of every
candidate in constant time, so that even a word of millions of characters is done block by block. A bit set of the vocabulary's hashes
drops nearly all candidates where they are made; what is left (hash, kind of edit, place, character) is hash-joined to the vocabulary,
and the edit, carried out on the word, must give exactly the word that was found. No distance is computed.

A word's form is its near word with the most occurrences if it has ``RATIO`` times the word's own or more, so forms that lead to forms
grow by that factor at every step: doubling the pointers a few times, known from the largest count, reaches every root.

Defined cases: null and empty texts have no words; a null ``doc_id`` is written as an empty number where a run is hashed; repeated rows
count anew; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import Scratch, bit_set, bounded_batches, partitions

LETTER = "[A-Za-z\\u00C0-\\u00FF]"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One run in so many, by its document and itself, loses one code point: planted misspellings.
SLIP_IN = 199
#: Candidates whose hashes are worked out at once.
BLOCK = 1 << 18
#: The bit set of the vocabulary has no more than 2**MOST_BITS bits (64 MB), enough for 30 million words.
MOST_BITS = 29
DELETION, REPLACEMENT, INSERTION = 0, 1, 2


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slip_in: int = SLIP_IN) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased, slips applied, of ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences or more."""
    # a slip only shortens, so shorter runs are left out at once
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{LETTER}{{{LEAST_LENGTH},}}"), F.lit(0))
    run = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    run = run.withColumn("run", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    word = F.when(F.col("h") % slip_in == 0, slipped).otherwise(F.col("run"))
    found = run.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---- hashes of neighbourhoods -----------------------------------------------------------------------------------------------
_BASE = 0x9E3779B97F4A7C15  # odd, hence invertible
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(13).integers(1, 1 << 63, 256, np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of words of one length, rows of Latin-1 codes: the sum of value(code) * base ** place."""
    return (_VALUES[codes] * _powers(_BASE, codes.shape[1])).sum(axis=1, dtype=np.uint64)


def neighbourhood(codes: np.ndarray, alphabet: np.ndarray):
    """All distinct edits of words of one length: (row, kind, place, code, hash) arrays, ``BLOCK`` or so candidates at a time.

    Of equal characters in a row only the first is deleted, none is replaced by itself, and none is inserted before its like: these are
    the edits that would give a string twice.
    """
    rows, length = codes.shape
    own, up = _VALUES[alphabet], _powers(_BASE, length + 1)
    down = np.uint64(_INVERSE)
    wide = max(1, BLOCK // max(1, rows * len(alphabet)))  # places a block
    ahead = np.zeros(rows, np.uint64)  # hash of what stands before the block
    behind = hashes(codes)  # hash of the block and what follows, at its own places
    for at in range(0, length + 1, wide):
        block = codes[:, at : at + wide]
        here = np.arange(at, at + block.shape[1])
        values = _VALUES[block] * up[here]
        run = np.cumsum(values, axis=1, dtype=np.uint64)
        left = ahead[:, None] + run - values  # before each place
        right = behind[:, None] - run  # after each place
        last = run[:, -1] if block.shape[1] else np.uint64(0)
        first = np.ones(block.shape, bool)
        first[:, 1:] = block[:, 1:] != block[:, :-1]
        if at and block.shape[1]:
            first[:, 0] = block[:, 0] != codes[:, at - 1]
        r, p = np.nonzero(first)
        yield r, DELETION, here[p], np.zeros(len(r), np.int64), (left + right * down)[r, p]
        put = up[here][None, :, None] * own  # place by character
        other = block[:, :, None] != alphabet
        r, p, c = np.nonzero(other)
        yield r, REPLACEMENT, here[p], alphabet[c], ((left + right)[:, :, None] + put)[r, p, c]
        yield r, INSERTION, here[p], alphabet[c], ((left + (right + values) * np.uint64(_BASE))[:, :, None] + put)[r, p, c]
        ahead, behind = ahead + last, behind - last
    r, c = np.divmod(np.arange(rows * len(alphabet)), max(1, len(alphabet)))
    yield r, INSERTION, np.full(len(r), length), alphabet[c], ahead[r] + own[c] * up[length]


def _by_length(batch: list[str]):
    """Words of a batch as rows of Latin-1 codes, by length: (numbers in the batch, codes)."""
    raw = [w.encode("latin-1") for w in batch]
    lengths = np.array([len(x) for x in raw], np.int64)
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        yield at, np.frombuffer(b"".join(raw[i] for i in at.tolist()), np.uint8).reshape(-1, length)


def _hashed(batches):
    for b in batches:
        found = np.zeros(b.num_rows, np.uint64)
        for at, codes in _by_length(b.column(0).to_pylist()):
            found[at] = hashes(codes)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found.view(np.int64))], names=["word", "n", "hash"])


def near_words(scratch: Scratch, vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n) for all pairs of ``vocabulary`` (word, n; words of Latin-1 characters, each once) one edit apart."""
    spark = vocabulary.sparkSession
    bounded_batches(spark)
    # dealt anew: making candidates is the work, and the vocabulary comes in few files
    known = scratch.write(vocabulary.mapInArrow(_hashed, "word string, n long, hash long").repartition(partitions(spark), "hash"), "vocabulary")
    letters = known.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()  # of one code page: 256 at most
    alphabet = np.array(sorted(ord(r["c"]) for r in letters), np.int64)
    bits = bit_set(known.select("hash"), probes=4, most_bits=MOST_BITS)

    def candidates(batches):
        test = bits.value.test
        for b in batches:
            own = b.column(1).to_numpy()
            for at, codes in _by_length(b.column(0).to_pylist()):
                step = max(1, BLOCK // (codes.shape[1] * max(1, len(alphabet))))
                for k in range(0, len(at), step):
                    for row, kind, place, code, found in neighbourhood(codes[k : k + step], alphabet):
                        found = found.view(np.int64)
                        hit = np.flatnonzero(test(found))
                        if len(hit):
                            columns = (own[at[k : k + step][row[hit]]], np.full(len(hit), kind, np.int8), place[hit], code[hit].astype(np.int16), found[hit])
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["own", "kind", "place", "code", "hash"])

    made = known.select("word", "hash").mapInArrow(candidates, "own long, kind byte, place long, code short, hash long")
    met = made.join(known.select("hash", F.col("word").alias("near"), F.col("n").alias("near_n")), "hash").drop("hash")
    met = met.join(known.select(F.col("hash").alias("own"), "word", "n"), "own")
    place, letter = F.col("place").cast("int"), F.char(F.col("code").cast("long"))
    rest = F.col("word").substr(place + F.when(F.col("kind") == INSERTION, 1).otherwise(2), F.length("word"))
    edited = F.concat(F.col("word").substr(F.lit(1), place), F.when(F.col("kind") == DELETION, "").otherwise(letter), rest)
    return met.where(edited == F.col("near")).select("word", "n", "near", "near_n")


def roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """(word, root): the last of the forms to which ``forms`` (word, form, form_n; at least ``RATIO`` times the word's count) leads."""
    most = forms.agg(F.max("form_n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(most, RATIO)))  # forms in a row, at most
    found = scratch.write(forms.select("word", F.col("form").alias("root")), "roots-0")
    for k in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        further = found.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        found = scratch.write(found.join(further, found["root"] == further["_word"], "left").select("word", F.coalesce("_root", "root").alias("root")), f"roots-{k + 1}")
    return found


def group_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slip_in: int = SLIP_IN) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the corpus."""
    scratch = Scratch(docs.sparkSession, "spelling")
    vocabulary = scratch.write(words(docs, doc_id, text, slip_in), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(scratch, vocabulary).groupBy("word").agg(F.first("n").alias("n"), F.count("*").alias("n_near"), best.alias("best"))
    near = scratch.write(near.select("word", "n_near", F.when(-F.col("best.less") >= RATIO * F.col("n"), F.col("best.near")).alias("form"), (-F.col("best.less")).alias("form_n")), "near")
    forms = near.where("form is not null").select("word", "form", "form_n")
    out = vocabulary.join(near.select("word", "n_near", "form", F.when(F.col("form").isNotNull(), F.col("form_n")).alias("form_n")), "word", "left").join(roots(scratch, forms), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
