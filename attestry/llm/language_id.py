"""Language identification with hyperdimensional profiles.

Every symbol (a lower-cased letter, or the gap between words) has a seeded random bipolar vector. An n-gram's vector binds its
letters' vectors, each rotated by its place; a text's vector bundles (sums) those of its n-grams; a language's prototype bundles the
vectors of all its training texts. A text gets the language whose prototype has the largest cosine with its vector.

Bundles are sums of whole numbers, so prototypes are exact and don't depend on the order of the data. Training reduces to counting:
each task counts n-grams by language, multiplies the counts with the n-grams' vectors now and then, and sends ``DIM`` numbers a language,
whatever its input.

Defined cases: null text and text without a letter give ``und`` with score 0; so does every text where no language was learned; equal
cosines go to the smallest language name; training rows without language or text are skipped; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import Scratch, bounded_batches

DIM, N, SEED = 1024, 3, 20_240_229
#: N-grams whose vectors a worker keeps, as a matrix of float32: 48 MB at most.
MEMO_NGRAMS = 12_288
#: Prototypes of one pass over the texts; with more languages, predict() makes more passes.
BLOCK_LANGUAGES = 2_000
#: Characters and texts that are counted together; n-grams that training gathers before it adds them up.
GROUP_CHARS, GROUP_TEXTS, GATHERED = 200_000, 512, 1 << 20
#: Bits of a symbol's number: n-grams of the first 2**BITS symbols have a place in a table, others are sorted.
BITS = 7
#: Distinct scores that a length class needs for a threshold of its own.
LEAST_SCORES = 80


class Profiles:
    """Turns texts into bundled vectors. Symbols are numbered as they are met; number 0 is the gap between words."""

    def __init__(self, dim: int = DIM):
        self.dim = dim
        self.number = np.full(0x110000, -1, np.int32)
        self.points = [0]  # code point of each number
        self.numbers: dict[int, int] = {0: 0}
        self.symbols: dict[int, np.ndarray] = {}
        self.place = np.full(1 << BITS * N, -1, np.int32)  # of a small n-gram within the keys at hand
        self.keys = np.zeros(0, np.int64)
        self.rows = np.zeros((0, dim), np.float32)

    def _learn(self, raw: np.ndarray) -> None:
        for c in np.unique(raw[self.number[raw] < 0]).tolist():
            s = chr(c)
            folded = (ord(s.lower()) if len(s.lower()) == 1 else c) if s.isalpha() else 0
            if folded not in self.numbers:
                self.numbers[folded] = len(self.points)
                self.points.append(folded)
            self.number[c] = self.numbers[folded]

    def letters(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the texts, one after the other, and the text each belongs to: letters lower-cased, each run of anything else one 0, a 0 at both ends."""
        raw = np.frombuffer(" " .join(["", *[f"{t} " for t in texts]]).encode("utf-32-le", "surrogatepass"), "<u4")
        if (self.number[raw] < 0).any():
            self._learn(raw)
        codes = self.number[raw].astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (owner[1:] != owner[:-1])
        return codes[keep], owner[keep]

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams and their texts. A text without letters has none."""
        c, owner = self.letters(texts)
        within = owner[: -(N - 1)] == owner[N - 1 :]
        keys = c[:-2] << 42 | c[1:-1] << 21 | c[2:]
        return keys[within], owner[: -(N - 1)][within]

    def distinct(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams and the place of each n-gram among them."""
        if not len(keys) or len(self.points) > 1 << BITS:
            return np.unique(keys, return_inverse=True)
        mask = (1 << BITS) - 1
        small = keys >> (42 - 2 * BITS) | (keys >> (21 - BITS)) & mask << BITS | keys & mask
        self.place[small] = 0
        found = np.flatnonzero(self.place == 0)
        self.place[found] = np.arange(len(found))
        at = self.place[small].astype(np.int64)
        self.place[found] = -1
        return found >> 2 * BITS << 42 | (found >> BITS & mask) << 21 | found & mask, at

    def symbol(self, number: int) -> np.ndarray:
        if number not in self.symbols:
            self.symbols[number] = np.random.default_rng([SEED, self.points[number]]).integers(0, 2, self.dim).astype(np.int8) * 2 - 1
        return self.symbols[number]

    def vector(self, key: int) -> np.ndarray:
        a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
        return np.roll(self.symbol(a), 2) * np.roll(self.symbol(b), 1) * self.symbol(c)

    def matrix(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of distinct, sorted n-grams."""
        missing = np.setdiff1d(keys, self.keys, assume_unique=True)
        if len(missing):
            if len(self.keys) + len(missing) > MEMO_NGRAMS:
                self.keys, self.rows, missing = self.keys[:0], self.rows[:0], keys
            both = np.concatenate([self.keys, missing])
            order = np.argsort(both)
            self.rows = np.concatenate([self.rows, np.array([self.vector(k) for k in missing.tolist()], np.float32)])[order]
            self.keys = both[order]
        return self.rows[np.searchsorted(self.keys, keys)]

    def bundle(self, texts: list[str]) -> np.ndarray:
        grams, owner = self.grams(texts)
        keys, at = self.distinct(grams)
        out = np.zeros((len(texts), self.dim))
        kind = np.float32 if np.bincount(owner, minlength=1).max() < 1 << 24 else np.float64  # sums stay exact whole numbers
        for first in range(0, len(keys), 4096):
            part, width = (at >= first) & (at < first + 4096), min(4096, len(keys) - first)
            counts = np.bincount(owner[part] * width + (at[part] - first), minlength=len(texts) * width).reshape(len(texts), width)
            out += counts.astype(kind) @ self.matrix(keys[first : first + 4096])
        return out

    def total(self, grams: np.ndarray) -> np.ndarray:
        """The bundle of many n-grams."""
        keys, at = self.distinct(grams)
        counts, out = np.bincount(at, minlength=len(keys)).astype(np.float64), np.zeros(self.dim)
        for first in range(0, len(keys), 4096):
            out += counts[first : first + 4096] @ self.matrix(keys[first : first + 4096])
        return out


_PROFILES: dict[int, Profiles] = {}


def profiles(dim: int) -> Profiles:
    if dim not in _PROFILES:
        _PROFILES[dim] = Profiles(dim)
    return _PROFILES[dim]


def _groups(texts: list[str], chars: int = GROUP_CHARS, most: int = GROUP_TEXTS):
    """Runs of texts of about so many characters; the count matrix stays small. A longer text makes a run of its own."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and (size + len(t) > chars or i - at >= most):
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


class Prototypes:
    """Unit vectors of the languages, smallest name first, in blocks that fit a worker; held as a table of one row a language."""

    def __init__(self, rows: DataFrame, dim: int):
        self.rows, self.dim = rows, dim

    def blocks(self, most: int = BLOCK_LANGUAGES):
        """(names, matrix) of at most ``most`` languages at a time; only one block is held."""
        names, vectors = [], []
        for r in self.rows.orderBy("lang").toLocalIterator():
            v = np.zeros(self.dim)
            for x in r["sums"]:
                v[x["place"]] = x["total"]
            if n := np.linalg.norm(v):
                names.append(r["lang"])
                vectors.append(v / n)
            if len(names) == most:
                yield names, np.array(vectors).T.copy()
                names, vectors = [], []
        if names:
            yield names, np.array(vectors).T.copy()


def train(docs: DataFrame, dim: int = DIM) -> Prototypes:
    """Prototypes of the languages in ``docs`` (text, lang)."""
    bounded_batches(docs.sparkSession)

    def count(batches):
        p, sums, waiting, held = profiles(dim), {}, {}, 0

        def add() -> None:
            for lang, parts in waiting.items():
                sums[lang] = sums.get(lang, 0) + p.total(np.concatenate(parts))
            waiting.clear()

        for b in batches:
            texts, langs = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), object)
            for i, j in _groups(texts):
                grams, owner = p.grams(texts[i:j])
                own = langs[i:j]
                for lang in set(own):
                    waiting.setdefault(lang, []).append(grams[(own == lang)[owner]])
                held += len(grams)
                if held > GATHERED:
                    add()
                    held = 0
        add()
        for lang in sorted(sums):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(range(dim), pa.int32()), pa.array(sums[lang].astype(np.int64))], names=["lang", "place", "total"])

    rows = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(count, "lang string, place int, total long")
    rows = rows.groupBy("lang", "place").agg(F.sum("total").alias("total")).groupBy("lang").agg(F.collect_list(F.struct("place", "total")).alias("sums"))  # dim entries a language
    return Prototypes(Scratch(docs.sparkSession, "language_id").write(rows, "prototypes"), dim)


def _scored(docs: DataFrame, names: list[str], table: np.ndarray, at: int, dim: int, first: bool) -> DataFrame:
    """One pass: ``lang_pred`` and ``score`` of the best of ``names`` (after the first pass, of those and what earlier ones found)."""
    def score(batches):
        p = profiles(dim)
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            own, best, top = b, ["und"] * len(texts), np.zeros(len(texts))
            if not first:
                own = b.select(b.schema.names[:-2])
                best, top = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_numpy().copy()
            for i, j in _groups(texts) if names else ():
                v = p.bundle(texts[i:j])
                norm = np.linalg.norm(v, axis=1)
                cosines = (v @ table / np.maximum(norm, 1e-300)[:, None]).round(6)
                for k in np.flatnonzero(norm):
                    m, c = int(cosines[k].argmax()), float(cosines[k].max())
                    if best[i + k] == "und" or c > top[i + k]:
                        best[i + k], top[i + k] = names[m], c
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(best, pa.string()), pa.array(top)], names=[*own.schema.names, "lang_pred", "score"])

    kept = docs.columns if first else docs.columns[:-2]
    types = dict(docs.dtypes)
    return docs.mapInArrow(score, ", ".join(f"`{c}` {types[c]}" for c in kept) + ", lang_pred string, score double")


def predict(docs: DataFrame, prototypes: Prototypes, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added (columns of these names are replaced). One pass over the texts for each block of languages."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    at, found = docs.columns.index(text), None
    for names, table in prototypes.blocks():
        found = _scored(docs if found is None else found, names, table, at, prototypes.dim, found is None)
    if found is None:
        found = _scored(docs, [], np.zeros((prototypes.dim, 0)), at, prototypes.dim, True)
    return found.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")))


def identify(docs: DataFrame, learn_from: Column, dim: int = DIM) -> DataFrame:
    """Learn from the rows that ``learn_from`` marks, predict for all rows."""
    return predict(docs, train(docs.where(learn_from), dim))


def length_class(text: str = "text") -> Column:
    """Whole binary logarithm of a text's length; null and empty texts count as 0."""
    return F.floor(F.log2(F.greatest(F.length(F.coalesce(F.col(text), F.lit(""))), F.lit(1)))).cast("int")


def thresholds(predicted: DataFrame, text: str = "text") -> dict[int, float]:
    """By length class, the score under which a text is no specimen of its language, from all labelled rows of ``predict``.

    It is the first quartile less three times the distance to the third (at least 1 / sqrt(DIM), what cosines of unrelated vectors vary by), so a
    minority of junk among the labelled rows moves it little and no fixed share goes. Equal scores count once, as copies of one text would narrow
    the quartiles. A class with too few of them has the threshold of the next shorter one; the shortest have none.
    """
    rows = predicted.where("lang is not null and lang_pred <> 'und'").select(length_class(text).alias("size"), "score").distinct()
    seen: dict[int, list[tuple[float, int]]] = {}
    for r in rows.groupBy("size", F.round("score", 3).alias("score")).count().collect():  # at most a thousand a class
        seen.setdefault(r["size"], []).append((r["score"], r["count"]))
    out: dict[int, float] = {}
    last = 0.0
    for size in range(max(seen, default=-1) + 1):
        own = sorted(seen.get(size, []))
        scores, places = np.array([x for x, _ in own]), np.cumsum([n for _, n in own])
        if own and places[-1] >= LEAST_SCORES:
            low, high = (scores[np.searchsorted(places, q * places[-1])] for q in (0.25, 0.75))
            last = max(0.0, float(low - 3 * max(high - low, DIM**-0.5)))
        out[size] = last
    return out


def recognizable(limits: dict[int, float], text: str = "text") -> Column:
    """Whether a row of ``predict`` reaches the threshold of its length."""
    least = F.lit(0.0)
    for size, limit in sorted(limits.items()):
        least = F.when(length_class(text) >= size, limit).otherwise(least)
    return (F.col("lang_pred") != "und") & (F.col("score") >= least)
