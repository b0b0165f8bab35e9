"""Quality classification: random Fourier features, ridge regression by normal equations, isotonic calibration.

A document becomes ``len(NAMES)`` statistics (shares of character classes, word and line shapes, repetition). Random Fourier features of the
standardized statistics approximate a Gaussian kernel. Each task sums its part of the normal equations, fold by fold; the driver gets
their totals, whose size depends on the number of features alone, and solves for the ridge weights. Every labelled document is scored
by the weights that left its fold out; those scores, counted in fixed bins, give the isotonic curve, interpolated between its blocks.

Defined cases: null and empty texts have statistics too (all zero) and get a score; documents without a label are scored, not learned from; a
null label is no label; several labels of one document count each; with no labelled document, or labels of one kind, every score is the
mean label (0.5 without any); repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import Scratch, bounded_batches, utf8

FEATURES, FOLDS, RIDGE, BINS, SEED = 256, 4, 1.0, 2048, 11
NAMES = ["chars", "upper", "lower", "digit", "blank", "newline", "stop", "comma", "exclaim", "symbol", "bar", "other", "beyond", "entropy", "words", "word_length", "word_spread", "short", "capital", "distinct", "lines", "line_length", "line_distinct", "triples", "glued"]
_CLASSES = np.zeros((256, 12), np.float64)
for _i, _set in enumerate([range(65, 91), range(97, 123), range(48, 58), b" \t\r\x0b\x0c", b"\n", b".", b",;:", b"!?", b"*#$%&@^~+=<>", b"|_\\/", b"\"'()[]{}-`", range(128, 256)]):
    _CLASSES[list(_set), _i] = 1
_TRIPLES = re.compile(rb"([^\s\w])\1\1|!!")
_GLUED = re.compile(rb"[a-z][A-Z]|[a-z][0-9]|[0-9][a-z]")


def statistics(raw: bytes) -> list[float]:
    """The statistics of one text in UTF-8, in the order of ``NAMES``."""
    if not raw:
        return [0.0] * len(NAMES)
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    present = counts[counts > 0] / n
    words, lines = raw.split(), raw.split(b"\n")
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    m = max(1, len(words))
    heads = sum(w[0] in _UPPER for w in words)
    return [math.log1p(n), *(counts @ _CLASSES / n).tolist(), float(-(present * np.log2(present)).sum()), math.log1p(len(words)), float(lengths.mean()), float(lengths.std()), float((lengths <= 3).mean()), heads / m, math.log1p(len(set(words))) / math.log1p(m), math.log1p(len(lines)), math.log1p(n / len(lines)), len(set(lines)) / len(lines), len(_TRIPLES.findall(raw)) / m, len(_GLUED.findall(raw)) / m]


_UPPER = frozenset(range(65, 91))


def statistics_table(scratch: Scratch, docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, doc_id, stats): the columns of ``docs`` but the text, its doc_id, and its statistics (array of double), written to the shared folder."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[c for c in docs.columns if c != text]).alias("row"), "doc_id", utf8(text).alias("raw"))
    types = dict(rows.dtypes)

    def measure(batches):
        for b in batches:
            stats = [statistics(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(stats, pa.list_(pa.float64()))], names=["row", "doc_id", "stats"])

    return scratch.write(rows.mapInArrow(measure, f"row {types['row']}, doc_id {types['doc_id']}, stats array<double>"), "stats")


class Model:
    """Standardization, random features, ridge weights (all, and without each fold) and the calibration curve."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.w = r.standard_normal((len(mean), features)) / math.sqrt(len(mean))
        self.b = r.uniform(0, 2 * math.pi, features)
        self.weights: list[np.ndarray] = []
        self.curve = (np.array([0.0]), np.array([0.5]))

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -6, 6)
        z = math.sqrt(2 / self.w.shape[1]) * np.cos(x @ self.w + self.b)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def solve(self, grams: list[np.ndarray]) -> None:
        """``grams``: per fold, sums of outer products of (features, 1, label)."""
        total = sum(grams)
        for g in [total, *(total - g for g in grams)]:
            a, y = g[:-1, :-1].copy(), g[:-1, -1]
            a[np.diag_indices(len(a) - 1)] += RIDGE
            a[-1, -1] += 1e-9
            self.weights.append(np.linalg.solve(a, y))

    def raw(self, z: np.ndarray, fold: int = -1) -> np.ndarray:
        return z @ self.weights[fold + 1]

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, *self.curve), 0, 1).round(6)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block centres and their rising means."""
    blocks: list[list[float]] = []
    for xi, yi, ni in zip(x, y, n, strict=True):
        blocks.append([xi * ni, yi, ni])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    a = np.array(blocks)
    return a[:, 0] / a[:, 2], a[:, 1] / a[:, 2]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(rows: DataFrame, features: int = FEATURES) -> Model:
    """Learn from ``rows`` (doc_id, stats, label)."""
    d = len(NAMES)
    rows = rows.where("label is not null").select((F.crc32(F.concat(F.lit("fold"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")) % FOLDS).cast("int").alias("fold"), F.col("label").cast("double").alias("label"), "stats")
    moments = rows.agg(F.count("*").alias("n"), F.avg("label").alias("y"), *(f(F.col("stats")[i]).alias(f"{k}{i}") for i in range(d) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    model = Model(np.array([moments[f"m{i}"] or 0.0 for i in range(d)]), np.array([max(moments[f"s{i}"] or 1.0, 1e-6) for i in range(d)]), features)
    if not moments["n"] or moments["y"] in (0.0, 1.0):
        model.curve = (np.array([0.0]), np.array([0.5 if moments["y"] is None else moments["y"]]))
        return model
    side = features + 2

    def sums(batches):
        grams = np.zeros((FOLDS, side, side))
        for b in batches:
            folds = b.column(0).to_numpy()
            z = np.concatenate([model.features(_matrix(b.column(2))), b.column(1).to_numpy()[:, None]], axis=1)
            for k in range(FOLDS):
                own = z[folds == k]
                grams[k] += own.T @ own
        for k in np.flatnonzero(grams[:, -2, -2]):  # folds of which the task has seen a row
            yield pa.RecordBatch.from_arrays([pa.array(range(k * side, (k + 1) * side), pa.int32()), pa.array(list(grams[k]), pa.list_(pa.float64()))], names=["line", "v"])

    def add(t: pa.Table) -> pa.Table:
        total = _matrix(t["v"].combine_chunks()).sum(0)
        return pa.table({"line": t["line"][:1], "v": pa.array([total], pa.list_(pa.float64()))})

    lines = rows.mapInArrow(sums, "line int, v array<double>").groupBy("line").applyInArrow(add, "line int, v array<double>").collect()  # FOLDS * side rows
    total = np.zeros((FOLDS * side, side))
    for r in lines:
        total[r["line"]] = r["v"]
    model.solve(list(total.reshape(FOLDS, side, side)))

    def left_out(batches):
        n = np.zeros((BINS, 2))
        for b in batches:
            folds, z, y = b.column(0).to_numpy(), model.features(_matrix(b.column(2))), b.column(1).to_numpy()
            s = np.zeros(len(y))
            for k in range(FOLDS):
                s[folds == k] = model.raw(z[folds == k], k)
            np.add.at(n, np.clip(((s + 0.5) / 2 * BINS).astype(int), 0, BINS - 1), np.stack([y, np.ones(len(y))], 1))
        at = np.flatnonzero(n[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at, 0]), pa.array(n[at, 1])], names=["bin", "y", "n"])

    bins = rows.mapInArrow(left_out, "bin int, y double, n double").groupBy("bin").agg(F.sum("y").alias("y"), F.sum("n").alias("n")).orderBy("bin").collect()  # BINS rows
    a = np.array([tuple(r) for r in bins])
    model.curve = isotonic((a[:, 0] + 0.5) / BINS * 2 - 0.5, a[:, 1], a[:, 2])
    return model


def score(rows: DataFrame, model: Model) -> DataFrame:
    """The columns of ``row`` with ``score`` and ``predicted`` (columns of these names are replaced)."""
    inner = [f.name for f in rows.schema["row"].dataType.fields]

    def apply(batches):
        for b in batches:
            z = model.features(_matrix(b.column(1)))
            s = model.calibrated(model.raw(z) if model.weights else np.zeros(len(z)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["row", "score", "predicted"])

    found = rows.select("row", "stats").mapInArrow(apply, f"row {dict(rows.dtypes)['row']}, score double, predicted int")
    return found.select(*[F.col("row").getField(c).alias(c) for c in inner if c.lower() not in ("score", "predicted")], "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score ``docs`` (doc_id, text, further columns of any names) after learning from ``labels`` (doc_id, label)."""
    table = statistics_table(Scratch(docs.sparkSession, "quality"), docs)
    return score(table, fit(table.select("doc_id", "stats").join(labels.select("doc_id", "label"), "doc_id")))
