"""Packing token pieces into sequences of fixed room by the sum-of-squares rule.

A document's ids are cut into pieces of at most ``room`` tokens; only the last one can be shorter. A piece goes where the squared
numbers of open sequences per residual gap become smallest, ties to the smallest gap. The rule sees nothing but lengths, so it runs
over the histogram of lengths (``room`` rows whatever the corpus): pieces of a length are placed in batches of equal size, one piece a
batch up to ``BATCHES`` pieces, and a batch moves as many sequences from one gap to another as the gap holds. Batches come in seeded
order, the shortest quarter of all pieces last and in falling order, as they fill what is left.

The rule's outcome is a list of slots: so many pieces of one length stand at one offset of so many sequences in a row. A piece finds its
slot by its rank among all pieces of its length. Ranks need no shuffle of pieces by length: every task numbers its own pieces as it cuts
them, and the pieces of earlier tasks are added from the table of counts by task and length. No token leaves its task but in
``sequences``, which builds the packed sequences themselves.

Defined cases: a null text is empty and holds the end id alone; repeated rows are separate documents; a null ``doc_id`` is kept; other
columns of the input, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry.llm.common import Scratch, bounded_batches
from attestry.llm.token_planes import word_encoder

ROOM, SEED = 4096, 11
#: Batches of pieces that the rule places at most, but for one more a length; the share of pieces that come last.
BATCHES, LAST_SHARE = 1 << 17, 0.25
_SLOT = ("length", "rank", "n", "first_sequence", "offset")
_FAR = np.iinfo(np.int64).max


def _batches(counts: np.ndarray, most: int, seed: int) -> Iterator[tuple[int, int]]:
    """(length, pieces) of every batch in the order in which they are placed."""
    per = max(1, -(-int(counts.sum()) // most))
    lengths = np.flatnonzero(counts)
    whole, rest = counts[lengths] // per, counts[lengths] % per
    length = np.concatenate([np.repeat(lengths, whole), lengths[rest > 0]])
    size = np.concatenate([np.full(whole.sum(), per), rest[rest > 0]])
    order = np.random.default_rng(seed).permutation(len(length))
    length, size = length[order], size[order]
    short = lengths[np.cumsum(counts[lengths]) <= LAST_SHARE * counts.sum()]
    late = np.isin(length, short)
    falling = np.argsort(-length[late], kind="stable")
    yield from zip(np.concatenate([length[~late], length[late][falling]]).tolist(), np.concatenate([size[~late], size[late][falling]]).tolist(), strict=True)


def sum_of_squares(counts: np.ndarray, room: int = ROOM, most: int = BATCHES, seed: int = SEED) -> tuple[np.ndarray, int]:
    """Slots (length, first rank, pieces, first sequence, offset) for ``counts[length]`` pieces of every length, and the number of sequences."""
    open_, stacks = np.zeros(room + 1, np.int64), [[] for _ in range(room + 1)]  # by gap: how many sequences, and which: [first, number]
    slots, ranks, opened = [], np.zeros(room + 1, np.int64), int(counts[room])
    if opened:  # full pieces are sequences of their own
        slots.append((room, 0, opened, 0, 0))
        counts = np.append(counts[:room], 0)

    def fill(length: int, gap: int, first: int, n: int) -> None:
        slots.append((length, int(ranks[length]), n, first, room - gap))
        ranks[length] += n
        if gap > length:
            stacks[gap - length].append((first, n))
            open_[gap - length] += n

    for length, left in _batches(counts, most, seed):
        while left:
            here, then = open_[length:room], open_[: room - length]
            moved = np.minimum(here, left)
            change = 2 * (then - here + moved)  # of the squares, by piece
            change[0] = moved[0] - 2 * here[0]  # a full sequence is counted no more
            change[here == 0] = _FAR
            k = int(change.argmin())
            if change[k] > 2 * open_[room - length] + left:
                fill(length, room, opened, left)
                opened, left = opened + left, 0
                continue
            gap, n = length + k, int(moved[k])
            open_[gap] -= n
            left -= n
            while n:
                first, size = stacks[gap].pop()
                if size > n:
                    stacks[gap].append((first + n, size - n))
                    size = n
                fill(length, gap, first, size)
                n -= size
    found = np.array(slots, np.int64).reshape(-1, len(_SLOT))
    return found[np.lexsort((found[:, 1], found[:, 0]))], opened


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, room: int = ROOM) -> DataFrame:
    """Every document's ids and the end id in pieces: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), part and local.

    ``local`` numbers the pieces of one length within the task ``part``, so write the rows down before they are read twice.
    """
    bounded_batches(docs.sparkSession)

    def cut(batches):
        encoder = word_encoder(tokenizer)
        part, seen = TaskContext.get().partitionId(), np.zeros(room + 1, np.int64)
        end, names = np.array([end_id], "<u4").tobytes(), ["part", "doc_id", "piece", "start", "length", "local", "ids"]
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at in range(0, len(texts), 250):
                rows = []
                for key, found in zip(keys[at : at + 250], encoder.encode(texts[at : at + 250]), strict=True):
                    raw = np.frombuffer(found, encoder.kind).astype("<u4").tobytes() + end
                    for piece, start in enumerate(range(0, len(raw) // 4, room)):
                        ids = raw[4 * start : 4 * (start + room)]
                        length = len(ids) // 4
                        rows.append((part, key, piece, start, length, int(seen[length]), ids))
                        seen[length] += 1
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "part int, doc_id long, piece int, start long, length long, local long, ids binary")


def pack(pieces: DataFrame, room: int = ROOM, most: int = BATCHES, seed: int = SEED) -> DataFrame:
    """``pieces`` (a written table with part, length, local; no length above ``room``) with ``sequence_id`` and ``offset``.

    Columns of these names are replaced; others are kept.
    """
    spark = pieces.sparkSession
    rest = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset", "part", "local")]
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(room + 1, np.int64)
    for length, n in by_part.groupBy("length").agg(F.sum("n")).collect():  # a row a length, ``room`` at most
        counts[length] = n
    slots, _ = sum_of_squares(counts, room, most, seed)
    # length and rank in one number, both in order
    wide = 1 << 48
    table = spark.sparkContext.broadcast((slots[:, 0] * wide + slots[:, 1], slots[:, 1], slots[:, 3], slots[:, 4]))  # bounded as ``most`` is

    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = by_part.select("part", "length", F.coalesce(earlier, F.lit(0)).alias("_before"))
    ranked = pieces.select("part", "length", "local", F.struct(*rest).alias("row")).join(before, ["part", "length"]).select("row", "length", (F.col("_before") + F.col("local")).alias("rank"))

    def place(batches):
        keys, ranks, firsts, offsets = table.value
        for b in batches:
            length, rank = b.column(1).to_numpy(), b.column(2).to_numpy()
            at = np.searchsorted(keys, length * wide + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(firsts[at] + rank - ranks[at]), pa.array(offsets[at])], names=["row", "sequence_id", "offset"])

    kind = dict(ranked.dtypes)["row"]
    return ranked.mapInArrow(place, f"row {kind}, sequence_id long, offset long").select(*[F.col("row").getField(c).alias(c) for c in rest], "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (all pieces in a row), spans (doc_id, piece, start, length, offset) in order of offset."""
    span = F.struct("offset", "doc_id", "piece", "start", "length", "ids")
    found = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(span)).alias("spans"))  # ``room`` pieces at most
    ids = F.expr("aggregate(spans, cast('' as binary), (a, s) -> a || s.ids)")
    return found.select("sequence_id", ids.alias("ids"), F.expr("transform(spans, s -> struct(s.doc_id, s.piece, s.start, s.length, s.offset))").alias("spans"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, room: int = ROOM) -> DataFrame:
    """Cut, pack and check-sum: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut_pieces(docs, tokenizer, end_id, room).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(Scratch(docs.sparkSession, "packing").write(pieces, "pieces"), room)
