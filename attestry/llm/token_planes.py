"""Token ids on disk: fixed-size id blocks transposed into bit or byte planes, each plane zstandard-compressed, with a chunk index.

A *segment* is one file of the format and holds whole documents in ascending ``doc_id`` order::

    magic "TPL1" | u8 planes per id (4 byte planes or 32 bit planes) | u32 ids per block | u64 ids in the segment
    the compressed planes, block after block (an all-zero plane takes no bytes)
    index: for every block and plane a u32 length | u32 crc32 of the index | u64 offset of the index

Only Spark reaches the shared store of a cluster, so a segment travels as the binary value of one Parquet row; ``export_segments``
puts the same bytes into plain files where a folder can be opened. A segment closes at ``SEGMENT_IDS`` ids, so memory is bounded by
that or by the longest single document. Segments are read back independently: there is no shuffle on the read side.

Defined cases: null text counts as empty; an empty text yields the end id alone; a null ``doc_id`` sorts first; repeated ids keep
all their rows, ordered by their token ids; other columns of the input, whatever their names, are ignored; an empty table yields no rows.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import Scratch, bounded_batches, partitions

MAGIC, BLOCK_IDS, SEGMENT_IDS = b"TPL1", 1 << 16, 1 << 18
#: Distinct words whose ids a worker remembers.
MEMO_WORDS, MEMO_CHARS = 400_000, 16 << 20


# ---- format ---------------------------------------------------------------------------------------------------------------
def _split(block: np.ndarray, planes: int) -> np.ndarray:
    cells = block.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == 4:
        return np.ascontiguousarray(cells.T)
    return np.packbits(np.unpackbits(cells, axis=1, bitorder="little").T, axis=1, bitorder="little")


def _join(planes: np.ndarray, n: int) -> np.ndarray:
    if len(planes) == 32:
        planes = np.packbits(np.unpackbits(planes, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little").T
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def encode_segment(ids: np.ndarray, planes: int = 4, block_ids: int = BLOCK_IDS) -> bytes:
    if planes not in (4, 32):
        raise ValueError("planes is 4 (bytes) or 32 (bits)")
    press, body, lengths = zstandard.ZstdCompressor(level=1, write_checksum=True), [MAGIC + struct.pack("<BIQ", planes, block_ids, len(ids))], []
    for at in range(0, len(ids), block_ids):
        for plane in _split(ids[at : at + block_ids], planes):
            packed = press.compress(plane.tobytes()) if plane.any() else b""
            body.append(packed)
            lengths.append(len(packed))
    index = np.array(lengths, "<u4").tobytes()
    offset = sum(map(len, body))
    return b"".join([*body, index, struct.pack("<IQ", zlib.crc32(index), offset)])


def decode_segment(blob: bytes, first: int = 0, count: int | None = None) -> np.ndarray:
    """All ids, or ``count`` ids from ``first`` on, touching only the blocks that hold them."""
    planes, block_ids, n = struct.unpack_from("<BIQ", blob, 4)
    crc, offset = struct.unpack_from("<IQ", blob, len(blob) - 12)
    index = blob[offset:-12]
    if blob[:4] != MAGIC or zlib.crc32(index) != crc:
        raise ValueError("not a token plane segment, or its index is damaged")
    lengths = np.frombuffer(index, "<u4").reshape(-1, planes)
    ends = np.cumsum(lengths.ravel(), dtype=np.int64).reshape(lengths.shape) + 17
    last = n if count is None else min(n, first + count)
    if first >= last:
        return np.zeros(0, "<u4")
    out, press = [], zstandard.ZstdDecompressor()
    for b in range(first // block_ids, -(-last // block_ids)):
        size = min(block_ids, n - b * block_ids)
        width = size if planes == 4 else -(-size // 8)
        rows = np.zeros((planes, width), np.uint8)
        for p in range(planes):
            if lengths[b, p]:
                try:
                    plane = press.decompress(blob[ends[b, p] - lengths[b, p] : ends[b, p]], max_output_size=width)
                except zstandard.ZstdError as e:  # frames carry a checksum
                    raise ValueError(f"plane {p} of block {b} is damaged") from e
                if len(plane) != width:
                    raise ValueError(f"plane {p} of block {b} has {len(plane)} bytes, not {width}")
                rows[p] = np.frombuffer(plane, np.uint8)
        out.append(_join(rows, size))
    skip = first // block_ids * block_ids
    return np.concatenate(out)[first - skip : last - skip]


# ---- tokenizing -----------------------------------------------------------------------------------------------------------
#: Texts of these characters alone take the word-by-word path: no combining marks, one lower-case form each, no special spaces.
_PLAIN = re.compile("[^\x00-\x7fÀ-ÖØ-öø-įı-ſ]")
#: The tokenizer's own pre-tokenization, spelled out for those characters after lower-casing.
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\t-\r a-z0-9ß-öø-ſ]+")


class WordEncoder:
    """Ids of texts under a BPE with word ends, each distinct word encoded once.

    Words of such a tokenizer never meet, so a text's ids are its words' ids in a row. Unknown words of a batch are encoded together;
    every word's last id is one whose token carries the end-of-word mark, which cuts the result apart. Texts with any character
    outside the plain set go whole through the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = "<u2" if max(vocab.values(), default=0) < 1 << 16 else "<u4"
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {}
        self.held = 0

    def learn(self, words: set[str]) -> None:
        if len(self.memo) > MEMO_WORDS or self.held > MEMO_CHARS:
            self.memo.clear()
            self.held = 0
            return
        new = [w for w in words if w not in self.memo]
        self.held += sum(map(len, new))
        for at in range(0, len(new), 5000):
            part = new[at : at + 5000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part) or (len(cuts) and cuts[-1] != len(ids)):  # a word that the tokenizer cuts further
                self.memo.update((w, np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, self.kind).tobytes()) for w in part)
                continue
            raw, width = ids.tobytes(), ids.itemsize
            self.memo.update((w, raw[i * width : j * width]) for w, i, j in zip(part, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        words = [None if "<|" in t or _PLAIN.search(t) else _WORDS.findall(t.lower()) for t in texts]
        self.learn(set().union(*(w for w in words if w)))
        if not self.memo:  # just cleared
            self.learn(set().union(*(w for w in words if w)))
        get = self.memo.__getitem__
        return [b"".join(map(get, w)) if w is not None else np.array(self.tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids, self.kind).tobytes() for t, w in zip(texts, words, strict=True)]


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


# ---- operator -------------------------------------------------------------------------------------------------------------
_IDS = "part int, doc_id long, kind string, ids binary"
_SEGMENTS = "part int, first long, n_ids long, doc_ids array<long>, lengths array<long>, blob binary"


def write_ids(scratch: Scratch, docs: DataFrame, tokenizer: str, end_id: int, planes: int = 4) -> DataFrame:
    """Encode ``text`` of ``docs`` (doc_id, text) and write segments in ascending doc_id order; returns the segment table."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = partitions(spark)
    share = [i / n for i in range(1, n)]
    found = docs.agg(F.percentile_approx("doc_id", share, 100 * n).alias("b")).first()["b"] if share else None
    bounds = np.array(found or [], np.int64)

    def tokenize(batches):
        encoder = word_encoder(tokenizer)
        end, press = np.array([end_id], encoder.kind).tobytes(), zstandard.ZstdCompressor(level=1)
        for b in batches:
            ids = b.column(0)
            plain = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            texts = b.column(1).to_pylist()
            for at in range(0, len(texts), 250):
                part = encoder.encode(texts[at : at + 250])
                rows = [press.compress(x + end) for x in part]
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, plain[at : at + 250], "left").astype(np.int32)), ids.slice(at, 250), pa.array([encoder.kind] * len(rows)), pa.array(rows, pa.binary())], names=["part", "doc_id", "kind", "ids"])

    def pack(batches):
        press, names = zstandard.ZstdDecompressor(), ["part", "first", "n_ids", "doc_ids", "lengths", "blob"]
        kept, size, first, part = [], 0, 0, 0

        def close():
            nonlocal kept, size, first
            ids = np.concatenate([x for _, x in kept])
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([[d for d, _ in kept]], pa.list_(pa.int64())), pa.array([[len(x) for _, x in kept]], pa.list_(pa.int64())), pa.array([encode_segment(ids, planes)], pa.binary())], names=names)
            first, kept, size = first + len(ids), [], 0
            return row

        for b in batches:
            for part_, doc, kind, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                part = part_
                ids = np.frombuffer(press.decompress(raw), kind).astype("<u4")
                kept.append((doc, ids))
                size += len(ids)
                if size >= SEGMENT_IDS:
                    yield close()
        if kept:
            yield close()

    rows = docs.mapInArrow(tokenize, _IDS).repartitionById(n, "part").sortWithinPartitions("part", "doc_id", "ids")
    return scratch.write(rows.mapInArrow(pack, _SEGMENTS), "segments", "none")


def read_ids(segments: DataFrame) -> DataFrame:
    """Read segments back: per document its first position in the whole sequence, its number of ids and their crc32."""
    sizes = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row for each written partition
    base, total = {}, 0
    for r in sizes:
        base[r["part"]], total = total, total + r["n"]

    def unpack(batches):
        for b in batches:
            for part, first, n, docs, lengths, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = decode_segment(blob)
                if len(ids) != n or sum(lengths) != n:
                    raise ValueError("a segment doesn't hold the ids that its row announces")
                ends = np.cumsum(lengths)
                starts, raw = ends - lengths, memoryview(ids.tobytes())
                crcs = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts + first + base[part], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.select("part", "first", "n_ids", "doc_ids", "lengths", "blob").mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export_segments(segments: DataFrame, folder: str) -> int:
    """Write every segment to a plain file ``folder/part-first.tpl``, one at a time; returns their number."""
    n = 0
    for r in segments.orderBy("part", "first").toLocalIterator():
        with open(f"{folder}/{r['part']:06d}-{r['first']:015d}.tpl", "wb") as f:
            f.write(r["blob"])
        n += 1
    return n


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2, planes: int = 4) -> DataFrame:
    """Encode, write, read back: doc_id, start, n_tokens, ids_crc32."""
    return read_ids(write_ids(Scratch(docs.sparkSession, "token_planes"), docs, tokenizer, end_id, planes))
