"""Fill-in-middle: texts cut at two token boundaries into prefix, middle and suffix and put together anew for training.

A token is a run of ASCII letters or any other single code point. Cuts are found for all texts of an Arrow batch together, on the
batch's UTF-8 bytes: a table gives every byte's class, a byte that begins a token is told by its class and that of the byte before it,
one cumulative sum numbers the tokens (a document's own numbers begin anew at its first byte), and ``searchsorted`` finds the bytes at
which the chosen tokens begin. The bytes are taken in blocks, so that the sums of a very long text take bounded memory.

Where to cut, and in which form a text is put together, comes from the sha256 of ``<seed>:<doc_id>``: its first four groups of eight hex
digits are h1 to h4. The prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) tokens and the middle after the larger. The form
is ``plain`` for empty texts, texts that hold one of the marks and h3 % 100 >= ``share``, else ``spm`` for h4 % 100 < ``spm``, else ``psm``.

Defined cases: a null text is empty; a null ``doc_id`` is hashed as an empty number; repeated rows stay; other columns are kept, those
named like a result are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import bounded_batches, utf8

MARKS = PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED, SHARE, SPM = 1, 90, 20
BLOCK_BYTES = 1 << 20
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")
#: 0: a byte within a code point, 1: a letter, 2: the first byte of any other code point.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[0x80:0xC0] = 0
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1


def _blocks(values: np.ndarray, starts: np.ndarray):
    """(first byte, begins a token?, begins a code point?) of each block of bytes; ``starts`` are the texts' first bytes."""
    before = np.uint8(2)
    for at in range(0, len(values), BLOCK_BYTES):
        kind = _CLASS[values[at : at + BLOCK_BYTES]]
        left = np.concatenate([[before], kind[:-1]])
        first = starts[np.searchsorted(starts, at) : np.searchsorted(starts, at + len(kind))] - at
        left[first] = 2  # a letter that begins a text begins a token
        yield at, (kind == 2) | ((kind == 1) & (left != 1)), kind != 0
        before = kind[-1]


def _before(values: np.ndarray, starts: np.ndarray, points: np.ndarray, what: int) -> np.ndarray:
    """How many tokens (0) or code points (1) begin before each of ``points``."""
    edges, seen = np.unique(points), 0
    found = np.zeros(len(edges), np.int64)
    for at, *begins in _blocks(values, starts):
        run = np.concatenate([[0], np.cumsum(begins[what])])
        here = slice(*np.searchsorted(edges, [at, at + len(run) - 1]))
        found[here] = seen + run[edges[here] - at]
        seen += int(run[-1])
    found[np.searchsorted(edges, len(values)) :] = seen
    return found[np.searchsorted(edges, points)]


def cut(values: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """For texts ``values[offsets[i]:offsets[i + 1]]``: tokens, the bytes at which prefix and middle end, and code points of both."""
    ends = offsets[1:]
    starts = offsets[:-1][ends > offsets[:-1]]
    tokens = _before(values, starts, offsets, 0)
    base, upto = tokens[:-1], tokens[1:]
    n = upto - base
    wanted = base + np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)  # tokens before each cut, from the first text on
    cuts, seen, inside = np.broadcast_to(ends, wanted.shape).copy(), 0, wanted < upto
    for at, token, _ in _blocks(values, starts):
        run = np.cumsum(token)
        here = inside & (wanted >= seen) & (wanted < seen + run[-1])
        cuts[here] = at + np.searchsorted(run, wanted[here] - seen + 1)
        seen += int(run[-1])
    chars = _before(values, starts, np.concatenate([offsets[:-1], *cuts]), 1).reshape(3, -1)
    return n, cuts[0], cuts[1], chars[1] - chars[0], chars[2] - chars[1]


def restore(output: bytes, form: str) -> bytes:
    """The text from which ``output`` was made."""
    if form == "plain":
        return output
    second, third = output.index(SUFFIX if form == "psm" else PREFIX), output.index(MIDDLE)
    first, then, last = output[3:second], output[second + 3 : third], output[third + 3 :]
    return first + last + then if form == "psm" else then + last + first


def _digest(doc_id: str, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, share: int = SHARE, spm: int = SPM) -> DataFrame:
    """``docs`` without ``text``, with n, form, prefix_chars, middle_chars (null if plain) and output (UTF-8)."""
    bounded_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != text and c.lower() not in RESULTS]
    held = F.struct(*rest).alias("row") if rest else F.struct(F.lit(0).alias("none")).alias("row")
    rows = docs.select(held, utf8(text).alias("text"), *[h.alias(f"h{k}") for k, h in enumerate(_digest(doc_id, seed), 1)])

    def kernel(batches):
        for b in batches:
            texts = b.column(1)
            # the offsets and bytes of Arrow's own buffers, without a copy
            offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
            raw = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            h1, h2, h3, h4 = (b.column(k).to_numpy() for k in range(2, 6))
            n, first, second, prefix, middle = cut(np.frombuffer(raw, np.uint8), offsets, h1, h2)
            out, forms = [], []
            for i, (start, end, p, m) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), first.tolist(), second.tolist(), strict=True)):
                whole = bytes(raw[start:end])
                if not whole or h3[i] % 100 >= share or any(x in whole for x in MARKS):
                    forms.append("plain")
                    out.append(whole)
                    continue
                forms.append("spm" if h4[i] % 100 < spm else "psm")
                parts = (PREFIX, raw[start:p], SUFFIX, raw[m:end]) if forms[-1] == "psm" else (SUFFIX, raw[m:end], PREFIX, raw[start:p])
                out.append(b"".join([*parts, MIDDLE, raw[p:m]]))
            plain = np.array([f == "plain" for f in forms], bool)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(forms, pa.string()), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), pa.array(out, pa.binary())], names=["row", *RESULTS])

    found = rows.mapInArrow(kernel, f"row {dict(rows.dtypes)['row']}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return found.select(*[F.col("row").getField(c).alias(c) for c in rest], *RESULTS)


def restored(found: DataFrame, name: str = "restored") -> DataFrame:
    """``found`` (form, output) with the texts rebuilt from these two columns alone."""
    rest = [c for c in found.columns if c != "output" and c != name]
    rows = found.select(F.struct(*rest).alias("row"), "form", "output")

    def rebuild(batches):
        for b in batches:
            texts = [restore(o, f) for f, o in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(texts, pa.binary())], names=["row", "output", name])

    made = rows.mapInArrow(rebuild, f"row {dict(rows.dtypes)['row']}, output binary, `{name}` binary")
    return made.select(*[F.col("row").getField(c).alias(c) for c in rest], "output", name)
