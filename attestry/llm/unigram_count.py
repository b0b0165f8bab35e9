"""Token counts under a unigram vocabulary, without building tokens.

An Aho-Corasick automaton enumerates the vocabulary's matches by their end; dynamic programming carries, for every position, the best
score and the number of pieces on the path that reaches it. Ties follow the tokenizer's own rule: starts are tried from left to right
and a later path replaces an earlier one only if it is strictly better, so among equal paths into a position the longest last piece
wins. A character that no single-character piece covers may also be stepped over at (lowest score - 10); it then counts as its UTF-8
bytes under byte fallback, else adjacent ones count as one piece.

Where it can't change the result, a text is cut first and each distinct segment is solved once: no piece holds a space mark after
another character, so every path breaks there; characters that occur in no piece break every path too; and whole-number scores add
up without rounding. ``Vocabulary`` checks these three conditions and solves whole texts where one fails.

Defined cases: null and empty texts have 0 tokens; repeated rows keep all their rows; other columns are kept.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from attestry.llm.common import bounded_batches

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct segments that a worker keeps, and their characters in all.
MEMO_SEGMENTS, MEMO_CHARS = 400_000, 16 << 20
#: Characters that are solved together.
BLOCK_CHARS = 4096
#: Longer segments are not kept.
MEMO_LENGTH = 1000
#: The segments of a longer text aren't listed before they are counted.
LISTED_CHARS = 1 << 20


class Vocabulary(dict):
    """Segment -> number of pieces; missing segments are solved when asked for."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        super().__init__()
        self.held = 0
        self.byte_fallback = byte_fallback
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces:
            if p:
                self.automaton.add_word(p, (len(p), float(s)))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces
        self.longest = max((len(p) for p, _ in pieces), default=1)
        used = set("".join(p for p, _ in pieces))
        crossing = any(a != SPACE and b == SPACE for p, _ in pieces for a, b in zip(p, p[1:], strict=False))
        self.additive = byte_fallback and not crossing and all(float(s).is_integer() for _, s in pieces)
        cut = "".join(c for c in "\n\t\r" if c not in used)
        self.segments = re.compile(f" *[^ {cut}]+|[{cut}]| +" if cut else " *[^ ]+| +")

    def solve(self, text: str) -> tuple[float, int]:
        """Best score and its number of pieces for one normalized text, block by block: of earlier blocks only as many places are held as the longest piece reaches back."""
        score, count, unknown = [0.0], [0], [False]  # by end
        for at in range(0, len(text), BLOCK_CHARS):
            upto = min(len(text), at + BLOCK_CHARS)
            by_end: list[list[tuple[int, float]]] = [[] for _ in range(upto - at + 1)]
            if not self.empty:
                for end, found in self.automaton.iter(text, max(0, at - self.longest), upto):
                    if end >= at:
                        by_end[end + 1 - at].append(found)
            for k in range(1, upto - at + 1):
                best, pieces, stepped = None, 0, False
                for length, s in sorted(by_end[k], reverse=True):
                    found = score[-length] + s
                    if best is None or found > best:
                        best, pieces = found, count[-length] + 1
                c = text[at + k - 1]
                if c not in self.single and (best is None or score[-1] + self.unknown > best):
                    best, stepped = score[-1] + self.unknown, True
                    pieces = count[-1] + (len(c.encode("utf-8", "surrogatepass")) if self.byte_fallback else int(not unknown[-1]))
                score.append(best)
                count.append(pieces)
                unknown.append(stepped)
            score, count, unknown = score[-self.longest :], count[-self.longest :], unknown[-1:]
        return score[-1], count[-1]

    def __missing__(self, segment: str) -> int:
        if len(segment) > MEMO_LENGTH:
            return self.solve(segment.replace(" ", SPACE))[1]
        if len(self) > MEMO_SEGMENTS or self.held > MEMO_CHARS:
            self.clear()
            self.held = 0
        self.held += len(segment)
        found = self[segment] = self.solve(segment.replace(" ", SPACE))[1]
        return found

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = " " + text  # the tokenizer's dummy prefix
        if not self.additive:
            return self.solve(text.replace(" ", SPACE))[1]
        text = text.replace(SPACE, " ")
        if len(text) <= LISTED_CHARS:
            return sum(map(self.__getitem__, self.segments.findall(text)))
        return sum(self[m[0]] for m in self.segments.finditer(text))


def sentencepiece_pieces(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece model file with their scores; control, unknown and byte pieces match no text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(sentencepiece_pieces(path))
    return _VOCABULARIES[path]


def token_counts(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` in place of the text column (a column ``n_tokens`` of the input is replaced)."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop("n_tokens")
    at = docs.columns.index(text)
    rest = [c for c in docs.columns if c != text]

    def count(batches):
        v = vocabulary(model_path)
        for b in batches:
            n = [v.count(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(b.columns) if i != at] + [pa.array(n, pa.int64())], names=[*rest, "n_tokens"])

    types = dict(docs.dtypes)
    return docs.mapInArrow(count, ", ".join([f"`{c}` {types[c]}" for c in rest] + ["n_tokens long"]))
