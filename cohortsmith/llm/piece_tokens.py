"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a Viterbi pass.

The automaton reads a unit's characters once. At each position its output links give every piece that
ends there, and each one relaxes the best score of that position; a character that no piece covers
alone costs the lowest score less 10 and becomes its UTF-8 bytes' pieces. That is the segmentation with
the highest sum of scores, what the library does for unigram models. (The public 32k model was made by
merges: the library itself would apply its merges in order, and for some words finds other pieces than
the ones with the highest sum. Decoding is exact either way.)

A text is "▁" and its characters, with "▁" for each space. No piece has "▁" after another character, so a
text falls into units that begin with "▁" and are encoded each by itself, once for as long as the
worker remembers it. A literal "▁" is spelled in bytes, so that decoding gives back every text exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import tidy

_SPACE = "▁"
#: Units that a worker remembers, each of at most so many characters.
_CACHE, _LONGEST = 500_000, 64
_UNKNOWN_PENALTY = 10.0


class Pieces:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)
        self.surface = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.score = [model.get_score(i) for i in range(model.vocab_size())]
        self.bytes = [0] * 256
        self.of_byte = {}
        normal = []
        for i, p in enumerate(self.surface):
            if model.is_byte(i):
                self.bytes[int(p[3:5], 16)], self.of_byte[i] = i, int(p[3:5], 16)
            elif not special(i):
                normal.append(i)
        if any(_SPACE in self.surface[i].lstrip(_SPACE) for i in normal):
            raise ValueError("a piece has a space inside: texts don't fall into units")
        self.lowest = min(self.score[i] for i in normal) - _UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            self.automaton.add_word(self.surface[i], (len(self.surface[i]), self.score[i], i))
        self.automaton.make_automaton()
        self.units: dict[str, bytes] = {}

    def best(self, unit: str) -> list[int]:
        """Ids of the best segmentation of a unit; -1 - code point where no piece covers a character."""
        n, lowest = len(unit), self.lowest
        score, start, piece, reached = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1), 0
        for end, (length, value, i) in self.automaton.iter(unit):
            at = end + 1
            while reached < end:  # positions that no piece ends at
                self._unknown(unit, reached, score, start, piece, lowest)
                reached += 1
            s = score[at - length] + value
            if reached < at:
                reached = at
                score[at], start[at], piece[at] = s, at - length, i
                if length > 1:
                    self._spare(unit, at, score, start, piece, lowest)
            elif s > score[at] or (s == score[at] and at - length < start[at]):
                score[at], start[at], piece[at] = s, at - length, i
        while reached < n:
            self._unknown(unit, reached, score, start, piece, lowest)
            reached += 1
        out = []
        while n:
            out.append(piece[n])
            n = start[n]
        out.reverse()
        return out

    @staticmethod
    def _unknown(unit, at, score, start, piece, lowest):
        score[at + 1], start[at + 1], piece[at + 1] = score[at] + lowest, at, -1 - ord(unit[at])

    def _spare(self, unit, at, score, start, piece, lowest):
        """A position that a longer piece reaches may still be reached better by an unknown character."""
        if unit[at - 1] not in self.automaton and score[at - 1] + lowest > score[at]:
            self._unknown(unit, at - 1, score, start, piece, lowest)

    def encoded(self, unit: str) -> bytes:
        out = []
        for i in self.best(unit):
            out += [i] if i >= 0 else [self.bytes[b] for b in chr(-1 - i).encode()]
        return np.array(out, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers; none for empty text."""
        if not text:
            return b""
        if _SPACE in text:
            return b"".join(np.array([self.bytes[b] for b in part.encode()], "<u4").tobytes() if part == _SPACE else self._plain(part, k == 0) for k, part in enumerate(_parts(text)))
        return self._plain(text, True)

    def _plain(self, text: str, first: bool) -> bytes:
        words = text.split(" ")
        head = []
        if not first:  # goes on after a literal mark: no space of its own before it
            head, words = [self.encoded(words[0])] if words[0] else [], words[1:]
        if "" in words:
            words = _merged(words)
        units = self.units
        if len(units) > _CACHE:
            units.clear()
        try:
            return b"".join([*head, *[units[w] for w in words]])
        except KeyError:
            for w in words:
                if w not in units:
                    units[w] = self.encoded(_SPACE + w)
            out = b"".join([*head, *[units[w] for w in words]])
            for w in words:
                if len(w) > _LONGEST:
                    units.pop(w, None)
            return out

    def decode(self, ids: np.ndarray) -> str:
        """The text that was encoded."""
        out = []
        if not hasattr(self, "raw"):
            self.raw = [bytes([self.of_byte[i]]) if i in self.of_byte else p.replace(_SPACE, " ").encode() for i, p in enumerate(self.surface)]
        raw = self.raw
        out = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


def _parts(text: str) -> list[str]:
    """The text cut around literal marks; the first part may be empty and stands for the leading space."""
    out = []
    for k, part in enumerate(text.split(_SPACE)):
        if k:
            out.append(_SPACE)
        if part or not k:
            out.append(part)
    return out


def _merged(words: list[str]) -> list[str]:
    """Words after which spaces repeat: the further marks go in front of the next word."""
    out, marks = [], ""
    for w in words:
        if w:
            out.append(marks + w)
            marks = ""
        else:
            marks += _SPACE
    # trailing spaces: a unit of marks alone (its own mark is added like any unit's)
    return [*out, marks[1:]] if marks else out


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """docs' doc_id with `ids` (little-endian 32-bit integers) and the text decoded from them again.

    A row for each row of docs; null text: as empty, no ids. Repeated and null doc_ids stay as they are. A text of any length is
    encoded whole, in one task. Other columns are ignored. No documents, no rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            ids = [pieces(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([pieces.decode(np.frombuffer(x, "<u4")) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(encode), "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_pieces, ids_sha256, decoded_sha256, exact): exact says that decoding gave the text back.

    A row for each row of docs, as encoded(): null text as empty, repeated and null doc_ids as they are, long texts whole. No documents, no rows.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            out = []
            for t in batch.column(1):
                text = t.as_py()
                ids = pieces(text)
                back = pieces.decode(np.frombuffer(ids, "<u4"))
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == text))
            n, a, b, same = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids_sha256", "decoded_sha256", "exact"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(digest), "doc_id long, n_pieces long, ids_sha256 string, decoded_sha256 string, exact boolean")
