"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a single-pass Viterbi.

The automaton over all pieces walks once over a stretch of text; at each position its output links
name the pieces that end there, and each relaxes the best score at that position. No piece has a
space mark behind its first characters, so a text falls into stretches that can be solved one by one
without changing the optimum; frequent stretches are solved once per worker.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import ship

MARK = "▁"
#: Default place of the model; a parameter of every function that needs one.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Stretches that a worker remembers; at so many it starts anew.
MAX_REMEMBERED = 300_000
#: Added to the least score for a character that is no piece; it is spelt in bytes.
FALLBACK_PENALTY = -10.0
#: Pieces with a score below this are never meant to win and don't set the least score.
NEVER = -1e8
NONE = float("-inf")
#: Rows that are encoded at a time.
ROWS = 256


def load_pieces(path: str = MODEL_PATH) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id; kind is "normal", "byte" or "control". Bounded by the vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if model.is_byte(i) else "control" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "normal"
    return [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())]


class Codec:
    """Encoder and decoder over a list of pieces."""

    def __init__(self, pieces: list[tuple[str, float, str]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.bytes_of = [b""] * len(pieces)
        self.byte_ids = {}
        normal = [(i, p, s) for i, (p, s, k) in enumerate(pieces) if k == "normal"]
        for i, piece, score in normal:
            if MARK in piece.lstrip(MARK):
                raise ValueError("a piece has a space mark inside")
            self.automaton.add_word(piece, (len(piece), i, score))
            self.bytes_of[i] = piece.replace(MARK, " ").encode()
        for i, (piece, _, kind) in enumerate(pieces):
            if kind == "byte":
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
        if len(self.byte_ids) < 256:
            raise ValueError("the model has no byte pieces to fall back on")
        self.is_byte = np.array([k == "byte" for _, _, k in pieces])
        self.automaton.make_automaton()
        self.fallback = min(s for _, _, s in normal if s > NEVER) + FALLBACK_PENALTY
        self.covered = frozenset(p for _, p, _ in normal if len(p) == 1)
        self.breaks = "\n" if not any("\n" in p for _, p, _ in normal) else None
        self.marked: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def solve(self, stretch: str, literal: str = "") -> list[int]:
        """Ids of the best segmentation of a stretch with marks for spaces.

        Of equal scores the one with the longer last piece wins. ``literal`` stands for the mark itself.
        """
        n = len(stretch)
        best, back, ids = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        at, fallback, covered = 0, self.fallback, self.covered
        for end, (length, piece, score) in self.automaton.iter(stretch):
            end += 1
            while at < end:
                best[at + 1], back[at + 1] = NONE if stretch[at] in covered else best[at] + fallback, at
                at += 1
            if (total := best[end - length] + score) > best[end]:
                best[end], back[end], ids[end] = total, end - length, piece
        while at < n:
            best[at + 1], back[at + 1] = best[at] + fallback, at
            at += 1
        found: list[int] = []
        while n:
            if ids[n] >= 0:
                found.append(ids[n])
            else:
                c = stretch[n - 1]
                found += [self.byte_ids[b] for b in reversed((MARK if c == literal else c).encode())]
            n = back[n]
        found.reverse()
        return found

    def _lookup(self, words: list[str], memory: dict[str, bytes], prefix: str) -> list[bytes]:
        out = []
        for w in words:
            got = memory.get(w)
            if got is None:
                if len(memory) >= MAX_REMEMBERED:
                    memory.clear()
                got = memory[w] = np.array(self.solve(prefix + w), dtype="<i4").tobytes()
            out.append(got)
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text, a space mark before it; none for an empty one. Every text can be decoded again."""
        if not text:
            return np.empty(0, dtype="<i4")
        if MARK in text:  # the mark itself is spelt in bytes; a character that the text lacks stands for it
            literal = next(c for c in map(chr, itertools.count(0xF0000)) if c not in text)
            return np.array(self.solve((MARK + text.replace(MARK, literal)).replace(" ", MARK), literal), dtype="<i4")
        parts: list[bytes] = []
        for i, line in enumerate(text.split(self.breaks) if self.breaks else [text]):
            if i:
                parts += self._lookup([self.breaks], self.bare, "")
            first, *words = line.split(" ")
            if not i:
                words, first = [first, *words], ""
            if first:
                parts += self._lookup([first], self.bare, "")
            if "" in words:  # runs of spaces stay with the word behind them
                marks, joined = 0, []
                for w in words:
                    if w:
                        joined.append(MARK * marks + w)
                        marks = 0
                    else:
                        marks += 1
                words = joined + [MARK * (marks - 1)] * bool(marks)
            parts += self._lookup(words, self.marked, MARK)
        return np.frombuffer(b"".join(parts), dtype="<i4")

    def decode(self, ids) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode()[1:]


_codecs: dict[str, Codec] = {}


def codec_of(pieces: list[tuple[str, float, str]]) -> Codec:
    """A worker's codec, built once for a list of pieces and kept for its next tasks."""
    key = hashlib.md5(repr(pieces).encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(pieces)
    return _codecs[key]


def _with_tokens(frame: DataFrame, model_path: str, text: str, added: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    shared = ship(frame.sparkSession).sparkContext.broadcast(load_pieces(model_path))
    rest = [c for c in frame.columns if c != text]

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = batch.column(text).to_pylist()
                ids = [codec.encode(t) for t in texts]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                same = [codec.decode(x.tolist()) == (t or "") for x, t in zip(ids, texts, strict=True)]
                made = {
                    "n_tokens": pa.array(np.diff(offsets).astype(np.int64)),
                    "n_byte_tokens": pa.array([int(codec.is_byte[x].sum()) for x in ids], pa.int64()),
                    "tokens": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else [], pa.int32())),
                    "tokens_sha256": pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]),
                    "round_trip": pa.array(same),
                }
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *[made[k] for k, _ in added]], names=[*rest, *[k for k, _ in added]])

    return frame.mapInArrow(tokenised, schema)


ADDED = "n_tokens long, n_byte_tokens long, tokens array<int>, tokens_sha256 string, round_trip boolean"


def encode_documents(docs: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """doc_id with n_tokens, n_byte_tokens, tokens, tokens_sha256 (of little-endian 32-bit ids) and
    round_trip (whether the decoded tokens are the text), one row per row of ``docs``.

    Null and empty texts have no tokens and decode to the empty text. Texts are encoded whole. Equal
    texts get equal tokens; an empty table gives an empty result; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [(x.split()[0], None) for x in ADDED.split(", ")]
    return _with_tokens(docs.select("doc_id", "text"), model_path, "text", names, f"doc_id {kind}, {ADDED}")


def decode_tokens(encoded: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """doc_id and text of encoded documents; null tokens give an empty text."""
    shared = ship(encoded.sparkSession).sparkContext.broadcast(load_pieces(model_path))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for batch in batches:
            texts = [codec.decode(x or []) for x in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "tokens").mapInArrow(decoded, f"doc_id {kind}, text string")
