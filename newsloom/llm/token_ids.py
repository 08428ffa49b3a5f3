"""Exact token ids of whole texts by a public byte-level BPE vocabulary.

Method: per-prefix dynamic programming. Every prefix of a byte string has exactly one BPE encoding, hence one last token.
A suffix automaton over the vocabulary reports all tokens that end at each byte; the last token of the prefix is the one
whose rest is a prefix already solved and whose pairing with that prefix's last token BPE would leave apart. Following the
back pointers from the end gives the ids. No merge loop is run over the text.

Texts are first split by the vocabulary's own pattern. A piece is further cut between two characters where no token holds
the two bytes that meet there, since no merge can reach over such a place; equal pieces are solved once per worker.

Defined results: null and empty texts give an empty list. Strings of special tokens are ordinary text. Texts are encoded
whole, at any length.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from newsloom.plans.runtime import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: The pattern of the vocabulary that splits a text before any merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's memories of solved pieces and of pairs; they are emptied when full, which changes no result.
MEMORY = 200_000


def byte_letters() -> dict[str, int]:
    """The letter that the vocabulary file writes for each byte: printable bytes stand for themselves, the others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Pieces(dict):
    """Piece -> its ids as bytes of 32-bit integers, solved on first use."""

    def __init__(self, solve):
        super().__init__()
        self.solve = solve

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMORY:
            self.clear()
        found = self[piece] = self.solve(piece)
        return found


class Encoder:
    """The dynamic programme over one vocabulary, given as the text of its file."""

    def __init__(self, vocabulary: str):
        import ahocorasick
        import regex

        model = json.loads(vocabulary)["model"]
        letters = byte_letters()
        ids = model["vocab"]
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joins: set[int] = set()
        self.matches = ahocorasick.Automaton()
        for token, i in ids.items():
            if all(c in letters for c in token):
                raw = bytes(letters[c] for c in token)
                self.matches.add_word(raw.decode("latin-1"), (len(raw), i))
                self.joins.update(a << 8 | b for a, b in zip(raw, raw[1:]))
        self.matches.make_automaton()
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            made = ids[a + b]
            self.merged[ids[a], ids[b]] = made
            self.parts[made] = (ids[a], ids[b])
        self.apart: dict[tuple[int, int], bool] = {}
        self.segments: dict[bytes, bytes] = {}
        self.pieces = _Pieces(self.solve)
        self.split = regex.compile(PATTERN).findall

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two tokens side by side.

        The two are taken back merge by merge, the latest first (of equal ranks the right one, merges run from the left).
        They would not both come to be if at any moment the two inner ends could have merged before the step just undone.
        """
        key = (left, right)
        known = self.apart.get(key)
        if known is not None:
            return known
        before = 1 << 30
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < before:
                answer = False
                break
            undo_left = left > right
            if undo_left and left not in self.parts:
                undo_left = False
            if not undo_left and right not in self.parts:
                if left not in self.parts:
                    answer = True
                    break
                undo_left = True
            if undo_left:
                before, left = left, self.parts[left][1]
            else:
                before, right = right + 1, self.parts[right][0]
        if len(self.apart) >= MEMORY:
            self.apart.clear()
        self.apart[key] = answer
        return answer

    def dynamic_programme(self, data: bytes) -> list[int]:
        """Ids of a byte string without any splitting."""
        last, size = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        for end, (length, token) in self.matches.iter(data.decode("latin-1")):
            at = end + 1
            if last[at] < 0:
                before = at - length
                if before == 0 or (last[before] >= 0 and self.stays_apart(last[before], token)):
                    last[at], size[at] = token, length
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def segment(self, data: bytes) -> bytes:
        found = self.segments.get(data)
        if found is None:
            found = array("i", self.dynamic_programme(data)).tobytes()
            if len(data) <= 16:
                if len(self.segments) >= MEMORY:
                    self.segments.clear()
                self.segments[data] = found
        return found

    def solve(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        if piece.isascii():
            return self.segment(data)
        joins, out, start, at = self.joins, [], 0, 0
        for c in piece:
            if at > start and (data[at - 1] << 8 | data[at]) not in joins:
                out.append(self.segment(data[start:at]))
                start = at
            o = ord(c)
            at += 1 if o < 0x80 else 2 if o < 0x800 else 3 if o < 0x10000 else 4
        out.append(self.segment(data[start:]))
        return b"".join(out)

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text as bytes of 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str | None) -> list[int]:
        return list(array("i", self.encode_bytes(text))) if text else []


_ENCODERS: dict[int, Encoder] = {}


def token_ids(documents: DataFrame, path: str = TOKENIZER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ids (array of int) of every row; one pass, no shuffle. The vocabulary file, of fixed size, is sent to the workers once."""
    spark = documents.sparkSession
    vocabulary = spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = hash(vocabulary.value)
        if mark not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[mark] = Encoder(vocabulary.value)
        encode = _ENCODERS[mark].encode_bytes
        for batch in batches:
            parts, offsets, at = [], array("i", [0]), 0
            for value in batch.column(1).to_pylist():
                if value:
                    part = encode(value)
                    parts.append(part)
                    at += len(part) // 4
                offsets.append(at)
            values = pa.Array.from_buffers(pa.int32(), at, [None, pa.py_buffer(b"".join(parts))])
            lists = pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(offsets), [None, pa.py_buffer(offsets.tobytes())]), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    rows = spread(documents.select(key, text))
    kind = documents.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"{key} {kind}, ids array<int>")
