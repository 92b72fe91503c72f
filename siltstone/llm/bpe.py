"""Problem 8: byte-level BPE with the vocabulary of a public tokenizer.

A text is cut by the tokenizer's pattern; each piece is a doubly linked list of symbols whose adjacent pairs wait in a
priority queue by merge rank. Pairs that no longer stand when they come up are stale and skipped. Pieces repeat, so each task
keeps the ids of the pieces it has met, up to a fixed number. Decoding concatenates the vocabulary's strings.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KEPT_PIECES, KEPT_CHARS = 300_000, 64  # pieces whose ids a task keeps, and the longest of them
ROWS = 1_000  # texts encoded before they are handed on

# Fixed value: the pattern that cuts a text into pieces before merging, as the public tokenizer defines it.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same pattern where a text has only ASCII characters, which a simpler engine matches faster.
ASCII_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\x0b\x0cA-Za-z0-9]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+"""


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Token bytes to id (also its merge rank) from the lines of a vocabulary file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece. The lowest rank merges first, of equal ranks the leftmost."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    start = list(range(n))  # symbol i covers piece[start[i]:end[i]]
    end = list(range(1, n + 1))
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(queue)
    alive = [True] * n
    while queue:
        _, i, stop = heappop(queue)
        j = right[i]
        if not alive[i] or j < 0 or end[j] != stop:
            continue  # stale: one of the two has been merged since
        end[i] = stop
        alive[j] = False
        right[i] = k = right[j]
        if k >= 0:
            left[k] = i
            if (r := ranks.get(piece[start[i] : end[k]])) is not None:
                heappush(queue, (r, i, end[k]))
        h = left[i]
        if h >= 0 and (r := ranks.get(piece[start[h] : stop])) is not None:
            heappush(queue, (r, h, stop))
    return [ranks[piece[start[i] : end[i]]] for i in range(n) if alive[i]]


class _Pieces(dict):
    """Piece to its packed ids, worked out when first asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(merge(piece.encode(), self.ranks), np.int32).tobytes()
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Tokenizer:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, lines: bytes):
        self.ranks = read_ranks(lines)
        self.pieces = _Pieces(self.ranks)
        self._cut, self._cut_ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall

    def packed(self, text: str) -> bytes:
        """The ids as consecutive 32-bit numbers."""
        cut = self._cut_ascii if text.isascii() else self._cut
        return b"".join(map(self.pieces.__getitem__, cut(text)))

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens, whose strings are ordinary text; none for an empty or null text."""
        return np.frombuffer(self.packed(text), np.int32).tolist() if text else []

    def decode(self, ids: list[int]) -> str:
        strings = {i: t for t, i in self.ranks.items()} if not hasattr(self, "_strings") else self._strings
        self._strings = strings
        return b"".join(strings[i] for i in ids).decode("utf-8", "replace")


@lru_cache(1)
def _tokenizer(lines: bytes) -> Tokenizer:
    return Tokenizer(lines)


def _lines(df: DataFrame, path: str):
    """The vocabulary file, sent to the executors once; its size does not depend on the data."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _map(lines, column: int, build: Callable[[list[bytes]], pa.Array], name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with the text column replaced by what ``build`` makes of the texts' packed ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(lines.value)
        for whole in batches:
            for b in (whole.slice(a, ROWS) for a in range(0, whole.num_rows, ROWS)):
                packed = [t.packed(x) if x else b"" for x in b.column(column).to_pylist()]
                cols = [build(packed) if i == column else c for i, c in enumerate(b.columns)]
                yield pa.RecordBatch.from_arrays(cols, names=[name if i == column else f.name for i, f in enumerate(b.schema)])

    return run


def _lists(packed: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(packed), np.int32)))


def _counts(packed: list[bytes]) -> pa.Array:
    return pa.array([len(p) // 4 for p in packed], pa.int64())


def encode(df: DataFrame, id_column: str, text_column: str, path: str = VOCABULARY) -> DataFrame:
    """``id_column`` and ids (list of integers) for every row. Null and empty texts give an empty list. Rows stay as they
    are: repeated ids stay repeated, a null id stays null. Other columns are ignored, whatever their names."""
    rows = df.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    kind = df.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(_map(_lines(df, path), 1, _lists, "ids"), f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_column)


def count_tokens(df: DataFrame, id_column: str, text_column: str, path: str = VOCABULARY) -> DataFrame:
    """``id_column`` and n_tokens for every row, 0 for null and empty texts."""
    rows = df.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    kind = df.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(_map(_lines(df, path), 1, _counts, "n_tokens"), f"_id {kind}, n_tokens long").withColumnRenamed("_id", id_column)


def decode(df: DataFrame, id_column: str, ids_column: str, path: str = VOCABULARY) -> DataFrame:
    """``id_column`` and text; null ids give an empty text."""
    lines = _lines(df, path)
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(lines.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["_id", "text"])

    return df.select(F.col(id_column).alias("_id"), ids_column).mapInArrow(run, f"_id {kind}, text string").withColumnRenamed("_id", id_column)
