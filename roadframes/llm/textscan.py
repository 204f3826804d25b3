"""Array kernels over the bytes of many texts at once.

A chunk is a run of rows of one Arrow string column, seen as one array of UTF-8
bytes with the offsets of its documents. Words, lines and their 64-bit hashes come
from a few passes over that array, without a Python object per word. A chunk is
bounded by bytes; a document longer than the bound is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from roadframes.llm.process import kept

CHUNK_BYTES = 1 << 20
U64 = np.uint64
#: Fixed odd multipliers of the rolling hash and its finish.
ROLL, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def byte_table(chars: str | bytes, inverted: bool = False) -> np.ndarray:
    """Which of the 256 byte values belong to a class."""
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode() if isinstance(chars, str) else chars)] = True
    return ~out if inverted else out


NOT_SPACE = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d", inverted=True)
NOT_NEWLINE = byte_table(b"\n", inverted=True)
UPPER = byte_table(bytes(range(65, 91)))
LOWER = byte_table(bytes(range(97, 123)))
DIGIT = byte_table(b"0123456789")
LETTER = UPPER | LOWER | byte_table(bytes(range(128, 256)))
POINT = ~byte_table(bytes(range(128, 192)))  # bytes that begin a code point
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


class _Powers:
    """Powers of ROLL and of its inverse modulo 2**64, grown as needed and kept by the process."""

    @staticmethod
    def get(n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(kept().get("powers", ((),))[0]) < n:
            size = max(n, CHUNK_BYTES + 1)
            one = np.ones(size, dtype=U64)
            one[1:] = ROLL
            up = np.cumprod(one, dtype=U64)
            one[1:] = pow(ROLL, -1, 2**64)
            down = np.cumprod(one, dtype=U64)
            if size > 4 * CHUNK_BYTES:
                return up, down
            kept()["powers"] = up, down
        return kept()["powers"]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finish of a 64-bit hash."""
    x = (x ^ (x >> U64(30))) * U64(MIX_A)
    x = (x ^ (x >> U64(27))) * U64(MIX_B)
    return x ^ (x >> U64(31))


@dataclass
class Runs:
    """Maximal runs of bytes of a class, none across two documents."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


class Chunk:
    """Some documents as one byte array."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.n = len(offsets) - 1

    def take(self, docs: np.ndarray) -> Chunk:
        """The chunk of the documents at these positions."""
        size = np.diff(self.offsets)[docs]
        offsets = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(offsets[-1]) + np.repeat(self.offsets[:-1][docs] - offsets[:-1], size)
        return Chunk(self.first, self.data[at], offsets)

    def runs(self, table: np.ndarray) -> Runs:
        inside = table[self.data]
        edge = np.zeros(len(inside) + 1, dtype=bool)
        edge[self.offsets] = True
        if not len(inside):
            none = np.zeros(0, dtype=np.int64)
            return Runs(none, none, none)
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return Runs(start, end, np.searchsorted(self.offsets, start, "right") - 1)

    def totals(self, table: np.ndarray) -> np.ndarray:
        """Bytes of a class before each position."""
        return np.concatenate([[0], np.cumsum(table[self.data], dtype=np.int64)])

    def per_doc(self, totals: np.ndarray) -> np.ndarray:
        return totals[self.offsets[1:]] - totals[self.offsets[:-1]]

    def hasher(self, fold: bool = False):
        """A function of starts and ends that gives the 64-bit hashes of these byte runs."""
        n = len(self.data)
        up, down = _Powers.get(n + 1)
        data = FOLD[self.data] if fold else self.data
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum((data.astype(U64) + U64(1)) * up[:n], out=sums[1:])

        def hashes(start: np.ndarray, end: np.ndarray) -> np.ndarray:
            return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(U64) * U64(MIX_A))

        return hashes


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The rows of a string column in chunks; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield Chunk(i, data[offsets[i] : offsets[j]], (offsets[i : j + 1] - offsets[i]).astype(np.int64))
        i = j


def count(docs: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(docs, minlength=n).astype(np.int64)


def text_hash(word: str) -> int:
    """The hash that ``hasher(fold=True)`` gives a word: for lists of fixed words."""
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    chunk = Chunk(0, data, np.array([0, len(data)]))
    return int(chunk.hasher(fold=True)(np.array([0]), np.array([len(data)]))[0])


class HashIndex:
    """Places of hashes in a sorted array; a bit table turns nearly all others away."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[(keys >> U64(44)).astype(np.int64)] = True

    def places(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 for those that are not there."""
        out = np.full(len(h), -1)
        maybe = np.flatnonzero(self.bits[(h >> U64(44)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[at] == h[maybe], at, -1)
        return out
