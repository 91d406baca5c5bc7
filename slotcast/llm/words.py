"""Words of whole Arrow string columns and 64-bit hashes of word sequences, in numpy.

A word is a run of bytes other than space and 0x09-0x0D; those bytes never occur inside a
multi-byte UTF-8 character, so byte runs are the words `[^\\x20\\x09-\\x0D]+`. Null texts have no
words. Memory follows the chunk size or the longest single text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# work arrays take some 60 times as much
CHUNK_BYTES = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown by doubling."""
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, np.uint64(base), dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[key] = have
    return have[:n]


_INVERSE = pow(int(_ODD), -1, 1 << 64)


@dataclass
class Chunk:
    """Words of rows `first` .. `first + len(bounds) - 2` of the column."""

    first: int
    data: np.ndarray  # bytes of the chunk
    offsets: np.ndarray  # byte offsets of the rows in data, one more than rows
    starts: np.ndarray  # byte offsets of the words
    ends: np.ndarray
    bounds: np.ndarray  # word numbers at which rows begin, one more than rows
    hashes: np.ndarray  # uint64 per word

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.bounds))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words at every word, and which of them stay inside their row."""
        n = len(self.hashes)
        valid = np.zeros(n, dtype=bool)
        if n < k:
            return np.zeros(n, dtype=np.uint64), valid
        out = np.zeros(n, dtype=np.uint64)
        out[: n - k + 1] = sequence_hash(self.hashes, k)
        valid[: n - k + 1] = True
        for back in range(1, k):
            at = self.bounds[1:] - back
            valid[at[at >= self.bounds[:-1]]] = False
        return out, valid


def head_hashes(chunk: Chunk, size: int) -> np.ndarray:
    """Hashes of the first `size` bytes of the words that are longer, by word; 0 for the others."""
    out = np.zeros(len(chunk.starts), dtype=np.uint64)
    long = np.flatnonzero(chunk.ends - chunk.starts > size)
    at = chunk.starts[long]
    total = np.full(len(at), np.uint64(size), dtype=np.uint64)
    for j in range(size):
        total *= _ODD
        total += _BYTE_VALUES[chunk.data[at + j]]
    out[long] = mix(total)
    return out


def sequence_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values."""
    n = len(hashes) - k + 1
    total = np.full(n, np.uint64(k), dtype=np.uint64)
    for j in range(k):
        total *= _ODD
        total += hashes[j : j + n]
    return mix(total)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column: pa.Array, lower: bool = False, size: int = CHUNK_BYTES, blanks: bytes = b"") -> Iterator[Chunk]:
    """Words of a string column, in chunks of about `size` bytes of whole texts.

    `lower` folds A-Z only; `blanks` are further ASCII characters between words. Every row of the column belongs to exactly one chunk.
    """
    if len(column) == 0:
        return
    data, offsets = _buffers(column)
    blank = _BLANK.copy()
    blank[list(blanks)] = True
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        rows = offsets[first : last + 1] - offsets[first]
        yield _chunk(first, data[offsets[first] : offsets[last]], rows, lower, blank)
        first = last


def _chunk(first: int, data: np.ndarray, offsets: np.ndarray, lower: bool, blank: np.ndarray) -> Chunk:
    n = len(data)
    if lower:
        data = _LOWER[data]
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Chunk(first, data, offsets, none, none, np.zeros(len(offsets), np.int64), none.astype(np.uint64))
    word = ~blank[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (edge[:n] | ~np.concatenate(([False], word[:-1]))))
    ends = np.flatnonzero(word & (edge[1:] | ~np.concatenate((word[1:], [False])))) + 1
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _power(int(_ODD), n), out=total[1:])
    hashes = (total[ends] - total[starts]) * _power(_INVERSE, n)[starts]
    hashes = mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return Chunk(first, data, offsets, starts, ends, np.searchsorted(starts, offsets), hashes)
