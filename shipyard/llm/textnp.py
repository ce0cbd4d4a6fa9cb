"""Vectorised reading of many texts at once: one byte buffer, positions as arrays."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: ASCII upper case to lower case; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: ASCII letters and digits, and every byte of a non-ASCII character.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
#: Bytes that are not ASCII white space.
SOLID = np.ones(256, bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False
#: Longer words are hashed one by one.
LONG_WORD = 256


class Texts:
    """The texts of an Arrow string column: ``buf`` (uint8) and each text's start and end."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column, "") if column.null_count else column
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
        at = at.astype(np.int64)
        low, high = (int(at[0]), int(at[-1])) if len(column) else (0, 0)
        self.buf = np.frombuffer(data, np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
        self.starts, self.ends = at[:-1] - low, at[1:] - low

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def lengths(self) -> np.ndarray:
        return self.ends - self.starts

    def owner(self) -> np.ndarray:
        """The text that each byte belongs to."""
        return np.repeat(np.arange(len(self), dtype=np.int32), self.lengths)

    def spans(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes marked in ``table`` that stay inside one text: text, start, end."""
        n = len(self.buf)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        inside = table[self.buf]
        edge = np.zeros(n + 1, bool)
        edge[self.starts] = edge[self.ends] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:n]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return np.searchsorted(self.starts, start, "right") - 1, start, end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (in place)."""
    x ^= x >> U(32)
    x *= U(0x9E3779B97F4A7C15)
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


def words64(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position of ``buf`` (which must end in 8 spare bytes) as an integer."""
    return np.lib.stride_tricks.as_strided(buf[:8].view(np.uint64), shape=(len(buf) - 8,), strides=(1,))


def padded(buf: np.ndarray, lower: bool = False) -> np.ndarray:
    out = np.zeros(len(buf) + 16, np.uint8)
    if lower:
        np.take(LOWER, buf, out=out[:len(buf)])
    else:
        out[:len(buf)] = buf
    return out


def span_keys(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit key of the bytes of each span; ``buf`` comes from :func:`padded`."""
    size = (end - start).astype(np.int64)
    key = mix(size.astype(np.uint64) + U(0x51ED270B))
    if not len(size):
        return key
    at8 = words64(buf)
    long = np.flatnonzero(size > LONG_WORD)
    live = np.flatnonzero(size > 0) if not len(long) else np.flatnonzero((size > 0) & (size <= LONG_WORD))
    k = 0
    while len(live):
        left = np.minimum(size[live] - 8 * k, 8)
        eight = at8[start[live] + 8 * k] & (~U(0) >> (U(64) - left.astype(np.uint64) * U(8)))
        key[live] = mix(key[live] ^ eight)
        k += 1
        live = live[size[live] > 8 * k]
    for i in long.tolist():
        digest = hashlib.blake2b(buf[start[i]:end[i]].tobytes(), digest_size=8).digest()
        key[i] = int.from_bytes(digest, "little")
    return key
