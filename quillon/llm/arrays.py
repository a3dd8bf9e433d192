"""Vectorised word splitting and hashing over Arrow string columns.

A word is a maximal run of bytes other than space, tab, LF, VT, FF and CR.
All hashes are 64-bit, fixed across processes and machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
GRAM = U(0xD6E8FEB86659FD93)
CHUNK_BYTES = 3_000_000
HASH_BLOCK = 1 << 19


def odd_inverse(x: int) -> int:
    """Inverse of an odd number modulo 2**64."""
    return pow(int(x), -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i up to n, kept for the next call when not huge."""
    size = 1 << max(10, int(n).bit_length())
    got = _tables.get((int(base), size))
    if got is None:
        got = powers(base, size), powers(odd_inverse(base), size)
        if size <= HASH_BLOCK * 2:
            _tables[(int(base), size)] = got
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; spreads every input bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _space_table(extra: bytes = b"") -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E), *extra]] = True
    return table


SPACE = _space_table()
#: Every ASCII byte that is neither letter nor digit; bytes of multi-byte characters stay in words.
PUNCT = _space_table(bytes(b for b in range(128) if not chr(b).isalnum()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """The words of some texts: byte bounds, and for each text its range of words."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE, lower: bool = False):
        lo, hi = int(offsets[0]), int(offsets[-1])
        buf = buf[lo:hi]
        self.buf = LOWER[buf] if lower else buf
        self.offsets = offsets - lo
        n = len(buf)
        solid = ~space[buf]
        cut = np.zeros(n + 1, dtype=bool)
        cut[self.offsets] = True
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0] = after[-1] = True
            before[1:] = ~solid[:-1]
            after[:-1] = ~solid[1:]
            before |= cut[:n]
            after |= cut[1:]
        self.start = np.flatnonzero(solid & before)
        self.end = np.flatnonzero(solid & after) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()

    def hashes(self) -> np.ndarray:
        """One hash for each word, of its bytes only."""
        out = np.empty(len(self), dtype=U)
        i, n = 0, len(self)
        while i < n:
            a = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, a + HASH_BLOCK, side="right")))
            b = self.end[j - 1]
            up, down = power_tables(int(BASE), int(b - a))
            total = np.zeros(b - a + 1, dtype=U)
            np.cumsum((self.buf[a:b].astype(U) + U(1)) * up[: b - a], out=total[1:])
            s, e = self.start[i:j] - a, self.end[i:j] - a
            out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U) * GRAM)
            i = j
        return out


class Rolling:
    """Hashes of any run of consecutive items, in constant time for each."""

    def __init__(self, items: np.ndarray, base: int = int(GRAM)):
        n = len(items)
        up, self.down = power_tables(base, n + 1)
        self.total = np.zeros(n + 1, dtype=U)
        np.cumsum(items * up[:n], out=self.total[1:])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(U))

    def grams(self, k: int) -> np.ndarray:
        n = max(0, len(self.total) - k)
        return mix((self.total[k : k + n] - self.total[:n]) * self.down[:n] + U(k))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, in linear time."""
    n = len(x)
    if n < w:
        return x[:0]
    pad = (-n) % w
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, dtype=x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def slices(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about so many bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
