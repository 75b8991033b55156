"""Vectorised text kernels that the Arrow operators share.

Everything works on the raw UTF-8 buffer of an Arrow string column, so a block of documents is handled by a few numpy
passes and never by a loop over words.  Hashes are seeded by constants, so every executor computes the same values.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U64 = np.uint64
_LIBC = ctypes.CDLL(None)
#: Bytes of text that one numpy pass handles; a longer single document is a block of its own.
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); a bijection of uint64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random uint64 values for a seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + mix(np.array([seed], U64)))


#: A word is hashed as the value of a polynomial modulo a prime, whose coefficients are its bytes: words of n bytes share a
#: value for at most n of the prime's points, whatever their pattern. Longer words than LONG go by a cryptographic hash.
_PRIME, LONG = (1 << 61) - 1, 1 << 20
_POINT = int(stream(12, 1)[0]) % _PRIME
_LETTER = np.arange(1, 257, dtype=U64)
_LETTER[65:91] = _LETTER[97:123]  # A-Z hash as a-z
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = _FOLD[97:123]
_point_powers: list[np.ndarray] = [np.ones(1, U64), np.zeros(1, U64)]
_BASE = int(stream(12, 1)[0]) | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = stream(13, 64) | U64(1)
_SHORT = stream(14, 8)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(max(n, BLOCK_BYTES + 1), base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers[0], _powers[1]


def _point_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The low 32 and the high bits of at least n powers of the point."""
    have = len(_point_powers[0])
    if have < n:
        power = (int(_point_powers[1][-1]) << 32) | int(_point_powers[0][-1])
        more = []
        for _ in range(max(2 * n, 4096) - have):
            power = power * _POINT % _PRIME
            more.append(power)
        more = np.array(more, U64)
        _point_powers[:] = np.r_[_point_powers[0], more & U64(0xFFFFFFFF)], np.r_[_point_powers[1], more >> U64(32)]
    return _point_powers[0], _point_powers[1]


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], ..., start[0] + size[0] - 1, start[1], ... of ranges of a size of one at least."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def release() -> None:
    """Gives a worker's free memory back to the system; workers are kept for later tasks, and would keep it with them."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def tidy(fn: Callable) -> Callable:
    """The same function over batches, with the worker's free memory given back at the end of a task."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            release()

    return run


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The named string column with nulls as empty texts."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.fill_null("") if col.null_count else col


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column without nulls; no copy of the bytes."""
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offs, data = col.buffers()
    if len(col) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def blocks(batch: pa.RecordBatch, text: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with at most limit bytes, or a single longer row."""
    data, offs = buffers(column(batch, text))
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a block of texts, A-Z folded: byte spans, 64-bit hashes and the first word of each row.

    first has one entry more than there are rows; row i has the words first[i]:first[i+1].
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        n = len(data)
        solid = ~_SPACE[data]
        starts, ends = solid.copy(), solid.copy()
        starts[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        inner = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < n)]
        starts[inner] = solid[inner]
        ends[inner - 1] = solid[inner - 1]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offs)
        self.data = data
        self.hash = self._hashed(data[solid])

    def _hashed(self, letters: np.ndarray) -> np.ndarray:
        size = self.end - self.start
        if not len(size):
            return np.zeros(0, U64)
        head = np.cumsum(size) - size
        place = np.arange(len(letters)) - np.repeat(head, size)
        longest = int(size.max())
        if longest > LONG:
            place = np.minimum(place, LONG - 1)
        low, high = _point_tables(min(longest, LONG))
        value = _LETTER[letters]
        # sums of at most LONG products of 9 and 32 bits don't overflow
        low, high = np.add.reduceat(value * low[place], head), np.add.reduceat(value * high[place], head)
        total = low + (high >> U64(29)) + ((high & U64((1 << 29) - 1)) << U64(32))
        total = (total & U64(_PRIME)) + (total >> U64(61))
        total = np.where(total >= _PRIME, total - U64(_PRIME), total)
        for i in np.flatnonzero(size > LONG).tolist():
            word = _FOLD[letters[head[i] : head[i] + size[i]]].tobytes()
            total[i] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return mix(total + (size.astype(U64) << U64(61)))

    def shingles(self, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the word shingles in order and the first shingle of each row; a row of fewer words (but any) has one shingle."""
        h, first = self.hash, self.first
        words = np.diff(first)
        n = len(h)
        acc = np.zeros(n, U64)
        for k in range(width):
            acc[: max(0, n - k)] += h[k:] * _STEP[k]
        count = np.where(words >= width, words - width + 1, (words > 0).astype(np.int64))
        short = np.flatnonzero((words > 0) & (words < width))
        for i in short.tolist():
            own = h[first[i] : first[i + 1]]
            acc[first[i]] = (own * _STEP[: len(own)]).sum(dtype=U64) ^ _SHORT[len(own)]
        at = np.zeros(len(words) + 1, np.int64)
        np.cumsum(count, out=at[1:])
        keep = np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])
        self.begin, self.wide = keep, np.repeat(np.minimum(words, width), count)
        return mix(acc[keep]), at

    def distinct(self, shingles: np.ndarray) -> bool:
        """Whether equal hashes of words and of the shingles made last stand for equal words throughout the block."""
        order = np.argsort(self.hash, kind="stable")
        same = self.hash[order[1:]] == self.hash[order[:-1]]
        a, b = order[:-1][same], order[1:][same]
        size = self.end[a] - self.start[a]
        if (size != self.end[b] - self.start[b]).any():
            return False
        step = max(1, BLOCK_BYTES // max(1, int(size.max(initial=1))))
        for k in range(0, len(a), step):
            x, y = (_FOLD[self.data[ranges(self.start[i[k : k + step]], size[k : k + step])]] for i in (a, b))
            if not np.array_equal(x, y):
                return False
        order = np.argsort(shingles, kind="stable")
        same = shingles[order[1:]] == shingles[order[:-1]]
        a, b = order[:-1][same], order[1:][same]
        if (self.wide[a] != self.wide[b]).any():
            return False
        for k in range(int(self.wide.max(initial=0))):
            own = self.wide[a] > k
            if (self.hash[self.begin[a[own]] + k] != self.hash[self.begin[b[own]] + k]).any():
                return False
        return True


class Bloom:
    """A read-only Bloom filter over 64-bit values; words is a power-of-two-sized uint64 array."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = U64(len(words) * 64 - 1)

    def has(self, x: np.ndarray) -> np.ndarray:
        found = np.ones(len(x), bool)
        for seed in (0x51, 0x52):
            bit = mix(x.astype(U64) ^ U64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & self.mask
            found &= (self.words[(bit >> U64(6)).astype(np.int64)] >> (bit & U64(63)) & U64(1)).astype(bool)
        return found


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == U64 else x.astype(np.int64)
