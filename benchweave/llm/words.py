"""Words of whole texts as arrays: splitting and hashing for Arrow batches, a few vector operations per batch.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``. Its hash is a polynomial in a random byte table
modulo 2^64, mixed afterwards; equal words have equal hashes everywhere, since table and multipliers are constants.
Such polynomials collide by construction on some inputs of 1,024 and more terms, whatever the constants: words of more
than ``LONG_WORD`` bytes are digested otherwise, and ranges of many words are polynomials modulo the prime 2^61 - 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
LONG_WORD = 128
_PRIME = np.uint64((1 << 61) - 1)
_MASK = (1 << 64) - 1


def _mixed(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that sums of powers of them collide only by chance."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> Powers:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        return self


_BYTES = np.array([_mixed(i) for i in range(256)], dtype=np.uint64)
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
_LETTERS = Powers(0xD6E8FEB86659FD93)
_OTHER_BYTES = np.array([_mixed(i + 1000) for i in range(256)], dtype=np.uint64)
_OTHER_LETTERS = Powers(0x9E3779B185EBCA87)
_SEQUENCE = Powers(0xA0761D6478BD642F)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_slices(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges with about ``size`` bytes of text each, one row at least; whole texts always stay together."""
    ends = np.cumsum(np.fromiter((0 if n is None else n for n in pc.binary_length(texts).to_pylist()), dtype=np.int64, count=len(texts)))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield start, stop
        start = stop


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each followed by one space, and the end of each text (nulls are empty)."""
    parts = [b"" if t is None else t for t in texts.cast(pa.large_binary()).to_pylist()]
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1
    return np.frombuffer(b" ".join([*parts, b""]), dtype=np.uint8), np.cumsum(sizes)


class Words:
    """Words of several texts: byte ``starts`` and ``ends`` in ``data``, ``hashes``, and ``offsets`` of each text's words."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.data, ends = text_buffer(texts)
        if lower:
            self.data = LOWER[self.data]
        inside = _IN_WORD[self.data].view(np.int8)
        steps = np.diff(inside, prepend=np.int8(0))
        self.starts = np.flatnonzero(steps == 1)
        self.ends = np.flatnonzero(steps == -1)
        self.hashes = self._hashes()
        self.offsets = np.concatenate([[0], np.searchsorted(self.starts, ends)]).astype(np.int64)

    def _hashes(self, table: np.ndarray = _BYTES, letters: Powers = _LETTERS, part: int = 0) -> np.ndarray:
        """Block by block, so that the temporary arrays stay small even for one huge text."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        first = 0
        while first < len(self.starts):
            base = self.starts[first]
            stop = max(first + 1, int(np.searchsorted(self.starts, base + BLOCK)))
            s, e = self.starts[first:stop] - base, self.ends[first:stop] - base
            values = table[self.data[base : base + e[-1] + 1]]
            powers = letters.to(len(values))
            values *= powers.up[: len(values)]
            marks = np.empty(2 * len(s), dtype=np.int64)
            marks[::2], marks[1::2] = s, e
            out[first:stop] = np.add.reduceat(values, marks)[::2] * powers.down[s]
            first = stop
        # The length takes part, since trailing bytes of value zero could otherwise vanish only by the table's choice.
        out = mix(out + (self.ends - self.starts).astype(np.uint64))
        for i in np.flatnonzero(self.ends - self.starts > LONG_WORD).tolist():
            digest = hashlib.blake2b(self.data[self.starts[i] : self.ends[i]].tobytes(), digest_size=16).digest()
            out[i] = int.from_bytes(digest[8 * part : 8 * part + 8], "little")
        return out

    @property
    def second(self) -> np.ndarray:
        """Word hashes from another table and multiplier, independent of ``hashes``."""
        return self._hashes(_OTHER_BYTES, _OTHER_LETTERS, 1)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def _windows(hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray, powers: Powers) -> np.ndarray:
    powers.to(len(hashes) + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * powers.up[: len(hashes)], dtype=np.uint64)])
    return mix((sums[stops] - sums[starts]) * powers.down[starts])


def range_hashes(hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each short range ``[start, stop)`` of a hash sequence, such as a shingle; equal sequences hash
    alike anywhere. Ranges of hundreds of words take ``sequence_hashes``."""
    return _windows(hashes, starts, stops, _SEQUENCE)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2^61 - 1 of numbers below it, in 64-bit arithmetic."""
    low, high = np.uint64((1 << 32) - 1), np.uint64(32)
    a0, a1, b0, b1 = a & low, a >> high, b & low, b >> high  # a1 and b1 are below 2^29
    cross = a0 * b1 + a1 * b0  # below 2^62
    middle = cross & np.uint64((1 << 29) - 1)
    out = (a1 * b1 << np.uint64(3)) + (cross >> np.uint64(29)) + (middle << np.uint64(32)) % _PRIME  # 2^64 = 8, 2^61 = 1
    low_part = a0 * b0
    out = (out & _PRIME) + (out >> np.uint64(61)) + (low_part & _PRIME) + (low_part >> np.uint64(61))
    out = (out & _PRIME) + (out >> np.uint64(61))
    return np.where(out >= _PRIME, out - _PRIME, out)


class PrimePowers:
    """Powers of a base and of its inverse modulo 2^61 - 1, grown on demand by doubling."""

    def __init__(self, base: int):
        prime = int(_PRIME)
        self.bases = base % prime, pow(base, -1, prime)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> PrimePowers:
        while len(self.up) < n:
            step = [np.uint64(pow(b, len(self.up), int(_PRIME))) for b in self.bases]
            self.up, self.down = (np.concatenate([p, _times(p, np.full(len(p), s, dtype=np.uint64))]) for p, s in zip((self.up, self.down), step, strict=True))
        return self


_BASES = PrimePowers(0x1B873593CC9E2D51), PrimePowers(0x0FE0A94C85EBCA6B)


def sequence_hashes(hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: int = 0) -> np.ndarray:
    """One hash below 2^61, mixed, for each range ``[start, stop)`` of any length; equal sequences hash alike anywhere."""
    powers = _BASES[base].to(len(hashes) + 1)
    terms = _times(hashes % _PRIME, powers.up[: len(hashes)])
    # Running sums of both halves stay below 2^64 for up to 2^32 words, and are reduced afterwards.
    half = np.uint64((1 << 31) - 1)
    low, high = np.cumsum(terms & half, dtype=np.uint64) % _PRIME, np.cumsum(terms >> np.uint64(31), dtype=np.uint64) % _PRIME
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), (low + _times(high, np.full(len(high), 1 << 31, dtype=np.uint64))) % _PRIME])
    return mix(_times((sums[stops] + _PRIME - sums[starts]) % _PRIME, powers.down[starts]))
