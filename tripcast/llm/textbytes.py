"""Words, lines and rolling hashes over the UTF-8 bytes of a whole batch, as numpy passes.

A hash of a short stretch is a polynomial in an odd base modulo 2**64 over seeded
values of its elements, mixed at the end; stretches of one batch are compared
through prefix sums, so any stretch costs two look-ups. Modulo a power of two some
long regular stretches (Thue-Morse words) collide under every base; what is longer
than ``SHORT`` elements is therefore hashed as bytes (BLAKE2b). Up to there, such
pairs still differ in 29 bits or more before mixing.
"""

from __future__ import annotations

import hashlib

import numpy as np

_SPACE = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[_SPACE] = False
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` once A-Z are lower-cased: digits, a-z and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_VALUES = [np.random.default_rng(7 + i).integers(1, 2**63, 256, dtype=np.uint64) for i in range(2)]
_powers: dict[tuple[int, bool], np.ndarray] = {}
SHORT = 128


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def powers(n: int, which: int = 0, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) (or of its inverse) modulo 2**64, kept for the next batch."""
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        base = int(_BASES[which])
        steps = np.full(max(n, 1 << 20), np.uint64(_inverse(base) if inverse else base))
        steps[0] = 1
        have = _powers[which, inverse] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Prefix:
    """Hashes of stretches of a sequence of 64-bit values (or bytes, by their seeded values)."""

    def __init__(self, values: np.ndarray, which: int = 0):
        self.which, self.values, n = which, values, len(values)
        if values.dtype == np.uint8:
            values = _VALUES[which][values]
        elif which:
            values = mix(values ^ np.uint64(0xA5A5A5A55A5A5A5A))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(n, which), out=self.sums[1:])
        self.back = powers(n + 1, which, True)

    def stretches(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = mix((self.sums[ends] - self.sums[starts]) * self.back[starts])
        for i in np.flatnonzero(ends - starts > SHORT).tolist():
            digest = hashlib.blake2b(self.values[starts[i]: ends[i]].tobytes(), digest_size=8, salt=bytes([self.which]))
            out[i] = int.from_bytes(digest.digest(), "little")
        return out

    def windows(self, k: int) -> np.ndarray:
        """Hash of every k (at most SHORT) consecutive elements, without regard to row bounds."""
        assert k <= SHORT
        m = max(0, len(self.sums) - k)
        return mix((self.sums[k: k + m] - self.sums[:m]) * self.back[:m])


def word_spans(raw: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word bounds of rows) of maximal runs of bytes that are in ``kind``; no run crosses a row."""
    n = len(raw)
    if n == 0:
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(bounds), np.int64)
    is_word = kind[raw]
    edge = bounds[(bounds > 0) & (bounds < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = is_word[:-1]
    before[edge] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    after[edge - 1] = False
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def per_row(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``mask`` in every row."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def row_of(bounds: np.ndarray) -> np.ndarray:
    """Row number of every element."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def window_starts(bounds: np.ndarray, k: int) -> np.ndarray:
    """Mask over elements: k elements of the same row start here."""
    ok = np.zeros(int(bounds[-1]) + 1, np.int64)
    lengths = np.diff(bounds)
    has = lengths >= k
    np.add.at(ok, bounds[:-1][has], 1)
    np.add.at(ok, bounds[1:][has] - k + 1, -1)
    return np.cumsum(ok)[:-1] > 0


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Mask over n elements: inside one of the windows of k elements at ``starts``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + k, -1)
    return np.cumsum(change)[:-1] > 0


def repeated_in_row(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of elements whose hash occurs twice or more in their row, positions of those that are not the first)."""
    if len(hashes) == 0:
        zero = np.zeros(0, np.int64)
        return zero, zero
    key = hashes ^ mix(rows.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = (key[order][1:] == key[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    return order[same[:-1] | same[1:]], order[same[:-1]]
