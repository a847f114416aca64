"""Vectorised word splitting and hashing over the UTF-8 bytes of many documents at once."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_GOLDEN = U64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are runs of digits, letters and bytes above 0x7F, once A-Z are lower-cased.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
#: Tokens are runs of anything but white space.
TOKEN = np.ones(256, bool)
TOKEN[[0x20, 9, 10, 11, 12, 13]] = False
_VALUE = mix(np.arange(1, 257, dtype=U64) * _GOLDEN)

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, U64(base))
            x[0] = U64(1)
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash; one longer than the data."""
    up, _ = powers(len(data) + 1)
    out = np.empty(len(data) + 1, U64)
    out[0] = 0
    np.cumsum(_VALUE[data] * up[: len(data)], out=out[1:])
    return out


def substring_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal for equal bytes."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64) * _GOLDEN)


def runs(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of member bytes inside each document: starts, ends, and each document's first run."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = member[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside & edge[:-1]
    first[1:] |= inside[1:] & ~inside[:-1]
    last = inside & edge[1:]
    last[:-1] |= inside[:-1] & ~inside[1:]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts, ends, hashes, and each document's first word (one more at the end)."""
    low = LOWER[data]
    starts, ends, first = runs(low, offsets, member)
    return low, starts, ends, substring_hash(prefix(low), starts, ends), first


class Known:
    """Values of sorted 64-bit hashes, found by the hashes' top bits. ``ordered`` arrays are kept as they are."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, ordered: bool = False):
        bits = max(len(keys), 2).bit_length() + 1
        if not ordered:
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], values[order]
        self.keys, self.values, self.shift = keys, values, U64(64 - bits)
        self.starts = np.full((1 << bits) + 1, len(keys), np.int32)
        for lo in range(0, 1 << bits, 1 << 16):  # in steps, since a worker has little room beside the arrays
            top = np.arange(lo, min(1 << bits, lo + (1 << 16)), dtype=U64)
            self.starts[lo : lo + len(top)] = np.searchsorted(keys, top << self.shift)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key's first occurrence, -1 where a key isn't there."""
        top = (keys >> self.shift).astype(np.int64)
        place, left = self.starts[top], self.starts[top + 1]
        left -= place
        out = np.full(len(keys), -1, np.int32)
        which = np.flatnonzero(left)
        place, left = place[which], left[which]
        while len(which):
            same = self.keys[place] == keys[which]
            out[which[same]] = place[same]
            going = np.flatnonzero(~same & (left > 1))
            which, place, left = which[going], place[going] + 1, left[going] - 1
        return out


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ..., counts[0] of them, then those of starts[1], ..."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    nonzero = counts > 0
    s, c = starts[nonzero], counts[nonzero]
    head = np.cumsum(c) - c
    out[head] = s
    out[head[1:]] -= s[:-1] + c[:-1] - 1
    return np.cumsum(out)
