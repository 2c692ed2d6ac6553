"""Vectorised words and rolling hashes over the UTF-8 bytes of many texts.

All word rules used here separate at ASCII bytes only, so they can be read off the bytes: in
UTF-8 no byte of a longer character is an ASCII byte.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPAN = 1 << 12
_POWER = np.cumprod(np.full(_SPAN, 0x9E3779B97F4A7C15 | 1, np.uint64))
_SEGMENT = 1 << 18

#: Separators as tables over bytes: white space; everything but ASCII letters, digits and non-ASCII.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def lowered(table: np.ndarray) -> np.ndarray:
    out = table.copy()
    out[0x41:0x5B] = table[0x61:0x7B]
    return out


_BYTE_LOWER = lowered(_BYTE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> np.uint64:
    return mix(np.array([x & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]


class Words(NamedTuple):
    start: np.ndarray  #: byte offset of each word
    end: np.ndarray
    hash: np.ndarray  #: 64 bits of the word's bytes
    first: np.ndarray  #: index of each document's first word; one entry more than documents


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool = False) -> Words:
    """Words of concatenated documents; none crosses a document's border."""
    letters = _BYTE_LOWER if lower else _BYTE
    n, starts, ends, hashes, a = len(data), [], [], [], 0
    cuts = offsets[(offsets > 0) & (offsets < n)]
    while a < n:
        b = min(n, a + _SEGMENT)
        while b < n:  # on to the next separator or document
            more = np.flatnonzero(separators[data[b : b + _SEGMENT]])
            k = np.searchsorted(cuts, b)
            to = int(cuts[k]) if k < len(cuts) else n
            b = min(b + (int(more[0]) if len(more) else _SEGMENT), to)
            if len(more) or b == to:
                break
        piece = data[a:b]
        inside = ~separators[piece]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        here = cuts[np.searchsorted(cuts, a) : np.searchsorted(cuts, b)] - a
        begins[here] = inside[here]
        s = np.flatnonzero(begins)
        if len(s):
            stops = np.zeros(len(piece) + 1, bool)
            stops[1:] = inside
            stops[1:-1] &= ~inside[1:]
            stops[here[here > 0]] |= inside[here[here > 0] - 1]
            e = np.flatnonzero(stops)
            at = np.zeros(len(piece), np.int32)
            at[s] = s
            np.maximum.accumulate(at, out=at)
            np.subtract(np.arange(len(piece), dtype=np.int32), at, out=at)
            far = bool((e - s > _SPAN).any())
            value = letters[piece] * _POWER[at & (_SPAN - 1) if far else np.minimum(at, _SPAN - 1)]
            if far:
                value *= (at // _SPAN * 2 + 1).astype(np.uint64)
            value[~inside] = 0
            h = np.add.reduceat(value, s)
            h += (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            starts.append(s + a)
            ends.append(e + a)
            hashes.append(mix(h))
        a = b
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    start, end, h = join(starts, np.int64), join(ends, np.int64), join(hashes, np.uint64)
    return Words(start, end, h, np.searchsorted(start, offsets))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k values; entry i covers i to i+k-1, the last k-1 entries are missing."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(0xD1342543DE82EF95)
        out += h[j : j + n]
    return mix(out + np.uint64(k))


def whole_windows(first: np.ndarray, k: int) -> np.ndarray:
    """True where a run of k words that starts at the word stays in its document."""
    total = int(first[-1])
    ends = np.repeat(first[1:], np.diff(first))
    return np.arange(total) + k <= ends


def covered(starts: np.ndarray, k: int, total: int) -> np.ndarray:
    """True for each of ``total`` words that a window of k words from one of ``starts`` covers."""
    steps = np.zeros(total + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + k, total), -1)
    return np.cumsum(steps[:-1]) > 0
