"""Vectorised text kernels: they take the byte buffers of an Arrow column as they
are, for many documents at once, and work in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes (or symbols) that one vectorised step works on.
PIECE = 1 << 19
#: Tables below come from this rule; they need only be the same on all tasks.
_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_CODE_LOWER = BYTE_CODE[LOWER]
STEP = _RNG.integers(1, 2**64, 8, dtype=np.uint64) | U(1)
BASE = 0x9E3779B97F4A7C15 | 1
UNBASE = pow(BASE, -1, 2**64)
_POW: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, at least n of them."""
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _POW[base] = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Prefix:
    """Polynomial hashes of all substrings of a sequence, by prefix sums."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * powers(BASE, n), out=self.sums[1:])
        self.un = powers(UNBASE, n + 1)

    def of(self, lo, hi) -> np.ndarray:
        return (self.sums[hi] - self.sums[lo]) * self.un[lo]

    def grams(self, k: int) -> np.ndarray:
        return (self.sums[k:] - self.sums[:-k]) * self.un[: len(self.sums) - k]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column without nulls as (bytes, offsets)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    at = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def pieces(at: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most ``limit`` bytes together; a longer document is alone."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(data: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes other than the six ASCII white spaces) of the documents
    data[at[i]:at[i+1]]: their starts, ends and 64-bit codes, and where each
    document's words begin. ``at[0]`` may be other than 0; starts count from it."""
    data, at = data[at[0] : at[-1]], at - at[0]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = IS_WORD[data]
    edge = at[(at > 0) & (at < n)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    table, codes = BYTE_CODE_LOWER if lower else BYTE_CODE, np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):  # a step ends with a word, so that its size is bounded but by one word's length
        j = max(k + 1, int(np.searchsorted(ends, starts[k] + 2 * PIECE, "right")))
        lo = starts[k]
        h = Prefix(table[data[lo : ends[j - 1]]])
        codes[k:j] = h.of(starts[k:j] - lo, ends[k:j] - lo)
        k = j
    codes = mix(codes ^ ((ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93)))
    return starts, ends, codes, np.searchsorted(starts, at)


def shingles(codes: np.ndarray, k: int = 5) -> np.ndarray:
    """Codes of the distinct k-word shingles of one document, ascending; with
    fewer words the whole sequence is one shingle, without words there is none."""
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < k:
        total = np.uint64(n)
        with np.errstate(over="ignore"):
            for j in range(n):
                total = total * STEP[7] + codes[j] * STEP[j]
        return mix(np.array([total], np.uint64))
    total = codes[: n - k + 1] * STEP[0]
    for j in range(1, k):
        total += codes[j : n - k + 1 + j] * STEP[j]
    return np.unique(mix(total))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    n, have = len(x) - w + 1, 1
    while have < w:
        step = min(have, w - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x[:n]


def anchors(codes: np.ndarray, at: np.ndarray, k: int, w: int) -> tuple[np.ndarray, ...]:
    """Minimisers of all windows of ``w`` symbols that lie inside one document.

    Each window's anchor is its k-symbol gram of least hash, the first of equals;
    equal windows thus have the same anchor at the same place. Returns, per run of
    windows with one anchor: the gram's hash; a hash of all symbols that the run's windows cover,
    with the anchor's place; document; first window's start; windows less one; anchor's place after that start."""
    out = []
    n = len(codes)
    step = max(PIECE, w)
    for b in range(0, max(0, n - w + 1), step):
        part = codes[b : b + step + w - 1]
        h = Prefix(part)
        grams = mix(h.grams(k))
        keyed = (grams & U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        least = (sliding_min(keyed, w - k + 1) & U(0xFFFFFFFF)).astype(np.int64)
        valid = np.ones(len(least), bool)
        for o in at[(at > b) & (at < b + len(part))] - b:
            valid[max(0, o - w + 1) : o] = False
        s = np.flatnonzero(valid)
        if not len(s):
            continue
        a = least[s]
        new = np.ones(len(s), bool)
        new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)
        i = np.flatnonzero(new)
        s0, s1, an = s[i], s[np.append(i[1:], len(s)) - 1], a[i]
        place = ((an - s0) << 16 | (s1 - s0)).astype(np.uint64)
        place = mix(place + U(0x2545F4914F6CDD1D))
        cover = mix(h.of(s0, s1 + w) ^ place)
        doc = np.searchsorted(at, s0 + b, "right") - 1
        out.append((grams[an], cover, doc, s0 + b - at[doc], s1 - s0, an - s0))
    if not out:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), z, z, z, z
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the half-open spans."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0
