"""Rolling polynomial hashes and winnowed runs of windows, vectorised with numpy.

Arithmetic is modulo 2**64 with an odd base, so that a prefix sum gives the hash of any
span: ``(S[i + n] - S[i]) * base**-i``.  A polynomial modulo 2**64 confuses certain sequences
of 2**10 tokens and more (Thue-Morse), so spans are those of runs, some dozens of tokens long;
words, which may be of any length, have hashes of another kind (``word_tokens``).  Texts are joined into one token array with the
bounds of each document, and no span crosses a bound.

A window of ``width`` tokens is represented by the smallest gram hash inside it (ties:
the leftmost).  Windows of one document that share that gram stand next to each other
and form a *run*.  Equal windows have equal grams at equal places, so equal windows can
only be found in runs with the same gram: runs, not windows, need to be shuffled.
"""

from __future__ import annotations

import numpy as np
import xxhash

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_U = np.uint64
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that close sums become unrelated hashes."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1), or of its inverse, kept for the next call."""
    key = "inverse" if inverse else "base"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        step = _U(pow(int(BASE), -1, 2**64)) if inverse else BASE
        have = np.full(max(n, 1 << 17), step, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 1 << 21:
            _POWERS[key] = have
    return have[:n]


def prefix(tokens: np.ndarray) -> np.ndarray:
    """Prefix sums of tokens (uint64) times powers; one longer than tokens."""
    out = np.zeros(len(tokens) + 1, dtype=np.uint64)
    np.cumsum(tokens * powers(len(tokens)), out=out[1:])
    return out


def byte_tokens(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def word_tokens(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of each word data[start:stop], without the structure of a polynomial: the mixed
    first and second eight bytes with the length, and XXH64 for words of more than 16."""
    n = stop - start
    padded = np.concatenate([data, np.zeros(24, np.uint8)])
    eight = np.ndarray((len(data) + 16,), dtype=np.uint64, buffer=padded, strides=(1,))
    low, high = (eight[start + at] & _MASK[np.clip(n - at, 0, 8)] for at in (0, 8))
    out = mix(mix(low + BASE) ^ (mix(high ^ BASE) + n.astype(np.uint64)))
    if len(long := np.flatnonzero(n > 16)):
        view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh64_intdigest
        out[long] = np.fromiter((digest(view[a:b], 7) for a, b in zip(start[long].tolist(), stop[long].tolist(), strict=True)), np.uint64, len(long))
    return out


def spans(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of tokens[start:stop] for arrays of bounds; equal spans of equal length agree."""
    inverse = powers(len(sums), inverse=True)
    return mix((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64))


def grams(sums: np.ndarray, n: int) -> np.ndarray:
    """The hash of every span of n tokens."""
    if len(sums) <= n:
        return np.zeros(0, dtype=np.uint64)
    count = len(sums) - n
    return mix((sums[n:] - sums[:count]) * powers(len(sums), inverse=True)[:count] + _U(n))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of width values, the index of its smallest, the leftmost of equals."""
    at, best, have = np.arange(len(values), dtype=np.int32), values, 1
    while have * 2 <= width:
        left, right = best[:-have], best[have:]
        take = right < left
        at = np.where(take, at[have:], at[:-have])
        best = np.where(take, right, left)
        have *= 2
    if rest := width - have:
        take = best[rest:] < best[:-rest]
        at = np.where(take, at[rest:], at[:-rest])
    return at


def runs(tokens: np.ndarray, ends: np.ndarray, width: int, gram: int) -> dict[str, np.ndarray]:
    """The runs of all documents in the joined tokens; ends: each document's end.

    Returns arrays: doc (index), lo and hi (first and last window start, joined places),
    key (hash of the gram), span (hash of all tokens of the run), at (the gram's place).
    """
    none = {k: np.zeros(0, np.int64) for k in ("doc", "lo", "hi", "at")} | {k: np.zeros(0, np.uint64) for k in ("key", "span")} | {"sums": prefix(tokens)}
    if len(tokens) < width:
        return none
    sums = none["sums"]
    hashes = grams(sums, gram)
    at = sliding_argmin(hashes, width - gram + 1)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    lengths = ends - begins
    windows = np.maximum(lengths - width + 1, 0)
    if not windows.sum():
        return none
    doc = np.repeat(np.arange(len(ends)), windows)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(begins, windows)
    chosen = at[start]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    lo, hi, place = start[first], start[last], chosen[first].astype(np.int64)
    return {"doc": doc[first], "lo": lo, "hi": hi, "at": place, "key": hashes[place], "span": spans(sums, lo, hi + width), "sums": sums}
