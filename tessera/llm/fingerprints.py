"""SimHash fingerprints of whole texts, from the XXH64 hashes of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from . import rolling
from .arrays import parts, within
from .op01_substring import word_bounds

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle (words joined by one space, repeats included); of the whole
    sequence if it has fewer words; none for a text without words."""
    parts = text.translate(_LOWER).split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(parts)
    data = np.frombuffer(joined, dtype=np.uint8)
    start, stop = word_bounds(data)
    size = min(words, len(parts))
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    bounds = zip(start[: len(start) - size + 1].tolist(), stop[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(view[a:b], SEED) for a, b in bounds), dtype=np.uint64, count=len(start) - size + 1)


def polynomial_shingles(texts: list[bytes | None], words: int) -> Iterator[np.ndarray]:
    """The same shingles of each text, known by 64-bit polynomial hashes, which numpy finds
    for many texts at once."""
    for a, b in parts(texts):
        some = [t or b"" for t in texts[a:b]]
        data = np.frombuffer(b"\n".join(some).translate(_LOWER), dtype=np.uint8)
        start, stop = word_bounds(data)
        tokens = rolling.word_tokens(data, start, stop)
        ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in some]))
        begins = np.concatenate([[0], ends[:-1]])
        n = ends - begins
        counts = np.maximum(n - words + 1, np.minimum(n, 1))
        first = np.repeat(begins, counts) + within(counts)
        hashes = rolling.spans(rolling.prefix(tokens), first, first + np.repeat(np.minimum(n, words), counts))
        yield from np.split(hashes, np.cumsum(counts)[:-1])


def majority_bits(hashes: np.ndarray) -> int:
    """Bit i is set if over half of the hashes have it."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for part in np.array_split(hashes, max(1, len(hashes) >> 14)):
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, words: int) -> int:
    return majority_bits(shingle_hashes(text or b"", words))
