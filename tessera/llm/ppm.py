"""Prediction by partial matching over bytes: contexts of up to ``order`` bytes.

The nodes of the trie are contexts; its symbols are the 256 bytes and an end.  In front of
each text stand start marks, so that every byte has a context of full length.  A byte or
end in its longest context is one integer, its *event*: digits in base ``BASE``, the oldest
byte first and the symbol last.  Shorter contexts' events are remainders of it, so counts
of events hold the whole trie.

A node's counts give its symbols' chances and, with as many escapes as it has distinct
symbols, the chance of going on to the next shorter context, where the symbols already
refused are excluded.  Below the empty context all symbols not seen there are equally
likely.  Events that share the last two bytes of their contexts can be worked out
together, apart from all others, with the counts of contexts of one byte and none at hand
(``Short``: BASE ** 2 numbers whatever the corpus).
"""

from __future__ import annotations

import numpy as np

from .arrays import new_groups, sections, within

END, START, BASE = 256, 257, 258
SYMBOLS = 257


def events(data: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The event of each byte and each end of the joined texts; how many each text has."""
    sizes = np.diff(np.concatenate([[0], ends])) + 1
    place, text = within(sizes), sections(sizes)
    symbol = np.full(len(place), END, dtype=np.int64)
    symbol[place < (sizes - 1)[text]] = data
    out = symbol.copy()
    for k in range(1, order + 1):
        before = np.full(len(symbol), START, dtype=np.int64)
        before[k:] = symbol[:-k]
        before[place < k] = START
        out += before * BASE**k
    return out, sizes


def suffix(event: np.ndarray) -> np.ndarray:
    """The last two bytes of the context."""
    return event // BASE % BASE**2


class Level:
    """The nodes of one context length: counts of events (n), each event's node, and of
    each node the sum and number of its symbols and, of the next shorter node, the sum of
    the counts of the symbols seen in it (refused)."""

    def __init__(self, n: np.ndarray, node: np.ndarray, shorter: np.ndarray) -> None:
        size = int(node[-1]) + 1 if len(node) else 0
        self.n, self.node = n, node
        self.total = np.bincount(node, weights=n, minlength=size)
        self.distinct = np.bincount(node, weights=n > 0, minlength=size)
        self.refused = np.bincount(node, weights=np.where(n > 0, shorter, 0), minlength=size)


class Short:
    """Contexts of one byte and of none; counts: of each event of one byte of context."""

    def __init__(self, counts: np.ndarray) -> None:
        one = counts.astype(np.float64)
        none = one.reshape(BASE, BASE).sum(axis=0)
        every = np.arange(BASE**2)
        self.one = Level(one, every // BASE, none[every % BASE])
        self.none = Level(none, np.zeros(BASE, dtype=np.int64), np.zeros(BASE))


def log10(keys: np.ndarray, counts: np.ndarray, order: int, short: Short) -> np.ndarray:
    """Base-10 log probabilities of distinct events (ascending), with their counts in the
    training texts.  All training events whose contexts share the last two bytes with one
    of them must be among them."""
    found = []
    n, at = short.one.n, keys % BASE**2
    for k in range(2, order + 1):
        event, first, of = np.unique(keys % BASE ** (k + 1), return_index=True, return_inverse=True)
        here = np.bincount(of, weights=counts, minlength=len(event))
        found.append((Level(here, np.cumsum(new_groups(event // BASE)) - 1, n[at[first]]), of))
        n, at = here, of
    out, open_ = np.zeros(len(keys)), np.arange(len(keys))
    out_n, out_d = np.zeros(len(keys)), np.zeros(len(keys))
    for level, of in [*reversed(found), (short.one, keys % BASE**2), (short.none, keys % BASE)]:
        event = of[open_]
        node, seen = level.node[event], level.n[event]
        free = level.distinct[node] - out_d
        whole = level.total[node] - out_n + free
        use = free > 0  # else every symbol here is refused, or none was ever seen
        out[open_] += np.where(use, np.log10(np.where(seen > 0, seen, np.maximum(free, 1)) / np.where(use, whole, 1)), 0.0)
        go = seen == 0
        open_, node = open_[go], node[go]
        out_n, out_d = level.refused[node], level.distinct[node]
    out[open_] -= np.log10(SYMBOLS - short.none.distinct[0]) if len(open_) else 0
    return out
