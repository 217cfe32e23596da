"""Operator 9: removal of byte strings that stand in documents with smaller ids.

Method: hash-compared suffix sort.  The windows of runs that may overlap in part are
suffixes of the texts that a bucket gathers (see ``repeats``; whole equal runs were met
before).  Prefix polynomial hashes and a binary search find the common extension of two
suffixes, so that a comparison takes a logarithmic number of steps; a bottom-up mergesort
orders them; neighbours in that order with a common extension of ``width`` bytes are
compared byte by byte, and sorted by their bytes if a hash collided.

Defined results: a null text is empty; a text under ``width`` bytes is kept; rows that
share a doc_id never match one another; a row with a null doc_id is returned whole; an
empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling
from .arrays import flat, new_groups, sections, within
from .repeats import Spec, _answer, remove_repeats

WIDTH, GRAM = 50, 20


class Suffixes:
    """Suffixes of joined texts, compared over their first width bytes."""

    def __init__(self, data: np.ndarray, width: int) -> None:
        self.data, self.width = data, width
        self.sums = rolling.prefix(rolling.byte_tokens(data))
        self.inverse = rolling.powers(len(self.sums), inverse=True)

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return (self.sums[a + n] - self.sums[a]) * self.inverse[a] == (self.sums[b + n] - self.sums[b]) * self.inverse[b]

    def order(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for suffixes at a before, equal to or after those at b."""
        out = np.zeros(len(a), dtype=np.int8)
        differ = np.flatnonzero(~self.same(a, b, self.width))
        if len(differ):
            x, y = a[differ], b[differ]
            low, high = np.zeros(len(x), np.int64), np.full(len(x), self.width, np.int64)
            while (high - low > 1).any():  # equal for low bytes, not for high
                mid = (low + high) // 2
                equal = self.same(x, y, mid)
                low, high = np.where(equal, mid, low), np.where(equal, high, mid)
            out[differ] = np.where(self.data[x + low] < self.data[y + low], -1, 1)
        return out

    def sort(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A stable mergesort of each segment (sizes: of consecutive parts of at), as an order of at."""
        order = np.arange(len(at))
        begin, size = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(sizes, sizes)
        run = 1
        while (busy := np.flatnonzero(size > run)).size:
            place = busy - begin[busy]
            left = place // (2 * run) * (2 * run)
            middle = np.minimum(left + run, size[busy])
            end = np.minimum(left + 2 * run, size[busy])
            first = place < middle
            low = np.where(first, middle, left)
            high = np.where(first, end, middle)
            start = low.copy()
            mine = at[order[busy]]
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) // 2
                their = at[order[begin[busy[open_]] + mid]]
                c = self.order(their, mine[open_])
                go = np.where(first[open_], c < 0, c <= 0)  # equals: the left run's first
                low[open_] = np.where(go, mid + 1, low[open_])
                high[open_] = np.where(go, high[open_], mid)
            target = begin[busy] + left + (place - np.where(first, left, middle)) + (low - start)
            new = order.copy()
            new[target] = order[busy]
            order, run = new, 2 * run
        return order

    def bytes_of(self, at: np.ndarray) -> np.ndarray:
        return self.data[at[:, None] + np.arange(self.width)]


def equal_suffixes(suffixes: Suffixes, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of at, and for each place in it whether a new class of equal suffixes begins."""
    order = suffixes.sort(at, sizes)
    segment = sections(sizes)
    begins = np.ones(len(at), dtype=bool)
    near = np.flatnonzero(segment[1:] == segment[:-1]) + 1
    near = near[suffixes.same(at[order[near]], at[order[near - 1]], suffixes.width)]
    for part in np.array_split(near, max(1, len(near) // 100_000)):
        if (suffixes.bytes_of(at[order[part]]) != suffixes.bytes_of(at[order[part - 1]])).any():
            plain = np.ascontiguousarray(suffixes.bytes_of(at)).view(f"V{suffixes.width}").ravel()
            _, value = np.unique(plain, return_inverse=True)
            order = np.lexsort((value, segment))
            return order, new_groups(segment[order], value[order])
    begins[near] = False
    return order, begins


def meet_texts(width: int):
    def meet(table: pa.Table) -> pa.Table:
        group, counts = flat(table.column("hash"))
        doc, many = flat(table.column("doc"))[0], flat(table.column("many"))[0].astype(np.int64)
        data = np.frombuffer(b"".join(table.column("text").to_pylist()), dtype=np.uint8)
        row, place = sections(counts), within(counts)
        length = many + width - 1
        text = sections(many)
        step = within(many)
        at = np.repeat(np.cumsum(length) - length, many) + step
        # Equal windows have the same gram at the same place: only such are compared.
        key, gram_at = group // width, group % width
        segment_key, segment_at = key[text], gram_at[text] - step
        order = np.lexsort((doc[text], segment_at, segment_key))
        begins = new_groups(segment_key[order], segment_at[order])
        sizes = np.diff(np.append(np.flatnonzero(begins), len(order)))
        keep = np.repeat(sizes > 1, sizes)
        order, sizes = order[keep], sizes[sizes > 1]
        later = np.zeros(len(at), dtype=bool)
        if len(order):
            sorted_, begins = equal_suffixes(Suffixes(data, width), at[order], sizes)
            element = order[sorted_]
            of = np.cumsum(begins) - 1
            least = np.minimum.reduceat(doc[text[element]], np.flatnonzero(begins))
            later[element] = doc[text[element]] > least[of]
        return _answer(table, 3, row[text], (later, place[text]), (later, step))

    return meet


def tokenize(texts: list[bytes | None]) -> tuple:
    data = np.frombuffer(b"".join(t or b"" for t in texts), dtype=np.uint8)
    return rolling.byte_tokens(data), np.cumsum([len(t or b"") for t in texts]), data


def cut(source: np.ndarray, number: int, begin: int, end: int, gone: np.ndarray) -> tuple:
    data = source[begin:end]
    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return end - begin, int(gone.sum()), spans, data[~gone].tobytes() if spans else data.tobytes()


def suffix_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) for each row."""
    columns = (("n_bytes", "bigint", pa.int64()), ("n_removed", "bigint", pa.int64()), ("n_spans", "bigint", pa.int64()), ("kept", "binary", pa.binary()))
    spec = Spec(width=width, gram=min(gram, width), within_doc=False, texts=True, tokenize=tokenize, cut=cut, columns=columns)
    return remove_repeats(docs, spec, meet_texts(width))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
