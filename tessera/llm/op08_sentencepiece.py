"""Operator 8: SentencePiece encoding and decoding for merge-type vocabularies.

Method: an agenda of adjacent symbol pairs, ordered by the score of the piece that a pair
makes (ties: the leftmost).  Texts are cut before runs of the space mark, which no piece
crosses; each distinct chunk of an Arrow batch is encoded once.  The agendas of all short
chunks are worked off together, a row of numpy arrays each; long chunks use a heap.  Each
new chunk is checked against the sentencepiece library in the same batch, and takes the
library's ids if they differ.

Defined results: a null or empty text has the begin and end ids alone and decodes to an
empty text; rows are independent, so null or repeated ids need no rule; an empty table
gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import within

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
WIDTHS = [3, 5, 7, 9, 12, 16, 24, 32]
LONG, CACHE = WIDTHS[-1], 300_000
_NONE = np.int32(2**31 - 1)


class PairTable:
    """(left symbol, right symbol) to the merged piece and its rank, as an open hash table."""

    def __init__(self, left: np.ndarray, right: np.ndarray, piece: np.ndarray, rank: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(len(left) * 3 + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, -1, dtype=np.int64)
        self.piece = np.zeros(1 << bits, dtype=np.int32)
        self.rank = np.full(1 << bits, _NONE, dtype=np.int32)
        keys, self.probes, todo, step = self.pair(left, right), 0, np.arange(len(left)), 0
        home = self.home(keys)
        while len(todo):
            slot = (home[todo] + step) & self.mask
            free = self.key[slot] == -1
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            first = first[free[first]]
            put = todo[first]
            self.key[slot[first]], self.piece[slot[first]], self.rank[slot[first]] = keys[put], piece[put], rank[put]
            todo, step = np.delete(todo, first), step + 1
        self.probes = step

    @staticmethod
    def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def slots(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair, or -1; symbols below zero make no pair."""
        keys = self.pair(left, right)
        slot = self.home(keys)
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        for _ in range(self.probes):
            held = self.key[slot[open_]]
            same = held == keys[open_]
            out[open_[same]] = slot[open_[same]]
            open_ = open_[~same & (held != -1)]
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.mask
        return out


class Agenda:
    """A merge-type sentencepiece model; calling a chunk (starting with the mark) gives its ids."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.library
        self.begin, self.end, unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.symbol = {pieces[i]: i for i in normal}
        if any(c not in self.symbol for i in normal for c in pieces[i]):
            raise ValueError("a character of a piece is no piece itself")
        if any(MARK in pieces[i].lstrip(MARK) for i in normal):
            raise ValueError("a piece crosses a space mark")
        scores = np.array([sp.get_score(i) for i in range(size)])
        order = np.searchsorted(np.unique(-scores), -scores)  # equal scores share a rank
        found = [(self.symbol[p[:k]], self.symbol[p[k:]], i, order[i]) for i in normal for p in (pieces[i],) for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol]
        self.table = PairTable(*(np.array(c, dtype=np.int64) for c in zip(*found, strict=True)))
        self.pairs = {(a, b): (r, i) for a, b, i, r in found}
        self.bytes = {int(pieces[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.unknown, self.size = unknown, size
        surface = [b"" if sp.is_control(i) else bytes([int(pieces[i][3:5], 16)]) if sp.is_byte(i) else " ⁇ ".encode() if i == unknown else pieces[i].replace(MARK, " ").encode() for i in range(size)]
        self.surface_size = np.array(list(map(len, surface)))
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size
        self.surfaces = np.frombuffer(b"".join(surface), dtype=np.uint8)
        # Characters by code point to their symbols; others to -10 less the code point.
        self.of_code = -10 - np.arange(0x110000, dtype=np.int32)
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.of_code[ord(c)] = i
        self.cache: dict[str, bytes] = {}
        self.differed = 0

    def _symbols(self, chunk: str) -> list[int]:
        return self.of_code[np.frombuffer(chunk.encode("utf-32-le"), dtype="<u4")].tolist()

    def _ids(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows of symbols (joined; counts: of each row): unknown ones by bytes."""
        known = (symbols >= 0) & (symbols < self.size)
        if known.all():
            return symbols.astype("<u4"), counts
        odd = np.flatnonzero(~known)
        own = [[self.bytes[b] for b in chr(c).encode()] if self.bytes else [self.unknown] for c in (-10 - symbols[odd]).tolist()]
        size = np.ones(len(symbols), dtype=np.int64)
        size[odd] = list(map(len, own))
        out = np.repeat(symbols, size)
        out[np.repeat(~known, size)] = list(chain.from_iterable(own))
        return out.astype("<u4"), np.add.reduceat(size, np.cumsum(counts) - counts)

    def by_heap(self, chunk: str) -> np.ndarray:
        s = self._symbols(chunk)
        after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        agenda: list[tuple] = []

        def add(i: int, j: int) -> None:
            if (found := self.pairs.get((s[i], s[j]))) is not None:
                agenda.append((found[0], i, j, s[i], s[j], found[1]))

        for i in range(len(s) - 1):
            add(i, i + 1)
        heapq.heapify(agenda)
        gone = [False] * len(s)
        while agenda:
            _, i, j, left, right, piece = heapq.heappop(agenda)
            if gone[i] or gone[j] or s[i] != left or s[j] != right or after[i] != j:
                continue
            s[i], gone[j], after[i] = piece, True, after[j]
            if after[i] < len(s):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(s) and (found := self.pairs.get((s[a], s[b]))) is not None:
                    heapq.heappush(agenda, (found[0], a, b, s[a], s[b], found[1]))
        left = np.array([x for x, g in zip(s, gone, strict=True) if not g], dtype=np.int64)
        return self._ids(left, np.array([len(left)]))[0]

    def together(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The agendas of short chunks, one merge of each at a time: ids and their counts."""
        lengths = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        width = int(lengths.max())
        s = np.full((len(chunks), width + 1), -1, dtype=np.int32)
        s[np.arange(width + 1) < lengths[:, None]] = self.of_code[np.frombuffer("".join(chunks).encode("utf-32-le"), dtype="<u4")]
        slots = self.table.slots(s[:, :-1].ravel(), s[:, 1:].ravel()).reshape(len(chunks), width)
        rank = np.where(slots >= 0, self.table.rank[slots], _NONE)
        rows, columns = np.arange(len(chunks)), np.arange(width)
        while len(rows):
            part = rank[rows]
            at = part.argmin(axis=1)
            busy = part[np.arange(len(rows)), at] != _NONE
            rows, at, part = rows[busy], at[busy], part[busy]
            if not len(rows):
                break
            slot = self.table.slots(s[rows, at], s[rows, at + 1])
            moved = columns + (columns > at[:, None])
            row = np.take_along_axis(s[rows], np.minimum(moved, width), axis=1)
            row[np.arange(len(rows)), at] = self.table.piece[slot]
            s[rows, :width] = row
            s[rows, width] = -1
            part = np.take_along_axis(part, np.minimum(moved, width - 1), axis=1)
            part[:, -1] = _NONE
            for shift in (-1, 0):
                place = at + shift
                near = np.flatnonzero((place >= 0) & (place < width))
                found = self.table.slots(s[rows[near], place[near]], s[rows[near], place[near] + 1])
                part[near, place[near]] = np.where(found >= 0, self.table.rank[found], _NONE)
            rank[rows] = part
        held = s != -1
        return self._ids(s[held], held.sum(axis=1))

    def learn(self, chunks: list[str]) -> None:
        """Encodes new chunks, checks them against the library and keeps them."""
        if len(self.cache) + len(chunks) > CACHE:
            self.cache.clear()
        lines = [c for c in chunks if len(c) <= LONG and "\n" in c]
        for begin in range(0, len(lines), 20_000):
            self._keep(lines[begin : begin + 20_000], *self.together(lines[begin : begin + 20_000]))
        short = sorted((c for c in chunks if len(c) <= LONG and "\n" not in c), key=len)
        begin = 0
        while begin < len(short):
            end, limit = bisect_right(short, WIDTHS[bisect_left(WIDTHS, len(short[begin]))], key=len), begin + 20_000
            part = short[begin : min(end, limit)]
            self._keep(part, *self.together(part))
            begin += len(part)
        for c in chunks:
            if len(c) > LONG:
                ids = self.by_heap(c)
                self._keep([c], ids, np.array([len(ids)]))

    def by_library(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids and their counts.  A line break is no part of any piece, so
        chunks without one are encoded in one text and told apart by its id."""
        line = self.bytes.get(10)
        whole = "\n" + "\n".join(chunks).replace(MARK, " ")
        if line is not None and "\n" not in self.symbol and whole.count("\n") == len(chunks):
            ids = np.array(self.library.encode(whole), dtype="<u4")
            at = np.append(np.flatnonzero(ids == line), len(ids))
            return ids[at[0] :][ids[at[0] :] != line], np.diff(at) - 1
        theirs = [self.library.encode("\n" + c.replace(MARK, " ")) for c in chunks]
        front = len(self.library.encode("\n"))
        sizes = np.array(list(map(len, theirs))) - front
        return np.fromiter(chain.from_iterable(t[front:] for t in theirs), dtype="<u4", count=int(sizes.sum())), sizes

    def _keep(self, chunks: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        given, sizes = self.by_library(chunks)
        if not (np.array_equal(sizes, counts) and np.array_equal(given, ids)):
            self.differed += 1
            ids, counts = given, sizes
        data, stops = ids.tobytes(), np.cumsum(4 * counts)
        self.cache.update(zip(chunks, map(data.__getitem__, map(slice, (stops - 4 * counts).tolist(), stops.tolist())), strict=True))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts of rows of ids (joined), without the space that encoding put in front."""
        size = self.surface_size[ids]
        row = np.repeat(np.arange(len(counts)), counts)
        data = self.surfaces[np.repeat(self.surface_at[ids], size) + within(size)].tobytes()
        stops = np.cumsum(np.bincount(row, weights=size, minlength=len(counts)).astype(np.int64)).tolist()
        return [data[a + (data[a : a + 1] == b" ") : b] for a, b in zip([0, *stops], stops, strict=False)]

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """For each text its ids (little-endian unsigned 32-bit) and its decoded bytes."""
        chunked = [_CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        seen = set().union(*chunked)
        new = seen - self.cache.keys()
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = seen
        if new:
            self.learn(sorted(new))
        begin, end = (np.array([x], dtype="<u4").tobytes() for x in (self.begin, self.end))
        ids = [b"".join([begin, *map(self.cache.__getitem__, chunks), end]) for chunks in chunked]
        counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        return ids, self.decode(np.frombuffer(b"".join(ids), dtype="<u4"), counts)


def sentencepiece_codes(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded (string)."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        agenda = Agenda(model or public_tokenizers.path("piece_bpe_32k.model"))
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                ids, decoded = agenda.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], schema=out)

    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, "doc_id bigint, n_tokens bigint, ids binary, decoded binary")
    return found.withColumn("decoded", F.col("decoded").cast("string"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_codes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
