"""Operator 3: packing of token sequences.

Method: best-fit decreasing.  A document longer than a window is cut into full windows
first; the rest of each document is placed, longest first, into the tightest open window,
found by a segment tree over the remaining capacities.  Each task packs what it reads, in
turns of at most ``TURN`` rests, so no rest crosses the network and memory stays bounded.

The vocabulary of the given tokenizers file runs in tiktoken, which gives the same ids at
several times the speed; a text that holds the string of one of the file's added tokens, or
a run of ``LONG_RUN`` or more blanks or other characters (tiktoken's pattern overflows its
stack on a million blanks), goes through the tokenizers library itself.

Defined results: a null or empty text is the end id alone; a text of any length, and of
white space or one letter only, has the library's ids; rows are independent, so null or
repeated ids need no rule; an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW, END, TURN = 1024, 0, 16_384
LONG_RUN = 20_000


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones for
    themselves, the others in order from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteTokenizer:
    """The ids of texts by a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        special = {t["content"] for t in held["added_tokens"]}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in piece): i for piece, i in held["model"]["vocab"].items() if piece not in special}
        self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(path)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.runs = re.compile(r"\s+|\S+")

    def encode(self, text: str) -> bytes:
        """Unsigned 32-bit integers."""
        if (self.special and self.special.search(text)) or (len(text) >= LONG_RUN and max(map(len, self.runs.findall(text))) >= LONG_RUN):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast.encode_ordinary(text)).tobytes()


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def _count(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.tree[node] += by
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        if capacity:
            self.at[capacity].append(window)
            self._count(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least capacity of need or more, and that capacity."""
        node = need + self.leaves
        if not self.tree[node]:
            while node > 1 and not (node % 2 == 0 and self.tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._count(capacity, -1)
        return self.at[capacity].pop(), capacity


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int], int]:
    """The window and offset of each length, longest first; how many windows."""
    open_, windows = OpenWindows(size), 0
    window, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = open_.take(lengths[i])
        if found is None:
            found, windows = (windows, size), windows + 1
        window[i], offset[i] = found[0], size - found[1]
        open_.put(found[1] - lengths[i], found[0])
    return window, offset, windows


_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_FULL_ROWS = 4096


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (binary, little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset.  tokenizer: a file of the tokenizers library."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encoder = ByteTokenizer(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
        sequence = TaskContext.get().partitionId() << 33
        rests: list[tuple] = []
        rows: list[tuple] = []

        def encoded(encoder: ByteTokenizer, batch: pa.RecordBatch) -> Iterator[tuple]:
            for key, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                yield key.as_py(), encoder.encode(text.as_py() or "") + END.to_bytes(4, "little")

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)
            rows.clear()
            return out

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            where, offset, count = best_fit([r[2] for r in rests], window)
            rows.extend((*r, sequence + w, o) for r, w, o in zip(rests, where, offset, strict=True))
            sequence += count
            rests.clear()
            if rows:
                yield made()

        for batch in batches:
            for key, ids in encoded(encoder, batch):
                total = len(ids) // 4
                full = total // window * window
                for start in range(0, full, window):
                    rows.append((key, start, window, ids[4 * start : 4 * (start + window)], total, sequence, 0))
                    sequence += 1
                if total > full:
                    rests.append((key, full, total - full, ids[4 * full :], total))
                if len(rests) >= TURN:
                    yield from packed()
                if len(rows) >= _FULL_ROWS:
                    yield made()
        yield from packed()

    schema = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, schema)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
