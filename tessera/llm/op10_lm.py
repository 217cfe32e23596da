"""Operator 10: language-model scores of texts, learnt from the corpus.

Method: prediction by partial matching.  A trie of byte contexts of up to ``ORDER`` bytes
is counted over the training texts; every text's code length is summed over its bytes and
end, with escapes and symbol exclusion (see ``ppm``).  The base score is a smoothed unigram
over words.  Both tables grow with the corpus and are never gathered in one place:

1. Documents are dealt to blocks once.  Each block sends its distinct words and its
   distinct events (a byte in its longest context), with their training counts, to
   buckets: words by their hash, events by the last two bytes of their context, which
   keeps the way from a context to its shorter ones in one bucket.
2. A bucket is met in two steps: first for ``SALT_BLOCKS`` blocks at a time, so that a
   suffix which all texts hold is not one task's work; then over these sums, where each
   distinct word gets its count and each distinct event its log probability.
3. The answers go back to the blocks the way they came.

What stands in every document is thus one number per block.  A word is known by 64 bits of
hash; contexts of one byte or none (258 ** 2 counts at most) are broadcast.

Defined results: a null or empty text is the end alone; a row with a null doc_id is not
held out and is learnt from; rows that share a doc_id are all learnt from; without
training rows all counts are zero; a text of any length is scored whole; an empty table
gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ppm, rolling
from .arrays import flat, lists, parts, sections
from .op01_substring import word_bounds

FOLDS, HELD_OUT = 5, 1
ORDER = 5
BLOCK_BYTES, LEAST_BLOCKS, BUCKET_WORDS, SALT_BLOCKS, MOST_SUFFIX_BUCKETS = 16 << 20, 24, 400_000, 64, 4096
WORDS, EVENTS = 0, 1
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
_END_WORD = np.uint64(0x656E64)

_SENT = "kind int, bucket int, salt int, block int, k array<bigint>, n array<int>"
_SUMS = "kind int, bucket int, salt int, k array<bigint>, n array<bigint>"
_BUILT = "kind int, bucket int, salt int, value array<double>, total bigint, distinct bigint"
_TOLD = "kind int, bucket int, block int, value array<double>, total bigint, distinct bigint"
_OUT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, score double"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(t or b"" for t in texts), dtype=np.uint8)
    return data, np.cumsum([len(t or b"") for t in texts])


def short_counts(docs: DataFrame) -> np.ndarray:
    """Counts of the events of one byte of context over the training rows (text, held_out)."""
    size = ppm.BASE**2

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, dtype=np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in parts(texts):
                sums += np.bincount(ppm.events(*joined(texts[a:b]), 1)[0], minlength=size)
        keys = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums[keys])], ["k", "n"])

    counted = docs.filter(~F.col("held_out")).select("text").mapInArrow(scan, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, dtype=np.int64)
    out[counted.column("k").to_numpy()] = counted.column("n").to_numpy()
    return out


def tokens_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of each text and of its end; how many tokens each has."""
    data = _LOWER[np.frombuffer(b"\n".join(t or b"" for t in texts), dtype=np.uint8)]
    start, stop = word_bounds(data)
    words = rolling.word_tokens(data, start, stop)
    ends = np.searchsorted(start, np.cumsum([len(t or b"") + 1 for t in texts]))
    return np.insert(words, ends, rolling.mix(np.array([_END_WORD]))[0]).view(np.int64), np.diff(np.concatenate([[0], ends])) + 1


def taken(texts: list[bytes | None], kind: int, order: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Words or events of the texts from a to b, and how many each of these texts has."""
    for a, b in parts(texts):
        yield a, b, *(tokens_of(texts[a:b]) if kind == WORDS else ppm.events(*joined(texts[a:b]), order))


def counted(found: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their numbers."""
    made = []
    for keys, n in found:
        one, of = np.unique(keys, return_inverse=True)
        made.append((one, np.bincount(of, weights=n, minlength=len(one))))
    if len(made) == 1:
        return made[0][0], made[0][1].astype(np.int64)
    keys, n = (np.concatenate(c) for c in zip(*made, strict=True)) if made else (np.zeros(0, np.int64), np.zeros(0))
    one, of = np.unique(keys, return_inverse=True)
    return one, np.bincount(of, weights=n, minlength=len(one)).astype(np.int64)


def lm_scores(docs: DataFrame, context: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.  context: the
    longest context in bytes, from 2 to 6."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    short = spark.sparkContext.broadcast(short_counts(source))
    size = source.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES), min(LEAST_BLOCKS, size >> 20))
    buckets = {WORDS: max(4, math.ceil(size / 32 / BUCKET_WORDS)), EVENTS: min(MOST_SUFFIX_BUCKETS, max(32, blocks))}
    salts = max(1, math.ceil(blocks / SALT_BLOCKS))
    # Rows that share an id, or have none, are spread by their text.
    dealt = source.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def asked(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct words or events of a block by (bucket, key): bucket, key, training count."""
        texts = table.column("text").to_pylist()
        learnt = ~table.column("held_out").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        keys, n = counted((k, np.repeat(learnt[a:b], sizes)) for a, b, k, sizes in taken(texts, kind, context))
        spread = keys.view(np.uint64) if kind == WORDS else rolling.mix(ppm.suffix(keys).astype(np.uint64))
        bucket = (spread % np.uint64(buckets[kind])).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        return bucket[order], keys[order], n[order]

    def send(key: tuple, table: pa.Table) -> pa.Table:
        number, out = key[0].as_py(), []
        for kind in (WORDS, EVENTS):
            bucket, keys, n = asked(table, kind)
            sizes = np.bincount(bucket)
            used = np.flatnonzero(sizes)
            same = lambda x: pa.array(np.full(len(used), x, np.int32))  # noqa: B023, E731
            salt = number % salts if kind == EVENTS else 0
            out.append(pa.table([same(kind), pa.array(used.astype(np.int32)), same(salt), same(number), lists(keys, sizes[used], pa.int64()), lists(n, sizes[used], pa.int32())], names=["kind", "bucket", "salt", "block", "k", "n"]))
        return pa.concat_tables(out)

    def add(key: tuple, table: pa.Table) -> pa.Table:
        keys, n = counted([(flat(table.column("k"))[0], flat(table.column("n"))[0])])
        return pa.table([*(pa.array([k.as_py()], pa.int32()) for k in key), lists(keys, np.array([len(keys)]), pa.int64()), lists(n, np.array([len(n)]), pa.int64())], names=["kind", "bucket", "salt", "k", "n"])

    def build(key: tuple, table: pa.Table) -> pa.Table:
        given, sizes = flat(table.column("k"))
        keys, n = counted([(given, flat(table.column("n"))[0])])
        value = n.astype(np.float64) if key[0].as_py() == WORDS else ppm.log10(keys, n, context, ppm.Short(short.value))
        only = np.arange(table.num_rows) == 0
        sums = [pa.array(np.where(only, x, 0), pa.int64()) for x in (n.sum(), (n > 0).sum())]
        return pa.table([*(table.column(c) for c in ("kind", "bucket", "salt")), lists(value[np.searchsorted(keys, given)], sizes, pa.float64()), *sums], names=["kind", "bucket", "salt", "value", "total", "distinct"])

    def answer(key: tuple, table: pa.Table, built: pa.Table) -> pa.Table:
        given, sizes = flat(table.column("k"))
        value = flat(built.column("value"))[0][np.searchsorted(np.unique(given), given)] if len(given) else np.zeros(0)
        only = np.arange(table.num_rows) == 0
        sums = [pa.array(np.where(only, built.column(c)[0].as_py(), 0), pa.int64()) for c in ("total", "distinct")]
        return pa.table([*(table.column(c) for c in ("kind", "bucket", "block")), lists(value, sizes, pa.float64()), *sums], names=["kind", "bucket", "block", "value", "total", "distinct"])

    def score(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        texts, sums, sizes = table.column("text").to_pylist(), {}, {}
        for kind in (WORDS, EVENTS):
            own = told.filter(pa.array(told.column("kind").to_numpy() == kind)).sort_by("bucket")
            _, keys, _ = asked(table, kind)
            order = np.argsort(keys)
            keys, value = keys[order], flat(own.column("value"))[0][order]
            made, count = [], []
            for a, b, k, n in taken(texts, kind, context):
                one, of = np.unique(k, return_inverse=True)
                v, text = value[np.searchsorted(keys, one)][of], sections(n)
                made.append([np.bincount(text, weights=w, minlength=b - a) for w in ([np.log10(v + 0.5), v > 0] if kind == WORDS else [v])])
                count.append(n)
            sums[kind] = [np.concatenate(c) for c in zip(*made, strict=True)] if made else [np.zeros(0)] * 2
            sizes[kind] = np.concatenate([np.zeros(0, np.int64), *count])
        columns = [table.column("doc_id"), table.column("held_out"), pa.array(sizes[WORDS]), pa.array(sums[WORDS][1].astype(np.int64)), pa.array(sums[WORDS][0]), pa.array(sums[EVENTS][0])]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "logs", "score"])

    by_block = dealt.groupBy("block")
    sent = by_block.applyInArrow(send, _SENT).groupBy("kind", "bucket", "salt")
    built = sent.applyInArrow(add, _SUMS).groupBy("kind", "bucket").applyInArrow(build, _BUILT)
    told = sent.cogroup(built.groupBy("kind", "bucket", "salt")).applyInArrow(answer, _TOLD)
    scored = by_block.cogroup(told.groupBy("block")).applyInArrow(score, _OUT)
    all_ = told.filter(F.col("kind") == WORDS).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("train_tokens"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v"))
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.col("train_tokens") + 0.5 * (F.col("v") + 1))
    return scored.join(F.broadcast(all_)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", base.alias("base_score"), "score")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
