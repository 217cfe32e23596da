"""Operator 7: quality rules.

Method: gradient-boosted trees over document statistics, flattened into numpy node arrays
(see ``boosted``) and scored an Arrow batch at a time.  The verdict may only fall with
symbols, capitals, exclamation marks, repeated words and repeated lines.  The trees are
fitted on the driver to the statistics of at most ``SAMPLE`` labelled documents (those of
least hash, a documented bound); the cut is the probability below which no more than
``LOSS`` of the sample's good documents fall, a half at most.  All statistics cover whole
texts.

Defined results: a null text has no words and one empty line; it fails the base rule, as
does an empty one.  Without labels of both sorts only the base rule rejects.  Rows are
independent, so null or repeated ids need no rule; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling
from .boosted import Trees, fit
from .op01_substring import word_bounds

SAMPLE, LOSS = 6000, 0.002
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["words", "word_length", "symbols", "capitals", "marks", "digits", "repeated", "repeated_lines", "distinct", "line_words"]
MONOTONE = np.array([0, 0, -1, -1, -1, 0, -1, -1, 0, 0])
_CHUNK = 1 << 20


def _flags(characters: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(characters)] = 1
    return out


_SYMBOL, _CAPITAL, _MARK, _DIGIT = _flags(b"#*$%&|<>"), _flags(bytes(range(65, 91))), _flags(b"!?"), _flags(b"0123456789")


def repeated_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line; lines with a word."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines)), len(lines)


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The counts (COUNTS) and the features (FEATURES) of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    start, stop = word_bounds(data)
    last = np.cumsum([len(t) + 1 for t in texts])
    first = np.concatenate([[0], last[:-1]])
    ends = np.searchsorted(start, last)
    begins = np.concatenate([[0], ends[:-1]])
    n = ends - begins

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[last] - sums[first]

    points = (data & 0xC0) != 0x80
    inside = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
    chars = total(points & inside)
    symbols = total(_SYMBOL[data])
    words = rolling.word_tokens(data, start, stop)
    doc = np.repeat(np.arange(len(texts)), n)
    own = rolling.mix(doc.astype(np.uint64) + np.uint64(1))
    # Three-word windows of one document, those found twice or more, and the words they hold.
    at = np.flatnonzero(np.arange(len(words)) + 3 <= ends[doc])
    grams = rolling.grams(rolling.prefix(words), 3)[at] ^ own[at] if len(at) else np.zeros(0, np.uint64)
    _, inverse, count = np.unique(grams, return_inverse=True, return_counts=True)
    twice = at[count[inverse] > 1]
    edge = np.zeros(len(words) + 4, dtype=np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + 3, -1)
    repeat = np.bincount(doc, weights=np.cumsum(edge)[: len(words)] > 0, minlength=len(texts)).astype(np.int64)
    _, one = np.unique(words ^ own, return_index=True)
    distinct = np.bincount(doc[one], minlength=len(texts))
    lines = np.array([repeated_lines(t) for t in texts], dtype=np.int64).reshape(-1, 2)
    w, c = np.maximum(n, 1), np.maximum(chars, 1)
    counts = np.stack([n, chars, symbols, lines[:, 0], repeat], axis=1)
    features = np.stack([np.log1p(n), chars / w, symbols / w, total(_CAPITAL[data]) / c, total(_MARK[data]) / w, total(_DIGIT[data]) / c, repeat / w, lines[:, 0] / np.maximum(lines[:, 1], 1), distinct / w, n / np.maximum(lines[:, 1], 1)], axis=1)
    return counts, features


def batched(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size < _CHUNK):
            size += len(texts[end] or b"")
            end += 1
        yield statistics([t or b"" for t in texts[begin:end]])
        begin = end


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


def sample_features(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: good) of at most sample labelled documents, in an order that
    only they decide; an id that several labels or documents share is in the sample once
    (its least label, its text of least hash)."""
    known_labels = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("double")).alias("good"))
    chosen = known_labels.withColumn("doc_id", F.col("doc_id").cast("bigint")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    known = known.groupBy("doc_id", "good").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.concatenate([f for _, f in batched(batch.column("text").to_pylist())])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("good"), *(pa.array(c) for c in x.T)], ["doc_id", "good", *FEATURES])

    rows = known.mapInArrow(scan, "doc_id bigint, " + ", ".join(f"{c} double" for c in ["good", *FEATURES])).toArrow().sort_by("doc_id")
    x = np.stack([rows.column(c).to_numpy() for c in FEATURES], axis=1) if rows.num_rows else np.zeros((0, len(FEATURES)))
    return x, rows.column("good").to_numpy()


def train(x: np.ndarray, y: np.ndarray, loss: float = LOSS) -> tuple[Trees, float] | None:
    if len(np.unique(y)) < 2:
        return None
    trees = fit(x, (y > 0).astype(float), MONOTONE)
    return trees, float(min(0.5, np.quantile(trees.probability(x[y > 0]), loss)))


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, carry: tuple = ()) -> DataFrame:
    """doc_id, COUNTS, score, base_failed, kept, and carry's columns as struct ``extra``.
    labels: doc_id, quality (1 or more: good)."""
    model = train(*sample_features(docs, labels, sample))
    inside = "text" in carry  # then it goes to Python once

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("extra").field("text").cast(pa.binary()) if inside else batch.column("text")
            counts, features = map(np.concatenate, zip(*batched(texts.to_pylist()), strict=True))
            failed = base_failed(counts)
            score = model[0].probability(features) if model else np.ones(len(counts))
            kept = ~failed & (score >= (model[1] if model else 0))
            columns = [batch.column("doc_id"), *map(pa.array, counts.T), pa.array(score), pa.array(failed), pa.array(kept)]
            names = ["doc_id", *COUNTS, "score", "base_failed", "kept"]
            if carry:
                columns, names = [*columns, batch.column("extra")], [*names, "extra"]
            yield pa.RecordBatch.from_arrays(columns, names)

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col("text").cast("binary").alias("text")] * (not inside), *[F.struct(*(F.col(f"`{c}`") for c in carry)).alias("extra")] * bool(carry))
    schema = "doc_id bigint, " + "".join(f"{c} bigint, " for c in COUNTS) + "score double, base_failed boolean, kept boolean"
    if carry:
        schema += f", extra {source.schema['extra'].dataType.simpleString()}"
    return source.mapInArrow(scan, schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "score")
