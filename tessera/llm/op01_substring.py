"""Operator 1: removal of word sequences that stand earlier in the corpus.

Method: Rabin-Karp hashes of every window of ``width`` words, counted in Spark; the
repeated windows merge into maximal removal intervals.  Windows with the same winnowed
gram travel and are counted as one run where the whole run is the same, one by one where
runs differ (see ``repeats``).

Defined results: a null text has no words; a text of fewer than ``width`` words is kept;
rows that share a doc_id are one place each, neither earlier than the other at the same
start; a row with a null doc_id is returned whole; an empty table gives an empty result.
Columns other than doc_id and text are ignored, or returned in ``extra`` on request.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling
from .repeats import Spec, remove_repeats

WIDTH, GRAM, BLOCK_BYTES = 20, 6, 1 << 20


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of bytes other than space, \\t, \\n, \\v, \\f, \\r."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def tokenize(texts: list[bytes | None]) -> tuple:
    joined = b"\n".join(t or b"" for t in texts)
    data = np.frombuffer(joined, dtype=np.uint8)
    start, stop = word_bounds(data)
    tokens = rolling.word_tokens(data, start, stop)
    bounds = np.cumsum([len(t or b"") + 1 for t in texts])
    ends = np.searchsorted(start, bounds)
    return tokens, ends, (texts, joined, start, stop)


def cut_words(source: tuple, number: int, begin: int, end: int, gone: np.ndarray) -> tuple:
    """(words, words removed, the kept words joined by one space)."""
    _, joined, start, stop = source
    words = joined[start[begin] : stop[end - 1]].split() if end > begin else []
    if gone.any():
        words = compress(words, ~gone)
    return end - begin, int(gone.sum()), b" ".join(words)


def cut_text(source: tuple, number: int, begin: int, end: int, gone: np.ndarray) -> tuple:
    """As cut_words, but the text keeps its own white space around the kept words, and a
    text from which nothing goes is returned as it is."""
    texts, joined, start, stop = source
    if not gone.any():
        return end - begin, 0, texts[number]
    offset = sum(len(t or b"") + 1 for t in texts[:number])
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    out, at = [], offset
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        out.append(joined[at : start[begin + a]])
        at = start[begin + b] if begin + b < end else stop[end - 1]
    out.append(joined[at : offset + len(texts[number] or b"")])
    return end - begin, int(gone.sum()), b"".join(out)


def substring_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, layout: bool = False, carry: tuple = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept (string), and carry's columns as struct ``extra``.

    layout: keep the white space around kept words instead of joining them by one space;
    a text from which nothing goes, null and empty ones too, is then returned as it is."""
    columns = (("n_words", "bigint", pa.int64()), ("n_removed", "bigint", pa.int64()), ("kept", "binary", pa.binary()))
    spec = Spec(width=width, gram=min(gram, width), within_doc=True, texts=False, tokenize=tokenize, cut=cut_text if layout else cut_words, columns=columns, block_bytes=BLOCK_BYTES)
    return remove_repeats(docs, spec, carry=carry).withColumn("kept", F.col("kept").cast("string"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
