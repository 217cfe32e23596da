"""Long words whose polynomial hashes agree: the operators must tell them apart."""

import math

import numpy as np
import pytest

from tessera.llm import rolling
from tessera.llm.near import similar_components
from tessera.llm.op01_substring import substring_dedup
from tessera.llm.op07_quality import quality_rules
from tessera.llm.op10_lm import held_out, lm_scores
from tessera.llm.op01_substring import word_bounds
from pyspark.sql import functions as F


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


@pytest.fixture(params=[1024, 8192])
def words(request):
    one = thue_morse(request.param)
    return one, one.translate(str.maketrans("ab", "ba"))


def test_hash_of_words():
    texts = ["", "a", "b", "aa", "ab", "a" * 8, "a" * 9, "a" * 16, "a" * 17, "a" * 7 + "b", "a" * 8 + "b", "a" * 15 + "b", *(w for n in (1024, 2048, 4096, 8192) for w in (thue_morse(n), thue_morse(n).translate(str.maketrans("ab", "ba"))))]
    data = np.frombuffer("\n".join(texts).encode(), np.uint8)
    start, stop = word_bounds(data)
    tokens = rolling.word_tokens(data, start, stop)
    assert len(set(tokens.tolist())) == len(texts) - 1
    again = np.frombuffer(" x ".join(texts).encode(), np.uint8)
    assert set(tokens.tolist()) <= set(rolling.word_tokens(again, *word_bounds(again)).tolist())


def test_operators(spark, words):
    one, other = words
    start = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{start} {one}"), (2, f"{start} {other}"), (3, f"{start} {one}")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup(docs).collect()) == [(1, 0), (2, 0), (3, 20)]
    assert sorted(tuple(r) for r in similar_components(spark.createDataFrame([(1, f"a b c d {one}"), (2, f"a b c d {other}")], "doc_id long, text string")).collect()) == [(1, 1), (2, 2)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    text = f"{one} x y {other} x y"
    assert [r.n_repeat_words for r in quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string"), labels).collect()] == [0]
    ids = spark.range(100).select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("out")).collect()
    learnt, kept_out = next(r.doc_id for r in ids if not r.out), next(r.doc_id for r in ids if r.out)
    got = {r.doc_id: r for r in lm_scores(spark.createDataFrame([(learnt, one), (kept_out, other)], "doc_id long, text string")).collect()}
    assert got[kept_out].n_known == 1 and math.isclose(got[kept_out].base_score, math.log10(0.5 / 3.5) + math.log10(1.5 / 3.5))
