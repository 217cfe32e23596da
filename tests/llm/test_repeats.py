import hashlib
import re

import pytest

from tessera.llm import op01_substring, op09_suffix, repeats

BASE = " ".join(f"w{i}" for i in range(60))


def rows():
    import random

    r = random.Random(5)
    vocabulary = [f"v{i}" for i in range(40)]
    out = [(1, BASE), (2, "head " + BASE + " tail"), (3, None), (4, ""), (5, "short text"), (6, BASE), (7, BASE + "\n\t" + BASE), (7, BASE), (None, BASE)]
    for i in range(8, 60):
        cut = r.randrange(30)
        out.append((i, " ".join(r.choices(vocabulary, k=r.randrange(80))) + " " + " ".join(BASE.split()[cut : cut + r.randrange(45)]) + "  " + " ".join(r.choices(vocabulary[:3], k=r.randrange(60)))))
    out.append((60, "é" * 300))
    out.append((61, "x" + "é" * 90))
    out.append((62, " ".join(["big"] * 70000)))
    return out


def brute_words(data, width):
    first = {}
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in data]
    for d, w in words:
        if d is not None:
            for i in range(len(w) - width + 1):
                key = tuple(w[i : i + width])
                first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        if d is not None:
            for i in range(len(w) - width + 1):
                if first[tuple(w[i : i + width])] < (d, i):
                    gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), kept))
    return sorted(out, key=str)


def brute_bytes(data, width):
    first = {}
    for d, t in data:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - width + 1):
                first[b[i : i + width]] = min(first.get(b[i : i + width], d), d)
    out = []
    for d, t in data:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - width + 1):
                if first[b[i : i + width]] < d:
                    gone[i : i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(params=["usual", "small"])
def sizes(request, monkeypatch):
    if request.param == "small":  # many blocks and buckets, every key hot
        for name, value in {"BLOCK_BYTES": 3000, "BUCKET_RUNS": 50, "CHUNK_TOKENS": 400, "FEW": 1, "MANY": 3}.items():
            monkeypatch.setattr(repeats, name, value)
        monkeypatch.setattr(op01_substring, "BLOCK_BYTES", 3000)
    return request.param


def test_words(spark, sizes):
    data = rows()
    docs = spark.createDataFrame([(d, t, "e") for d, t in data], "doc_id long, text string, extra string")
    got = op01_substring.substring_dedup(docs, carry=("extra", "doc_id")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute_words(data, 20)
    assert {r.extra.extra for r in got} == {"e"} and all(r.extra.doc_id == r.doc_id for r in got)


def test_words_keep_layout(spark):
    docs = spark.createDataFrame([(1, BASE), (2, f" a\n b {BASE}\n\nend  "), (3, " clean\n\ttext "), (4, BASE), (5, None), (6, ""), (7, " \n")], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in op01_substring.substring_dedup(docs, layout=True).collect()}
    assert got == {1: BASE, 2: " a\n b end  ", 3: " clean\n\ttext ", 4: "", 5: None, 6: "", 7: " \n"}


def test_bytes(spark, sizes):
    data = [r for r in rows() if r[0] != 62] + [(62, "big " * 3000), (63, "big " * 2000)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = op09_suffix.suffix_dedup(docs).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got), key=str) == brute_bytes(data, 50)


def test_queries(spark, sf):
    """The contract's columns and digests over a whole table."""
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op01_substring.op1_substring_dedup(spark, sf).collect()
    want = [(d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in brute_words(data, 20)]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == sorted(want, key=str)
    got = op09_suffix.op9_suffix_dedup(spark, sf).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute_bytes(data, 50)


def test_collisions_are_sorted_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(op09_suffix.Suffixes, "same", lambda self, a, b, n: self.data[a] == self.data[b])
    data = [r for r in rows() if r[0] != 62]
    import numpy as np

    text = np.frombuffer(b"abcdeabcxeabcde", dtype=np.uint8)
    order, begins = op09_suffix.equal_suffixes(op09_suffix.Suffixes(text, 5), np.array([0, 5, 10]), np.array([3]))
    assert begins.sum() == 2 and set(order[:2]) == {0, 2}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op01_substring.substring_dedup(docs).collect() == [] and op09_suffix.suffix_dedup(docs).collect() == []
