import collections
import math
import re
import zlib

import numpy as np

from tessera.llm import op10_lm, ppm
from tessera.llm.op10_lm import lm_scores, op10_lm_score


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [None]


def out(d):
    return d is not None and zlib.crc32(str(d).encode()) % 5 == 1


def brute_ppm(train, order=op10_lm.ORDER):
    """Counts by context tuple (start marks in front of a text), and the log10 probability
    of a text by walking the trie."""
    nodes = collections.defaultdict(collections.Counter)

    def placed(text):
        b = [257] * order + [*(text or "").encode(), 256]
        return [(b[i - order : i], b[i]) for i in range(order, len(b))]

    for t in train:
        for before, s in placed(t):
            for k in range(order + 1):
                nodes[tuple(before[len(before) - k :])][s] += 1

    def score(text):
        total = 0.0
        for before, s in placed(text):
            refused = set()
            for k in range(order, -1, -1):
                here = {x: n for x, n in nodes.get(tuple(before[len(before) - k :]), {}).items() if x not in refused}
                if not here:
                    continue
                whole = sum(here.values()) + len(here)
                if s in here:
                    total += math.log10(here[s] / whole)
                    break
                total += math.log10(len(here) / whole)
                refused |= set(here)
            else:
                total -= math.log10(257 - len(refused))
        return total

    return score


def brute(rows):
    counts = collections.Counter(t for d, x in rows if not out(d) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    score = brute_ppm([x for d, x in rows if not out(d)])
    result = []
    for d, x in rows:
        own = tokens(x)
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        result.append((d, out(d), len(own), sum(counts[t] > 0 for t in own), n, base, score(x)))
    return result


def compare(got, want):
    key = lambda r: (str(r[0]), r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-5)


def test_cases(spark, monkeypatch):
    texts = [None, "", " ", "The the THE cat", "a\tb\n\nc", "éÉ ü", "日本 🙂", "word " * 2000, "long text " * 30_000, "unseen zzz qq"] * 2
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id the"), (3, "again the cat"), (3, "again the cat")]
    docs = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, score double")
    compare(lm_scores(docs).collect(), brute(rows))
    monkeypatch.setattr(op10_lm, "BLOCK_BYTES", 100)
    monkeypatch.setattr(op10_lm, "BUCKET_WORDS", 1)
    monkeypatch.setattr(op10_lm, "SALT_BLOCKS", 3)
    monkeypatch.setattr(op10_lm, "LEAST_BLOCKS", 1)
    compare(lm_scores(docs).collect(), brute(rows))
    assert lm_scores(docs.limit(0)).collect() == []
    held = [(d, t) for d, t in rows if out(d)]
    assert held
    compare(lm_scores(spark.createDataFrame(held, "doc_id long, text string")).collect(), brute(held))


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    compare(op10_lm_score(spark, sf).collect(), brute(rows))


def test_chances_sum_to_one():
    text = np.frombuffer(b"abracadabra abc", dtype=np.uint8)
    keys, counts = np.unique(ppm.events(text, np.array([len(text)]), 4)[0], return_counts=True)
    short = ppm.Short(np.bincount(ppm.events(text, np.array([len(text)]), 1)[0], minlength=ppm.BASE**2))
    for context in (b"abra", b"zbra", b"zzra", b"zzzz", b"zzza", b"  ab"):
        node = 0
        for c in context:
            node = node * ppm.BASE + c
        asked = np.setdiff1d(node * ppm.BASE + np.arange(ppm.SYMBOLS), keys)
        both = np.concatenate([keys, asked])
        order = np.argsort(both)
        chances = ppm.log10(both[order], np.concatenate([counts, 0 * asked])[order], 4, short)
        assert np.isclose((10 ** chances[both[order] // ppm.BASE == node]).sum(), 1)


def test_longer_contexts_beat_the_base(spark):
    """On held-out documents, which the model has not seen."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    r = lm_scores(docs).filter("held_out").groupBy().sum("score", "base_score").first()
    assert r[0] > r[1]
