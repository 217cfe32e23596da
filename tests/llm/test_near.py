import random

from pyspark.sql import functions as F

from tessera.llm import near
from tessera.llm.near import similar_components

from .test_simhash import brute_fingerprint


def shingles(text, n=5):
    words = (text or "").lower().split()
    n = min(n, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def brute(rows):
    """The classes by comparing all pairs, and the pairs of different sets that are linked."""
    sets, label, pairs = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}, []

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            x, y = sets[a], sets[b]
            if a < b and (x == y or 5 * len(x & y) >= 4 * len(x | y)):
                pairs += [(a, b)] * (x != y)
                p, q = find(a), find(b)
                label[max(p, q)] = min(p, q)
    return {(d, find(d)) for d in sets}, pairs


def edited(r, words, times):
    out = list(words)
    for i in r.sample(range(len(out)), times):
        out[i] = f"new{r.random()}"
    return " ".join(out)


def test_every_pair_of_similar_sets(spark, monkeypatch):
    r = random.Random(5)
    rows = [(900, None), (901, ""), (902, "two words"), (903, "Two\tWORDS"), (904, "one two three four five six")]
    passage = [f"p{i}" for i in range(150)]
    for g in range(25):
        base = [f"w{r.randrange(4000)}" for _ in range(r.randrange(50, 400))] + passage * (g % 2)
        rows += [(g * 20 + i, edited(r, base, i * len(base) // 150)) for i in range(7)] + [(g * 20 + 9, " ".join(base))]
    want, pairs = brute(rows)
    texts = dict(rows)
    bits = [(brute_fingerprint(texts[a], 5) ^ brute_fingerprint(texts[b], 5)).bit_count() for a, b in pairs]
    assert sum(x > 6 for x in bits) > 20  # which fingerprints within six bits do not link
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(x) for x in similar_components(docs).collect()} == want
    monkeypatch.setattr(near, "SAMPLE", 1)
    monkeypatch.setattr(near, "BROADCAST", 0)
    assert {tuple(x) for x in similar_components(docs, max_bits=0).collect()} == want
    repeated = docs.union(docs.filter("doc_id < 60")).union(docs.limit(1).select(F.lit(None).cast("long"), "text"))
    assert {tuple(x) for x in similar_components(repeated).collect()} == want


def test_ids_shared_and_false_prints(spark):
    text = " ".join(f"word{i}" for i in range(50))
    rows = [(5, text), (5, "quite another text of nine words stands here now"), (3, text + " end"), (8, "a b c d e f g"), (7, "a b c d e f z")]
    got = sorted(tuple(x) for x in similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3), (5, 3), (5, 5), (7, 7), (8, 8)]
