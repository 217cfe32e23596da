import re

import xxhash

from tessera.llm import op04_simhash
from tessera.llm.op04_simhash import links, simhash_components


def brute_fingerprint(text, n):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    n = min(n, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, n, bits):
    prints = {d: brute_fingerprint(t, n) for d, t in rows}
    label = {d: d for d in prints}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {(d, f"{prints[d]:016x}", find(d)) for d in prints}


def test_components_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(9001, None), (9002, ""), (9003, " \n"), (9004, "one"), (9005, "One TWO\tthree"), (9006, "x " * 40000)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash_components(made).collect()}
    assert got == brute_components(rows, 4, 4)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = op04_simhash.op4_simhash(spark, sf)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert {tuple(r) for r in out.collect()} == brute_components(rows, 4, 4)


def test_links_are_whole(spark):
    import random

    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(60)] + [0, 2**64 - 1]
    points = set(base)
    for p in base:
        for _ in range(6):
            q = p
            for b in r.sample(range(64), r.randrange(1, 7)):
                q ^= 1 << b
            points.add(q)
    signed = {p - (1 << 64) if p >> 63 else p: p for p in points}
    for bits in (0, 1, 4, 6):
        got = links(spark.createDataFrame([(s,) for s in signed], "fp long"), bits).collect()
        pairs = [frozenset((signed[x.a], signed[x.b])) for x in got]
        assert len(pairs) == len(set(pairs))
        want = {frozenset((a, b)) for a in points for b in points if a < b and (a ^ b).bit_count() <= bits}
        assert set(pairs) == want


def test_null_ids_and_repeats(spark):
    text = " ".join(f"word{i}" for i in range(50))
    rows = [(5, text), (5, text), (None, text), (3, text), (8, "other words stand here in place")]
    got = simhash_components(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("3", "3"), ("5", "3"), ("5", "3"), ("8", "8"), ("None", "None")]
    assert op04_simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
