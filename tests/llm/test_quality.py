import re

import numpy as np

from tessera.llm import boosted
from tessera.llm.op07_quality import FEATURES, MONOTONE, op7_quality_rules, quality_rules, sample_features, train


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_counts(spark):
    texts = [None, "", "a b a b a b a b", "x\nx\n \n \nx y\nx y", "é ü#*$ %&|<>", "one two three four one two three", "w " * 3000, "one line\r\none line\r\n"] + [" ".join("abc"[i * k % 3] for i in range(k)) for k in range(30, 80)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules(docs, labels, carry=("kept", "doc_id")).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)
        assert r.extra.kept == 5 and r.extra.doc_id == i
    assert quality_rules(docs.limit(0), labels).collect() == []
    rows = spark.createDataFrame([(None, "a " * 60), (1, "b"), (1, "b")], "doc_id long, text string")
    assert len(quality_rules(rows, labels).collect()) == 3


def test_query_matches_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op7_quality_rules(spark, sf).collect():
        if len(texts[r.doc_id]) < 4000:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    x, y = sample_features(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"), 6000)
    half = np.arange(len(y)) % 2 == 0
    trees, cut = train(x[half], y[half])
    kept = trees.probability(x[~half]) >= cut
    assert (kept[y[~half] > 0]).mean() > 0.98
    assert (~kept[y[~half] == 0]).mean() > 0.9


def test_constraints_hold_and_arrays_match_nodes():
    r = np.random.default_rng(1)
    x = r.normal(size=(600, len(FEATURES)))
    y = (x[:, 2] * r.normal(size=600) + x[:, 0] > 0).astype(float)
    trees = boosted.fit(x, y, MONOTONE)
    for f in np.flatnonzero(MONOTONE):
        for row in x[:20]:
            many = np.repeat(row[None], 50, axis=0)
            many[:, f] = np.linspace(-3, 3, 50)
            assert (MONOTONE[f] * np.diff(trees.margin(many)) >= -1e-12).all()
    for row in x[:20]:
        margin = trees.bias
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            margin += trees.value[node]
        assert np.isclose(margin, trees.margin(row[None])[0])
    assert ((trees.probability(x) > 0.5) == (y > 0)).mean() > 0.8
