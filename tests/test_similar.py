"""Similar pairs against a comparison of all pairs."""

import ast
import difflib
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import parsing as P
from tessera.operators import similar as M
from tessera.plans.joins import c6_code, d13_code, functions_of


def tokens(text, pattern=r"\w+|[^\w\s]"):
    return re.findall(pattern, text)


def bound(a, b):
    return 2 * (Counter(a) & Counter(b)).total() / (len(a) + len(b))


def brute(rows, least=0.8):
    """Every pair a < b of (key, text, ast): its ratios, if similar."""
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
    held, out = [(k, tokens(t), tokens(s, r"\w+")) for k, t, s in sorted(rows)], {}
    for i, (a, ta, sa) in enumerate(held):
        for b, tb, sb in held[i + 1 :]:
            if 0.4 + 1.2 * min(len(sa), len(sb)) / (len(sa) + len(sb)) >= 0.8 and 0.4 * bound(ta, tb) + 0.6 * bound(sa, sb) >= 0.8 - 1e-9:
                trees, text = ratio(sa, sb), ratio(ta, tb)
                if 0.4 * text + 0.6 * trees >= least - 1e-9:
                    out[a, b] = (round(text, 6), round(trees, 6), round(0.4 * text + 0.6 * trees, 6))
    return out


@pytest.mark.parametrize("sample", [1, 16])
def test_code_pairs_are_all_found(spark, monkeypatch, sample):
    monkeypatch.setattr(M, "SAMPLE", sample)
    r = random.Random(8)
    lines = [f"    {r.choice(['x', 'y'])} = a.{r.choice(['run', 'load', 'keep', 'fold'])}_{r.randrange(30)}(b, {r.randrange(4)})" for _ in range(60)]
    made = {}
    for i in range(40):
        body = r.sample(lines, r.randrange(2, 9))
        made[f"p{i:03}"] = body
        for k in range(r.randrange(3)):  # edited copies
            other = list(body)
            other[r.randrange(len(other))] = r.choice(lines)
            made[f"p{i:03}_{k}"] = other
    made["p000_same"] = made["p000"]
    src = spark.createDataFrame([(k, "def f(a, b):\n" + "\n".join(v) + "\n    return x\n") for k, v in made.items()] + [("bad", "def ("), ("none", None)], "path string, code string").repartition(3)
    functions = P.code_functions(src).select(F.col("path").alias("key"), "text", "ast")
    rows = [tuple(x) for x in functions.collect()]
    want = brute(rows)
    got = {(x.a, x.b): (round(x.text_ratio, 6), round(x.ast_ratio, 6), round(x.similarity, 6)) for x in M.code_class_pairs(M.code_classes(functions)).collect()}
    first = {}
    for row in sorted(rows):
        first.setdefault(row[1:], row[0])
    assert len(want) > 30 and len(first) < len(rows) and got == {p: v for p, v in want.items() if set(p) <= set(first.values())}
    total = len(rows) * (len(rows) - 1) // 2
    assert [tuple(x) for x in M.code_repetition(functions).collect()] == [(len(rows), total, len(want), round(100 * len(want) / total, 2))]
    with pytest.raises(ValueError):
        M.code_class_pairs(M.code_classes(functions), 0.3)
    assert [tuple(x) for x in M.code_repetition(functions.limit(0)).collect()] == [(0, 0, 0, 0.0)]


def test_queries(spark, sf):
    rows = [tuple(x) for x in functions_of(spark, sf).collect()]
    for _, text, tree in rows:
        assert ast.parse(text) and tree.startswith("FunctionDef(")
    first = {}
    for k, t, s in sorted(rows):
        first.setdefault((tuple(tokens(t)), tuple(tokens(s, r"\w+"))), (k, t, s))
    want = brute(first.values())
    assert {(x.a, x.b): (x.text_ratio, x.ast_ratio, x.similarity) for x in c6_code(spark, sf).collect()} == want
    found = d13_code(spark, sf).collect()
    assert found[0].functions == len(rows) > 50 and found[0].similar >= len(want) > 0


def test_names_are_normalised(spark):
    code = "class A:\n    def f(self, x, *, y=[]):\n        # c\n        z = x + y\n        return g(z, 'a#b')\n    def g(this, one, *, two=[]):\n        three = one + two\n        return h(three, 'a#b')\n"
    f, g = sorted(P.code_functions(spark.createDataFrame([("p", code)], "path string, code string")).collect(), key=lambda x: x.name)
    assert f.text.replace("def f", "def g") == g.text and f.ast.replace("'f'", "'g'", 1) == g.ast and "'a#b'" in f.text and "# c" not in f.text
    assert M.block_ratio([], []) == 1.0 and M.block_ratio([1, 2, 3], [1, 9, 3]) == pytest.approx(2 / 3)


def test_long_sequences_have_the_same_blocks(monkeypatch):
    r = random.Random(2)
    for _ in range(150):
        a = [r.randrange(r.choice([2, 6, 50])) for _ in range(r.randrange(1, 90))]
        b = [x for x in a if r.random() < 0.8] + [r.randrange(6) for _ in range(r.randrange(1, 40))]
        monkeypatch.setattr(M, "PLAIN", 1 << 16)
        want = M.block_ratio(a, b)
        monkeypatch.setattr(M, "PLAIN", 0)
        assert M.block_ratio(a, b) == want


@pytest.mark.parametrize("most", [1_000_000, 1])
def test_only_sets_that_meet_are_joined(spark, monkeypatch, most):
    """Few met sets are broadcast, so that the others stay where they are; many give the same pairs."""
    from tessera.operators import similar

    monkeypatch.setattr(similar, "MET", most)
    rows = spark.createDataFrame([(i, list(range(100 * i, 100 * i + 20))) for i in range(30)] + [(50, list(range(19))), (51, list(range(20)))], "id long, tokens array<bigint>")
    out = similar.jaccard_pairs(rows, 0.8)
    assert (out._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 2) == (most > 1)
    assert {(r.a, r.b, r.jaccard) for r in out.collect()} == {(0, 50, 0.95), (0, 51, 1.0)}


@pytest.mark.parametrize("query", ["pairs", "ratio"])
def test_whole_sets_are_not_shuffled(spark, query):
    """Sets that meet no other are not shuffled whole, and a set in many pairs not once for each."""
    from tessera.operators.aggregates import similar_pair_ratio

    written = lambda: (time.sleep(1), spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite())[1]
    apart = spark.range(3000).select("id", F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(399)), lambda k: F.xxhash64("id", k))).alias("tokens"))
    dense = spark.range(5000, 5300).select("id", F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(399)), lambda k: F.when(k < 380, k.cast("bigint")).otherwise(F.col("id") * 1000 + k))).alias("tokens"))
    rows = apart.union(dense).union(dense.filter("id < 5010").withColumn("id", F.col("id") + 1000))
    before = written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as in tables too large for it
    try:
        found = (M.jaccard_pairs if query == "pairs" else similar_pair_ratio)(rows, 0.8).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    if query == "pairs":
        assert sorted((r.a, r.b) for r in found if r.a < 5300 and r.b < 6000) == [(a, b) for a in range(5000, 5300) for b in range(a + 1, 5300)]
        assert {r.jaccard for r in found if r.b < 6000} == {380 / 420} and sorted((r.a, r.b, r.jaccard) for r in found if r.b >= 6000) == [(i, i + 1000, 1.0) for i in range(5000, 5010)]
    else:
        got = found[0]
        assert (got.similar, got.pairs) == (310 * 309 // 2, 3310 * 3309 // 2)
    assert written() - before < 2 * 3310 * 400 * 8


def test_chance_pairs_are_left_out_and_no_other(spark):
    """Pairs of which no more is known than one shared token go, all that may be similar stay, also
    where a part of the spread holds more tokens than a byte counts."""
    r = random.Random(3)
    base = [sorted(r.sample(range(10**9), n)) for n in (30, 400, 3000, 90_000)]
    sets = [s[: int(len(s) * part)] for s in base for part in (1.0, 0.9, 0.79)] + [sorted({base[k][0], *r.sample(range(10**9), 400)}) for k in (0, 1)]
    rows = spark.createDataFrame(list(enumerate(sets)), "key long, tokens array<bigint>").withColumn("n", F.size("tokens"))
    held = M.with_prefix(rows, "tokens", 0.8, keep=["key", "n"])
    every = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))]
    kept = {(x.a, x.b) for x in M._near(spark.createDataFrame(every, "a long, b long"), held, 0.8 / 1.8).collect()}
    similar = {(i, j) for i, j in every if len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]})}
    assert len(similar) == 8 and similar <= kept and not kept & {(0, 12), (1, 12), (3, 13), (4, 13), (12, 13)}
