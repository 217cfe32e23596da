"""Searches and pair sums against all pairs, on whole and broken vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import grams, topk
from tessera.operators.topk import cosine_pairs, indexed_nearest, nearest

BROKEN = [None, [], [None] * 4, [float("nan"), 1.0, 1.0, 1.0], [float("inf")] * 4, [1.0, 2.0], [1.0] * 9, [0.0] * 4]


def vectors(n, r, centres=5, width=4):
    held = [[r.gauss(0, 1) for _ in range(width)] for _ in range(centres)]
    return [(i, [c + r.gauss(0, 0.3) for c in held[i % centres]], f"g{i % 7}") for i in range(n)]


def cosine(a, b):
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=False)) / size if size else None


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("kind", ["cosine", "l2"])
@pytest.mark.parametrize("block", [8192, 50])
def test_nearest(spark, monkeypatch, kind, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    r = random.Random(1)
    rows = vectors(400, r) + [(1000 + i, v, "g0") for i, v in enumerate(BROKEN)] + [(2000 + i, [0.25] * 4, "g1") for i in range(200)]
    held = spark.createDataFrame(rows, "vec_id long, embedding array<double>, grp string")
    asked = [(i, v) for i, v, _ in rows if i % 50 == 0 or 1000 <= i < 2000]
    queries = spark.createDataFrame(asked, "query_id long, q array<double>")
    score = cosine if kind == "cosine" else lambda a, b: 1 / (1 + math.dist(a, b))
    want, groups = set(), set()
    for q, v in asked:
        found = sorted((-round(s, 9), i, g) for i, w, g in rows if fine(v) and fine(w) and len(v) == len(w) > 0 and (s := score(v, w)) is not None)
        want |= {(q, i, p + 1) for p, (_, i, _) in enumerate(found[:6])}
        best = {}
        for x in found:
            best.setdefault(x[2], x)
        groups |= {(q, i, g, p + 1) for p, (_, i, g) in enumerate(sorted(best.values())[:3])}
    got = nearest(held, queries, kind, 6).collect()
    assert {(x.query_id, x.vec_id, x.place) for x in got} == want and len(got) == len(want)
    assert {(x.query_id, x.vec_id, x.grp, x.place) for x in nearest(held, queries, kind, 3, group="grp").collect()} == groups
    for none in (nearest(held.limit(0), queries, kind, 3), nearest(held, queries.limit(0), kind, 3), indexed_nearest(held.limit(0), queries, kind, 3), indexed_nearest(held, queries.limit(0), kind, 3)):
        assert none.collect() == []


@pytest.mark.parametrize("kind", ["cosine", "l2"])
@pytest.mark.parametrize("centres", [30, 3000])  # clusters; hardly any
def test_index_finds_nine_in_ten(spark, monkeypatch, kind, centres):
    rows = vectors(6000, random.Random(2), centres, 16) + [(10_000 + i, v, "g") for i, v in enumerate(BROKEN)]
    held = spark.createDataFrame(rows, "vec_id long, embedding array<double>, grp string")
    queries = held.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    true = {(x.query_id, x.vec_id): x.score for x in nearest(held, queries, kind, 10).collect()}
    for block in (8192, 40):
        monkeypatch.setattr(topk, "BLOCK", block)
        found = {(x.query_id, x.vec_id): x.score for x in indexed_nearest(held, queries, kind, 10).collect()}
        assert len(set(true) & set(found)) >= 0.9 * len(true)
        assert all(found[k] == pytest.approx(true[k]) for k in set(true) & set(found))


def test_index_of_the_table(spark):
    """Recall on the given vectors, which are not clustered, and how many cells a query visits."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    queries = rows.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    true, found = ({(x.query_id, x.vec_id) for x in f(rows, queries, "cosine", 20).collect()} for f in (nearest, indexed_nearest))
    assert len(true & found) >= 0.9 * len(true)


@pytest.mark.parametrize("floor", [None, -2.0, 0.2, 0.9, 1.0])
def test_pairs_above_a_floor(spark, monkeypatch, floor):
    monkeypatch.setattr(topk, "PAIR_BLOCK", 40)
    rows = vectors(200, random.Random(3), 6, 20) + [(1000 + i, v, "g0") for i, v in enumerate(BROKEN)] + [(3000 + i, [1.0] * 20, "g0") for i in range(30)]
    got = cosine_pairs(spark.createDataFrame(rows, "vec_id long, embedding array<double>, grp string"), "grp", floor).collect()
    want = {(g, i, j): c for i, v, g in rows for j, w, h in rows if i < j and g == h and fine(v) and fine(w) and (c := cosine(v, w)) is not None and (floor is None or c >= floor - 1e-12)}
    assert len(got) == len(want) and {(x.g, x.i, x.j): pytest.approx(x.score) for x in got} == want


def test_agreement_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(grams, "GROUPS", 2)
    r = random.Random(4)
    rows = [(i, v, [a + r.gauss(0, 0.4) for a in v[::-1]], g) for i, v, g in vectors(300, r)] + [(900, [0.0] * 4, [1.0] * 4, "g0"), (901, None, [1.0] * 4, "g0"), (902, [1.0] * 4, [None] * 4, "g1"), (903, [1.0] * 4, [2.0] * 4, "alone"), (904, [1.0] * 4, [2.0] * 4, None)]
    held = spark.createDataFrame(rows, "id long, a array<double>, b array<double>, g string").repartition(3)
    got = {x.g: x for x in grams.space_agreement(held, "g", F.col("a"), F.col("b")).collect()}
    for g in {x[3] for x in rows}:
        mine = [x for x in rows if x[3] == g and fine(x[1]) and fine(x[2]) and any(x[1]) and any(x[2])]
        pairs = [(cosine(x[1], y[1]), cosine(x[2], y[2])) for k, x in enumerate(mine) for y in mine[k + 1 :]]
        assert got[g].n == len(mine)
        assert got[g].agreement == pytest.approx(np.corrcoef(*zip(*pairs, strict=True))[0, 1]) if len(mine) > 2 else got[g].agreement is None
    assert grams.space_agreement(held.limit(0), "g", F.col("a"), F.col("b")).collect() == []


def test_pairs_are_rounded_where_they_are_made(spark):
    """Halves away from zero and no negative zero, as SQL has it, and no rounding row by row after."""
    from tessera.plans.registry import QUERIES

    assert topk.half_up(np.array([0.125, -0.125, -0.004, 0.1249, float("nan")]), 2).astype(str).tolist() == ["0.13", "-0.13", "0.0", "0.12", "nan"]
    got = cosine_pairs(spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [-1e-9, 1.0], 0), (3, [1.0, 1.0], 0)], "vec_id long, embedding array<double>, grp int"), "grp", None, 4).collect()
    assert {(x.i, x.j): str(x.score) for x in got} == {(1, 2): "0.0", (1, 3): "0.7071", (2, 3): "0.7071"}
    for name in ("f7_pairwise_cosine", "f7_cosine_above_floor"):
        assert "round(" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_are_shuffled_once(spark, monkeypatch):
    """A row goes to the pairs of blocks of its own block, in its own type, and no group goes through one task."""
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0], i % 2) for i in range(300)] + [(900, None, 0), (901, [1.0, float("inf")], 1), (902, [1.0], None)], "vec_id long, embedding array<float>, grp int").repartition(4)
    plan = cosine_pairs(rows, "grp", 0.3)._jdf.queryExecution()
    assert "cast(embedding#" not in plan.optimizedPlan().toString()
    assert sum("Exchange hashpartitioning" in x for x in plan.executedPlan().toString().splitlines()) == 2  # of counts; of pairs of blocks
    monkeypatch.setattr(topk, "PAIR_BLOCK", 40)
    dealt = topk._tiles(rows, "grp").collect()
    assert len(dealt) == 300 * 4 and len({(x.g, x.x, x.y) for x in dealt}) == 2 * 4 * 5 // 2
    assert all(x.x <= x.y and x.own in (x.x, x.y) for x in dealt) and len({(x.vec_id, x.x, x.y) for x in dealt}) == len(dealt)
    monkeypatch.setattr(topk, "PAIR_BLOCK", 8192)
    monkeypatch.setattr(topk, "PAIR_LEAST", 10)  # small groups: up to four blocks
    assert topk._tiles(rows, "grp").count() == 300 * 4
    monkeypatch.setattr(topk, "PAIR_LEAST", 75)
    assert topk._tiles(rows, "grp").count() == 300 * 3  # broken rows are counted for the number of blocks only


@pytest.mark.parametrize("floor", [None, -1.0, 0.3, 0.95])
@pytest.mark.parametrize("y", [0, 1])
def test_pairs_come_in_bounded_batches(monkeypatch, floor, y):
    """Pieces of a pair of blocks against all its pairs; ids that are given twice meet no equal id."""
    import pyarrow as pa

    r = np.random.default_rng(6)
    v = np.concatenate([r.normal(size=(180, 5)), [[0.0] * 5] * 2, [[1e-3] * 5, [2e3] * 5]]).astype(np.float32)
    ids = np.append(r.permutation(183), 7)
    own = ids % 2 * y
    table = pa.table({"g": pa.array([3] * 184, pa.int32()), "own": pa.array(own, pa.int32()), "vec_id": ids, "v": v.tolist()})
    monkeypatch.setattr(topk, "SCORES", 400)
    key = pa.scalar(3, pa.int32()), pa.scalar(0), pa.scalar(y)
    got = list(topk._tile(floor, None)(key, iter(table.to_batches(50))))
    assert max(x.num_rows for x in got) <= 400 and {x.schema.field("g").type for x in got} == {pa.int32()}
    w = v.astype(float)
    size = np.sqrt((w * w).sum(1))
    c = w @ w.T / np.where(size > 0, size, np.nan)[:, None] / np.where(size > 0, size, np.nan)[None]
    met = (ids[:, None] < ids[None]) & ~np.isnan(c) & ((own[:, None] != own[None]) | (y == 0)) & (True if floor is None else c >= floor - 1e-12)
    want = sorted((ids[a], ids[b], c[a, b]) for a, b in zip(*np.nonzero(met), strict=True))
    found = sorted((x["i"], x["j"], x["score"]) for z in got for x in z.to_pylist())
    assert len(found) == len(want) and np.allclose(found, want, rtol=0, atol=1e-12)


def test_single_precision_loses_no_pair():
    """Pairs at the floor and a few units of double beside it, which single precision cannot tell apart."""
    angles = np.arccos(0.3 + np.arange(-40, 41) * 1e-9)
    q, v = np.array([[1.0, 0.0]]), np.stack([np.cos(angles), np.sin(angles)], 1)
    row, at, score = topk._products(q, v, v.astype(np.float32), 0.3)
    assert at.tolist() == np.flatnonzero(v[:, 0] >= 0.3 - 1e-12).tolist() and row.tolist() == [0] * len(at)
    assert np.array_equal(score, v[at, 0])


def test_scores_at_once_are_bounded(spark, monkeypatch):
    """A block meets as many queries at once as the bound allows, with the same result."""
    r = np.random.default_rng(5)
    s = r.integers(0, 4, (30, 50)).astype(float)
    s[3] = -np.inf
    row, at = topk._first(s, 7)
    assert row.tolist() == np.repeat(np.arange(30), 7).tolist() and at.tolist() == np.argsort(-s, axis=1, kind="stable")[:, :7].ravel().tolist()
    assert topk._first(s[:, :3], 7)[1].tolist() == np.argsort(-s[:, :3], axis=1, kind="stable").ravel().tolist()
    sizes, plain = [], topk._scores
    monkeypatch.setattr(topk, "_scores", lambda kind, q, x, *more: sizes.append(len(q) * len(x)) or plain(kind, q, x, *more))
    import pyarrow as pa

    rows = pa.table({"vec_id": range(400), "embedding": r.normal(size=(400, 4)).tolist()})
    asked = pa.table({"query_id": range(300), "q": r.normal(size=(300, 4)).tolist()})
    whole = topk._meet("l2", 5, 4, False)(rows, asked)
    assert max(sizes) <= topk.SCORES
    monkeypatch.setattr(topk, "SCORES", 1000)
    sizes.clear()
    assert topk._meet("l2", 5, 4, False)(rows, asked).equals(whole) and max(sizes) <= 1000 and len(sizes) == 150
