import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import op06_topk
from tessera.llm.op06_topk import exact_topk, op6_exact_topk

from .oracle import same


def test_sql(spark, sf):
    same(op6_exact_topk(spark, sf), op06_topk.ORACLE, sf)


def brute(rows, k):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in {i: min(v for j, v in fine if j == i) for i, _ in fine if i % 50 == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in fine if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)}
    return out


def test_bounds_leave_clusters_out():
    """Of clustered vectors most are under the bound; of unclustered ones few."""
    r = np.random.default_rng(2)
    centers = r.normal(size=(40, 64)) * 200
    rows = np.rint(centers[r.integers(0, 40, 20_000)] + r.normal(size=(20_000, 64)) * 20)
    pivots = op06_topk.fit_pivots(rows[:4096], 40)
    near = op06_topk.squared(rows, pivots)
    p = near.argmin(1)
    d = np.sqrt(near[np.arange(len(rows)), p])
    cells = [(i, 0, d[p == i].min(), d[p == i].max(), (rows[p == i] ** 2).sum(1).max(), int((p == i).sum())) for i in range(40) if (p == i).any()]
    directory = op06_topk.Directory(pivots, cells)
    queries = rows[:200]
    kth = np.sort(queries @ rows.T, axis=1)[:, -6]
    visited = ((directory.bounds(queries) >= kth[:, None]) * directory.rows[None]).sum(1) / len(rows)
    assert visited.mean() < 0.3


def test_cases(spark, monkeypatch):
    r = random.Random(4)
    center = [[r.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [c + r.gauss(0, 0.2) for c in center[i % 5]]) for i in range(700)]
    rows += [(i, [0.5] * 8) for i in range(700, 1000)]  # a vector that a third of the rows share
    rows += [(1000, None), (1050, [None] * 8), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (None, [1.0] * 8), (1200, [3.0]), (1250, []), (5, [0.1] * 8), (50, [9.0] * 8)]
    docs = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, block int")
    want = brute(rows, 5)
    for size in (8192, 60):
        monkeypatch.setattr(op06_topk, "BLOCK_ROWS", size)
        monkeypatch.setattr(op06_topk, "PORTION", 8192 if size == 8192 else 5)
        got = exact_topk(docs, F.col("vec_id") % 50 == 0).collect()
        assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert exact_topk(docs.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    huge = [(i, [float(i % 7), 5000.0 * (i % 3), -1e9 if i == 40 else 0.25]) for i in range(120)] + [(150, [0.0, 0.0, 0.0]), (200, [1e10, 1.0, 1.0])]
    got = {tuple(x) for x in exact_topk(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()}
    assert got == brute(huge, 5) and (0, 1, 200, 0) not in got
    wide = [(0, [2.0**22, 0.0]), (1, [2.0**22, 1.0]), (2, [2.0**-8, 3.0]), (3, [5.0, 1.0]), (4, [-(2.0**22), 1.0]), (50, [0.0, 2.0**47])]
    with pytest.raises(Exception, match="does not fit a long"):  # 0 and 1 score 2**60 in units of 256 * 256, 2**76 in all
        exact_topk(spark.createDataFrame([(0, [2.0**22]), (1, [2.0**30])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    got = {tuple(x) for x in exact_topk(spark.createDataFrame(wide, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=3).collect()}
    assert got == {x for x in brute(wide, 3) if x[0] == 0} and max(s for *_, s in got) == 2**60
    # products past 64 bits that are not returned stop nothing, and never rank as small
    far = [(0, [2.0**47]), (1, [0.0]), (2, [2.0**-8]), (3, [-(2.0**60)]), (4, [2.0**-7])]
    got = {tuple(x) for x in exact_topk(spark.createDataFrame(far, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=3).collect()}
    assert got == {x for x in brute(far, 3) if x[0] == 0}
    few = spark.createDataFrame([(0, [1.0]), (3, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in exact_topk(few, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 3, 131072)]
