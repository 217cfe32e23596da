import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import op12_negatives as op
from tessera.llm.op12_negatives import hard_negatives, op12_hard_negatives

from .oracle import same


def whole(x):
    return int(x) * 256 if abs(x) > 1e15 else math.floor(256 * x)


def brute(rows, asked, k=5):
    fine = [(i, g, [whole(x) for x in v]) for i, v, g in rows if i is not None and g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda v, w: sum(a * b for a, b in zip(v, w, strict=False))
    out = []
    for a in sorted({i for i, _, _ in fine if asked(i)}):
        label, v = min((g, w) for i, g, w in fine if i == a)
        others = sorted((-dot(v, w), i, g) for i, g, w in fine if i != a)
        for score, i, g in [x for x in others if x[2] == label][:k]:
            near = [x for x in others if x[2] != label and 80 * -score <= 100 * -x[0] <= 100 * -score][:k]
            out += [(a, i, r + 1, j, -score, -s) for r, (s, j, _) in enumerate(near)]
    return sorted(out)


def test_sql(spark, sf):
    out = op12_hard_negatives(spark, sf)
    assert out.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    same(out, op.ORACLE, sf)


def test_tables_give_inner_products():
    r = np.random.default_rng(1)
    for scale in (1, 1e6, 1e12, 1e30):
        rows = [r.normal(size=n) * scale for n in (3, 8, 20, 0, 64, 64, 17)]
        held = op.packed(np.concatenate(rows), np.array([len(x) for x in rows]))
        ints = [[whole(x) for x in v.tolist()] for v in rows]
        back = op.unpacked(*held)
        assert [[int(x) for x in b[: len(v)]] for b, v in zip(back, ints, strict=True)] == ints
        planes = op.planes_of(*held)
        got = op.scores(op.subset_sums(back, op.kind_for(back, len(planes))), planes)
        assert [[int(x) for x in y] for y in got] == [[sum(a * b for a, b in zip(v, w, strict=False)) for w in ints] for v in ints]


def test_cases(spark, monkeypatch):
    r = random.Random(4)
    center = [[r.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    rows = [(i, [c + r.gauss(0, 0.5) for c in center[i % 6]], r.choice([0, 0, 0, 1, 2, -3])) for i in range(700)]
    rows += [(i, [0.5] * 12, i % 3) for i in range(700, 1000)]  # a vector that a third of the rows share
    rows += [(1000, None, 1), (1020, [None] * 12, 1), (1040, [float("nan")] * 12, 1), (1060, [float("inf")] * 12, 1), (1080, [1.0] * 12, None), (None, [1.0] * 12, 1)]
    rows += [(1100, [3.0], 1), (1120, [], 1), (1140, [0.0] * 12, 0), (1160, [9.0] * 12, 7), (5, [0.1] * 12, 0), (20, [2.0] * 12, 0), (7, *rows[7][1:]), (7, *rows[7][1:]), (1180, [1e7, 1.0], 2), (1181, [0.9e7, 1.0], 0), (1182, [0.95e7], 2)]
    held = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, label int, block int").withColumns({c: F.lit(1) for c in ("planes", "anchor", "number", "bucket", "anchor_id")}).repartition(4)
    want = brute(rows, lambda i: i % 20 == 0)
    for block, portion in ((4096, 8192), (40, 7)):
        monkeypatch.setattr(op, "LEAST_BLOCK", block)
        monkeypatch.setattr(op, "PORTION", portion)
        got = sorted(tuple(x) for x in hard_negatives(held, F.col("vec_id") % 20 == 0).collect())
        assert got == want
    assert hard_negatives(held.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    plain = "vec_id long, embedding array<double>, label int"
    huge = [(0, [1e25, 1.0], 1), (1, [-1e25, 5.0], 1), (2, [0.0, 9.0], 1), (3, [0.0, 8.0], 2), (4, [0.0, 5.0], 2), (5, [-1e30], 2)]
    assert sorted(tuple(x) for x in hard_negatives(spark.createDataFrame(huge, plain), F.col("vec_id") == 0).collect()) == brute(huge, lambda i: i == 0) != []
    with pytest.raises(Exception, match="does not fit a long"):
        hard_negatives(spark.createDataFrame([(0, [1e25], 1), (1, [1e25], 1)], plain), F.col("vec_id") == 0).collect()
