"""Two-level numbers and running sums against a plain loop."""

import random

from pyspark.sql import functions as F

from tessera.operators.prefix import places, running


def test_places_and_sums(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot"] * 8 + ["a", "b", None]), r.choice([None, *range(40)]), r.choice([None, 1.0, 2.5])) for _ in range(3000)]
    held = spark.createDataFrame(rows, "k string, t int, v double").repartition(7)
    got = running(held, ["k"], ["t", "v"], {"s": F.col("v")}).collect()
    for key in ("hot", "a", "b", None):
        mine = sorted((x for x in rows if x[0] == key), key=lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or 0))
        sums, total, seen = [], 0.0, False
        for x in mine:
            total, seen = total + (x[2] or 0), seen or x[2] is not None
            sums.append((*x, total if seen else None))
        assert sorted(map(str, sums)) == sorted(str(tuple(x)) for x in got if x.k == key)
    numbered = places(held, ["k"], ["t"]).collect()
    for key in ("hot", "a", "b", None):
        mine = sorted((x.place, x.t if x.t is not None else -1) for x in numbered if x.k == key)
        assert [p for p, _ in mine] == list(range(1, len(mine) + 1)) and [t for _, t in mine] == sorted(t for _, t in mine)
    assert sorted(x.place for x in places(held, [], ["t"]).collect()) == list(range(1, 3001))
    assert running(held.limit(0), ["k"], ["t"], {"s": F.col("v")}).collect() == []
