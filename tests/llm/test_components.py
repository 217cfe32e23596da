import random

import pytest

from tessera.llm import components as module
from tessera.llm.components import components


@pytest.mark.parametrize("finish, held", [(200_000, 500_000), (0, 500_000), (0, 3), (200_000, 3)])
def test_components(spark, monkeypatch, finish, held):
    monkeypatch.setattr(module, "FINISH", finish)
    monkeypatch.setattr(module, "HELD", held)
    r = random.Random(7)
    path = list(range(1000, 1120))
    r.shuffle(path)
    edges = list(zip(path, path[1:], strict=False)) + [(5, i) for i in range(6, 60)] + [(i, j) for i in range(200, 215) for j in range(200, 215)]
    edges += [(r.randrange(300, 500), r.randrange(300, 500)) for _ in range(90)] + [(-3, 5), (7, 7)]
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
