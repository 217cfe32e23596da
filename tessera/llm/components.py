"""Connected components by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import checkpointed

#: Links that one task finishes (with more of them, rounds over all tasks do), and nodes that a
#: task holds at a time.
FINISH, HELD = 200_000, 500_000


def _stars(whole: bool):
    """Links (a, b) of a task to (a, b): each node and the least node a that it reaches by
    links held together; whole: all links are held, and the least nodes have a row too."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (above := up.setdefault(x, x)) != x:
                up[x] = x = up[above]
            return x

        def made() -> pa.RecordBatch:
            found = [f for f in ((root(x), x) for x in list(up)) if whole or f[0] != f[1]]
            up.clear()
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            if not whole and len(up) >= HELD:
                yield made()
        yield made()

    return scan


def _roots(parents: DataFrame) -> DataFrame:
    """Pointer jumping: each node's (node, label) last label on its way down."""
    while True:
        above = parents.select(F.col("node").alias("label"), F.col("label").alias("further"))
        stepped = checkpointed(parents.join(above, "label", "left").select("node", "label", F.coalesce("further", "label").alias("next")))
        parents = stepped.select("node", F.col("next").alias("label"))
        if stepped.filter("next <> label").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """node, label: for each end of an edge (columns a, b: bigint) the smallest node it reaches.

    Each task first replaces its own edges by stars.  If FINISH or fewer are left, one
    task joins these.  Otherwise rounds follow: every node points to the least of itself and its
    neighbours, pointers are followed to their roots, and the edges are contracted to the roots, so that at
    most half of the nodes and only edges between different roots go on.  Every table is
    written in between, and both sides of the joins are scans, so skewed ones can be split."""
    stars = "a bigint, b bigint"
    edges = checkpointed(edges.select("a", "b").filter("a <> b").mapInArrow(_stars(False), stars))
    if edges.count() <= FINISH:
        return checkpointed(edges.coalesce(1).mapInArrow(_stars(True), stars).select(F.col("b").alias("node"), F.col("a").alias("label")))
    edges = checkpointed(edges.distinct())
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("next")).union(edges.select("b", "a"))
        roots = _roots(checkpointed(both.groupBy("node").agg(F.least("node", F.min("next")).alias("label"))))
        to_a, to_b = roots.toDF("a", "root_a"), roots.toDF("b", "root_b")
        met = edges.join(to_a, "a").join(to_b, "b").filter("root_a <> root_b")
        edges = checkpointed(met.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct())
        if labels is None:
            labels = roots
        else:
            labels = checkpointed(labels.join(roots.toDF("label", "further"), "label", "left").select("node", F.coalesce("further", "label").alias("label")))
    return labels
