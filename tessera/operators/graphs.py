"""Graphs as edge tables, and bounded iteration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import RangeTree
from .storage import checkpointed


def hot_nodes(degrees: DataFrame, over: int) -> DataFrame:
    return degrees.filter(F.col("degree") > over).select("node")


def ego_edges(edges: DataFrame, hot: DataFrame) -> DataFrame:
    """src, dst of the distinct edges among the hot nodes and their neighbours."""
    e = edges.select("src", "dst").distinct()
    out = e.join(hot.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))
    into = e.join(hot.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node"))
    near = hot.union(out).union(into).distinct()
    return e.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def trade_paths(starts: DataFrame, items: DataFrame, goal: float, low: float, high: float, steps: int = 20, score: Column | None = None) -> DataFrame:
    """user, step, id, value: from each start (user, id, value) the best-scored item with a
    value of low to high times the last, until the goal or the steps are reached.

    The frontier is one row per user; each step asks a tree of the items' values, made once, for
    the best in its range (RangeTree), and the frontier's lineage is cut by a checkpoint.
    score reads columns of items; ties go to the smaller id."""
    own = F.col("id").cast("string")  # no item follows itself: every item is a type of its own
    tree = RangeTree(items.withColumn("type", own), F.col("value") if score is None else score, 1, kept=True)
    values = items.select(F.col("id").alias("right_id"), "value")
    front = checkpointed(starts.select("user", "id", "value"))
    out = front.withColumn("step", F.lit(0))
    for step in range(1, steps + 1):
        open_ = front.filter(F.col("value") < goal)
        found = tree.topk(open_.select(F.col("user").alias("id"), "value", own.alias("type")), low, high)
        front = checkpointed(found.join(values, "right_id").select(F.col("left_id").alias("user"), F.col("right_id").alias("id"), "value"))
        if front.isEmpty():
            break
        out = out.unionByName(front.withColumn("step", F.lit(step)))
    return out
