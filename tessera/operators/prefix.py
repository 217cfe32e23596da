"""Numbers and running sums along sorted keys, in two levels.

A window function sorts all rows of a key in one task.  Here rows are dealt by ranges of
(keys, order), so a long series fills as many blocks as it needs.  Each block is worked on
alone; what stands before it is added after that.  Only the first key of a block can have
rows before it, so what is added has one row for each block at most, and is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import checkpointed


def blocks(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with _tie (a number for rows of equal order) and _block (in the order of keys
    and order, nulls first), written so that both stay as they are."""
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys, *order, "_tie")
    return checkpointed(ranged.withColumn("_block", F.spark_partition_id()))


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with, for each name of sums, the sum of its column over the rows of the same keys
    up to this one in order; nulls count as nothing.  Null keys are a key of their own."""
    held = blocks(rows, keys, order)
    inner = Window.partitionBy(*keys, "_block").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    totals = held.groupBy(*keys, "_block").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_block").alias("_at"), F.count("*").over(before).alias("_n"), *(F.sum(n).over(before).alias(f"_s{i}") for i, n in enumerate(sums)))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), F.col("_block") == F.col("_at"))
    local = held.withColumns({n: F.sum(c).over(inner) for n, c in sums.items()})
    out = local.join(F.broadcast(earlier.filter("_n > 0").drop("_n")), same, "left")
    added = {n: F.coalesce(F.col(f"_s{i}") + F.col(n), F.col(n), F.col(f"_s{i}")) for i, n in enumerate(sums)}
    return out.withColumns(added).select(*rows.columns, *sums)


def places(rows: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """rows with their number from 1 among those of the same keys, in order; rows of equal
    order are numbered in the order they are read."""
    return running(rows, keys, order, {name: F.lit(1).cast("bigint")})
