"""Sinks; each write is atomic per job by Spark's commit protocol."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def export(rows: DataFrame, path: str, kind: str) -> None:
    if kind == "csv":
        rows.write.option("header", True).csv(path)
    elif kind == "json":
        rows.write.json(path)
    else:
        raise ValueError(f"no such format: {kind}")


def append_tuples(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).option("compression", "gzip").csv(path)


def snapshot_tables(spark: SparkSession, tables: dict[str, str], references: dict[str, int], folder: str, slow: float = 5.0) -> dict[str, str]:
    """Writes tables (name to path) that are slow to count or used more than once; gives the
    snapshots, and leaves out tables that cannot be read."""
    out = {}
    for name, path in tables.items():
        began = time.time()
        try:
            held = spark.read.parquet(path)
            held.count()
        except Exception as e:  # a table that cannot be read is reported and skipped
            print(f"{name}: {type(e).__name__}")
            continue
        if time.time() - began > slow or references.get(name, 0) > 1:
            out[name] = f"{folder}/{name}"
            held.write.mode("overwrite").parquet(out[name])
    return out
