"""Operator 4: near-duplicate classes by SimHash.

Method: segment-popcount embedding.  A fingerprint's 32 segments of two bits become their
bit counts; the Manhattan distance of two such vectors is never more than the number of
differing bits.  The vector is held as a long whose segments are sorted (01 for one, 11
for two), so that the distance is the bit count of an exclusive or.  The segments form
``max_bits // 2 + 1`` groups; fingerprints with ``max_bits`` differing bits or fewer are
at a distance of one or less in some group's grid, so each looks only into its own cell
and the cells one step up.  What meets there is verified on all 64 bits at once, inside
the join.  Equal fingerprints are unified before, so a group of copies is one point.

Defined results: a null or empty text has fingerprint zero and links like any other; rows
without a doc_id have a fingerprint, but no class; rows that share a doc_id share nothing
else; an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import checkpointed
from .components import components
from .fingerprints import fingerprint

ODD = 0x5555555555555555


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, fp (long) of each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), words) for t in batch.column("text")]
            signed = [x - (1 << 64) if x >> 63 else x for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(signed, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(scan, "doc_id bigint, fp bigint")


def sorted_segments(fp: Column) -> Column:
    """The embedding: each two-bit segment holds its count as 00, 01 or 11."""
    high = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(high).bitwiseAND(F.lit(ODD)).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(F.lit(ODD)), 1))


def group_masks(groups: int) -> list[int]:
    """Bit masks of the groups of segments, as signed longs."""
    masks = [sum(3 << 2 * s for s in range(32) if s * groups // 32 == g) for g in range(groups)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(points: DataFrame, max_bits: int) -> DataFrame:
    """a, b: each pair of different fp within max_bits differing bits, once."""
    masks = group_masks(max_bits // 2 + 1)
    e = points.select("fp", sorted_segments(F.col("fp")).alias("e"))
    own = e.select(F.col("fp").alias("a"), F.posexplode(F.array(*(F.col("e").bitwiseAND(F.lit(m)) for m in masks))).alias("g", "cell"))

    def steps(mask: int) -> Column:
        """The cell of e in this group and the cells with one count higher by one."""
        cell, up = F.col("e").bitwiseAND(F.lit(mask)), []
        for bit in range(0, 64, 2):
            if mask >> bit & 1:
                one, two = 1 << bit, (1 << bit + 1) - (1 << 64 if bit == 62 else 0)
                up.append(F.when(cell.bitwiseAND(F.lit(one)) == 0, cell.bitwiseOR(F.lit(one))).when(cell.bitwiseAND(F.lit(two)) == 0, cell.bitwiseOR(F.lit(two))))
        return F.array_compact(F.array(cell, *up))

    other = e.select(F.col("fp").alias("b"), F.posexplode(F.array(*map(steps, masks))).alias("g", "cells")).select("b", "g", F.posexplode("cells").alias("step", "cell"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    group_of = F.col("o.g")
    once = (F.col("step") > 0) | (F.col("a") < F.col("b"))
    between = sorted_segments(F.col("a")).bitwiseXOR(sorted_segments(F.col("b")))
    for g, mask in enumerate(masks[:-1]):  # met in an earlier group already
        once &= (group_of <= g) | (F.bit_count(between.bitwiseAND(F.lit(mask))) > 1)
    o, p = own.alias("o"), other.alias("p")
    return o.join(p, (F.col("o.g") == F.col("p.g")) & (F.col("o.cell") == F.col("p.cell")) & apart & once).select("a", "b")


def simhash_components(docs: DataFrame, words: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable
    through links of max_bits differing bits or fewer."""
    rows = checkpointed(fingerprints(docs, words))
    points = checkpointed(rows.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(links(points, max_bits))
    best = linked.join(points, linked.node == points.fp).groupBy("label").agg(F.min("least").alias("component_id"))
    named = linked.join(best, "label").select(F.col("node").alias("fp"), "component_id")
    final = checkpointed(points.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    out = rows.join(final, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
