"""Operator 5: removal of lines that many documents share.

Method: explode the normalised lines, hash, count distinct documents per hash, drop the
lines of hashes at the threshold, and reassemble each text by position.  DataFrame
functions only.  A line is hashed to two XXH64 values.

The hashes at the threshold are written and counted.  Up to ``BROADCAST_HASHES`` of them
are broadcast; more are joined by hash with the lines salted, so that a line which a
third of all documents hold is spread over ``SALTS`` parts.

Defined results: a null or empty text is one empty line; a row without a doc_id counts as
no document but loses the same lines; rows that share a doc_id count as one document and
are each cut on their own; an empty table gives an empty result; a text of any length is
cut whole; the columns of docs come back in struct ``row``, so no name of theirs can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
BROADCAST_HASHES, SALTS = 200_000, 64


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """Struct ``row``: all columns of docs; struct ``lines``: n_lines, n_dropped, kept (string)."""
    source = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = source.withColumn("text_hash", F.xxhash64("text"))
    lines = keyed.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    lines = lines.filter(F.char_length("key") >= min_chars).select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    often = lines.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n")).filter(F.col("n") >= min_docs).select("h1", "h2")
    often = checkpointed(often)
    if often.count() <= broadcast_hashes:
        found = lines.join(F.broadcast(often), ["h1", "h2"])
    else:
        salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)))
        found = salted.join(often.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))), ["h1", "h2", "salt"])
    drops = found.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("drop"))
    joined = keyed.alias("k").join(drops.alias("d"), F.col("k.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("k.text_hash") == F.col("d.text_hash")), "left").select("row", "text", "drop")
    all_lines = F.split("text", "\n")
    positions = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(positions, lambda i: F.get(all_lines, i)), "\n"))
    cut = F.struct(F.size(all_lines).cast("bigint").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("bigint").alias("n_dropped"), kept.alias("kept"))
    return joined.select("row", cut.alias("lines"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = line_dedup(docs)
    return out.select("row.doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
often AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (o.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (o.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often o USING (key)
GROUP BY doc_id
"""
