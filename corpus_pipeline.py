"""A training-data pipeline over documents, built from the operators of tessera.llm.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, but for the
last, which returns the packed pieces.  Rows without a doc_id pass the stages that compare
documents.  Rows that share a doc_id stay or go together where one document of a group
stays, and those of them with the same text become one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.near import similar_components
from tessera.llm.op01_substring import substring_dedup
from tessera.llm.op03_packing import pack
from tessera.llm.op05_lines import line_dedup
from tessera.llm.op07_quality import quality_rules


def _with_text(docs: DataFrame, columns: list[str], row: str, changed: Column, text: Column) -> DataFrame:
    """The columns of documents from struct row, with the new text and its length where it changed."""
    old = lambda c: F.col(f"{row}.`{c}`")
    length = F.when(changed, F.char_length(text).cast("bigint")).otherwise(old("n_chars"))
    new = {"text": text, "n_chars": length}
    return docs.select(*(new[c].alias(c) if c in new else old(c).alias(c) for c in columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the rules reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs, labels, carry=tuple(docs.columns)).filter("kept").select("extra.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: lines that ten or more documents share go."""
    changed = F.col("lines.n_dropped") > 0
    return _with_text(line_dedup(docs), docs.columns, "row", changed, F.when(changed, F.col("lines.kept")).otherwise(F.col("row.text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4, on shingles of five words, with every pair of an exact similarity of 0.8
    or more linked: the smallest document of each class stays."""
    classes = similar_components(docs, words=5)
    first = classes.filter("doc_id = component_id").select("doc_id").distinct()
    ordered = [f"row.`{c}`" for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    twins = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(*ordered)
    rows = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kept = rows.join(first, "doc_id", "left_semi").withColumn("twin", F.row_number().over(twins)).filter("twin = 1").select("row.*")
    return kept.unionByName(docs.filter("doc_id is null"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: words covered by windows that stand earlier go; white space stays."""
    cut = substring_dedup(docs, layout=True, carry=tuple(c for c in docs.columns if c != "text"))
    return _with_text(cut, docs.columns, "extra", F.col("n_removed") > 0, F.col("kept"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the pieces of the packed sequences."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
