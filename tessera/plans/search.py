"""F: sorts, limits, top-k and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import grams as N
from ..operators import joins as J
from ..operators import scoring as S
from ..operators import topk as K
from .aggregates import MAIL, mails
from .base import query, table


def asked(spark, sf):
    """The queries: every hundredth vector."""
    return table(spark, sf, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def _nearest(score, n):
    return f"""SELECT query_id, vec_id, round(score, 4) + 0.0 AS score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM (
  SELECT q.vec_id AS query_id, e.vec_id, round({score}, 9) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)) WHERE place <= {n}"""


@query("f1_cosine_topk", _nearest("list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])", 20))
def f1(spark, sf):
    return K.cosine_topk(table(spark, sf, "embeddings"), asked(spark, sf)).withColumn("score", F.round("score", 4) + F.lit(0.0))


@query("f1_cosine_index")
def f1_index(spark, sf):
    """The same search through cells: nearly all of the same rows (the test measures how many)."""
    return K.indexed_nearest(table(spark, sf, "embeddings"), asked(spark, sf), "cosine", 20).withColumn("score", F.round("score", 4) + F.lit(0.0))


@query("f2_l2_topk_similarity", "SELECT query_id, vec_id, score, place, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.60 THEN 'medium' ELSE 'low' END AS band FROM (" + _nearest("1 / (1 + list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]))", 5) + ")")
def f2(spark, sf):
    out = K.l2_topk(table(spark, sf, "embeddings"), asked(spark, sf)).withColumn("score", F.round("score", 4) + F.lit(0.0))
    return out.withColumn("band", S.quality_band(F.col("score")))


@query("f3_top_pairs", f"SELECT * FROM ({MAIL}) ORDER BY n DESC, sender, recipient LIMIT 10")
def f3(spark, sf):
    from ..operators.aggregates import pair_counts

    return pair_counts(mails(spark, sf), table(spark, sf, "lineitem").count()).orderBy(F.desc("n"), "sender", "recipient").limit(10)


def offers(spark, sf):
    """Items and listings: parts by type, valued by their size and key."""
    p = table(spark, sf, "part")
    value = (F.col("p_size") * 20 + F.col("p_partkey") % 13).cast("double")
    return p.select(F.col("p_partkey").alias("id"), value.alias("value"), F.col("p_type").alias("type"), "p_size")


FOUND = """WITH p AS (SELECT p_partkey AS id, (p_size * 20 + p_partkey % 13)::DOUBLE AS value, p_type AS type, p_size FROM part),
  m AS (SELECT a.id AS item, b.id AS listing, greatest(least(60 + CASE WHEN b.value / a.value >= 1.05 AND b.value / a.value <= 1.5 THEN 20 WHEN b.value / a.value >= 1.0 AND b.value / a.value <= 1.05 THEN 10 WHEN b.value / a.value > 2.0 THEN -30 ELSE 0 END - least(b.p_size % 7 * 2, 20) + 8, 95), 10) AS score
    FROM p a JOIN p b ON a.type <> b.type AND b.value >= a.value * 1.05 AND b.value <= a.value * 1.5), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, listing) AS place FROM m)
  SELECT item, listing, CAST(score AS INTEGER) AS score, CAST(place AS INTEGER) AS place FROM r WHERE place <= """


def opportunities(spark, sf, n):
    """The value of every offer found is 1.05 to 1.5 times the item's, so its score depends
    on the offer alone."""
    o = offers(spark, sf)
    score = S.listing_score(F.lit(1.0), F.lit(1.2), F.col("p_size") % 7, F.lit("eBay")).cast("int")
    found = J.range_topk(o, o, 1.05, 1.5, score, n)
    return found.select(F.col("left_id").alias("item"), F.col("right_id").alias("listing"), "score", "place")


@query("f4_opportunity_search", FOUND + "10")
def f4(spark, sf):
    return opportunities(spark, sf, 10)


@query("f5_top_suggestions", FOUND + "3")
def f5(spark, sf):
    return opportunities(spark, sf, 3)


@query("f6_latest_items", "SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INTEGER) AS place FROM orders")
def f6(spark, sf):
    """Every user's items, newest first."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("place"))


_PAIRS = "embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id"


@query("f7_pairwise_cosine", f"SELECT a.label AS g, a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) + 0.0 AS score FROM {_PAIRS}")
def f7(spark, sf):
    return K.cosine_pairs(table(spark, sf, "embeddings"), "label", places=4)


@query("f7_cosine_above_floor", f"SELECT g, i, j, round(c, 4) AS score FROM (SELECT a.label AS g, a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM {_PAIRS}) WHERE c >= 0.3")
def f7_floor(spark, sf):
    return K.cosine_pairs(table(spark, sf, "embeddings"), "label", 0.3, 4)


def spaces(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.withColumn("front", F.slice("embedding", 1, 32)).withColumn("back", F.slice("embedding", 33, 32))


def agreement(rows, one, two):
    """Correlation of the pair similarities of two spaces over the same rows."""
    return N.space_agreement(rows, "label", one, two).select("g", F.round("agreement", 4).alias("agreement"))


@query("f8_space_agreement", f"""SELECT a.label AS g, round(corr(list_cosine_similarity(a.embedding[1:32]::DOUBLE[], b.embedding[1:32]::DOUBLE[]), list_cosine_similarity(a.embedding[33:64]::DOUBLE[], b.embedding[33:64]::DOUBLE[])), 4) AS agreement FROM {_PAIRS} GROUP BY 1""")
def f8(spark, sf):
    return agreement(spaces(spark, sf), F.col("front"), F.col("back"))


@query("f9_linear_space_map")
def f9(spark, sf):
    """The agreement after the first space is mapped into the second."""
    rows = spaces(spark, sf)
    m = K.linear_map(rows, F.col("front"), F.col("back"))
    return agreement(rows.withColumn("mapped", K.apply_map(F.col("front"), m)), F.col("mapped"), F.col("back"))


@query("f9_gram_entries", """WITH a AS (SELECT vec_id, unnest(embedding[1:32]) AS x, generate_subscripts(embedding[1:32], 1) - 1 AS i FROM embeddings), b AS (SELECT vec_id, unnest(embedding[33:64]) AS y, generate_subscripts(embedding[33:64], 1) - 1 AS j FROM embeddings)
  SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(x::DOUBLE * y::DOUBLE), 4) + 0.0 AS x FROM a JOIN b USING (vec_id) GROUP BY 1, 2""")
def f9_gram(spark, sf):
    return N.gram_sums(spaces(spark, sf), F.col("front"), F.col("back")).filter("kind = 'ab'").select("i", "j", (F.round("x", 4) + F.lit(0.0)).alias("x"))
