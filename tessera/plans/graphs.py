"""J: graphs, iteration and extension points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing as P
from ..operators import aggregates as A
from ..operators import graphs as G
from .base import query, table


def edges(spark, sf):
    return table(spark, sf, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))


HOT = "SELECT 'p' || l_partkey AS node FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 9"


@query("j1_code_graph")
def j1(spark, sf):
    """Sources made from the benchmark's words."""
    name = F.regexp_replace(F.lower(F.get(F.split("text", " "), F.lit(0))), "[^a-z]", "")
    code = F.format_string("import os\nfrom re import sub\nclass C_%s:\n    def f(self):\n        return 'used literal', 17, 0, True\n", name)
    return P.code_graph(table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("path"), code.alias("code")))


@query("j2_hot_nodes", HOT)
def j2(spark, sf):
    return G.hot_nodes(A.in_degree(edges(spark, sf)), 9)


@query("j3_ego_subgraph", f"""WITH e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem), h AS ({HOT}), n AS (SELECT node FROM h UNION SELECT dst FROM e WHERE src IN (SELECT node FROM h) UNION SELECT src FROM e WHERE dst IN (SELECT node FROM h))
  SELECT src, dst FROM e WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)""")
def j3(spark, sf):
    e = edges(spark, sf)
    return G.ego_edges(e, G.hot_nodes(A.in_degree(e), 9))


def families(spark, sf):
    """Records made from customers: each has a spouse and a child of its nation's name."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return c.select(F.lit("Smith").alias("last"), F.concat(F.lit("P"), "c_custkey").alias("first"), F.concat(F.lit("S"), F.col("c_custkey"), F.lit(" Smith")).alias("spouse"), F.array(F.concat(F.lit("N"), F.col("c_nationkey"), F.lit(" Smith"))).alias("children"))


@query("j4_family_graph", """WITH c AS (SELECT 'Smith P' || c_custkey AS me, 'Smith S' || c_custkey AS s, 'Smith N' || c_nationkey AS k FROM customer)
  SELECT DISTINCT * FROM (SELECT me AS src, 'spouse' AS relation, s AS dst FROM c UNION ALL SELECT s, 'spouse', me FROM c UNION ALL SELECT me, 'child', k FROM c UNION ALL SELECT k, 'parent', me FROM c)""")
def j4(spark, sf):
    return P.family_edges(families(spark, sf))[1]


@query("j5_trade_path", """WITH RECURSIVE p AS (SELECT p_partkey AS id, (p_size * 20 + p_partkey % 13)::DOUBLE AS value FROM part), s AS (SELECT p_size AS "user", id, value FROM (SELECT p_size, p.*, row_number() OVER (PARTITION BY p_size ORDER BY value DESC, id) AS n FROM part JOIN p ON id = p_partkey) WHERE n = 1),
  r AS (SELECT "user", id, value, 0 AS step FROM s UNION ALL SELECT "user", id, value, step FROM (SELECT r."user", p.id, p.value, r.step + 1 AS step, row_number() OVER (PARTITION BY r."user" ORDER BY p.value DESC, p.id) AS n FROM r JOIN p ON p.value >= r.value * 1.05 AND p.value <= r.value * 1.5 AND p.id <> r.id WHERE r.value < 900 AND r.step < 20) WHERE n = 1)
  SELECT "user", step, id, value FROM r""")
def j5(spark, sf):
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 20 + F.col("p_partkey") % 13).cast("double").alias("value"), F.col("p_size").alias("user"))
    first = F.min_by(F.struct("id", "value"), F.struct(-F.col("value"), "id")).alias("first")
    starts = items.groupBy("user").agg(first).select("user", "first.id", "first.value")
    return G.trade_paths(starts, items, 900.0, 1.05, 1.5).select("user", "step", "id", "value")
