"""K: common query patterns, each over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import joins as J
from ..operators.prefix import running
from .base import query, table

DAY = "yyyy-MM-dd"
NEW = ["o_orderdate", "o_orderkey"]


def by_customer(*order):
    return Window.partitionBy("o_custkey").orderBy(*order)


@query("k1_dup_groups", "SELECT md5(text) AS h, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def k1(spark, sf):
    return table(spark, sf, "documents").groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n")).filter("n > 1")


@query("k1_dedup_keep_one", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(text)")
def k1b(spark, sf):
    w = Window.partitionBy(F.md5("text")).orderBy("doc_id")
    return table(spark, sf, "documents").select("doc_id", F.row_number().over(w).alias("n")).filter("n = 1").select("doc_id")


@query("k2_topk_with_ties", "SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM orders GROUP BY 1) WHERE r <= 5")
def k2(spark, sf):
    """The k-th count bounds the ties, so no window runs over all rows in one task."""
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    least = n.orderBy(F.desc("n")).limit(5).agg(F.min("n").alias("least"))
    return n.join(F.broadcast(least), F.col("n") >= F.col("least")).select("o_custkey", "n")


@query("k3_anti_match", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def k3(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'P'")
    return table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("k3_semi_match", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def k3b(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'P'")
    return table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("k4_self_manager_join", "SELECT c.c_custkey, c.c_name AS name, m.c_name AS manager FROM customer c JOIN (SELECT c_nationkey, min(c_custkey) AS k FROM customer GROUP BY 1) r USING (c_nationkey) JOIN customer m ON m.c_custkey = r.k")
def k4(spark, sf):
    """The first customer of each nation manages the others."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    first = c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("manager_key"))
    m = c.select(F.col("c_custkey").alias("manager_key"), F.col("c_name").alias("manager"))
    return c.join(first, "c_nationkey").join(m, "manager_key").select("c_custkey", F.col("c_name").alias("name"), "manager")


@query("k5_date_spine", """SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS d FROM orders) LEFT JOIN (SELECT o_orderdate AS d, count(*) AS n FROM orders GROUP BY 1) USING (d)""")
def k5(spark, sf):
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"))
    spine = o.agg(F.min("d").alias("a"), F.max("d").alias("b")).select(F.explode(F.sequence("a", "b")).alias("d"))
    return spine.join(o.groupBy("d").agg(F.count("*").alias("n")), "d", "left").select(F.date_format("d", DAY).alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


@query("k6_group_report", """SELECT p_type, strftime(o_orderdate, '%Y-%m') AS month, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue, count(DISTINCT o_custkey) AS customers FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2 HAVING count(*) > 10""")
def k6(spark, sf):
    t = lambda n: table(spark, sf, n)
    j = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
    g = j.groupBy("p_type", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 0).alias("revenue"), F.count_distinct("o_custkey").alias("customers"), F.count("*").alias("_n"))
    return g.filter("_n > 10").drop("_n")


_SETS = "SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS q, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY "


def _multi(spark, sf, kind):
    t = table(spark, sf, "lineitem")
    return getattr(t, kind)("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("bigint").alias("q"), F.grouping_id().alias("level"))


@query("k7_cube", _SETS + "CUBE (l_returnflag, l_linestatus)")
def k7(spark, sf):
    return _multi(spark, sf, "cube")


@query("k7_rollup", _SETS + "ROLLUP (l_returnflag, l_linestatus)")
def k7b(spark, sf):
    return _multi(spark, sf, "rollup")


@query("k7_grouping_sets", _SETS + "GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def k7c(spark, sf):
    t = table(spark, sf, "lineitem")
    f, s = F.col("l_returnflag"), F.col("l_linestatus")
    return t.groupingSets([[f], [s], []], f, s).agg(F.sum("l_quantity").cast("bigint").alias("q"), F.grouping_id().alias("level"))


@query("k8_pct_of_total", """SELECT o_orderpriority, o_orderstatus, round(100 * sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 4) AS of_all, round(100 * sum(o_totalprice) / sum(sum(o_totalprice)) OVER (PARTITION BY o_orderpriority), 4) AS of_priority FROM orders GROUP BY 1, 2""")
def k8(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.sum("o_totalprice").alias("s"))
    share = lambda w: F.round(100 * F.col("s") / F.sum("s").over(w), 4)
    return g.select("o_orderpriority", "o_orderstatus", share(Window.partitionBy(F.lit(1))).alias("of_all"), share(Window.partitionBy("o_orderpriority")).alias("of_priority"))


@query("k9_string_agg", "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ', ' ORDER BY CAST(l_partkey AS VARCHAR)) AS parts FROM lineitem GROUP BY 1")
def k9(spark, sf):
    """The parts of each order in one string; an order has few lines."""
    part = F.col("l_partkey").cast("string")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(part)), ", ").alias("parts"))


@query("k10_top_per_group", """SELECT o_orderpriority, o_orderkey, CAST(place AS INTEGER) AS place FROM (SELECT *, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3""")
def k10(spark, sf):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").withColumn("place", F.dense_rank().over(w)).filter("place <= 3").select("o_orderpriority", "o_orderkey", "place")


@query("k10_latest_per_customer", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def k10b(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct(*NEW)).alias("o_orderkey"))


@query("k11_nth_highest", "SELECT c_mktsegment, c_acctbal FROM (SELECT DISTINCT c_mktsegment, c_acctbal, dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS r FROM customer) WHERE r = 2")
def k11(spark, sf):
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"))
    return table(spark, sf, "customer").withColumn("r", F.dense_rank().over(w)).filter("r = 2").select("c_mktsegment", "c_acctbal").distinct()


@query("k12_correlated_rewrite", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def k12(spark, sf):
    o = table(spark, sf, "orders")
    mean = o.groupBy("o_custkey").agg((1.5 * F.avg("o_totalprice")).alias("limit"))
    return o.join(mean, "o_custkey").filter("o_totalprice > limit").select("o_orderkey")


@query("k12_recursive_cte", "WITH RECURSIVE r AS (SELECT o_custkey, min(o_orderkey) AS k, 1 AS depth FROM orders GROUP BY 1 UNION ALL SELECT r.o_custkey, o.o_orderkey, depth + 1 FROM r JOIN orders o ON o.o_custkey = r.o_custkey AND o.o_orderkey > r.k AND o.o_orderkey <= r.k + 20 AND depth < 4) SELECT o_custkey, k, depth FROM r")
def k12b(spark, sf):
    """Chains of up to four orders of a customer, each at most 20 keys after the last."""
    table(spark, sf, "orders").createOrReplaceTempView("_orders")
    return spark.sql("WITH RECURSIVE r AS (SELECT o_custkey, min(o_orderkey) AS k, 1 AS depth FROM _orders GROUP BY o_custkey UNION ALL SELECT r.o_custkey, o.o_orderkey, depth + 1 FROM r JOIN _orders o ON o.o_custkey = r.o_custkey AND o.o_orderkey > r.k AND o.o_orderkey <= r.k + 20 AND depth < 4) SELECT o_custkey, k, depth FROM r")


@query("k13_rank_family", """SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS INTEGER) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS INTEGER) AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey)""")
def k13(spark, sf):
    w = by_customer("o_orderstatus")
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(by_customer("o_orderstatus", "o_orderkey")).alias("rn"), F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"))


@query("k14_period_change", """WITH m AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_orderpriority, month, n, n - lag(n) OVER w AS change, lead(n) OVER w AS next FROM m WINDOW w AS (PARTITION BY o_orderpriority ORDER BY month)""")
def k14(spark, sf):
    m = table(spark, sf, "orders").groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("o_orderpriority").orderBy("month")
    return m.select("o_orderpriority", "month", "n", (F.col("n") - F.lag("n").over(w)).alias("change"), F.lead("n").over(w).alias("next"))


@query("k15_running_total", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 2) AS total FROM events")
def k15(spark, sf):
    """In two levels, so a user with most of the events fills all tasks."""
    e = table(spark, sf, "events").select("user_id", "event_id", "value")
    return running(e, ["user_id"], ["event_id"], {"total": F.col("value")}).select("event_id", F.round("total", 2).alias("total"))


@query("k15_running_total_overall", "SELECT strftime(d, '%Y-%m-%d') AS day, CAST(sum(n) OVER (ORDER BY d) AS BIGINT) AS total FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1)")
def k15b(spark, sf):
    """Rows are counted per day first: the one-task window has as many rows as days."""
    d = table(spark, sf, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1)).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return d.select(F.date_format("d", DAY).alias("day"), F.sum("n").over(w).alias("total"))


@query("k16_first_last_nth", """SELECT event_id, first_value(value) OVER w AS first, last_value(value) OVER w AS last, nth_value(value, 2) OVER w AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def k16(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf, "events").select("event_id", F.first_value("value").over(w).alias("first"), F.last_value("value").over(w).alias("last"), F.nth_value("value", 2).over(w).alias("second"))


_DAILY = "(SELECT user_id, CAST(ts AS DATE) - DATE '2024-01-01' AS day, count(*) AS n FROM events GROUP BY 1, 2)"


@query("k17_rows_vs_range_frames", f"""SELECT user_id, CAST(day AS INTEGER) AS day, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS by_rows, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS by_range FROM {_DAILY}""")
def k17(spark, sf):
    d = _daily(spark, sf)
    w = Window.partitionBy("user_id").orderBy("day")
    return d.select("user_id", "day", F.sum("n").over(w.rowsBetween(-2, 0)).alias("by_rows"), F.sum("n").over(w.rangeBetween(-2, 0)).alias("by_range"))


def _daily(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day")).agg(F.count("*").alias("n"))


@query("k17_moving_avg_7d", f"SELECT user_id, CAST(day AS INTEGER) AS day, round(avg(n) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS mean FROM {_DAILY}")
def k17b(spark, sf):
    return _daily(spark, sf).select("user_id", "day", F.round(F.avg("n").over(Window.partitionBy("user_id").orderBy("day").rangeBetween(-6, 0)), 4).alias("mean"))


@query("k18_user_timestamps", "SELECT user_id, md5(string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S'), ',' ORDER BY ts, event_id)) AS times FROM events GROUP BY 1")
def k18(spark, sf):
    times = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: F.date_format(x["ts"], "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf, "events").groupBy("user_id").agg(F.md5(F.array_join(times, ",")).alias("times"))


@query("k19_table_diff", """SELECT o_orderkey, o_orderstatus, 'gone' AS side FROM (SELECT o_orderkey, o_orderstatus FROM orders EXCEPT ALL SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END FROM orders WHERE o_orderkey % 70 <> 0)
  UNION ALL SELECT o_orderkey, s, 'new' FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 70 <> 0 EXCEPT ALL SELECT o_orderkey, o_orderstatus FROM orders)""")
def k19(spark, sf):
    a = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    b = a.filter("o_orderkey % 70 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 50 == 0, "X").otherwise(F.col("o_orderstatus")))
    return a.exceptAll(b).withColumn("side", F.lit("gone")).unionByName(b.exceptAll(a).withColumn("side", F.lit("new")))


@query("k20_set_ops", """WITH c AS (SELECT c_nationkey AS k FROM customer), s AS (SELECT s_nationkey AS k FROM supplier) SELECT 'union' AS op, k FROM (SELECT k FROM c UNION SELECT k FROM s) UNION ALL SELECT 'all', k FROM (SELECT k FROM c UNION ALL SELECT k FROM s)
  UNION ALL SELECT 'both', k FROM (SELECT k FROM c INTERSECT SELECT k FROM s) UNION ALL SELECT 'only', k FROM (SELECT k FROM c EXCEPT SELECT k FROM s)""")
def k20(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    made = {"union": c.union(s).distinct(), "all": c.union(s), "both": c.intersect(s), "only": c.subtract(s)}
    return reduce(lambda x, y: x.unionByName(y), (d.select(F.lit(n).alias("op"), "k") for n, d in made.items()))


@query("k21_flatten_json", "SELECT event_id, 'k' AS name, CAST(json_extract_string(props, '$.k') AS BIGINT) AS v FROM events")
def k21(spark, sf):
    return table(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("name", "v"))


@query("k22_star_load", """SELECT o_orderkey, md5(c_name) AS customer_key, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, CAST(isodow(o_orderdate) AS INTEGER) AS weekday FROM orders JOIN customer ON c_custkey = o_custkey""")
def k22(spark, sf):
    """Facts with hashed customer keys and the attributes of their date dimension."""
    c = table(spark, sf, "customer").dropDuplicates(["c_custkey"]).select("c_custkey", F.md5("c_name").alias("customer_key"))
    d = F.col("o_orderdate")
    dates = table(spark, sf, "orders").select(F.to_date(d).alias("day")).distinct().select("day", F.date_format("day", "yyyyMMdd").cast("int").alias("date_key"), F.quarter("day").alias("quarter"), (F.weekday("day") + 1).alias("weekday"))
    return table(spark, sf, "orders").withColumn("day", F.to_date(d)).join(c, F.col("c_custkey") == F.col("o_custkey")).join(dates, "day").select("o_orderkey", "customer_key", "date_key", "quarter", "weekday")


@query("k23_scd1", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY 1")
def k23(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_type").alias("state"), F.struct("ts", "event_id").alias("at"))
    return C.upsert(e.limit(0), e, "user_id", "at").select("user_id", "state")


_SCD2 = """WITH c AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), v AS (SELECT user_id, event_type, ts, event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM c WHERE b IS NULL OR b <> event_type)"""


def versions(spark, sf):
    return C.scd2(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type", F.col("ts"))


@query("k23_scd2_apply", _SCD2 + " SELECT user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS effective_from, strftime(t, '%Y-%m-%d %H:%M:%S') AS effective_to, t IS NULL AS is_current FROM v")
def k23b(spark, sf):
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return versions(spark, sf).select("user_id", "event_type", at("effective_from"), at("effective_to"), "is_current")


@query("k24_scd2_asof", _SCD2 + ", f AS (SELECT o_orderkey, o_custkey % 15 AS user_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(o_orderkey * 29 % 43200 AS BIGINT)) AS ts FROM orders) SELECT o_orderkey, event_type AS state FROM f LEFT JOIN v ON v.user_id = f.user_id AND v.ts <= f.ts AND (t IS NULL OR f.ts < t)")
def k24(spark, sf):
    facts = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 15).alias("user_id"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(o_orderkey * 29 % 43200 AS INT), 0)").alias("ts"))
    return C.as_of(facts, versions(spark, sf), "user_id", "ts", "event_type").select("o_orderkey", F.col("event_type").alias("state"))


@query("k25_dq_checks", """SELECT count(*) AS n, count(*) - count(text) AS null_text, round(100.0 * count(*) FILTER (lang IS NULL) / count(*), 4) AS pct_null_lang, count(DISTINCT doc_id) = count(*) AS unique_ids, min(n_chars) >= 0 AS sane FROM documents""")
def k25(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("null_text"), F.round(100 * F.count_if(F.col("lang").isNull()) / F.count("*"), 4).alias("pct_null_lang"), (F.count_distinct("doc_id") == F.count("*")).alias("unique_ids"), (F.min("n_chars") >= 0).alias("sane"))


@query("k26_salted_join", "SELECT p_type, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def k26(spark, sf):
    big = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), "l_orderkey", "l_linenumber", "l_quantity")
    small = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_type")
    return J.salted_join(big, small, "k", 8).groupBy("p_type").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("bigint").alias("q"))


@query("k27_keyset_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 700 ORDER BY o_orderkey LIMIT 25")
def k27(spark, sf):
    return table(spark, sf, "orders").filter("o_orderkey > 700").orderBy("o_orderkey").limit(25).select("o_orderkey", "o_totalprice")
