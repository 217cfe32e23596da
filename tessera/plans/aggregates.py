"""D: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import aggregates as A
from ..operators import similar as M
from .base import query, table
from .joins import _SETS, id_texts

MAIL = """SELECT c_name AS sender, s_name AS recipient, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2"""


def mails(spark, sf):
    """Orders as mails: a customer to the suppliers of its lines."""
    t = lambda n: table(spark, sf, n)
    names = t("lineitem").join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy("l_orderkey").agg(F.collect_list("s_name").alias("recipients"))
    return t("orders").join(names, F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_name").alias("sender"), "recipients")


@query("d1_sender_recipient_counts", MAIL)
def d1(spark, sf):
    return A.pair_counts(mails(spark, sf), table(spark, sf, "lineitem").count())


@query("d2_violation_summary", f"SELECT rule, count(*) AS n FROM ({R.SCAN_SQL}) GROUP BY 1")
def d2(spark, sf):
    return R.summary(R.scan(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), R.TEXT_RULES)).select("rule", "n")


@query("d3_session_summary", """SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type = 'error') AS errors,
  round(avg(CASE WHEN event_type = 'click' THEN value END), 4) AS mean_click, round(avg(CAST(value AS INTEGER) % 6) FILTER (event_type <> 'error'), 4) AS mean_grade
  FROM (SELECT * REPLACE (floor(value) AS value), value AS v FROM events) GROUP BY 1""")
def d3(spark, sf):
    kind = lambda k: F.col("event_type") == k
    value = F.floor("value")
    return table(spark, sf, "events").groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(kind("view")).alias("views"), F.count_if(kind("purchase")).alias("purchases"), F.count_if(kind("error")).alias("errors"),
        F.round(F.avg(F.when(kind("click"), value)), 4).alias("mean_click"), F.round(F.avg(F.when(~kind("error"), value % 6)), 4).alias("mean_grade"))


@query("d4_cumulative_totals", """WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS good, count(*) FILTER (event_type IN ('purchase', 'error')) AS tried, floor(epoch(max(ts))) - floor(epoch(min(ts))) AS seconds FROM events GROUP BY 1, 2)
  SELECT count(*) AS sessions, count(DISTINCT user_id) AS students, CAST(sum(n) AS BIGINT) AS events, round(avg(seconds), 3) AS mean_seconds, round(avg(CASE WHEN tried = 0 THEN 0.0 ELSE good::DOUBLE / tried END), 6) AS mean_accuracy FROM s""")
def d4(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")))
    s = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("good"), F.count_if(F.col("event_type").isin("purchase", "error")).alias("tried"), (F.max("at") - F.min("at")).alias("seconds"))
    return s.agg(F.count("*").alias("sessions"), F.count_distinct("user_id").alias("students"), F.sum("n").alias("events"), F.round(F.avg("seconds"), 3).alias("mean_seconds"), F.round(F.avg(F.when(F.col("tried") == 0, 0.0).otherwise(F.col("good") / F.col("tried"))), 6).alias("mean_accuracy"))


@query("d4_distinct_sketches", "SELECT day FROM (SELECT DISTINCT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day FROM events)")
def d4_sketches(spark, sf):
    """The days, each with a sketch of its students that later days can be added to."""
    s = A.distinct_sketches(table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "day", "user_id")
    return s.filter(F.hll_sketch_estimate("sketch") > 0).select("day")


@query("d4_distinct_total")
def d4_total(spark, sf):
    """How many students there are in all, from the sketches of the days alone."""
    s = A.distinct_sketches(table(spark, sf, "events").withColumn("day", F.to_date("ts")), "day", "user_id")
    return A.distinct_total(s)


@query("d5_dir_stats", """SELECT coalesce(source, 'TOTAL') AS ext, count(*) AS files, count(*) FILTER (lang IN ('en', 'de')) AS supported, CAST(coalesce(sum(n_chars) FILTER (lang IN ('en', 'de')), 0) AS BIGINT) AS bytes FROM documents GROUP BY ROLLUP (source)""")
def d5(spark, sf):
    ok = F.col("lang").isin("en", "de")
    return table(spark, sf, "documents").rollup("source").agg(F.count("*").alias("files"), F.count_if(ok).alias("supported"), F.coalesce(F.sum(F.when(ok, F.col("n_chars"))), F.lit(0)).alias("bytes")).select(F.coalesce("source", F.lit("TOTAL")).alias("ext"), "files", "supported", "bytes")


@query("d6_ordinal_quality_mean", """SELECT user_id, CASE WHEN m >= 2.5 THEN 'high' WHEN m >= 1.5 THEN 'medium' ELSE 'low' END AS band FROM (SELECT user_id, avg(CASE WHEN value / 150 >= 0.75 THEN 3 WHEN value / 150 >= 0.60 THEN 2 ELSE 1 END) AS m FROM events GROUP BY 1)""")
def d6(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(A.ordinal_band(F.col("value") / 150).alias("band"))


@query("d7_user_progress", """WITH o AS (SELECT *, coalesce(lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_totalprice) AS from_value FROM orders)
  SELECT o_custkey, round(sum(o_totalprice - from_value), 2) AS gained, count(*) AS items, round(max(o_totalprice), 2) AS most, round(arg_min(from_value, (o_orderdate, o_orderkey)), 2) AS start_value,
  round(max(o_totalprice) / arg_min(from_value, (o_orderdate, o_orderkey)), 2) AS multiplier, array_to_string(list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC)[1:5], ',') AS last_five,
  CAST(sum(o_totalprice::DECIMAL(18,2)) AS DOUBLE) AS total_value, array_to_string(list(o_orderkey || ':' || round(o_totalprice - from_value, 2)::DECIMAL(18,2) ORDER BY o_orderdate DESC, o_orderkey DESC)[1:5], ',') AS recent_trades,
  array_to_string(list(o_orderkey || ':' || o_totalprice::DECIMAL(18,2) ORDER BY o_orderdate DESC, o_orderkey DESC)[1:10], ',') AS current_items FROM o GROUP BY 1""")
def d7(spark, sf):
    return A.user_progress(table(spark, sf, "orders"))


@query("d8_precision_recall_f1", r"""WITH h AS (SELECT p, quality = 0 AS want, regexp_matches(text, p) AS got FROM documents JOIN labels USING (doc_id), (VALUES ('[#$%&*]{3}'), ('[A-Z]{4,}!!'), ('the'), ('the|' || repeat('x', 236)), ('and|' || repeat('x', 496))) t(p)),
  c AS (SELECT p, count(*) FILTER (want AND got) AS tp, count(*) FILTER (NOT want AND got) AS fp, count(*) FILTER (want AND NOT got) AS fn FROM h GROUP BY p),
  r AS (SELECT p, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS pr, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS re FROM c)
  SELECT p AS pattern, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 6) AS f1, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END * CASE WHEN length(p) > 200 THEN greatest(0.5, 1 - 0.005 * (length(p) - 200)) ELSE 1.0 END, 6) AS fitness FROM r""")
def d8(spark, sf):
    """Patterns of 240 and 500 characters lose a fifth and half of their score."""
    patterns = spark.createDataFrame([(p,) for p in ("[#$%&*]{3}", "[A-Z]{4,}!!", "the", "the|" + 236 * "x", "and|" + 496 * "x")], "pattern string")
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").crossJoin(F.broadcast(patterns))
    return A.fitness(rows.select("pattern", (F.col("quality") == 0).alias("want"), F.rlike("text", F.col("pattern")).alias("got")))


@query("d9_graph_degree", "SELECT l_partkey AS node, count(DISTINCT l_suppkey) AS degree FROM lineitem GROUP BY 1")
def d9(spark, sf):
    return A.in_degree(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))


@query("d10_type_bucket_counts", """SELECT CASE WHEN event_type IN ('click', 'view', 'error') THEN event_type ELSE 'other' END AS bucket, count(*) AS n, array_to_string(list(event_id ORDER BY event_id)[1:50], ',') AS first_fifty FROM events GROUP BY 1""")
def d10(spark, sf):
    e = table(spark, sf, "events").select(F.when(F.col("event_type").isin("click", "view", "error"), F.col("event_type")).otherwise("other").alias("bucket"), F.col("event_id").alias("id"))
    return A.buckets_with_first(e, 50)


@query("d11_subtotal_rollup", """SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'GRAND TOTAL' WHEN grouping(l_linestatus) = 1 THEN 'SUBTOTAL' ELSE 'ROW' END AS level, l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS quantity, round(sum(l_extendedprice), 1) AS price FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def d11(spark, sf):
    return A.subtotals(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], quantity=F.sum("l_quantity").cast("bigint"), price=F.round(F.sum("l_extendedprice"), 1))


@query("d12_status_histogram", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def d12(spark, sf):
    out = table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return out.select("o_orderpriority", *(F.col(c).alias(c.lower()) for c in ("F", "O", "P")))


@query("d13_similar_pair_ratio", f"""WITH {_SETS}, g AS (SELECT t, count(*) AS m FROM s GROUP BY t), p AS (SELECT CAST(sum(x.m * y.m) AS BIGINT) AS n FROM g x JOIN g y ON x.t < y.t WHERE len(list_intersect(x.t, y.t))::DOUBLE / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) >= 0.8 - 1e-12)
  SELECT (SELECT coalesce(n, 0) FROM p) + (SELECT CAST(coalesce(sum(m * (m - 1) // 2), 0) AS BIGINT) FROM g) AS similar, (SELECT count(*) FROM s) * ((SELECT count(*) FROM s) - 1) // 2 AS pairs,
  round(100.0 * ((SELECT coalesce(n, 0) FROM p) + (SELECT CAST(coalesce(sum(m * (m - 1) // 2), 0) AS BIGINT) FROM g)) / ((SELECT count(*) FROM s) * ((SELECT count(*) FROM s) - 1) // 2), 2) AS percent""")
def d13(spark, sf):
    """Similar pairs are counted from the classes of equal sets and their sizes."""
    return A.similar_pair_ratio(id_texts(spark, sf), 0.8, M.shingle_sets)


@query("d14_label_majority", r"""SELECT doc_id, CASE WHEN CAST(regexp_matches(text, '[#$%&*]{3}') AS INTEGER) + CAST(regexp_matches(text, '[A-Z]{4,}') AS INTEGER) + CAST(n_chars < 300 AS INTEGER) >= 2 THEN 'bad' ELSE 'good' END AS label FROM documents""")
def d14(spark, sf):
    votes = [F.rlike("text", F.lit("[#$%&*]{3}")), F.rlike("text", F.lit("[A-Z]{4,}")), F.col("n_chars") < 300]
    return table(spark, sf, "documents").select("doc_id", A.majority(votes, "bad", "good").alias("label"))


@query("d14_weak_label_fit")
def d14_fit(spark, sf):
    """Accuracies of the three labelers and each class' share, by expectation-maximisation."""
    votes = {"symbols": F.rlike("text", F.lit("[#$%&*]{3}")), "capitals": F.rlike("text", F.lit("[A-Z]{4,}")), "short": F.col("n_chars") < 300}
    return A.weak_label_fit(table(spark, sf, "documents"), votes)


@query("d15_group_centroid", """WITH u AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x::DOUBLE) AS x FROM u GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS m FROM m GROUP BY 1)
  SELECT vec_id, label, round(list_inner_product(embedding::DOUBLE[], m), 6) AS score FROM embeddings JOIN c USING (label)""")
def d15(spark, sf):
    return A.centroid_scores(table(spark, sf, "embeddings"))
