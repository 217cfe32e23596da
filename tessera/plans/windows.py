"""E: window functions and ordered folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import topk as K
from ..operators import windows as W
from .base import query, table

E_SQL = "SELECT user_id, event_type, event_id, ts, CAST(floor(value) AS BIGINT) % 6 AS grade FROM events"


def attempts(spark, sf):
    return table(spark, sf, "events").withColumn("grade", F.floor("value") % 6)


@query("e1_best_per_group", """SELECT query_id, vec_id, label, round(score, 4) + 0.0 AS score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS p FROM (
  SELECT q.vec_id AS query_id, e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)) WHERE p = 1) WHERE place <= 5""")
def e1(spark, sf):
    """For every hundredth vector the best row of each label, and of these the five best."""
    from .search import asked

    out = K.nearest(table(spark, sf, "embeddings"), asked(spark, sf), "cosine", 5, group="label")
    return out.select("query_id", "vec_id", "label", (F.round("score", 4) + F.lit(0.0)).alias("score"), "place")


@query("e2_chunk_sequence", """SELECT doc_id, CAST(k AS INTEGER) AS chunk, length(substr(text, k * 800 + 1, 1000)) AS size FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 800.0) AS BIGINT)))) AS k FROM documents)""")
def e2(spark, sf):
    """Fixed windows of 1000 characters, 200 of them shared; numbers run per document."""
    last = F.greatest(F.ceil(F.char_length("text") / 800), F.lit(1)) - 1
    d = table(spark, sf, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("k"))
    return d.select("doc_id", F.col("k").cast("int").alias("chunk"), F.char_length(F.substring(F.col("text"), (F.col("k") * 800 + 1).cast("int"), F.lit(1000))).cast("bigint").alias("size"))


@query("e3_moving_average", """WITH s AS (SELECT user_id, event_id, value, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
  SELECT a.event_id, round(avg(b.value), 6) AS smooth FROM s a JOIN s b ON a.user_id = b.user_id AND abs(a.i - b.i) <= floor(a.n * 0.05) GROUP BY 1""")
def e3(spark, sf):
    out = W.moving_average(table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", 0.05)
    return out.select("event_id", F.round("smooth", 6).alias("smooth"))


@query("e4_kalman_smooth", """WITH RECURSIVE s AS (SELECT user_id, event_id, value AS z, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
  f AS (SELECT user_id, event_id, i, (1.0001 / 1.0101) * z AS x, (1 - 1.0001 / 1.0101) * 1.0001 AS p FROM (SELECT user_id, event_id, i, z::DOUBLE AS z FROM s) WHERE i = 1
    UNION ALL SELECT s.user_id, s.event_id, s.i, f.x + (f.p + 0.0001) / (f.p + 0.0101) * (s.z - f.x), (1 - (f.p + 0.0001) / (f.p + 0.0101)) * (f.p + 0.0001) FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1)
  SELECT event_id, round(x, 6) AS smooth FROM f""")
def e4(spark, sf):
    return W.kalman_series(table(spark, sf, "events"), "user_id", "event_id", "value").select("event_id", F.round("smooth", 6).alias("smooth"))


def hourly(spark, sf, kind):
    e = table(spark, sf, "events").filter(F.col("event_type") == kind)
    return e.groupBy(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("t")).agg(F.sum("value").alias("v"))


@query("e5_lag_correlate", """WITH h AS (SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS t, sum(value) AS v FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2), m AS (SELECT event_type, t, v - avg(v) OVER (PARTITION BY event_type) AS v FROM h)
, c AS (
  SELECT a.t - b.t AS lag, sum(a.v * b.v) AS corr FROM m a JOIN m b ON a.event_type = 'view' AND b.event_type = 'click' GROUP BY 1)
  SELECT lag, round(corr, 1) AS corr, lag = (SELECT arg_max(lag, (corr, -lag)) FROM c) AS "offset" FROM c""")
def e5(spark, sf):
    """Every lag of the two hourly series, and which is the offset."""
    return W.lag_correlation(hourly(spark, sf, "view"), hourly(spark, sf, "click")).select("lag", F.round("corr", 1).alias("corr"), "offset")


STREAK = f"""WITH e AS ({E_SQL}), g AS (SELECT *, sum(CASE WHEN grade >= 4 THEN 0 ELSE 1 END) OVER w AS i, sum(CASE WHEN grade < 3 THEN 0 ELSE 1 END) OVER w AS j FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
  k AS (SELECT *, CASE WHEN grade >= 4 THEN sum(CASE WHEN grade >= 4 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type, i ORDER BY ts, event_id) ELSE 0 END AS rights, CASE WHEN grade < 3 THEN sum(CASE WHEN grade < 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type, j ORDER BY ts, event_id) ELSE 0 END AS wrongs FROM g)"""


@query("e6_streaks", STREAK + ' SELECT event_id, CAST(rights AS BIGINT) AS "right", CAST(wrongs AS BIGINT) AS wrong FROM k')
def e6(spark, sf):
    return W.streaks(attempts(spark, sf), ["user_id", "event_type"], ["ts", "event_id"], "grade").select("event_id", "right", "wrong")


@query("e7_mastery_flag", STREAK + " SELECT event_id, CASE WHEN rights >= 3 THEN 'review' WHEN wrongs >= 3 THEN 'remediation' ELSE 'learning' END AS status, CASE WHEN rights >= 3 THEN strftime(CAST(ts AS DATE) + 1, '%Y-%m-%d') END AS next_review FROM k")
def e7(spark, sf):
    s = W.streaks(attempts(spark, sf), ["user_id", "event_type"], ["ts", "event_id"], "grade")
    return s.select("event_id", F.when(F.col("right") >= 3, "review").when(F.col("wrong") >= 3, "remediation").otherwise("learning").alias("status"), F.when(F.col("right") >= 3, F.date_format(F.date_add(F.to_date("ts"), 1), "yyyy-MM-dd")).alias("next_review"))


@query("e8_sm2_fold", f"""WITH RECURSIVE s AS (SELECT user_id, event_type, grade, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM ({E_SQL})),
  f AS (SELECT DISTINCT user_id, event_type, CAST(0 AS BIGINT) AS i, 2.5::DOUBLE AS ease, 0::DOUBLE AS iv FROM s
    UNION ALL SELECT s.user_id, s.event_type, s.i, CASE WHEN grade >= 3 THEN least(greatest(f.ease + (0.1::DOUBLE - (5 - grade) * (0.08::DOUBLE + (5 - grade) * 0.02::DOUBLE)), 1.3::DOUBLE), 2.5::DOUBLE) ELSE f.ease END,
      CASE WHEN grade < 3 THEN 1 WHEN f.iv = 0 THEN 1 WHEN f.iv = 1 THEN 6 ELSE round_even(f.iv * f.ease, 0) END FROM f JOIN s ON s.user_id = f.user_id AND s.event_type = f.event_type AND s.i = f.i + 1)
  SELECT user_id, event_type, round(arg_max(ease, i), 4) AS ease, arg_max(iv, i) AS "interval" FROM f GROUP BY 1, 2""")
def e8(spark, sf):
    """The grades of one learner and topic fold in order."""
    s = W.repetition_series(attempts(spark, sf), ["user_id", "event_type"], ["ts", "event_id"], "grade")
    return s.withColumn("ease", F.round("ease", 4))


@query("e9_outline_ffill", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
  m AS (SELECT doc_id, pos, CASE WHEN regexp_matches(line, '^([A-Z]\S*) .*\.$') THEN regexp_extract(line, '^([A-Z]\S*) .*\.$', 1) END AS head, CASE WHEN regexp_matches(line, '^([a-zA-Z]+)[^.]*$') THEN regexp_extract(line, '^([a-zA-Z]+)[^.]*$', 1) END AS item FROM l),
  f AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM m)
  SELECT doc_id AS doc, CAST(pos - 1 AS INTEGER) AS pos, section, item FROM f WHERE item IS NOT NULL AND head IS NULL AND section IS NOT NULL""")
def e9(spark, sf):
    """Lines that end in a stop act as headings, lines without one as items."""
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return W.outline_rows(lines, r"^([A-Z]\S*) .*\.$", r"^([a-zA-Z]+)[^.]*$")


@query("e10_recent_n_per_user", "SELECT o_custkey, o_orderkey, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders) WHERE place <= 5")
def e10(spark, sf):
    return K.newest(table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], 5).select("o_custkey", "o_orderkey", "place")


@query("e11_fluency_remaining", """SELECT user_id, x AS a, y AS b FROM (SELECT DISTINCT user_id FROM events) u, range(1, 6) r(x), range(1, 6) s(y)
  WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 + 1 = x AND event_id % 5 + 1 = y AND event_type <> 'error' AND value <= 100)""")
def e11(spark, sf):
    """All pairs of 1 to 5 less those answered rightly in time; pairs are numbered from 1 to 25."""
    e = table(spark, sf, "events")
    done = e.filter("event_type <> 'error' and value <= 100").select("user_id", (F.get_json_object("props", "$.k").cast("bigint") % 5 * 5 + F.col("event_id") % 5 + 1).alias("pair"))
    left = W.remaining(done, e, "user_id", "pair", 25)
    return left.select("user_id", F.expr("bigint((pair - 1) div 5 + 1)").alias("a"), F.expr("bigint((pair - 1) % 5 + 1)").alias("b"))
