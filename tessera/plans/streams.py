"""H: streams, each run to the end of what is there; batch twins as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.storage import checkpointed, shared_folder
from ..streaming import streams as S
from .base import ORACLES, query, table
from .changes import second_snapshot
from .joins import LISTED
from .windows import STREAK


@query("h1_listing_alerts", f"SELECT o_orderkey, profit FROM ({LISTED}) WHERE profit > 100")
def h1(spark, sf):
    folder = shared_folder(spark)
    orders = S.read(spark, f"{sf}/orders.parquet")
    alerts = S.listing_alerts(checkpointed(S.daily_history(table(spark, sf, "orders"))))
    S.run(orders, f"{folder}/state", lambda b, n: S.append_to(f"{folder}/out")(alerts(b), n))
    return spark.read.parquet(f"{folder}/out").select("o_orderkey", "profit")


def timed(df):
    return df.withColumn("at", F.col("ts").cast("timestamp"))


@query("h2_event_counts_stream", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1, 2")
def h2(spark, sf):
    folder = shared_folder(spark)
    counts = S.windowed_counts(timed(S.read(spark, f"{sf}/events.parquet")))
    S.run(counts, f"{folder}/state", S.append_to(f"{folder}/out"), "update")
    last = S.latest_per_key(spark, f"{folder}/out", ["window", "event_type"])
    return last.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.round("mean", 4).alias("mean"))


_SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, floor(epoch(max(ts))) - floor(epoch(min(ts))) > 1500 AS tired FROM s GROUP BY user_id, k"""


def _shown(s):
    return s.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", S.fatigue(s).alias("tired"))


@query("h3_session_fatigue", _SESSIONS)
def h3(spark, sf):
    return _shown(S.sessions(timed(table(spark, sf, "events"))))


@query("h3_session_stream", _SESSIONS)
def h3b(spark, sf):
    """Sessions as they close; those that the watermark leaves open are closed by one event
    after all others, of a user that is none."""
    folder = shared_folder(spark)
    e = table(spark, sf, "events").select("user_id", "ts")
    e.write.parquet(f"{folder}/in")
    e.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("bigint").alias("user_id"), (F.col("ts") + F.expr("INTERVAL 3 HOURS")).alias("ts")).write.mode("append").parquet(f"{folder}/in")
    s = S.sessions(timed(S.read(spark, f"{folder}/in")))
    S.run(s, f"{folder}/state", S.append_to(f"{folder}/out"))
    return _shown(spark.read.parquet(f"{folder}/out").filter("user_id >= 0"))


def learners(spark, sf):
    """The last state of each learner and topic, after two runs over a growing folder."""
    folder = shared_folder(spark)
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", (F.floor("value") % 6).alias("grade"))
    middle = e.agg(F.percentile_approx(F.unix_seconds(F.col("ts").cast("timestamp")), 0.5)).first()[0]
    late = F.unix_seconds(F.col("ts").cast("timestamp")) > middle
    with S.with_state(spark):
        for half in (e.filter(~late), e.filter(late)):
            half.write.mode("append").parquet(f"{folder}/in")
            S.run(S.mastery(timestamped(S.read(spark, f"{folder}/in"))), f"{folder}/state", S.append_to(f"{folder}/out"), "update")
    return S.latest_per_key(spark, f"{folder}/out", ["user_id", "event_type"])


def timestamped(events):
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("h4_mastery_stateful")
def h4(spark, sf):
    return learners(spark, sf).select("user_id", "event_type", F.round("ease", 4).alias("ease"), "interval")


@query("h4_mastery_status", STREAK + """, l AS (SELECT user_id, event_type, arg_max(struct_pack(r := rights, w := wrongs, d := CAST(ts AS DATE), e := event_id), (ts, event_id)) AS x FROM k GROUP BY 1, 2)
  SELECT user_id, event_type, x.e AS event_id, CAST(x.r AS INTEGER) AS "right", CAST(x.w AS INTEGER) AS wrong, CASE WHEN x.r >= 3 THEN 'review' WHEN x.w >= 3 THEN 'remediation' ELSE 'learning' END AS status, CASE WHEN x.r >= 3 THEN strftime(x.d + 1, '%Y-%m-%d') END AS next_review FROM l""")
def h4_status(spark, sf):
    """Streaks, status and next review of each learner and topic, from the same stream."""
    return learners(spark, sf).select("user_id", "event_type", "event_id", "right", "wrong", "status", F.date_format("next_review", "yyyy-MM-dd").alias("next_review"))


@query("h5_change_stream", None)
def h5(spark, sf):
    folder = shared_folder(spark)
    known = table(spark, sf, "pages").filter("page_id % 5 <> 0").select("page_id", F.md5("html").alias("digest"))
    known.write.parquet(f"{folder}/digests/kind=whole/batch=-1")
    second_snapshot(spark, sf).select("page_id", "html").write.parquet(f"{folder}/in")
    S.run(S.read(spark, f"{folder}/in"), f"{folder}/state", S.change_stream(f"{folder}/digests", f"{folder}/changes", "page_id"))
    return spark.read.parquet(f"{folder}/changes").select("page_id", "digest", "change")


@query("h6_incremental_corpus", "SELECT lang, count(*) AS n, 1 AS times FROM documents GROUP BY 1")
def h6(spark, sf):
    """Two runs over a growing folder: each file is taken once."""
    folder = shared_folder(spark)
    d = table(spark, sf, "documents").select("doc_id", "lang")
    for half in (0, 1):
        d.filter(F.col("doc_id") % 2 == half).write.mode("append").parquet(f"{folder}/in")
        S.run(S.read(spark, f"{folder}/in"), f"{folder}/state", S.append_to(f"{folder}/out"))
    seen = spark.read.parquet(f"{folder}/out").groupBy("doc_id", "lang").agg(F.count("*").alias("times"))
    return seen.groupBy("lang").agg(F.count("*").alias("n"), F.max("times").cast("int").alias("times"))


ORACLES["h5_change_stream"] = ORACLES["g4_snapshot_diff"]
ORACLES["h4_mastery_stateful"] = ORACLES["e8_sm2_fold"]
