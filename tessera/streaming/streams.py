"""Structured Streaming versions of the monitoring jobs.

Event time is a column, never the clock.  Every stream runs with availableNow and a
checkpoint, so a second run over the same folder takes only what is new."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import changes as C


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files at a path, a folder or a file (as a pattern, since the
    source takes a plain path for a folder)."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """Each batch goes to a folder of its own number, so a batch that is run again after a
    failure replaces itself."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def daily_history(orders: DataFrame) -> DataFrame:
    day = F.to_date("o_orderdate").alias("day")
    return orders.groupBy("o_orderpriority", "o_orderstatus", day).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"), F.count("*").alias("n"))


def trailing_history(history: DataFrame, days: int = 90) -> DataFrame:
    """o_orderpriority, o_orderstatus, at, mean: for each day after a day of history, the mean of the
    days before it.  Each day's sums are added to the days that see it, once for all listings."""
    seen = F.explode(F.sequence(F.date_add("day", 1), F.date_add("day", days))).alias("at")
    each = history.select("o_orderpriority", "o_orderstatus", seen, "s", "n")
    return each.groupBy("o_orderpriority", "o_orderstatus", "at").agg((F.sum("s").cast("double") / F.sum("n")).alias("mean"))


def listing_alerts(history: DataFrame, days: int = 90, least: float = 100.0) -> Callable[[DataFrame, int], DataFrame]:
    """A function of each batch of listings: those whose profit against the daily history of
    the days before is above a limit.  A listing meets one row: its day's mean."""
    means = trailing_history(history, days)

    def alerts(batch: DataFrame) -> DataFrame:
        b = batch.withColumn("at", F.to_date("o_orderdate")).join(means, ["o_orderpriority", "o_orderstatus", "at"])
        return b.select("o_orderkey", (F.col("mean") - F.col("o_totalprice")).alias("profit")).filter(F.col("profit") > least)

    return alerts


def windowed_counts(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and means per event type and window; rows later than the watermark are dropped
    (numRowsDroppedByWatermark in the query's progress counts them)."""
    w = F.window("at", length, slide) if slide else F.window("at", length)
    return events.withWatermark("at", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """user_id, start, finish (last event), n of each session."""
    marked = events.withWatermark("at", late) if events.isStreaming else events
    s = marked.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.min("at").alias("start"), F.max("at").alias("finish"), F.count("*").alias("n"))
    return s.select("user_id", "start", "finish", "n")


def fatigue(s: DataFrame, minutes: int = 25) -> Column:
    return F.unix_seconds("finish") - F.unix_seconds("start") > minutes * 60


class Learner:
    """What is kept of a learner and topic: ease, interval, streaks, the last answer's day."""

    FIELDS = "ease double, interval double, right int, wrong int, status string, next_review date"

    def __init__(self, kept: tuple | None) -> None:
        self.ease, self.interval, self.right, self.wrong, self.status, self.next_review = kept or (2.5, 0.0, 0, 0, "learning", None)

    def answer(self, grade: int, day) -> None:
        """Streaks of grades of 4 or more and of grades below 3; three of the first are a mastery
        with a review on the next day, three of the second need another explanation."""
        import datetime

        self.right = self.right + 1 if grade >= 4 else 0
        self.wrong = self.wrong + 1 if grade < 3 else 0
        self.status = "review" if self.right >= 3 else "remediation" if self.wrong >= 3 else "learning"
        self.next_review = day + datetime.timedelta(days=1) if self.right >= 3 else None
        if grade >= 3:
            self.interval = 1.0 if self.interval == 0 else 6.0 if self.interval == 1 else float(round(self.interval * self.ease))
            self.ease = min(max(self.ease + (0.1 - (5 - grade) * (0.08 + (5 - grade) * 0.02)), 1.3), 2.5)
        else:
            self.interval = 1.0

    def kept(self) -> tuple:
        return self.ease, self.interval, self.right, self.wrong, self.status, self.next_review


def mastery(events: DataFrame, forget_days: int | None = None) -> DataFrame:
    """user_id, event_type, at, ease, interval, right, wrong, status, next_review, event_id of each batch's last
    answer of a learner and topic: the spaced-repetition state, the streaks and the status after it.
    events: user_id, event_type, ts, event_id, grade; rows without a grade or ts take no part.

    State and a timer are kept for each learner and topic.  With forget_days (events then
    carry a watermark on ts) a timer is set that many days after the last answer; when
    the watermark passes it, the state is dropped and a row of status expired goes out, without an event_id.
    The state store must be the RocksDB one (``with_state``).  A learner's answers come and go as
    rows: a table of its own for each of them would cost more than all of the rest."""
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    made = Row("user_id", "event_type", "us", "ease", "interval", "right", "wrong", "status", "next_review", "event_id")

    class Processor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("learner", Learner.FIELDS)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
            held = sorted(((r["us"], r["event_id"] is None, r["event_id"], r["grade"], r["day"]) for r in rows), key=lambda r: r[:3] if not r[1] else r[:2])
            learner = Learner(self.state.get())
            for *_, grade, day in held:
                learner.answer(grade, day)
            self.state.update(learner.kept())
            last = held[-1]
            if forget_days is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(last[0] // 1000 + forget_days * 86_400_000)
            yield made(*key, last[0], *learner.kept(), last[2])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
            learner = Learner(self.state.get())
            self.state.clear()
            learner.status, learner.next_review = "expired", None
            yield made(*key, expiredTimerInfo.getExpiryTimeInMs() * 1000, *learner.kept(), None)

        def close(self) -> None:
            pass

    time = [] if forget_days is None else ["ts"]  # it carries the watermark
    fine = events.filter("grade is not null and ts is not null").select("user_id", "event_type", *time, F.unix_micros("ts").alias("us"), F.to_date("ts").alias("day"), "event_id", F.col("grade").cast("int").alias("grade"))
    out = f"user_id bigint, event_type string, us bigint, {Learner.FIELDS}, event_id bigint"
    kept = fine.groupBy("user_id", "event_type").transformWithState(Processor(), out, "Update", "None" if forget_days is None else "EventTime")
    return kept.select("user_id", "event_type", F.timestamp_micros("us").alias("at"), *kept.columns[3:])


@contextmanager
def with_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which timers and typed state need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def latest_per_key(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Of the batches below a path the last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return spark.read.option("basePath", path).parquet(path).withColumn("_p", F.row_number().over(w)).filter("_p = 1").drop("_p", "batch")


def kept_state(spark: SparkSession, path: str, key: str, before: int) -> tuple[DataFrame, int]:
    """key, digest as they were before a batch: the newest whole state and, over it, the
    parts of the batches after it.  Also how many parts those are."""
    held = spark.read.option("basePath", path).parquet(path).filter(F.col("batch") < before)
    numbers = {(kind, int(n)) for f in held.inputFiles() for kind, n in re.findall(r"kind=(\w+)/batch=(-?\d+)", f)}
    whole = max((n for kind, n in numbers if kind == "whole"), default=None)
    later = [n for kind, n in numbers if kind == "part" and (whole is None or n > whole)]
    first = (F.col("kind") == "whole") & (F.col("batch") == F.lit(whole))
    held = held.filter(((F.col("kind") == "part") & F.col("batch").isin(later)) | F.coalesce(first, F.lit(False)))
    return held.groupBy(key).agg(F.max_by("digest", "batch").alias("digest")), len(later)


def change_stream(state_path: str, changes_path: str, key: str, compact: int = 16) -> Callable[[DataFrame, int], None]:
    """For each batch of pages (key, html): changes against the digests kept before it, and
    its part of the new state beside the old one.

    A batch reads what earlier ones left and nothing of its own, so it may be run again; of
    a key that a batch holds twice the last text by order counts.  After compact parts the
    whole state is written anew, so a read stays as large as the state and those parts."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        states, parts = kept_state(spark, state_path, key, number)
        once = batch.groupBy(key).agg(F.max("html").alias("html"))
        C.snapshot_diff(states, once, key, F.col("html")).write.mode("overwrite").parquet(f"{changes_path}/batch={number}")
        found = spark.read.parquet(f"{changes_path}/batch={number}").select(key, "digest")
        if parts + 1 >= compact:
            new = states.join(found.select(key), key, "left_anti").unionByName(found)
            new.write.mode("overwrite").parquet(f"{state_path}/kind=whole/batch={number}")
        else:
            found.write.mode("overwrite").parquet(f"{state_path}/kind=part/batch={number}")

    return each
