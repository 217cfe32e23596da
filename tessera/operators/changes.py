"""Set, upsert and change operations over tables; the new state is a DataFrame to write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import places


def upsert(base: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of base replaced or joined by the latest of new, by key (new wins ties)."""
    both = base.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_place", F.row_number().over(w)).filter("_place = 1").select(*base.columns)


def insert_ignore(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return base.unionByName(new.dropDuplicates([key]).join(base.select(key), key, "left_anti").select(*base.columns))


def counter_increment(base: DataFrame, deltas: DataFrame, key: str, counter: str) -> DataFrame:
    """base with the sums of deltas (key, delta) added to a counter."""
    sums = deltas.groupBy(key).agg(F.sum("delta").alias("_d"))
    return base.join(sums, key, "left").withColumn(counter, F.col(counter) + F.coalesce("_d", F.lit(0))).select(*base.columns)


def snapshot_diff(state: DataFrame, now: DataFrame, key: str, content: Column) -> DataFrame:
    """key, digest, change (new or changed) of rows whose digest is not in the state."""
    seen = now.select(key, F.md5(content).alias("digest"))
    joined = seen.join(state.select(key, F.col("digest").alias("_old")), key, "left")
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_old") != F.col("digest"), "changed")
    return joined.withColumn("change", change).filter("change is not null").select(key, "digest", "change")


def latest_edges(actions: DataFrame, order: Column) -> DataFrame:
    """src, dst of edges whose latest action (src, dst, action) is add."""
    last = actions.groupBy("src", "dst").agg(F.max_by("action", order).alias("action"))
    return last.filter("action = 'add'").select("src", "dst")


def follow_lists(edges: DataFrame, size: int = 10_000) -> DataFrame:
    """user, part, following, followers: both sides of the edges (src follows dst), each a sorted
    array, cut into parts of up to size entries, so that no user's followers are one row; a
    side that has fewer parts than the other has an empty array."""
    both = edges.select(F.col("src").alias("user"), F.lit(True).alias("_out"), F.col("dst").alias("other")).union(edges.select("dst", F.lit(False), "src")).distinct()
    numbered = places(both, ["user", "_out"], ["other"])
    parts = numbered.groupBy("user", ((F.col("place") - 1) / size).cast("int").alias("part"))
    side = lambda out: F.sort_array(F.collect_list(F.when(F.col("_out") == out, F.col("other"))))
    return parts.agg(side(True).alias("following"), side(False).alias("followers"))


def skip_existing(wanted: DataFrame, made: DataFrame, key: str) -> DataFrame:
    return wanted.join(made.select(key), key, "left_anti")


def latest_status(results: DataFrame, key: str, order: Column, at: Column, days: int) -> DataFrame:
    """Per key: status, last_checked and next_check after its latest result."""
    last = results.groupBy(key).agg(F.max_by("status", order).alias("status"), F.max(at).alias("last_checked"))
    return last.withColumn("next_check", F.date_add("last_checked", days))


def scd2(changes: DataFrame, key: str, order: list[str], attribute: str, since: Column) -> DataFrame:
    """Versions of an attribute: effective_from, effective_to (the next change), is_current."""
    w = Window.partitionBy(key).orderBy(*order)
    fresh = changes.withColumn("_before", F.lag(attribute).over(w)).filter(F.col("_before").isNull() | (F.col("_before") != F.col(attribute)))
    out = fresh.withColumn("effective_from", since).withColumn("effective_to", F.lead("effective_from").over(w))
    return out.select(key, attribute, "effective_from", "effective_to", F.col("effective_to").isNull().alias("is_current"))


def as_of(facts: DataFrame, versions: DataFrame, key: str, at: str, attribute: str) -> DataFrame:
    """Facts with the version valid at their time (inclusive), also for late facts: facts and
    versions are sorted together per key and the last version is filled forward, so no
    range join is needed."""
    v = versions.select(key, F.col("effective_from").alias(at), attribute, F.lit(0).alias("_kind"))
    f = facts.withColumn("_kind", F.lit(1)).withColumn(attribute, F.lit(None).cast(versions.schema[attribute].dataType))
    w = Window.partitionBy(key).orderBy(at, "_kind")
    both = f.unionByName(v, allowMissingColumns=True).withColumn(attribute, F.last(attribute, ignorenulls=True).over(w))
    return both.filter("_kind = 1").drop("_kind")
