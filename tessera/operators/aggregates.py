"""Aggregations of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .similar import set_classes
from .storage import checkpointed
from .vectors import dot


#: Pairs that one task counts.
COUNTED = 1 << 19


def pair_counts(mails: DataFrame, pairs: int | None = None) -> DataFrame:
    """sender, recipient, n over mails (sender, recipients array).  With the number of pairs in
    all mails (about) they are dealt to as many tasks as it needs, each of COUNTED pairs or so; pairs
    are counted there only, since before they meet hardly one would be found twice."""
    each = mails.select("sender", F.explode("recipients").alias("recipient"))
    if pairs is not None:
        each = each.repartition(max(1, -(-pairs // COUNTED)), "sender", "recipient")
    return each.groupBy("sender", "recipient").agg(F.count("*").alias("n"))


def ordinal_band(score: Column) -> Column:
    """high 3, medium 2, low 1; the mean's band: 2.5 or more high, 1.5 or more medium."""
    mean = F.avg(F.when(score >= 0.75, 3).when(score >= 0.60, 2).otherwise(1))
    return F.when(mean >= 2.5, "high").when(mean >= 1.5, "medium").otherwise("low")


def distinct_sketches(rows: DataFrame, by: str, what: str) -> DataFrame:
    """by, sketch: a mergeable sketch of the distinct values of what (a few KB, whatever their
    number is); the relative error of an estimate is about 1.04 / sqrt(2 ** 12)."""
    return rows.groupBy(by).agg(F.hll_sketch_agg(what, F.lit(12)).alias("sketch"))


def distinct_total(sketches: DataFrame, *by: str) -> DataFrame:
    """by, distinct: about how many distinct values all sketches of a group hold together."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def user_progress(orders: DataFrame) -> DataFrame:
    """Per customer: gain over the previous orders, counts, total, highest and first value, the ratio
    of these two, the newest five orders with what each gained, and the newest ten with
    their values.  An order's from-value is the order before."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    newest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    o = orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", F.coalesce(F.lag("o_totalprice").over(order), "o_totalprice").alias("from_value"), F.row_number().over(newest).alias("place"))
    start = F.min_by("from_value", F.struct("o_orderdate", "o_orderkey"))
    gain = F.round(F.col("o_totalprice") - F.col("from_value"), 2).cast("decimal(18,2)")
    ten = F.array_sort(F.collect_list(F.when(F.col("place") <= 10, F.struct("place", "o_orderkey", gain.alias("gain"), F.col("o_totalprice").cast("decimal(18,2)").alias("value")))))
    named = lambda k, line: F.array_join(F.transform(F.slice(ten, 1, k), line), ",")
    pair = lambda x, y: F.concat(x.cast("string"), F.lit(":"), y.cast("string"))
    return o.groupBy("o_custkey").agg(
        F.round(F.sum(F.col("o_totalprice") - F.col("from_value")), 2).alias("gained"), F.count("*").alias("items"), F.round(F.max("o_totalprice"), 2).alias("most"),
        F.round(start, 2).alias("start_value"), F.round(F.max("o_totalprice") / start, 2).alias("multiplier"), named(5, lambda x: x["o_orderkey"].cast("string")).alias("last_five"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total_value"), named(5, lambda x: pair(x["o_orderkey"], x["gain"])).alias("recent_trades"), named(10, lambda x: pair(x["o_orderkey"], x["value"])).alias("current_items"))


def fitness(rows: DataFrame, length: int = 200, slope: float = 0.005) -> DataFrame:
    """pattern, precision, recall, f1 and fitness: f1 less a penalty for long patterns."""
    c = rows.groupBy("pattern").agg(F.count_if(F.col("want") & F.col("got")).alias("tp"), F.count_if(~F.col("want") & F.col("got")).alias("fp"), F.count_if(F.col("want") & ~F.col("got")).alias("fn"))
    share = lambda a, b: F.when(a + b == 0, 0.0).otherwise(a / (a + b))
    c = c.select("pattern", share(F.col("tp"), F.col("fp")).alias("p"), share(F.col("tp"), F.col("fn")).alias("r"))
    f1 = F.when(F.col("p") + F.col("r") == 0, 0.0).otherwise(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")))
    over = F.char_length("pattern") - length
    penalty = F.when(over > 0, F.greatest(F.lit(0.5), 1 - slope * over)).otherwise(1.0)
    return c.select("pattern", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(f1, 6).alias("f1"), F.round(f1 * penalty, 6).alias("fitness"))


def in_degree(edges: DataFrame) -> DataFrame:
    """node, degree over distinct edges (src, dst)."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("degree"))


def buckets_with_first(rows: DataFrame, most: int) -> DataFrame:
    """bucket, n and the first ids of each bucket.  Only the first rows of a bucket reach
    its list: the ranks stop early in each task."""
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("id"))).filter(F.col("place") <= most)
    lists = first.groupBy("bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("first_fifty"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n")).join(lists, "bucket")


def subtotals(rows: DataFrame, keys: list[str], **sums: Column) -> DataFrame:
    """Rows, SUBTOTAL rows of all but the last key, and the GRAND TOTAL."""
    level = F.when(F.grouping(keys[0]) == 1, "GRAND TOTAL").when(F.grouping(keys[-1]) == 1, "SUBTOTAL").otherwise("ROW")
    return rows.rollup(*keys).agg(level.alias("level"), *(v.alias(k) for k, v in sums.items())).select("level", *keys, *sums)


def similar_pair_ratio(rows: DataFrame, least: float, sets: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """similar, pairs and percent of rows (see ``set_classes``); copies count by the sizes of their classes."""
    classes, _, found = set_classes(rows, least, sets)
    sizes = classes.select(F.col("key").alias("id"), F.col("copies").alias("m"))
    pairs = found.join(sizes.toDF("a", "ma"), "a").join(sizes.toDF("b", "mb"), "b").agg(F.coalesce(F.sum(F.col("ma") * F.col("mb")), F.lit(0)).alias("between"))
    inside = sizes.agg(F.coalesce(F.sum(F.expr("m * (m - 1) div 2")), F.lit(0)).alias("inside"), F.sum("m").alias("n"))
    both = pairs.crossJoin(inside)
    similar, all_ = F.col("between") + F.col("inside"), F.expr("n * (n - 1) div 2")
    return both.select(similar.alias("similar"), all_.alias("pairs"), F.round(100 * similar / all_, 2).alias("percent"))


def majority(votes: list[Column], yes: str, no: str) -> Column:
    total = sum((v.cast("int") for v in votes), F.lit(0))
    return F.when(total * 2 > len(votes), yes).otherwise(no)


def weak_label_fit(rows: DataFrame, votes: dict[str, Column], rounds: int = 20) -> DataFrame:
    """labeler, on_yes, on_no, share: how often each labeler says yes for rows that are and
    are not of the class (Dawid-Skene).  The votes' patterns are counted once, in Spark; the
    rounds work on at most 2**labelers counts."""
    import numpy as np

    names = list(votes)
    counted = rows.groupBy(*(v.cast("int").alias(n) for n, v in votes.items())).count().collect()
    x = np.array([[r[n] for n in names] for r in counted], dtype=float).reshape(-1, len(names))
    n = np.array([r["count"] for r in counted], dtype=float)
    belief = (x.mean(1) > 0.5) * 0.8 + 0.1
    for _ in range(rounds):
        yes, no = n * belief, n * (1 - belief)
        share = yes.sum() / max(n.sum(), 1)
        on_yes = np.clip((yes[:, None] * x).sum(0) / max(yes.sum(), 1e-9), 1e-3, 1 - 1e-3)
        on_no = np.clip((no[:, None] * x).sum(0) / max(no.sum(), 1e-9), 1e-3, 1 - 1e-3)
        a = share * np.prod(np.where(x > 0, on_yes, 1 - on_yes), axis=1)
        b = (1 - share) * np.prod(np.where(x > 0, on_no, 1 - on_no), axis=1)
        belief = a / np.maximum(a + b, 1e-12)
    out = [(k, round(float(on_yes[i]), 6), round(float(on_no[i]), 6), round(float(share), 6)) for i, k in enumerate(names)] if len(n) else []
    return rows.sparkSession.createDataFrame(out, "labeler string, on_yes double, on_no double, share double")


def centroid_scores(rows: DataFrame) -> DataFrame:
    """vec_id, label, score: each vector's product with the mean of its label."""
    flat = rows.select("label", F.posexplode("embedding").alias("i", "x"))
    mean = flat.groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    return rows.join(mean, "label").select("vec_id", "label", F.round(dot(F.col("embedding"), F.col("m")), 6).alias("score"))
