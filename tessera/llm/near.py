"""Near-duplicate classes by SimHash and, for the pairs that fingerprints miss, by set similarity.

Two texts are linked if their sets of word shingles have a Jaccard similarity of SHARE or
more; every link is verified on the sets.  Equal sets are one point (known by 64 bits of
hash).  Candidates come in two passes:

1. points whose fingerprints are within four bits (op04), and each point with the least
   point of every posting list it is in, so that dense groups become few classes;
2. all pairs of different classes that meet in a posting list.

The posting lists hold each set's prefix: its first n - ceil(SHARE * n) + 1 shingles in one
order of all shingles.  Sets as similar as SHARE meet in their prefixes whatever the order
is, and the place of the first shingle they share bounds their overlap, so the second pass
misses no pair.  Shingles that a sample finds common come last in the order, which keeps
the lists short.  Before sets are compared, odd sketches (the parity of shingles in each of
SKETCH bits) drop pairs: they differ in at most as many bits as the sets do in shingles.

Defined results: null and empty texts are one (empty) set; rows without a doc_id have no
class; rows that share a doc_id are points of their own; repeated rows are one point; a
long text is one set like any other; an empty table gives an empty result.  Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import lists
from .checkpoints import checkpointed, release
from .components import components
from .fingerprints import majority_bits, polynomial_shingles
from .op04_simhash import links

SHARE = (4, 5)
SAMPLE, COMMON, BROADCAST = 16, 200_000, 200_000
SKETCH = 1024


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a sample's shingles that stand in three or more texts, the COMMON most frequent at
    most: hash (ascending) and count.  It gives the order only, so it need not be exact."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(h) for h in polynomial_shingles(batch.column("text").to_pylist(), words)]
            found, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    counted = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(scan, "h bigint, n bigint")
    counted = checkpointed(counted.groupBy("h").agg(F.sum("n").alias("n")).filter("n >= 3"))
    least, have = 1 << 62, 0
    for r in sorted(counted.groupBy(F.least("n", F.lit(10_000)).alias("n")).count().collect(), reverse=True):
        if (have := have + r["count"]) > COMMON:
            break
        least = r["n"]
    table = counted.filter(F.col("n") >= least).toArrow()
    h, n = table.column("h").to_numpy().astype(np.int64).view(np.uint64), table.column("n").to_numpy().astype(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def scanned(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, version, and of each row's set: sid, fp, n, sketch, prefix (in order)."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, words))
    names = ["doc_id", "version", "sid", "fp", "n", "sketch", "prefix"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = common.value
        for batch in batches:
            sid, fp, n, sketch, prefix = [], [], [], [], [np.zeros(0, np.uint64)]
            for hashes in polynomial_shingles(batch.column("text").to_pylist(), words):
                h = np.unique(hashes)
                rank = np.zeros(len(h), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    rank = np.where(known[at] == h, counts[at], 0)
                size = len(h) + SHARE[0] * len(h) // -SHARE[1] + 1 if len(h) else 0
                prefix.append(h[np.argsort(rank, kind="stable")[:size]])
                sid.append(_signed(xxhash.xxh64_intdigest(h.tobytes())))
                fp.append(_signed(majority_bits(hashes)))
                n.append(len(h))
                sketch.append(np.packbits(np.bincount((h % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).tobytes())
            sizes = np.array([len(p) for p in prefix[1:]], dtype=np.int64)
            columns = [batch.column("doc_id"), batch.column("version"), pa.array(sid, pa.int64()), pa.array(fp, pa.int64()), pa.array(n, pa.int64()), pa.array(sketch, pa.binary()), lists(np.concatenate(prefix), sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(scan, "doc_id bigint, version bigint, sid bigint, fp bigint, n bigint, sketch binary, prefix array<bigint>")


def _sketches_allow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, SKETCH // 64) for c in ("sketch_a", "sketch_b"))
        size = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
        apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
        allowed = (SHARE[0] + SHARE[1]) * apart <= (SHARE[1] - SHARE[0]) * size
        yield batch.select(["a", "b", "x", "y", "n_a", "n_b", "first_a", "first_b"]).filter(pa.array(allowed))


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """sid, shingles (their hashes, each once) of rows (sid, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(h) for h in polynomial_shingles(batch.column("text").to_pylist(), words)]
            sizes = np.array(list(map(len, sets)), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("sid"), lists(np.concatenate([np.zeros(0, np.uint64), *sets]), sizes, pa.int64())], ["sid", "shingles"])

    return docs.mapInArrow(scan, "sid bigint, shingles array<bigint>")


def verified(pairs: DataFrame, points: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b: sid, each pair once, and x, y) whose sets are similar enough, as (a, b: x, y)."""

    def sides(table: DataFrame, *columns: str) -> list[DataFrame]:
        return [table.select(F.col("sid").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in columns)).hint("merge") for s in "ab"]

    a, b = sides(points, "n", "sketch", "first")
    sized = pairs.join(a, "a").join(b, "b").filter(SHARE[1] * F.least("n_a", "n_b") >= SHARE[0] * F.greatest("n_a", "n_b"))
    of = points.schema["first"].dataType.simpleString()
    near = checkpointed(sized.mapInArrow(_sketches_allow, f"a bigint, b bigint, x bigint, y bigint, n_a bigint, n_b bigint, first_a {of}, first_b {of}"))
    asked = near.select(F.explode(F.array(F.struct(F.col("a").alias("sid"), F.col("first_a").alias("first")), F.struct(F.col("b").alias("sid"), F.col("first_b").alias("first")))).alias("s"))
    asked = checkpointed(asked.select("s.sid", "s.first.doc_id", "s.first.version").distinct())
    asked = F.broadcast(asked) if asked.count() <= BROADCAST else asked
    sets = checkpointed(shingle_sets(docs.join(asked, ["doc_id", "version"]).dropDuplicates(["sid"]).select("sid", "text"), words))
    a, b = sides(sets, "shingles")
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    enough = SHARE[1] * both >= SHARE[0] * (F.col("n_a") + F.col("n_b") - both)
    del sized, asked
    release(docs.sparkSession)
    return near.select("a", "b", "x", "y", "n_a", "n_b").join(a, "a").join(b, "b").filter(enough).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def similar_components(docs: DataFrame, words: int = 5, max_bits: int = 4) -> DataFrame:
    """doc_id, component_id of each row with a doc_id: the smallest doc_id reachable through
    links of a shingle similarity of SHARE or more.  max_bits is that of the first pass and
    does not change the result."""
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("version"))
    spark = docs.sparkSession
    rows = checkpointed(scanned(docs, words))
    first = F.min(F.struct("doc_id", "version")).alias("first")
    points = checkpointed(rows.groupBy("sid").agg(first, *(F.first(c).alias(c) for c in ("fp", "n", "sketch", "prefix"))))
    rows = checkpointed(rows.select("doc_id", "sid"))
    release(spark)
    lists_ = Window.partitionBy("h")
    postings = points.select(F.posexplode("prefix").alias("place", "h"), "sid", "n")
    shared = postings.withColumns({"chosen": F.min("sid").over(lists_), "last": F.max("sid").over(lists_)}).filter("chosen < last")
    shared = checkpointed(shared.drop("last"))
    points = checkpointed(points.drop("prefix"))
    del postings
    release(spark)

    prints = checkpointed(points.groupBy("fp").agg(F.min("sid").alias("sid")))
    one, other = prints.toDF("a", "sid_a").hint("merge"), prints.toDF("b", "sid_b").hint("merge")
    by_bits = links(prints, max_bits).join(one, "a").join(other, "b").select(*_pair("sid_a", "sid_b"))
    by_prints = points.select("fp", "sid").join(prints.toDF("fp", "other").hint("merge"), "fp").filter("sid <> other").select(*_pair("sid", "other"))
    by_lists = shared.filter("sid <> chosen").select(F.col("chosen").alias("a"), F.col("sid").alias("b"))
    candidates = checkpointed(by_bits.union(by_prints).union(by_lists).distinct())
    del by_bits, by_prints, by_lists, one, other, prints
    release(spark)
    found = checkpointed(verified(candidates.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y")), points, docs, words))
    del candidates
    release(spark)
    classes = components(found)
    classes = checkpointed(points.select("sid", "first.doc_id").join(classes.toDF("sid", "class").hint("merge"), "sid", "left").select("sid", "doc_id", F.coalesce("class", "sid").alias("class")))
    marked = shared.drop("chosen").join(classes.drop("doc_id").hint("merge"), "sid").withColumns({"x": F.min("class").over(lists_), "y": F.max("class").over(lists_)})
    open_ = checkpointed(marked.filter("x <> y").select("h", "sid", "n", "place", "class"))
    p, q = open_.toDF(*(f"{c}_p" for c in open_.columns)), open_.toDF(*(f"{c}_q" for c in open_.columns))
    rest = F.least(F.col("n_p") - F.col("place_p"), F.col("n_q") - F.col("place_q"))
    may = SHARE[0] * (F.col("n_p") + F.col("n_q")) <= (SHARE[0] + SHARE[1]) * rest
    pairs = p.join(q.hint("merge"), (F.col("h_p") == F.col("h_q")) & (F.col("sid_p") < F.col("sid_q")) & (F.col("class_p") != F.col("class_q")) & may)
    pairs = checkpointed(pairs.select(F.col("sid_p").alias("a"), F.col("sid_q").alias("b"), F.col("class_p").alias("x"), F.col("class_q").alias("y")).distinct())
    more = checkpointed(verified(pairs, points, docs, words))
    del pairs, p, q, open_, marked, shared
    release(spark)
    merged = components(more)
    named = classes.join(merged.toDF("class", "root").hint("merge"), "class", "left")
    named = checkpointed(named.select("sid", "doc_id", F.coalesce("root", "class").alias("class")))
    least = named.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    final = checkpointed(named.join(least.hint("merge"), "class").select("sid", "component_id"))
    return rows.select("doc_id", "sid").join(final.hint("merge"), "sid").select("doc_id", "component_id")
