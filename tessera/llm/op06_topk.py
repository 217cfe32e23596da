"""Operator 6: exact top-k search by inner product.

Method: a pivot-distance index.  Each vector is keyed by its nearest pivot and by the
annulus of its distance to it; a small directory holds each annulus' least and greatest
distance and greatest norm.  By the triangle inequality a vector x of an annulus is at
least lb = max(0, least - d, d - greatest) from a query at distance d from the pivot, so
its score is at most (|q|^2 + |x|^2 - lb^2) / 2.  A query visits annuli in order of that
bound, in rounds: first until it has enough candidates, then the next ``STEP`` annuli, then
the others, in each round only those whose bound reaches its k-th score so far.  The result
is exact.

Pivots are fitted on at most ``SAMPLE`` vectors of least hash; the directory has at most
``CELLS`` rows and one for the vectors with large components.  Crowded annuli are split by
a hash of vec_id into blocks, so a vector that a third of the rows share fills many blocks.
Visits are counted for each block: blocks that no query visits go no further, and a block is
copied once for each ``PORTION`` of the queries that do visit it.

Defined results: null vectors and vectors holding null or non-finite components take no
part, nor do rows without a vec_id; shorter vectors count as filled up with zeros; rows
that share the query's vec_id are its own; a vec_id repeated among the queries is one
query (its least vector); an empty table gives an empty result.  Other columns are
ignored.  Vectors with a component of 2**20 or more in size (of the integers) are visited by every
query, and as queries visit every block, with 64-bit integers in place of doubles, or with Python's
where a product could leave 63 bits; a score of 2**63 - 1 or more in size is an error if it is one of
those returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .checkpoints import checkpointed

SAMPLE, CELLS, CELL_ROWS, BLOCK_ROWS, PORTION, STEP = 4096, 4096, 4096, 8192, 4096, 16
LARGE = 1 << 20
TOP = 2**63 - 1


def quantized(vectors: Column, scale: int) -> Column:
    """floor(scale * x) as doubles: those of 2**53 and more are whole numbers already."""

    def whole(x: Column) -> Column:
        scaled = F.lit(float(scale)) * x.cast("double")
        fits = F.when(F.abs(scaled) < F.lit(float("inf")), scaled).otherwise(F.raise_error(F.lit("a component does not fit a double")).cast("double"))
        return F.when(F.abs(scaled) < F.lit(float(1 << 53)), F.floor(scaled).cast("double")).otherwise(fits)

    return F.transform(vectors, whole)


def prepared(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, v: the vectors that take part, as integers."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    held = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fine)
    return held.select(F.col("vec_id").cast("bigint").alias("vec_id"), quantized(F.col("embedding"), scale).alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(rows, pa.ChunkedArray):
        rows = pa.concat_arrays(rows.chunks) if rows.num_chunks else pa.array([], rows.type)
    counts = np.diff(rows.offsets.to_numpy())
    out = np.zeros((len(rows), width))
    out[np.arange(width) < counts[:, None]] = rows.flatten().to_numpy()
    return out


def large(v: np.ndarray) -> np.ndarray:
    """Rows that doubles cannot score exactly."""
    return (np.abs(v) >= LARGE).any(axis=1)


def integer_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers given as doubles, exact up to TOP in size and cut there."""
    if not large(q).any() and not large(x).any() and x.shape[1] <= 4096:
        return q @ x.T
    most = float(np.abs(q).sum(axis=1).max(initial=0)) * float(np.abs(x).max(initial=0))
    if most < 2.0**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = lambda m: np.array([[int(c) for c in row] for row in m.tolist()], dtype=object).reshape(m.shape)
    return np.clip(whole(q) @ whole(x).T, -TOP, TOP).astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows, without rounding."""
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T


def fit_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Integer pivots: farthest-first starts, a few rounds of means."""
    pivots = sample[:1]
    while len(pivots) < min(count, len(sample)):
        pivots = np.vstack([pivots, sample[squared(sample, pivots).min(1).argmax()]])
    for _ in range(5):
        near = squared(sample, pivots).argmin(1)
        pivots = np.stack([np.rint(sample[near == i].mean(0)) if (near == i).any() else p for i, p in enumerate(pivots)])
    return pivots


class Directory:
    """The annuli: pivot, annulus, least and greatest distance, greatest norm, rows, blocks."""

    def __init__(self, pivots: np.ndarray, rows: list) -> None:
        self.pivots = pivots
        self.pivot, self.least, self.greatest, self.norm, self.rows = (np.array([r[i] for r in rows]) for i in (0, 2, 3, 4, 5))
        self.blocks = -(-self.rows // BLOCK_ROWS)
        self.first = np.cumsum(self.blocks) - self.blocks

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The greatest score that each annulus may hold for each query, never too low."""
        d = np.sqrt(squared(queries, self.pivots))[:, self.pivot]
        apart = np.maximum(0, np.maximum(self.least - d, d - self.greatest) * (1 - 1e-9) - 1e-6)
        own = (queries * queries).sum(1)[:, None]
        with np.errstate(invalid="ignore"):
            most = np.minimum((own + self.norm - apart**2) / 2, np.sqrt(own * self.norm)) + 1e-3
        return np.where(np.isinf(self.norm)[None] | large(queries)[:, None], np.inf, most)


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Row numbers, ids and scores of the k highest of each row, ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    scores, ids = scores[:, order], ids[order]
    none = -np.inf if scores.dtype.kind == "f" else np.iinfo(np.int64).min
    scores = np.where(ids[None] == own[:, None], none, scores)
    if scores.shape[1] > k:
        floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k][:, None]
        over = scores > floor
        room = k - over.sum(1, keepdims=True)
        level = scores == floor
        keep = over | (level & (np.cumsum(level, axis=1) <= room))
    else:
        keep = np.ones(scores.shape, dtype=bool)
    row, column = np.nonzero(keep & (scores > none))
    return row, ids[column], scores[row, column]


def exact_topk(rows: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of rows (vec_id, embedding) that
    is_query holds for, the k other rows of highest inner product."""
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    vectors = prepared(rows, scale)
    about = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    if not about["n"]:
        return empty
    width, cells = max(1, about["width"]), min(CELLS, max(32, about["n"] // CELL_ROWS))
    usual = vectors.filter(F.forall("v", lambda x: F.abs(x) < LARGE))
    sample = matrix(usual.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).select("v").toArrow().column("v"), width)
    sample = sample if len(sample) else np.zeros((1, width))
    pivots = fit_pivots(sample, max(4, int(math.sqrt(2 * cells))))
    step = cells // len(pivots)
    near = np.sqrt(squared(sample, pivots).min(1))
    edges = np.unique(np.quantile(near, np.arange(1, step) / step))
    parts = spark.sparkContext.broadcast((pivots, edges))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, edges = parts.value
        for batch in batches:
            v = matrix(batch.column("v"), width)
            d = squared(v, pivots)
            p = d.argmin(1) if len(v) else np.zeros(0, np.int64)
            d = np.sqrt(d[np.arange(len(v)), p])
            huge = large(v)
            p, d, norm = np.where(huge, -1, p), np.where(huge, 0.0, d), np.where(huge, np.inf, (v * v).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(p.astype(np.int32)), pa.array(np.searchsorted(edges, d).astype(np.int32)), pa.array(d), pa.array(norm)], ["vec_id", "v", "pivot", "annulus", "distance", "norm"])

    placed = vectors.mapInArrow(place, "vec_id bigint, v array<double>, pivot int, annulus int, distance double, norm double")
    held = placed.groupBy("pivot", "annulus").agg(F.min("distance"), F.max("distance"), F.max("norm"), F.count("*"))
    cells_held = sorted(tuple(r) for r in held.collect())
    directory = Directory(pivots, cells_held)
    shared = spark.sparkContext.broadcast(directory)
    names = spark.createDataFrame([(int(r[0]), int(r[1]), int(f), int(b)) for r, f, b in zip(cells_held, directory.first, directory.blocks, strict=True)], "pivot int, annulus int, first bigint, blocks bigint")
    block = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("blocks"))
    indexed = placed.join(F.broadcast(names), ["pivot", "annulus"]).select(block.alias("block"), "vec_id", "v")
    queries = vectors.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))

    def visited(part: pa.RecordBatch, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """The queries (rows of part) and the annuli that they visit in a round."""
        d = shared.value
        bound = d.bounds(matrix(part.column("v"), width))
        order = np.argsort(-bound, axis=1, kind="stable")
        before = np.cumsum(d.rows[order], axis=1) - d.rows[order]
        round_ = np.zeros(bound.shape, dtype=np.int8)
        np.put_along_axis(round_, order, np.where(before <= k, 0, np.where(np.arange(bound.shape[1]) < STEP, 1, 2)).astype(np.int8), axis=1)
        go = round_ == turn
        if turn:
            floor = part.column("floor").to_numpy(zero_copy_only=False)[:, None]
            go &= (bound >= floor - np.abs(floor) * 1e-12) | np.isnan(floor)
        return np.nonzero(go)

    def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from (batch.slice(begin, 1024) for begin in range(0, batch.num_rows, 1024))

    def crowds(turn: int):
        """How many queries visit each block."""

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            d = shared.value
            for part in in_parts(batches):
                n = np.bincount(visited(part, turn)[1], minlength=len(d.rows))
                c = np.flatnonzero(n)
                many = d.blocks[c]
                number = np.repeat(d.first[c], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(np.repeat(n[c], many))], ["block", "n"])

        return scan

    def visits(turn: int):
        """The (query, block) pairs of a round."""

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            d = shared.value
            for part in in_parts(batches):
                q, c = visited(part, turn)
                many = d.blocks[c]
                q, c = np.repeat(q, many), np.repeat(c, many)
                number = d.first[c] + np.arange(len(c)) - np.repeat(np.cumsum(many) - many, many)
                for at in range(0, len(q), 4096):
                    some = pa.array(q[at : at + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(number[at : at + 4096]), part.column("vec_id").take(some), part.column("v").take(some)], ["block", "query_id", "v"])

        return scan

    def score(key: tuple, held: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if held.num_rows and asked.num_rows:
            x, ids = matrix(held.column("v"), width), held.column("vec_id").to_numpy()
            for begin in range(0, asked.num_rows, 512):
                part = asked.slice(begin, 512)
                whose, vectors = part.column("query_id").to_numpy(), matrix(part.column("v"), width)
                huge = large(vectors)
                for some in (np.flatnonzero(~huge), np.flatnonzero(huge)):
                    if len(some):
                        row, found, value = best(integer_scores(vectors[some], x), ids, whose[some], k)
                        out.append(pa.table([pa.array(whose[some][row]), pa.array(found), pa.array(value.astype(np.int64))], names=["query_id", "vec_id", "score"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64())] * 3, names=["query_id", "vec_id", "score"])

    pair, count = "block bigint, query_id bigint, v array<double>", "block bigint, n bigint"

    def found(asked: DataFrame, turn: int) -> DataFrame:
        """A round's scores: each block that queries visit meets them in portions."""
        crowd = asked.mapInArrow(crowds(turn), count).groupBy("block").agg(F.ceil(F.sum("n") / PORTION).alias("portions"))
        copies = indexed.join(crowd, "block").select("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("portions") - 1)).alias("portion"), "vec_id", "v")
        pairs = asked.mapInArrow(visits(turn), pair).join(crowd, "block").select("block", F.pmod(F.xxhash64("query_id"), F.col("portions")).alias("portion"), "query_id", "v")
        return copies.groupBy("block", "portion").cogroup(pairs.groupBy("block", "portion")).applyInArrow(score, "query_id bigint, vec_id bigint, score bigint")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    queries = checkpointed(queries)
    have = checkpointed(ranked(found(queries, 0)))
    for turn in (1, 2):
        floors = have.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
        more = found(queries.join(floors, "vec_id", "left"), turn)
        have = ranked(have.drop("rank").unionByName(more))
        have = checkpointed(have) if turn == 1 else have
    fits = F.when(F.abs("score") < TOP, F.col("score")).otherwise(F.raise_error(F.lit("a score does not fit a long")).cast("bigint"))
    return have.select("query_id", "rank", "vec_id", fits.alias("score"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
