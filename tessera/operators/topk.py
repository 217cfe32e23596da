"""Sorts, limits and nearest neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grams import dense, finite, gram_sums, whole

BLOCK, PAIR_BLOCK, PAIR_LEAST, SAMPLE, CELLS, TRIED, SCORES = 8192, 8192, 2048, 4096, 1024, 128, 1 << 19


def newest(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The newest n rows of each key, with their place."""
    w = Window.partitionBy(key).orderBy(*map(F.desc, order))
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def _best_of_groups(s, groups):
    """For each row of scores the columns of the best of each group, the first of equals.
    groups: a number for each column."""
    order = np.argsort(groups, kind="stable")
    starts = np.flatnonzero(np.diff(groups[order], prepend=groups[order[0]] - 1))
    held = s[:, order]
    top = np.repeat(np.maximum.reduceat(held, starts, axis=1), np.diff([*starts, len(order)]), axis=1)
    return order[np.minimum.reduceat(np.where(held == top, np.arange(len(order))[None], len(order)), starts, axis=1)]


def _first(s, n):
    """Rows and columns of the n greatest of each row, the first of equals."""
    least = np.partition(s, -n, axis=1)[:, -n] if s.shape[1] > n else np.full(len(s), -np.inf)
    row, at = np.nonzero(s >= least[:, None])
    order = np.lexsort((at, -s[row, at], row))
    row, at = row[order], at[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < n
    return row[kept], at[kept]


def _scores(kind: str, q, x, n: int, exact: bool):
    """Cosines, or 1 / (1 + distance), of all rows of q with all of x.  Distances come from norms
    and one product; those that may be among the n least are taken again from the
    differences, which have no cancellation (exact: all of them are)."""
    qq, xx = (q * q).sum(1), (x * x).sum(1)
    product = q @ x.T
    if kind == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            return product / np.sqrt(qq[:, None] * xx[None])
    square = np.maximum(qq[:, None] + xx[None] - 2 * product, 0)
    slack = 1e-9 * (qq[:, None] + xx.max(initial=0))
    near = np.ones(square.shape, bool) if exact or square.shape[1] <= n else square <= np.partition(square, n - 1, axis=1)[:, n - 1 : n] + 2 * slack
    row, at = np.nonzero(near)
    for begin in range(0, len(row), 1 << 16):
        r, c = row[begin : begin + (1 << 16)], at[begin : begin + (1 << 16)]
        square[r, c] = ((x[c] - q[r]) ** 2).sum(1)
    return 1 / (1 + np.sqrt(square))


def _meet(kind: str, n: int, width: int, group: bool):
    """Arrow tables of rows (vec_id, embedding, grp) and of queries (query_id, q) to each
    query's n best, or the best of each group."""
    names = ["query_id", "vec_id", "score"] + (["grp"] if group else [])
    one = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        kinds = [b.schema.field("query_id").type, a.schema.field("vec_id").type, pa.float64()] + ([a.schema.field("grp").type] if group else [])
        made = [pa.table([pa.array([], k) for k in kinds], names=names)]
        if a.num_rows and b.num_rows:
            a = a.sort_by("vec_id")
            held = one(a.column("embedding"))
            x, lengths = dense(held, width), np.diff(held.offsets.to_numpy())
            of = np.array(one(a.column("grp").dictionary_encode()).indices.fill_null(-1)) if group else None
            portion = max(1, SCORES // a.num_rows)  # no more scores at once, whatever meets
            for begin in range(0, b.num_rows, portion):
                some = b.slice(begin, portion)
                asked = pa.concat_arrays([one(some.column("q"))])  # offsets from zero
                s = _scores(kind, dense(asked, width), x, n, group)
                own = np.diff(asked.offsets.to_numpy())
                s = np.where(np.isnan(s) | (own[:, None] != lengths[None]) | (own == 0)[:, None], -np.inf, np.round(s, 9))
                if group:
                    at = _best_of_groups(s, of)
                    row, at = np.repeat(np.arange(len(s)), at.shape[1]), at.ravel()
                else:
                    row, at = _first(s, n)
                fine = s[row, at] > -np.inf
                row, at = row[fine], at[fine]
                columns = [some.column("query_id").take(pa.array(row)), a.column("vec_id").take(pa.array(at)), pa.array(s[row, at])]
                made.append(pa.table(columns + ([a.column("grp").take(pa.array(at))] if group else []), names=names))
        return pa.concat_tables(made).combine_chunks()

    return meet


def _sides(rows: DataFrame, queries: DataFrame, group: str | None) -> tuple[DataFrame, DataFrame, int]:
    """Rows and queries whose vectors are whole, and the greatest length of a row."""
    held = rows.select("vec_id", whole(F.col("embedding")).alias("embedding"), *([F.col(group).alias("grp")] if group else [])).filter("embedding is not null")
    asked = queries.select("query_id", whole(F.col("q")).alias("q")).filter("q is not null")
    return held, asked, max(1, held.agg(F.max(F.size("embedding"))).first()[0] or 0)


def nearest(rows: DataFrame, queries: DataFrame, kind: str, n: int, group: str | None = None) -> DataFrame:
    """query_id, vec_id, score, place: the n best rows for each query, by cosine or by
    1 / (1 + distance); with group, of the best row of each group the n best, and the group.
    Scores are rounded to nine places, ties go to the smaller vec_id.  rows: vec_id, embedding;
    queries: query_id, q.

    Vectors that are null, empty or hold nulls or values that are not finite take no part; a
    query meets rows of its own length only; a zero vector has no cosine.  An empty side
    gives an empty result.

    Rows meet queries in blocks: each block of rows and portion of queries is one matrix
    product, of which a query's n best (or the best of each group) go on.  Exact, with all
    rows compared with all queries; ``indexed_nearest`` reads a part of them."""
    held, asked, width = _sides(rows, queries, group)
    blocks, portions = max(1, -(-held.count() // BLOCK)), max(1, -(-asked.count() // BLOCK))
    every = lambda k, name: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(name)
    part = lambda c, k, name: F.pmod(F.xxhash64(c), F.lit(k)).cast("int").alias(name)
    kinds = dict(rows.dtypes)
    schema = f"query_id {dict(queries.dtypes)['query_id']}, vec_id {kinds['vec_id']}, score double" + (f", grp {kinds[group]}" if group else "")
    left = held.select("*", part("vec_id", blocks, "block")).select("*", every(portions, "portion"))
    right = asked.filter(F.size("q") <= width).select("query_id", "q", part("query_id", portions, "portion")).select("*", every(blocks, "block"))
    found = left.groupBy("block", "portion").cogroup(right.groupBy("block", "portion")).applyInArrow(_meet(kind, n, width, bool(group)), schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if group:
        best = Window.partitionBy("query_id", "grp").orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("place", F.row_number().over(best)).filter("place = 1").drop("place").withColumnRenamed("grp", group)
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


class Cells:
    """An index by cells: centres fitted on a bounded sample, and how many cells a query has to
    visit so that, within the sample, the given part of the true n nearest lies in them."""

    def __init__(self, sample, count: int, unit: bool, n: int, recall: float) -> None:
        self.unit = unit
        x = self.scaled(sample)
        self.centres = x[np.linspace(0, len(x) - 1, min(count, len(x))).astype(int)]
        for _ in range(6):
            own = self.distances(x).argmin(1)
            self.centres = np.stack([x[own == i].mean(0) if (own == i).any() else c for i, c in enumerate(self.centres)])
        asked = x[:: max(1, len(x) // TRIED)]
        order = np.argsort(((asked[:, None] - x[None]) ** 2).sum(2) if len(x) <= 256 else (asked * asked).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * asked @ x.T, axis=1)[:, 1 : n + 1]
        ranks = np.argsort(np.argsort(self.distances(asked), axis=1), axis=1)
        own = self.distances(x).argmin(1)
        found = ranks[np.arange(len(asked))[:, None], own[order]]
        self.probes = int(np.quantile(found, recall, method="higher")) + 1 if found.size else len(self.centres)

    def scaled(self, x):
        size = np.sqrt((x * x).sum(1, keepdims=True))
        return x / np.where(size > 0, size, 1) if self.unit else x

    def distances(self, x):
        c = self.centres
        return (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T

    def visits(self, x):
        """The cells nearest to each row of x, as many as a query visits."""
        return np.argsort(self.distances(self.scaled(x)), axis=1, kind="stable")[:, : self.probes]


def indexed_nearest(rows: DataFrame, queries: DataFrame, kind: str, n: int, recall: float = 0.98) -> DataFrame:
    """As ``nearest`` without groups, but a query reads the rows of its nearest cells only; what it
    returns is scored exactly.

    Cells are fitted on at most SAMPLE rows (those of least hash), CELLS of them at most, and
    the number that a query visits is chosen there, so that ``recall`` of the sample's true
    neighbours are found; true neighbours among all rows are nearer and so rather easier to find.
    Rows go to their cell once; a crowded cell is split into blocks, and only a
    cell that more than BLOCK queries visit is copied for each BLOCK of them."""
    spark = rows.sparkSession
    held, asked, width = _sides(rows, queries, None)
    sample = held.filter(F.size("embedding") > 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow().column("embedding")
    if not len(sample):
        return nearest(rows, queries, kind, n)
    count = held.count()
    index = spark.sparkContext.broadcast(Cells(dense(sample.combine_chunks(), width), max(4, min(CELLS, int(count**0.5))), kind == "cosine", n, recall))

    def scan(vector: str, key: str, all_visits: bool):
        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin in range(0, batch.num_rows, 4096):
                    some = batch.slice(begin, 4096)
                    visits = index.value.visits(dense(pa.concat_arrays([some.column(vector)]), width))
                    visits = visits if all_visits else visits[:, :1]
                    row = pa.array(np.repeat(np.arange(some.num_rows), visits.shape[1]))
                    yield pa.RecordBatch.from_arrays([some.column(key).take(row), some.column(vector).take(row), pa.array(visits.ravel().astype(np.int32))], [key, vector, "cell"])

        return cells

    ids = [f"{c} {dict(t.dtypes)[c]}" for c, t in (("vec_id", rows), ("query_id", queries))]
    left = held.mapInArrow(scan("embedding", "vec_id", False), f"{ids[0]}, embedding array<double>, cell int")
    right = asked.filter(F.size("q") <= width).mapInArrow(scan("q", "query_id", True), f"{ids[1]}, q array<double>, cell int")
    parts = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = F.broadcast(parts(left, "blocks").join(parts(right, "portions"), "cell"))  # a row for each cell
    every = lambda k, name: F.explode(F.sequence(F.lit(0), F.col(k) - 1)).alias(name)
    part = lambda c, k, name: F.pmod(F.xxhash64(c), F.col(k)).cast("int").alias(name)
    left = left.join(sizes, "cell").select("cell", part("vec_id", "blocks", "block"), every("portions", "portion"), "vec_id", "embedding")
    right = right.join(sizes, "cell").select("cell", part("query_id", "portions", "portion"), every("blocks", "block"), "query_id", "q")
    keys = ["cell", "block", "portion"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_meet(kind, n, width, False), f"{ids[1]}, {ids[0]}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def cosine_topk(rows: DataFrame, queries: DataFrame, n: int = 20) -> DataFrame:
    return nearest(rows, queries, "cosine", n)


def l2_topk(rows: DataFrame, queries: DataFrame, n: int = 5) -> DataFrame:
    """By similarity 1 / (1 + distance)."""
    return nearest(rows, queries, "l2", n)


def half_up(x: np.ndarray, places: int) -> np.ndarray:
    """Rounded, halves away from zero; no zero is negative."""
    return np.trunc(x * 10.0**places + np.copysign(0.5, x)) / 10.0**places + 0.0


def _products(q, v, light, floor: float | None):
    """Rows, columns and products of all unit vectors of q with all of v, or of those whose product is floor
    or more.  These are sought among products in single precision (light: v in it), less what these can
    be off by, and taken again in double."""
    if floor is None:
        return np.repeat(np.arange(len(q)), len(v)), np.tile(np.arange(len(v)), len(q)), (q @ v.T).ravel()
    slack = (v.shape[1] + 8) * 2.0**-23  # twice the bound: half a unit for each product, sum and rounding
    found = np.flatnonzero(q.astype(np.float32) @ light.T >= np.float32(floor - slack))
    row, at = np.divmod(found, max(1, len(v)))
    if 8 * len(found) > len(q) * len(v):
        score = (q @ v.T).ravel()[found]
    else:
        score, part = np.empty(len(found)), max(1, SCORES // v.shape[1])
        for begin in range(0, len(found), part):
            some = slice(begin, begin + part)
            np.einsum("ij,ij->i", q[row[some]], v[at[some]], out=score[some])
    kept = score >= floor - 1e-12
    return row[kept], at[kept], score[kept]


def _tile(floor: float | None, places: int | None):
    """For a pair (g, x, y) of blocks, from their rows (own: a row's block), batches of their pairs; no more
    than SCORES pairs are held at once."""

    def tile(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).sort_by("vec_id")
        held = rows.column("v").combine_chunks()
        v, kind = dense(held, max(1, pc.max(pc.list_value_length(held)).as_py())), rows.schema.field("vec_id").type
        size, own, ids = np.sqrt((v * v).sum(1)), rows.column("own").to_numpy(), rows.column("vec_id").to_numpy()
        x, y = key[1].as_py(), key[2].as_py()
        (u, one), (v, other) = ((v[of] / size[of][:, None], ids[of]) for of in ((own == side) & (size > 0) for side in (x, y)))
        light, step = v.astype(np.float32), max(1, math.isqrt(SCORES))
        for begin in range(0, len(u), step):
            # a vec_id is in one block: only there rows meet themselves, and those behind are enough
            for after in range(begin if x == y else 0, len(v), step):
                row, at, score = _products(u[begin : begin + step], v[after : after + step], light[after : after + step], floor)
                i, j = one[begin + row], other[after + at]
                if x == y:
                    once = i < j
                    i, j, score = i[once], j[once], score[once]
                if len(i):
                    score = score if places is None else half_up(score, places)
                    yield pa.RecordBatch.from_arrays([pa.repeat(key[0], len(i)), pa.array(np.minimum(i, j), kind), pa.array(np.maximum(i, j), kind), pa.array(score)], names=["g", "i", "j", "score"])

    return tile


def _tiles(rows: DataFrame, group: str) -> DataFrame:
    """g, x, y, own, vec_id, v: the rows of each pair x <= y of blocks of a group.  A block has some PAIR_BLOCK rows at
    most; a group of fewer than four such has up to four blocks of some PAIR_LEAST, so that there are tasks enough.

    A row goes to as many pairs as its group has blocks, and only there; what is broadcast is a row for each
    group of more than one block, of PAIR_LEAST rows or so at least."""
    column, kinds = F.col("embedding"), dict(rows.dtypes)
    held = rows.select(F.col(group).alias("g"), "vec_id", (column if kinds["embedding"] == "array<float>" else column.cast("array<double>")).alias("v"))
    held = held.filter(finite(F.col("v")) & F.col("vec_id").isNotNull() & F.col("g").isNotNull())
    blocks = lambda n: F.greatest(F.ceil(n / PAIR_BLOCK), F.least(F.lit(4), F.ceil(n / PAIR_LEAST))).cast("int").alias("blocks")
    counted = rows.groupBy(F.col(group).alias("g")).agg(blocks(F.count("*"))).filter("blocks > 1")
    dealt = held.join(F.broadcast(counted), "g", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    met = dealt.select("g", "own", "vec_id", "v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("met"))
    return met.select("g", F.least("own", "met").alias("x"), F.greatest("own", "met").alias("y"), "own", "vec_id", "v")


def cosine_pairs(rows: DataFrame, group: str, floor: float | None = None, places: int | None = None) -> DataFrame:
    """g, i, j, score: the cosine of all pairs i < j (vec_id) of rows of a group, or of those whose
    cosine is floor or more, rounded to places.  Vectors that are null, not whole or zero take no part;
    shorter ones count as filled up with zeros.  vec_id names a row.

    The rows of a group are dealt to blocks, and each pair of blocks is multiplied piece by piece.  There the
    floor and the rounding are applied too, on arrays: a pair costs no more than its own row.  All pairs
    are compared: the work grows with the square of a group."""
    kinds = dict(rows.dtypes)
    return _tiles(rows, group).groupBy("g", "x", "y").applyInArrow(_tile(floor, places), f"g {kinds[group]}, i {kinds['vec_id']}, j {kinds['vec_id']}, score double")


def linear_map(rows: DataFrame, a: Column, b: Column) -> list[list[float]]:
    """The least-squares M with A M near B, from two Gram sums; solved on the driver, whose
    work is bounded by the dimensions."""
    entries = gram_sums(rows, a, b).collect()
    if not entries:
        raise ValueError("no row holds both vectors")

    def matrix(kind: str) -> np.ndarray:
        own = [r for r in entries if r.kind == kind]
        out = np.zeros((max(r.i for r in own) + 1, max(r.j for r in own) + 1))
        for r in own:
            out[r.i, r.j] = r.x
        return out

    return np.linalg.lstsq(matrix("aa"), matrix("ab"), rcond=None)[0].tolist()


def apply_map(a: Column, m: list[list[float]]) -> Column:
    """Rows times the matrix, scaled to length one; null where a is null, holds a null, is not as
    long as the matrix, or is mapped to zero."""
    matrix = np.array(m, dtype=float)

    @F.arrow_udf("array<double>")
    def mapped(v: pa.Array) -> pa.Array:
        holds_null = np.bincount(np.repeat(np.arange(len(v)), pc.list_value_length(v).fill_null(0).to_numpy())[pc.is_null(v.flatten()).to_numpy(zero_copy_only=False)], minlength=len(v)) > 0
        fine = (pc.list_value_length(v).fill_null(-1).to_numpy() == len(matrix)) & ~holds_null
        out = v.filter(pa.array(fine)).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(matrix)) @ matrix
        size = np.sqrt((out * out).sum(1))
        kept = (size > 0) | np.isnan(size)
        fine[fine] = kept
        offsets = np.concatenate([[0], np.cumsum(np.where(fine, matrix.shape[1], 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array((out[kept] / size[kept, None]).ravel()), mask=pa.array(~fine))

    return mapped(a.cast("array<double>"))
