"""Sums over all pairs of rows from sums over rows: Gram matrices of paired vectors.

Over rows u_i and v_i the sum of (u_i . u_j) (v_i . v_j) over all i and j is the squared
Frobenius norm of the sum of u_i v_i'.  So what pairs' similarities add up to takes one pass
over the rows and a matrix of the dimensions; no pair is made."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUPS = 64


def dense(column, width: int) -> np.ndarray:
    """The rows of an Arrow list column as a matrix; shorter ones are filled up with zeros."""
    counts = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width) < counts[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def finite(column: Column) -> Column:
    """Whether an array holds no null and no value that is not finite; null if it is null."""
    return F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def whole(column: Column) -> Column:
    """column as doubles; null if it is null, or holds a null or a value that is not finite."""
    return F.when(finite(column), column.cast("array<double>"))


def gram_sums(rows: DataFrame, a: Column, b: Column, group: str | None = None, unit: bool = False) -> DataFrame:
    """g, n, kind, i, j, x: for each group (null: all rows) the entries of A'A (kind aa), A'B (ab) and
    B'B (bb), and of the sums of A (a) and B (b, j is 0), over the n rows in which both vectors
    are whole; with unit, vectors are scaled to length one, and rows with a zero one left out.

    Every task adds its rows up in matrices and sends these, not the rows."""
    import pyarrow as pa

    g = F.col(group) if group else F.lit(None).cast("string")
    held = rows.select(g.alias("g"), whole(a).alias("a"), whole(b).alias("b")).filter("a is not null and b is not null")
    size = held.agg(F.max(F.size("a")).alias("a"), F.max(F.size("b")).alias("b")).first()
    wa, wb = max(1, size["a"] or 0), max(1, size["b"] or 0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}

        def made() -> pa.RecordBatch:
            keys = list(sums)
            columns = [pa.array(keys, kind), pa.array([sums[k][0] for k in keys], pa.int64()), pa.array([np.concatenate([m.ravel() for m in sums[k][1:]]) for k in keys], pa.list_(pa.float64()))]
            sums.clear()
            return pa.RecordBatch.from_arrays(columns, ["g", "n", "x"])

        for batch in batches:
            kind = batch.schema.field("g").type
            u, v, fine = dense(batch.column("a"), wa), dense(batch.column("b"), wb), np.ones(batch.num_rows, bool)
            if unit:
                lu, lv = np.sqrt((u * u).sum(1)), np.sqrt((v * v).sum(1))
                fine = (lu > 0) & (lv > 0)
                u, v = u / np.where(fine, lu, 1)[:, None], v / np.where(fine, lv, 1)[:, None]
            codes = batch.column("g").dictionary_encode()
            of = np.where(fine, codes.indices.fill_null(len(codes.dictionary)).to_numpy(), -1)
            names = [*codes.dictionary.to_pylist(), None]
            for code in np.unique(of[of >= 0]):
                x, y = u[of == code], v[of == code]
                now = (len(x), x.T @ x, x.T @ y, y.T @ y, x.sum(0), y.sum(0))
                had = sums.get(names[code])
                sums[names[code]] = now if had is None else tuple(p + q for p, q in zip(had, now, strict=True))
            if len(sums) >= GROUPS:
                yield made()
        if sums:
            yield made()

    kind = held.schema["g"].dataType.simpleString()
    parts = held.mapInArrow(scan, f"g {kind}, n bigint, x array<double>")
    each = parts.select("g", "n", F.posexplode("x").alias("at", "x")).groupBy("g", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    shapes, begin, kinds, i, j = [("aa", wa, wa), ("ab", wa, wb), ("bb", wb, wb), ("a", wa, 1), ("b", wb, 1)], 0, None, None, None
    for name, height, width in shapes:
        here, at = F.col("at") < begin + height * width, F.col("at") - begin
        value = (F.lit(name), F.floor(at / width).cast("int"), (at % width).cast("int"))
        kinds, i, j = (F.when(here, v) if c is None else c.when(here, v) for c, v in zip((kinds, i, j), value, strict=True))
        begin += height * width
    return each.select("g", "n", kinds.alias("kind"), i.alias("i"), j.alias("j"), "x")


def space_agreement(rows: DataFrame, group: str | None, one: Column, two: Column) -> DataFrame:
    """g, n, agreement: for each group the correlation, over all pairs of its rows, of the cosines
    in two spaces.  Rows in which a vector is null, not whole or zero take no part; the
    agreement is null below three rows, and where all cosines of a space are equal."""
    entries = gram_sums(rows, one, two, group, unit=True)
    squares = entries.groupBy("g").agg(F.first("n").cast("double").alias("n"), *(F.sum(F.when(F.col("kind") == k, F.col("x") * F.col("x"))).alias(k) for k in ("aa", "ab", "bb", "a", "b")))
    # over pairs i < j: half of the sums over all i and j without the diagonal, whose entries are 1
    pairs = F.col("n") * (F.col("n") - 1) / 2
    ss, st, tt, s, t = ((F.col(c) - F.col("n")) / 2 for c in ("aa", "ab", "bb", "a", "b"))
    vs, vt = pairs * ss - s * s, pairs * tt - t * t
    flat = (vs <= 1e-12 * pairs * ss) | (vt <= 1e-12 * pairs * tt)
    return squares.select("g", F.col("n").cast("bigint").alias("n"), F.when((F.col("n") > 2) & ~flat, (pairs * st - s * t) / F.sqrt(vs * vt)).alias("agreement"))
