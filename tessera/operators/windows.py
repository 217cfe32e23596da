"""Window functions and ordered folds per group."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import running
from .storage import checkpointed


def moving_average(rows: DataFrame, series: str, order: str, value: str, factor: float) -> DataFrame:
    """A centred mean whose half width is a share of the series: none or less leaves it, one
    or more gives its mean.  The width depends on each series' length, so the sums are
    taken as differences of running sums at both edges; these run in two levels, so one long
    series fills all tasks."""
    if factor <= 0:
        return rows.withColumn("smooth", F.col(value).cast("double"))
    whole = Window.partitionBy(series)
    if factor >= 1:
        return rows.withColumn("smooth", F.avg(value).over(whole))
    lengths = rows.groupBy(series).agg(F.count("*").alias("_n"))
    sums = running(rows, [series], [order], {"_i": F.lit(1).cast("bigint"), "_s": F.col(value).cast("double")})
    sums = checkpointed(sums.join(lengths, sums[series].eqNullSafe(lengths[series])).drop(lengths[series]))
    half = F.floor(F.col("_n") * factor)
    lo, hi = F.greatest(F.col("_i") - half, F.lit(1)), F.least(F.col("_i") + half, F.col("_n"))
    edges = sums.withColumns({"_lo": lo, "_hi": hi})
    at = sums.select(series, F.col("_i").alias("_at"), "_s")
    high = edges.drop("_s").join(at.withColumnsRenamed({"_at": "_hi", "_s": "_high"}), [series, "_hi"])
    both = high.withColumn("_before", F.col("_lo") - 1).join(at.withColumnsRenamed({"_at": "_before", "_s": "_low"}), [series, "_before"], "left")
    return both.select(*rows.columns, ((F.col("_high") - F.coalesce("_low", F.lit(0.0))) / (F.col("_hi") - F.col("_lo") + 1)).alias("smooth"))


def kalman(values: Column, q: float = 1e-4, r: float = 1e-2) -> Column:
    """The filtered series of an array in order, from x = 0 and P = 1."""
    start = F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("p"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, z: Column) -> Column:
        p = acc["p"] + q
        k = p / (p + r)
        x = acc["x"] + k * (z - acc["x"])
        return F.struct(x.alias("x"), ((1 - k) * p).alias("p"), F.concat(acc["out"], F.array(x)).alias("out"))

    return F.aggregate(values, start, step, lambda acc: acc["out"])


def kalman_series(rows: DataFrame, series: str, order: str, value: str, q: float = 1e-4, r: float = 1e-2) -> DataFrame:
    """series, order, smooth: the filtered series.  Rows are sorted within their series by
    Spark and pass as Arrow batches; two numbers are carried from one to the next, so a
    series may be longer than memory.  The gain does not depend on the values: after some
    steps it is constant and the filter is a weighted sum, worked out for many rows at once.

    A value that is null or not finite is no measurement: its row gets the last smooth value (0
    before the first) and leaves the state as it is."""
    import numpy as np
    import pyarrow as pa

    kinds = dict(rows.dtypes)
    step = 128
    steady = 400  # by then the gain has settled to all digits of a double

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, last = 1.0, None
        for _ in range(10 * steady):
            p = (1 - (p + q) / (p + q + r)) * (p + q)
        gain = (p + q) / (p + q + r)
        fade = (1 - gain) ** np.arange(1, step + 1)
        lower = np.tril(gain * (1 - gain) ** (np.arange(step)[:, None] - np.arange(step)[None]).clip(0))

        def smooth(z: np.ndarray, x: float, p: float, n: int) -> tuple[np.ndarray, float, float, int]:
            out, i = np.empty(len(z)), 0
            while i < len(z) and n < steady:
                p += q
                k = p / (p + r)
                x += k * (z[i] - x)
                p *= 1 - k
                out[i] = x
                i, n = i + 1, n + 1
            while i < len(z):
                part = z[i : i + step]
                out[i : i + len(part)] = lower[: len(part), : len(part)] @ part + fade[: len(part)] * x
                x, i, n = out[i + len(part) - 1], i + len(part), n + len(part)
            return out, x, p, n

        state = (0.0, 1.0, 0)
        for batch in batches:
            names = batch.column(series).to_pylist()
            z = batch.column(value).to_numpy(zero_copy_only=False).astype(np.float64)
            edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            made = []
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if last is None or names[a] != last[0]:
                    state, last = (0.0, 1.0, 0), (names[a],)
                held = np.isfinite(z[a:b])
                out, *rest = smooth(z[a:b][held], *state)
                made.append(np.concatenate([[state[0]], out])[np.cumsum(held)])
                state = tuple(rest)
            yield pa.RecordBatch.from_arrays([batch.column(series), batch.column(order), pa.array(np.concatenate(made) if made else z)], [series, order, "smooth"])

    chosen = rows.select(series, order, F.col(value).cast("double").alias(value)).repartition(series).sortWithinPartitions(series, order)
    return chosen.mapInArrow(scan, f"{series} {kinds[series]}, {order} {kinds[order]}, smooth double")


def lag_correlation(left: DataFrame, right: DataFrame, most: int | None = None, block: int = 1 << 15) -> DataFrame:
    """lag, corr, offset: sums of products of two mean-free series (t long, v) at each lag at
    which they meet (of up to most steps, if given), and whether the lag is the offset, the
    one with the greatest sum (ties, to six places: the least).  Rows without a value or a
    time take no part; an empty series gives an empty result.

    Both series are cut into blocks of steps.  A pair of blocks gives all of its lags by
    one Fourier transform, in block x log(block) work instead of the square, and a second one
    counts the steps that meet; what the pairs give is added by lag."""
    import numpy as np
    import pyarrow as pa

    a, b = (s.filter("t is not null and v is not null").select(F.col("t").cast("bigint").alias("t"), F.col("v").cast("double").alias("v")) for s in (left, right))
    a, b = (s.join(F.broadcast(s.agg(F.avg("v").alias("m")))).select("t", (F.col("v") - F.col("m")).alias("v"), F.expr(f"bigint(floor(t / {block}))").alias("own")) for s in (a, b))
    ends = [tuple(s.agg(F.min("own"), F.max("own")).first()) for s in (a, b)]
    if None in (ends[0][0], ends[1][0]):
        return left.sparkSession.createDataFrame([], "lag bigint, corr double, offset boolean")
    reach = None if most is None else most // block + 1

    def dealt(s: DataFrame, other: tuple, names: tuple[str, str], t: str, v: str) -> DataFrame:
        low, high = (F.lit(x).cast("bigint") for x in other)
        if reach is not None:
            low, high = F.greatest(low, F.col("own") - reach), F.least(high, F.col("own") + reach)
        met = F.explode(F.when(low <= high, F.sequence(low, high))).alias(names[1])
        return s.select(F.col("own").alias(names[0]), met, F.col("t").alias(t), F.col("v").alias(v))

    x, y = dealt(a, ends[1], ("i", "j"), "t", "v"), dealt(b, ends[0], ("j2", "i2"), "u", "w")

    def tile(key: tuple, one: pa.Table, other: pa.Table) -> pa.Table:
        names = ["lag", "corr", "met"]
        if not one.num_rows or not other.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.int64())], names=names)
        i, j = key[0].as_py(), key[1].as_py()
        spectra = []
        for table, t, v, begin in ((one, "t", "v", i * block), (other, "u", "w", j * block)):
            at, made = table.column(t).to_numpy() - begin, np.zeros((2, 2 * block))
            np.add.at(made[0], at, table.column(v).to_numpy())
            np.add.at(made[1], at, 1.0)
            spectra.append(np.fft.rfft(made))
        sums, met = np.fft.irfft(spectra[0] * np.conj(spectra[1]), 2 * block)
        steps = np.concatenate([np.arange(block), np.arange(-block, 0)])
        held = np.rint(met) > 0
        lag = steps[held] + (i - j) * block
        return pa.table([pa.array(lag), pa.array(sums[held]), pa.array(np.rint(met[held]).astype(np.int64))], names=names)

    tiles = x.groupBy("i", "j").cogroup(y.groupBy("i2", "j2")).applyInArrow(tile, "lag bigint, corr double, met bigint")
    tiles = tiles if most is None else tiles.filter(F.abs("lag") <= most)
    sums = checkpointed(tiles.groupBy("lag").agg(F.sum("corr").alias("corr")))
    best = sums.agg(F.max_by("lag", F.struct(F.round("corr", 6), -F.col("lag"))).alias("best"))
    return sums.join(F.broadcast(best)).select("lag", "corr", (F.col("lag") == F.col("best")).alias("offset"))


def first_gaps(done: DataFrame, key: str, number: str) -> DataFrame:
    """key, gap: the least number from 1 that a key's rows (key, number) do not hold.  The distinct
    numbers of a key are sorted; those that stand at their own place come before the gap."""
    w = Window.partitionBy(key).orderBy(number)
    held = done.select(key, number).filter(F.col(number) >= 1).distinct().withColumn("_at", F.row_number().over(w))
    return held.groupBy(key).agg((F.count_if(F.col(number) == F.col("_at")) + 1).alias("gap"))


def remaining(done: DataFrame, keys: DataFrame, key: str, number: str, most: int) -> DataFrame:
    """key, number: of the numbers 1 to most those that a key's rows do not hold, for each row
    of keys.  The held numbers of a key are one set of at most most entries."""
    held = done.filter(F.col(number).between(1, most)).groupBy(key).agg(F.collect_set(F.col(number).cast("int")).alias("_held"))
    all_ = F.sequence(F.lit(1), F.lit(most))
    return keys.select(key).distinct().join(held, key, "left").select(key, F.explode(F.array_except(all_, F.coalesce("_held", F.array().cast("array<int>")))).alias(number))


def streaks(rows: DataFrame, keys: list[str], order: list[str], grade: str) -> DataFrame:
    """Adds right (grades of 4 or more in a row, up to this row) and wrong (grades below 3
    in a row)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = rows
    for name, holds in (("right", F.col(grade) >= 4), ("wrong", F.col(grade) < 3)):
        out = out.withColumn("_island", F.sum(F.when(holds, 0).otherwise(1)).over(w))
        counted = F.sum(F.when(holds, 1).otherwise(0)).over(Window.partitionBy(*keys, "_island").orderBy(*order))
        out = out.withColumn(name, F.when(holds, counted).otherwise(0)).drop("_island")
    return out


def spaced_repetition(grades: Column) -> Column:
    """ease and interval (in days, a double since it grows without bound) after an array of
    grades in order."""
    start = F.struct(F.lit(2.5).alias("ease"), F.lit(0.0).alias("interval"))

    def step(s: Column, g: Column) -> Column:
        ease = F.least(F.greatest(s["ease"] + (0.1 - (5 - g) * (0.08 + (5 - g) * 0.02)), F.lit(1.3)), F.lit(2.5))
        nxt = F.when(s["interval"] == 0, 1.0).when(s["interval"] == 1, 6.0).otherwise(F.bround(s["interval"] * s["ease"]))
        return F.when(g >= 3, F.struct(ease.alias("ease"), nxt.alias("interval"))).otherwise(F.struct(s["ease"].alias("ease"), F.lit(1.0).alias("interval")))

    return F.aggregate(grades, start, step)


def repetition_series(rows: DataFrame, keys: list[str], order: list[str], grade: str) -> DataFrame:
    """keys, ease, interval after the last grade of each key.  Rows are sorted within their key
    by Spark and pass as Arrow batches; the two numbers are carried from one to the next, so
    a history may be longer than memory.  Null grades take no part."""
    import pyarrow as pa

    kinds = {k: rows.schema[k].dataType.simpleString() for k in keys}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ease, interval = None, 2.5, 0.0
        for batch in batches:
            done = []
            for key, g in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), batch.column(grade).to_pylist(), strict=True):
                if key != last:
                    done += [(*last, ease, interval)] if last else []
                    last, ease, interval = key, 2.5, 0.0
                if g >= 3:
                    interval = 1.0 if interval == 0 else 6.0 if interval == 1 else float(round(interval * ease))
                    ease = min(max(ease + (0.1 - (5 - g) * (0.08 + (5 - g) * 0.02)), 1.3), 2.5)
                else:
                    interval = 1.0
            types = [batch.schema.field(k).type for k in keys] + [pa.float64()] * 2
            yield made(done, types)
        if last:
            yield made([(*last, ease, interval)], types)

    def made(done: list[tuple], types: list) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*keys, "ease", "interval"])

    chosen = rows.filter(F.col(grade).isNotNull()).select(*keys, *order, F.col(grade).cast("int").alias(grade)).repartition(*keys).sortWithinPartitions(*keys, *order)
    return chosen.mapInArrow(scan, ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", ease double, interval double")


def outline_rows(lines: DataFrame, heading: str, item: str) -> DataFrame:
    """doc, pos, section, item: each item line takes the last heading above it.  heading and
    item are patterns with one group."""
    head, sub = F.regexp_extract("line", heading, 1), F.regexp_extract("line", item, 1)
    w = Window.partitionBy("doc").orderBy("pos")
    marked = lines.select("doc", "pos", F.when(F.rlike("line", F.lit(heading)), head).alias("head"), F.when(F.rlike("line", F.lit(item)), sub).alias("item"))
    return marked.withColumn("section", F.last("head", ignorenulls=True).over(w)).filter("item is not null and head is null and section is not null").select("doc", "pos", "section", "item")
