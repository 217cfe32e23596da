"""Operator 12: hard negatives for anchors, by exact inner products.

Method: Four-Russians scoring.  A candidate's integer components are packed once into bit planes
(two's complement), a byte for each plane and group of eight dimensions.  For an anchor and a
group a table holds the sums of all 256 subsets of the anchor's eight components, so a
plane's part of a score is one lookup for each group; planes are added from the highest (which counts
negative) to the lowest, doubling in between.  Scores are full and exact: in 32-bit
integers where bounds allow, else in 64-bit ones, else in Python's, which have no bound.

Rows are dealt to blocks, and anchors to portions; each block meets each portion in one task.
Blocks of the first pass hold rows of one bucket of labels, so an anchor meets its own label
only; there each block returns an anchor's first positives.  In the second pass all blocks
meet all anchors, whose positives' scores bound the negatives, and each block returns the first
negatives of each positive.  Blocks are dealt by row numbers, so no label or vector,
however frequent, makes one block larger than others.

Defined results: rows with a null vec_id or label, a null vector or a null or non-finite
component take no part; vectors of other lengths count as filled up with zeros, so an empty
one scores 0; rows that share the anchor's vec_id are its own and no candidates; a
vec_id repeated among the anchors is one anchor (its least label, then vector); repeated rows are
candidates of their own; an empty table gives an empty result.  A positive with a score of 2**63 - 1 or
more is an error, since it is returned; smaller scores beyond 64 bits never are, because a
negative's lies between the positive's and 0.8 of it.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import flat, sections, within
from .checkpoints import checkpointed

LABELS, LEAST_BLOCK, BLOCK, PORTION = 1024, 4096, 65_536, 8192
ANCHORS, CANDIDATES = 64, 2048
TOP = 2**63 - 1


def packed(values: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Bit planes of each row of values (doubles, counts[i] of them in row i): bytes of
    plane after plane, lowest first; and the numbers of planes and of groups."""
    whole = np.floor(values * 256)
    out: list[bytes] = [b""] * len(counts)
    planes, groups = np.ones(len(counts), np.int32), (-(-counts // 8)).astype(np.int32)
    most = np.zeros(len(counts))
    np.maximum.at(most, sections(counts), np.abs(whole))
    starts = np.cumsum(counts) - counts
    fits = most < 2.0**52
    planes[fits] = np.frexp(most[fits])[1] + 1  # 2**e > most, and a plane for the sign
    order = np.flatnonzero(fits)
    for g, p in {(int(groups[i]), int(planes[i])) for i in order}:
        rows = order[(groups[order] == g) & (planes[order] == p)]
        held = np.zeros((len(rows), 8 * g), np.int64)
        n = counts[rows]
        held[sections(n), within(n)] = whole[np.repeat(starts[rows], n) + within(n)].astype(np.int64)
        bits = np.stack([np.packbits((held >> b) & 1 == 1, axis=1, bitorder="little") for b in range(p)], axis=1).reshape(len(rows), -1)
        for i, row in zip(rows, bits, strict=True):
            out[i] = row.tobytes()
    for i in np.flatnonzero(~fits):  # doubles of 2**44 and more are whole numbers
        row = [int(v) * 256 if abs(v) >= 2.0**44 else int(np.floor(v * 256)) for v in values[starts[i] : starts[i] + counts[i]].tolist()]
        planes[i] = max(v.bit_length() for v in row) + 1
        row += [0] * (8 * int(groups[i]) - len(row))
        out[i] = np.packbits([[v >> b & 1 for v in row] for b in range(int(planes[i]))], axis=1, bitorder="little").tobytes()
    return out, planes, groups


def unpacked(data: list[bytes], planes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """The integers of packed rows, one row each; Python's if 64 bits are too few."""
    width = 8 * int(max(groups, default=0))
    out = np.zeros((len(data), width), dtype=object if max(planes, default=0) > 62 else np.int64)
    for i, (row, p, g) in enumerate(zip(data, planes.tolist(), groups.tolist(), strict=True)):
        bits = np.unpackbits(np.frombuffer(row, np.uint8).reshape(p, g), axis=1, bitorder="little").astype(out.dtype)
        weights = np.array([1 << b for b in range(p - 1)] + [-(1 << (p - 1))], dtype=out.dtype)
        out[i, : 8 * g] = (weights[:, None] * bits).sum(axis=0) if g else 0
    return out


def planes_of(data: list[bytes], planes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """plane x group x row: the bytes of packed rows, with the sign plane repeated in rows of
    fewer planes, and zeros in missing groups."""
    p, g = int(planes.max()), int(groups.max())
    out = np.zeros((p, g, len(data)), np.uint8)
    for own_p, own_g in set(zip(planes.tolist(), groups.tolist(), strict=True)):
        rows = np.flatnonzero((planes == own_p) & (groups == own_g))
        held = np.frombuffer(b"".join(data[i] for i in rows), np.uint8).reshape(len(rows), own_p, own_g).transpose(1, 2, 0)
        out[np.ix_(range(p), range(own_g), rows)] = held[np.minimum(np.arange(p), own_p - 1)]
    return out


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """group x 256 x anchor: the sums of all subsets of eight components."""
    held = anchors.T.reshape(-1, 8, len(anchors)).astype(kind)
    out = np.zeros((len(held), 256, len(anchors)), dtype=kind)
    for i in range(8):
        out[:, 1 << i : 2 << i] = out[:, : 1 << i] + held[:, i : i + 1]
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """candidate x anchor: the inner products."""
    count, groups, rows = planes.shape
    out = np.zeros((rows, tables.shape[2]), dtype=tables.dtype)
    for p in range(count - 1, -1, -1):
        if p < count - 1:
            out += out
        for g in range(min(groups, len(tables))):
            if p == count - 1:
                out -= tables[g][planes[p, g]]
            else:
                out += tables[g][planes[p, g]]
    return out


def kind_for(anchors: np.ndarray, planes: int) -> type:
    """The narrowest integers that hold a hundred times any score."""
    bound = max([1, *(int(x) for x in np.abs(anchors).sum(axis=1))]) << planes
    return np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 56 else object


def first_of(groups: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Of rows the numbers of those with the highest scores (ties: least ids) of each group."""
    if score.dtype == object:
        order = np.array(sorted(range(len(ids)), key=lambda i: (groups[i], -score[i], ids[i])), dtype=np.int64)
    else:
        order = np.lexsort((ids, -score, groups))
    held = groups[order]
    begins = np.searchsorted(held, held, side="left")
    return order[np.arange(len(held)) - begins < most]


class Side:
    """The packed rows of one side of a tile."""

    def __init__(self, table: pa.Table, ids: str) -> None:
        self.ids, self.labels = table.column(ids).to_numpy(), table.column("label").to_numpy()
        self.planes, self.groups = table.column("planes").to_numpy(), table.column("groups").to_numpy()
        self.data = table.column("data").to_pylist()

    def planes_at(self, rows: np.ndarray) -> np.ndarray:
        return planes_of([self.data[i] for i in rows], self.planes[rows], self.groups[rows])

    def integers(self, rows: np.ndarray) -> np.ndarray:
        return unpacked([self.data[i] for i in rows], self.planes[rows], self.groups[rows])


def _tiles(held: Side, asked: Side) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a tile: numbers of candidates, numbers of anchors, candidate x anchor scores.
    Rows of like numbers of planes stand together, so a large component slows its part only."""
    candidates = np.lexsort((held.groups, held.planes))
    of_anchors = np.lexsort((asked.groups, asked.planes))
    parts = [candidates[i : i + CANDIDATES] for i in range(0, len(candidates), CANDIDATES)]
    loaded = [(rows, held.planes_at(rows)) for rows in parts]
    for at in range(0, len(of_anchors), ANCHORS):
        who = of_anchors[at : at + ANCHORS]
        anchors, tables = asked.integers(who), {}
        for rows, planes in loaded:
            kind = kind_for(anchors, len(planes))
            if kind not in tables:
                tables[kind] = subset_sums(anchors, kind)
            yield rows, who, scores(tables[kind], planes)


_POSITIVE = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("score", pa.int64())])
_NEGATIVE = pa.schema([("anchor_id", pa.int64()), ("place", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])


def _long(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) if x.dtype != object else np.array([max(-TOP, min(TOP, v)) for v in x], dtype=np.int64)


def _positives(most: int):
    def tile(key: tuple, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return _POSITIVE.empty_table()
        held, asked = Side(rows, "vec_id"), Side(anchors, "anchor_id")
        floor = np.full(len(asked.ids), -TOP, dtype=np.int64)
        best: dict[int, list[tuple]] = {}
        for at, who, score in _tiles(held, asked):
            may = (held.labels[at][:, None] == asked.labels[who][None]) & (held.ids[at][:, None] != asked.ids[who][None])
            c, a = np.nonzero(may & (_long(score.ravel()).reshape(score.shape) >= floor[who][None]))
            chosen = first_of(a, value := score[c, a], ids := held.ids[at][c], most)
            for i in chosen.tolist():
                best.setdefault(int(who[a[i]]), []).append((-int(value[i]), int(ids[i])))
            for i in {int(who[x]) for x in np.unique(a[chosen])}:
                best[i] = sorted(best[i])[:most]
                if len(best[i]) == most:
                    floor[i] = max(-TOP, min(TOP, -best[i][-1][0]))
        out = [(int(asked.ids[i]), vec, max(-TOP, min(TOP, -score))) for i, found in best.items() for score, vec in found]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _POSITIVE, strict=True)], schema=_POSITIVE) if out else _POSITIVE.empty_table()

    return tile


def _negatives(most: int, low: int, high: int):
    """Negatives: low * positive <= 100 * negative <= high * positive."""

    def tile(key: tuple, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return _NEGATIVE.empty_table()
        held, asked = Side(rows, "vec_id"), Side(anchors, "anchor_id")
        values, counts = flat(anchors.column("scores"))
        names, _ = flat(anchors.column("positives"))
        starts = np.cumsum(counts) - counts
        # bands in whole numbers: ceil(low * p / 100) to floor(high * p / 100)
        bands = np.array([(-(-low * p // 100), high * p // 100) for p in values.tolist()], dtype=object).reshape(-1, 2)
        bands = bands.astype(np.int64)
        least = np.array([min(bands[s : s + n, 0], default=TOP) for s, n in zip(starts, counts, strict=True)])
        greatest = np.array([max(bands[s : s + n, 1], default=-TOP) for s, n in zip(starts, counts, strict=True)])
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        pending = 0

        def reduced(found: list) -> list:
            if not found:
                return found
            slot, ids, score = (np.concatenate(x) for x in zip(*found, strict=True))
            keep = first_of(slot, score, ids, most)
            return [(slot[keep], ids[keep], score[keep])]

        for at, who, score in _tiles(held, asked):
            score = _long(score.ravel()).reshape(score.shape)
            may = (score >= least[who][None]) & (score <= greatest[who][None])
            c, a = np.nonzero(may)
            other = held.labels[at][c] != asked.labels[who][a]
            c, a = c[other], a[other]
            if not len(c):
                continue
            n = counts[who[a]]
            row, slot = np.repeat(np.arange(len(c)), n), np.repeat(starts[who[a]], n) + within(n)
            value = score[c, a][row]
            inside = (value >= bands[slot, 0]) & (value <= bands[slot, 1])
            row, slot, value = row[inside], slot[inside], value[inside]
            ids = held.ids[at][c[row]]
            keep = first_of(slot, value, ids, most)
            best.append((slot[keep], ids[keep], value[keep]))
            pending += len(keep)
            if pending > 1 << 20:
                best, pending = reduced(best), 0
        if not (best := reduced(best)):
            return _NEGATIVE.empty_table()
        slot, ids, value = best[0]
        owner = sections(counts)[slot]
        return pa.table([asked.ids[owner], within(counts)[slot].astype(np.int32) + 1, names[slot], values[slot], ids, value], schema=_NEGATIVE)

    return tile


def prepared(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """vec_id, label, anchor, planes, groups, data and number (in whole rows of a task and spread
    over 2**31) of the rows that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    held = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(fine)
    held = held.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), is_anchor.alias("anchor"), F.col("embedding").cast("array<double>").alias("v"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, planes, groups = packed(*flat(batch.column("v")))
            number = ((task * 0x9E3779B1 + (done + np.arange(batch.num_rows)) * 0x85EBCA77) % (1 << 31)).astype(np.int64)
            done += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("anchor"), pa.array(planes), pa.array(groups), pa.array(data, pa.binary()), pa.array(number)], ["vec_id", "label", "anchor", "planes", "groups", "data", "number"])

    return checkpointed(held.mapInArrow(scan, "vec_id bigint, label bigint, anchor boolean, planes int, groups int, data binary, number bigint"))


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.  For each row of
    rows (vec_id, embedding, label) that is_anchor holds for: its first ``positives`` other
    rows of its label, and for each of them the first ``negatives`` rows of other labels
    with low * positive_score <= 100 * negative_score <= high * positive_score."""
    spark = rows.sparkSession
    table = prepared(rows, is_anchor)
    packed_row = [F.col(c) for c in ("planes", "groups", "data")]
    once = table.filter("anchor").groupBy("vec_id").agg(F.min(F.struct("label", "planes", "groups", "data", "number")).alias("a"))
    anchors = checkpointed(once.select(F.col("vec_id").alias("anchor_id"), "a.*"))
    bucket = F.pmod(F.xxhash64("label"), F.lit(LABELS)).cast("int")

    def spread(n: Column, least: int, size: int) -> Column:
        """How many parts n rows make: of least to size rows, sixteen in between."""
        return F.greatest(F.lit(1), F.ceil(n / F.least(F.lit(size), F.greatest(F.lit(least), n / 16)))).cast("int")

    # the numbers of blocks and portions of each bucket of labels, LABELS rows at most
    counted = table.groupBy(bucket.alias("bucket")).agg(spread(F.count("*"), LEAST_BLOCK, BLOCK).alias("blocks"), spread(F.count_if("anchor"), PORTION, PORTION).alias("portions"))
    counted = F.broadcast(checkpointed(counted))
    numbers = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    block, portion = (F.pmod("number", F.col(n)).cast("int").alias(x) for n, x in (("blocks", "block"), ("portions", "portion")))
    x = table.withColumn("bucket", bucket).join(counted, "bucket").select("bucket", block, numbers("portions", "portion"), "vec_id", "label", *packed_row)
    y = anchors.withColumn("bucket", bucket).join(counted, "bucket").select("bucket", portion, numbers("blocks", "block"), "anchor_id", "label", *packed_row)
    keys = ["bucket", "block", "portion"]
    found = x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInArrow(_positives(positives), "anchor_id bigint, positive_id bigint, score bigint")
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id"))).filter(F.col("place") <= positives)
    fits = F.when(F.col("score") < TOP, F.col("score")).otherwise(F.raise_error(F.lit("a positive's score does not fit a long")).cast("bigint"))
    lists_ = ranked.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", fits.alias("score")))).alias("p"))
    asked = anchors.join(lists_, "anchor_id").select("*", F.transform("p", lambda p: p["positive_id"]).alias("positives"), F.transform("p", lambda p: p["score"]).alias("scores")).drop("p")
    asked = checkpointed(asked)

    sizes = table.agg(spread(F.count("*"), LEAST_BLOCK, BLOCK).alias("blocks"), spread(F.count_if("anchor"), PORTION, PORTION).alias("portions")).first()
    everywhere = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    block, portion = (F.pmod("number", F.lit(n)).cast("int").alias(x) for n, x in ((sizes["blocks"], "block"), (sizes["portions"], "portion")))
    x = table.select(block, everywhere(sizes["portions"], "portion"), "vec_id", "label", *packed_row)
    y = asked.select(portion, everywhere(sizes["blocks"], "block"), "anchor_id", "label", "positives", "scores", *packed_row)
    tile = "anchor_id bigint, place int, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    found = x.groupBy("block", "portion").cogroup(y.groupBy("block", "portion")).applyInArrow(_negatives(negatives, low, high), tile)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
