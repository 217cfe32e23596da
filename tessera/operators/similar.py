"""Pairs of similar sets, and of similar sequences of code.

Both find their candidates by prefixes.  Every set's tokens are put in one order of all tokens,
in which those that a sample finds frequent come last.  Two sets that share a given part
of their tokens share one of each set's first few, whatever the order is, so only these
prefixes are shuffled and joined; the places of the shared token bound what the pair can
have in common, which drops most of what meets.  No pair is lost.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import checkpointed, small_side

SAMPLE, COMMON, PLAIN, PAIRS, MET, CELL = 16, 100_000, 1 << 16, 1 << 16, 1_000_000, 128
_SLACK = 1e-9


def _sampled(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.filter(F.pmod(F.xxhash64(*columns), F.lit(SAMPLE)) == 0)


def _frequent(sample: DataFrame, tokens: str) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that three or more rows of a sample hold, COMMON at most, and their counts.
    They give the order only."""
    counted = sample.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n")).filter("n >= 3")
    found = counted.orderBy(F.desc("n"), "token").limit(COMMON).toArrow().sort_by("token")
    return found.column("token").to_numpy(), found.column("n").to_numpy()


def with_prefix(rows: DataFrame, tokens: str, share: float, sample: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """rows (of their columns those to keep) with prefix: of the n distinct tokens (array<bigint>)
    of each row the first n - ceil(share * n) + 1 in the common order; and spread: how many
    tokens fall in each of 256 parts, a byte each (255: so many or more)."""
    import pyarrow as pa

    keep = keep or rows.columns
    known = rows.sparkSession.sparkContext.broadcast(_frequent(_sampled(rows, tokens) if sample is None else sample, tokens))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = known.value
        for batch in batches:
            column = batch.column(tokens)
            value, n = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy())
            rank = np.zeros(len(value), np.int64)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, value), len(frequent) - 1)
                rank = np.where(frequent[at] == value, counts[at], 0)
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(value)) - np.repeat(np.cumsum(n) - n, n)
            size = np.where(n > 0, n - np.ceil(share * n - _SLACK).astype(np.int64) + 1, 0)
            kept = value[np.lexsort((value, rank, row))][place < size[row]]
            offsets = np.concatenate([[0], np.cumsum(np.minimum(size, n))]).astype(np.int32)
            part = (value.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.int64)
            spread = np.minimum(np.bincount(row * 256 + part, minlength=len(n) * 256), 255).astype(np.uint8).reshape(len(n), 256)
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), pa.ListArray.from_arrays(pa.array(offsets), pa.array(kept)), pa.array([x.tobytes() for x in spread], pa.binary())], [*keep, "prefix", "spread"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(scan, f"{kinds}, prefix array<bigint>, spread binary")


def meeting(rows: DataFrame, least_common: Callable[[Column], Column], *sizes: str) -> DataFrame:
    """a, b (keys, a < b): the pairs of rows (key, n, prefix, sizes) that share a token of their
    prefixes and may have least_common(the sum of both n) tokens in common."""
    flat = rows.select("key", "n", F.posexplode("prefix").alias("place", "token"), *sizes)
    x, y = flat.alias("x"), flat.alias("y")
    rest = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    near = (F.col("x.token") == F.col("y.token")) & (F.col("x.key") < F.col("y.key")) & (least_common(F.col("x.n") + F.col("y.n")) <= rest + _SLACK)
    return x.join(y, near).select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()


def shingle_sets(rows: DataFrame, width: int = 5) -> DataFrame:
    """rows (id, text and others) with tokens (64-bit hashes, each once, ascending) for text: the
    runs of width words [a-z0-9]+ of the lower-cased text.  A text of fewer words, or null, has none."""
    import re

    import pyarrow as pa
    import xxhash

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            sets = []
            for text in batch.column("text").to_pylist():
                words = re.findall("[a-z0-9]+", (text or "").lower())
                known.update((w, xxhash.xxh64_intdigest(w)) for w in set(words) if w not in known)
                w = np.array([known[w] for w in words], dtype=np.uint64)
                h = w[: max(0, len(w) - width + 1)]
                for k in range(1, width):
                    h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + len(h)])
                sets.append(np.unique(h).view(np.int64))
                if len(known) > 1 << 20:
                    known.clear()
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*map(batch.column, others), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))], [*others, "tokens"])

    others = [c for c in rows.columns if c != "text"]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.mapInArrow(scan, f"{kinds}, tokens array<bigint>")


def _near(pairs: DataFrame, rows: DataFrame, share: float) -> DataFrame:
    """The pairs (a, b) of rows (key, n, spread) that may have share of both n in common: in
    no part more than the smaller of both counts.  Most that met by chance are left out."""
    import pyarrow as pa

    ids = small_side(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), MET)
    held = rows.select("key", "n", "spread").join(ids, "key", "left_semi")
    both = pairs.join(held.toDF("a", "na", "sa"), "a").join(held.toDF("b", "nb", "sb"), "b").select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "sa", "sb")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 256) for c in ("sa", "sb"))
            most = np.minimum(x, y)
            near = (most.sum(axis=1, dtype=np.int64) >= share * batch.column("n").to_numpy() - _SLACK) | (most == 255).any(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near))

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(scan, f"a {kind}, b {kind}")


def _scored(pairs: DataFrame, rows: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """a, b, jaccard of pairs (a, b).

    Rows that are similar to each other are few, but each may be in many pairs.  So pairs are
    dealt to cells, by the least partner of a, and a cell's sets are shuffled once for
    all its pairs.  Where a least partner has many pairs these go to several cells, each of about
    2 x CELL rows at most."""
    sides = F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))
    least = pairs.select(F.explode(sides).alias("e")).groupBy(F.col("e.id").alias("a")).agg(F.min("e.other").alias("other"))
    named = pairs.join(least.select("a", F.least("a", "other").alias("group")), "a")
    sizes = named.select("group", F.explode(F.array("a", "b")).alias("id")).distinct().groupBy("group").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("parts"))
    cells = named.join(sizes, "group").select(F.xxhash64("group", part("a"), part("b")).alias("cell"), F.explode(sides).alias("e"))
    each = cells.groupBy("cell", F.col("e.id").alias("id")).agg(F.collect_list("e.other").alias("others"))
    asked = checkpointed(each.groupBy("id").agg(F.collect_list(F.struct("cell", "others")).alias("cells")))
    asked = small_side(asked, MET) if pairs.limit(2 * MET + 1).count() <= 2 * MET else asked
    held = sets(rows.join(asked, "id")).select("id", "tokens", F.inline("cells"))  # most sets meet no other: theirs are not shuffled
    x, y = held.alias("x"), held.alias("y")
    one = (F.col("x.cell") == F.col("y.cell")) & (F.col("x.id") < F.col("y.id")) & F.array_contains("x.others", F.col("y.id")) & F.array_contains("y.others", F.col("x.id"))
    both = x.join(y.hint("merge"), one).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.size(F.array_intersect("x.tokens", "y.tokens")).alias("common"), (F.size("x.tokens") + F.size("y.tokens")).alias("sum"))
    return both.groupBy("a", "b").agg(F.max(F.col("common") / (F.col("sum") - F.col("common"))).alias("jaccard"))


def set_classes(rows: DataFrame, least: float, sets: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of equal sets (key: the smallest id, copies: their number, h1, h2), the rows'
    classes (id, h1, h2), and the pairs of classes (a, b: keys, jaccard) with a Jaccard similarity of
    least or more, exact.  sets adds tokens (array<bigint>, each once and ascending) to rows
    (id and what it reads), and keeps other columns.  Empty sets take no part.

    Sets are known by 128 bits of hash.  Whole sets are made again where they are
    needed, for the sample and for those that meet another, and neither shuffled nor
    written before: of the others only hashes, prefixes and spreads are."""
    made = lambda some: sets(some).filter(F.size("tokens") > 0)
    hashed = made(rows).select("id", "tokens", F.size("tokens").alias("n"), F.xxhash64("tokens").alias("h1"), F.xxhash64(F.lit(7), "tokens").alias("h2"))
    sample = made(_sampled(rows, *(c for c in rows.columns if c != "id"))).select("tokens").distinct()
    marks = with_prefix(hashed, "tokens", least, sample, ["id", "n", "h1", "h2"])
    marks = checkpointed(marks.withColumn("row", F.monotonically_increasing_id()))
    classes = checkpointed(marks.groupBy("h1", "h2").agg(F.min(F.struct("id", "row")).alias("first"), F.count("*").alias("copies")).select("h1", "h2", F.col("first.id").alias("key"), "first.row", "copies"))
    one = marks.join(small_side(classes.select("row"), MET), "row", "left_semi").select(F.col("id").alias("key"), "n", "prefix", "spread")
    common = least / (1 + least)
    met = checkpointed(meeting(one, lambda n: n * common))
    pairs = _scored(checkpointed(_near(met, one, common)), rows, made)
    return classes.drop("row"), marks.select("id", "h1", "h2"), pairs.filter(F.col("jaccard") >= least - _SLACK)


def jaccard_pairs(rows: DataFrame, least: float, sets: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """a, b, jaccard: pairs of rows with a Jaccard similarity of least or more, as ``set_classes``
    has them.  Equal sets are unified and come back as pairs of their smallest row with
    each other one, so that a group of copies gives rows in proportion to its size and is
    gathered nowhere."""
    classes, marks, pairs = set_classes(rows, least, sets)
    copies = marks.join(classes.filter("copies > 1"), ["h1", "h2"]).filter("id <> key")
    return pairs.unionByName(copies.select(F.col("key").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard")))


class _Windows:
    """Exact names of all windows of two sequences whose length is a power of two, by doubling."""

    def __init__(self, a: list[int], b: list[int]) -> None:
        names = np.unique(np.array([*a, *b]), return_inverse=True)[1].astype(np.int64)
        self.levels, self.b = [names], len(a)
        while 2 << len(self.levels) - 1 <= min(len(a), len(b)):
            half, last = 1 << len(self.levels) - 1, self.levels[-1]
            both = last[: len(last) - half] * (len(names) + 1) + last[half:]
            self.levels.append(np.unique(both, return_inverse=True)[1].astype(np.int64))

    def common(self, size: int, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int] | None:
        """The first place in a (then in b) of a window of that size that both ranges hold."""
        k = size.bit_length() - 1
        name, rest = self.levels[k], size - (1 << k)
        of = lambda lo, hi: name[lo : hi - size + 1] * len(self.levels[0]) + name[lo + rest : hi - size + 1 + rest]
        x, y = of(alo, ahi), of(self.b + blo, self.b + bhi)
        found = np.isin(x, y)
        if not found.any():
            return None
        i = int(found.argmax())
        return alo + i, blo + int((y == x[i]).argmax())

    def longest(self, *bounds: int) -> tuple[int, int, int]:
        low, high, at = 0, min(bounds[1] - bounds[0], bounds[3] - bounds[2]), (bounds[0], bounds[2])
        while low < high:
            middle = (low + high + 1) // 2
            if (now := self.common(middle, *bounds)) is None:
                high = middle - 1
            else:
                low, at = middle, now
        return *at, low


def block_ratio(a: list[int], b: list[int]) -> float:
    """2 x the tokens in matching blocks over all tokens: the longest block that both hold (ties:
    the first in a, then in b), then the longest ones left and right of it, and so on.  1 for
    two empty sequences.  Long sequences go through named windows, since the plain search takes
    the square of a token's repeats; the blocks are the same."""
    from difflib import SequenceMatcher

    if len(a) * len(b) <= PLAIN:
        return SequenceMatcher(None, a, b, autojunk=False).ratio()
    windows, matched, left = _Windows(a, b), 0, [(0, len(a), 0, len(b))]
    while left:
        alo, ahi, blo, bhi = left.pop()
        i, j, size = windows.longest(alo, ahi, blo, bhi)
        if size:
            matched += size
            left += [x for x in ((alo, i, blo, j), (i + size, ahi, j + size, bhi)) if x[0] < x[1] and x[2] < x[3]]
    return 2 * matched / (len(a) + len(b))


def _tokenized(batches: Iterator) -> Iterator:
    """Token hashes of text (words and signs) and ast (words: kinds of nodes, names, values), and
    both as sets: there the k-th token of a kind is a token of its own."""
    import re

    import pyarrow as pa
    import xxhash

    known: dict[str, int] = {}

    def hashes(text: str | None, pattern: str) -> list[int]:
        out = []
        for token in re.findall(pattern, text or ""):
            if token not in known:
                if len(known) > 1 << 20:
                    known.clear()
                known[token] = xxhash.xxh64_intdigest(token) - (1 << 63)
            out.append(known[token])
        return out

    def numbered(tokens: list[int]) -> list[int]:
        seen: Counter = Counter()
        out = []
        for t in tokens:
            seen[t] += 1
            out.append(xxhash.xxh64_intdigest(t.to_bytes(8, "little", signed=True), seen[t]) - (1 << 63))
        return out

    for batch in batches:
        texts = [hashes(t, r"\w+|[^\w\s]") for t in batch.column("text").to_pylist()]
        asts = [hashes(t, r"\w+") for t in batch.column("ast").to_pylist()]
        columns = [texts, asts, list(map(numbered, texts)), list(map(numbered, asts))]
        yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, pa.list_(pa.int64())) for c in columns)], ["key", "t", "s", "nt", "ns"])


def code_classes(functions: DataFrame) -> DataFrame:
    """Functions (key, text, ast) with equal tokens as one row: key (the least), copies, t, s
    (token hashes of text and ast), nt, ns (numbered ones), n (those of ns)."""
    kind = functions.schema["key"].dataType.simpleString()
    rows = functions.select("key", "text", "ast").mapInArrow(_tokenized, f"key {kind}, t array<bigint>, s array<bigint>, nt array<bigint>, ns array<bigint>")
    rows = rows.filter("size(s) > 0").select("*", F.xxhash64("t", "s").alias("h1"), F.xxhash64(F.lit(7), "t", "s").alias("h2"))
    return checkpointed(rows.groupBy("h1", "h2").agg(F.min("key").alias("key"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("t", "s", "nt", "ns"))).withColumn("n", F.size("ns")))


def code_class_pairs(classes: DataFrame, least: float = 0.8, text_weight: float = 0.4) -> DataFrame:
    """a, b, text_ratio, ast_ratio, similarity: the pairs of classes (see code_classes) whose
    weighted block ratios are least or more.

    A ratio is never more than the share of common tokens, counted with their repeats, and
    a text's is 1 at most, so the trees of such a pair share at least
    (least - text_weight) / (1 - text_weight) of their tokens: the prefixes are of that bound.
    What meets is bounded again with both shares before the blocks are sought."""
    import pyarrow as pa

    share = (least - text_weight) / (1 - text_weight)
    if share <= 0:
        raise ValueError("with this weight of the text trees may differ wholly: no candidate can be left out")
    kind = classes.schema["key"].dataType.simpleString()
    held = checkpointed(with_prefix(classes.select("key", "n", "t", "s", "nt", "ns"), "ns", share / (2 - share)).drop("spread"))
    pairs = checkpointed(meeting(held.select("key", "n", "prefix"), lambda n: n * (share / 2)))
    parts = max(held.sparkSession.sparkContext.defaultParallelism, -(-pairs.count() // PAIRS))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, ta, tb, sa, sb, most in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "t_a", "t_b", "s_a", "s_b", "most_text")), strict=True):
                trees = block_ratio(sa, sb)
                if text_weight * most + (1 - text_weight) * trees >= least - _SLACK:
                    text = block_ratio(ta, tb)
                    if (both := text_weight * text + (1 - text_weight) * trees) >= least - _SLACK:
                        out.append((a, b, text, trees, both))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, batch.schema.field("a").type if i < 2 else pa.float64()) for i, c in enumerate(columns)], ["a", "b", "text_ratio", "ast_ratio", "similarity"])

    sides = [held.select(F.col("key").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("t", "s", "nt", "ns"))) for x in "ab"]
    shared = lambda c: 2 * F.size(F.array_intersect(f"{c}_a", f"{c}_b")) / F.greatest(F.size(f"{c}_a") + F.size(f"{c}_b"), F.lit(1))
    both = pairs.join(sides[0], "a").join(sides[1], "b").withColumns({"most_text": F.when((F.size("nt_a") == 0) & (F.size("nt_b") == 0), 1.0).otherwise(shared("nt")), "most_trees": shared("ns")})
    near = both.filter(text_weight * F.col("most_text") + (1 - text_weight) * F.col("most_trees") >= least - _SLACK)
    near = near.select("a", "b", "t_a", "t_b", "s_a", "s_b", "most_text").repartition(parts, "a", "b")
    return near.mapInArrow(scan, f"a {kind}, b {kind}, text_ratio double, ast_ratio double, similarity double")


def code_repetition(functions: DataFrame, least: float = 0.8) -> DataFrame:
    """functions, pairs, similar, percent: how many of all pairs of functions (key, text, ast)
    are similar; pairs are counted by the sizes of their classes and never made."""
    classes = code_classes(functions)
    sizes = classes.select("key", "copies")
    found = code_class_pairs(classes, least).select("a", "b").join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    between = found.agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("between"))
    inside = sizes.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("functions"), F.coalesce(F.sum(F.expr("copies * (copies - 1) div 2")), F.lit(0)).alias("inside"))
    both = inside.join(F.broadcast(between))
    pairs, similar = F.expr("functions * (functions - 1) div 2"), F.col("between") + F.col("inside")
    return both.select("functions", pairs.alias("pairs"), similar.alias("similar"), F.round(100 * similar / F.greatest(pairs, F.lit(1)), 2).alias("percent"))
