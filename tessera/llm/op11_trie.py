"""Operator 11: the trie of the prefixes of all conversations.

Method: splitter-skeleton.  A conversation is the sequence of its turns, each known by 128 bits
of SHA-256.  Sampled conversations split the sorted order of (sequence, conv_id) into shards; the
trie of the splitters' paths, the skeleton, is broadcast.  A node whose members stand in two
shards is a prefix of the splitter between them, so every other node lies within one shard:
the sorted shards finish those in one pass, with a stack of open nodes.  For skeleton nodes each
shard sends partial aggregates, which are reduced by node and then summed up the skeleton.

Bounds: at most ``SHARDS`` splitters of ``SPAN`` turns make the skeleton, which the driver
holds.  A longer conversation is cut into segments of SPAN turns; segments of one level whose
earlier turns agree have one root (a hash of those turns), so each level is a set of tries like
any other, worked off from the last level to the first, one round for each SPAN turns of the
longest conversation.  What a node of the last depth of a level takes from the next is joined to
its rows by that hash.  Turns are numbered along sorted blocks, and copies of one conversation
are split by conv_id, so neither a long conversation nor a much repeated one meets in one
task.  A SHA-256 is one chain by its nature: the ids that end at a skeleton node are hashed by one
task, in pieces, with constant memory.

Defined results: rows without a conv_id take no part; null turns come first; turns of one
number stand in the order of role, then of a hash of the text; null roles and texts are
empty; repeated rows are turns of their own; an empty table gives an empty result, without a
root; texts of any length count by their bytes.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import places
from .checkpoints import checkpointed

SPAN, SHARDS, SHARD_ROWS, OVERSAMPLE, PIECE = 256, 1024, 4096, 8, 1 << 16
ID = 16
ROOT = bytes(ID)
EMPTY = hashlib.sha256().hexdigest()

_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_FOUND = pa.schema(
    [("kind", pa.int32()), ("sid", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int32()), ("parent_conv_id", pa.int64()), ("parent_sid", pa.int32())]
    + [(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved", "size")]
    + [("ends", pa.string()), ("root", pa.binary()), ("shard", pa.int32()), ("number", pa.int32())]
    + [(c, pa.int64()) for c in ("b_children", "b_leaves", "b_saved")]
)
_FOUND_SQL = "kind int, sid int, conv_id bigint, depth int, parent_conv_id bigint, parent_sid int, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, size bigint, ends string, root binary, shard int, number int, b_children bigint, b_leaves bigint, b_saved bigint"
NODE, PART, PIECE_OF_ENDS = 0, 1, 2


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), id (of role and text), bytes (of the text) of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    light = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), F.unhex(F.substring(F.sha2(whole, 256), 1, 2 * ID)).alias("id"), F.octet_length(text).cast("bigint").alias("bytes"))
    return checkpointed(places(light, ["conv_id"], ["turn", "role", "id"]).select("conv_id", "place", "id", "bytes"))


def rebuilt(turns: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns in which conversation c begins with the first h turns of conversation c - c % group
    and goes on with its own turns after its first h, h = crc32(c in decimal) % heads; and the
    conv_id of every conversation, with turns or without."""
    least = F.col("conv_id") - F.col("conv_id") % group
    head = turns.filter((F.col("place") < heads) & (F.col("conv_id") == least)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "id", "bytes"))).alias("head"))
    convs = turns.groupBy("conv_id").agg(least.alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int").alias("h"))
    some = F.when(F.col("h") > 0, F.slice(F.coalesce("head", F.array()), 1, F.greatest("h", F.lit(1)))).otherwise(F.array())
    convs = checkpointed(convs.join(head, "base", "left").select("conv_id", "h", some.alias("head")))
    own = turns.join(convs.select("conv_id", "h", F.size("head").alias("m")).hint("merge"), "conv_id").filter(F.col("place") > F.col("h"))
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("m")).alias("place"), "id", "bytes")
    taken = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.place", "t.id", "t.bytes")
    return taken.unionByName(own), convs.select("conv_id")


def segments(turns: DataFrame, members: DataFrame) -> DataFrame:
    """conv_id, level, ids (of up to SPAN turns, joined), sizes: every conversation in
    segments of SPAN turns; the last has fewer, or none."""
    turn = F.struct("place", "id", "bytes")
    level = lambda place: F.floor(place / F.lit(SPAN)).cast("int").alias("level")
    held = turns.select("conv_id", level(F.col("place") - 1), turn.alias("t"))
    nothing = F.lit(None).cast(held.schema["t"].dataType).alias("t")
    further = turns.filter(F.col("place") % SPAN == 0).select("conv_id", level(F.col("place")), nothing)
    first = members.select("conv_id", F.lit(0).alias("level"), nothing)
    grouped = held.union(further).union(first).groupBy("conv_id", "level").agg(F.sort_array(F.collect_list("t")).alias("t"))
    ids = F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["id"])), ""))
    return grouped.select("conv_id", "level", ids.alias("ids"), F.transform("t", lambda x: x["bytes"]).alias("sizes"))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, level and hash of its segments) to (conv_id, level, root, next): the hash of
    the turns before a segment, and of those up to its end if the conversation goes on."""
    for batch in batches:
        out = []
        for conv, parts in zip(batch.column("conv_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            root = ROOT
            for i, part in enumerate(parts):
                next_ = hashlib.sha256(root + part["hash"]).digest()[:ID] if i + 1 < len(parts) else None
                out.append((conv, part["level"], root, next_))
                root = next_
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], ["conv_id", "level", "root", "next"])


class Open:
    """A node on the stack: its local aggregates so far."""

    __slots__ = ("sid", "conv", "n", "children", "leaves", "saved", "size", "ends", "ended", "below", "waiting", "number")

    def __init__(self, sid: int | None, size: int) -> None:
        self.sid, self.size = sid, size
        self.conv: int | None = None
        self.n = self.children = self.leaves = self.saved = self.number = 0
        self.ends, self.ended, self.below = None, False, None
        self.waiting: list[tuple] = []


def _scan(skeleton, level: int):
    """Rows (shard, path, conv_id, sizes, goes on, and what lies below), sorted, to nodes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out = skeleton.value, []
        stack: list[Open] = []
        tokens: list[bytes] = []
        shard = None

        def piece(node: Open) -> None:
            out.append((PIECE_OF_ENDS, node.sid, None, None, None, None, None, None, None, None, None, ",".join(node.ends), None, shard, node.number, None, None, None))
            node.number, node.ends = node.number + 1, []

        def close() -> None:
            node, up = stack.pop(), stack[-1] if stack else None
            depth = level * SPAN + len(stack) - 1
            root = tokens[0] if len(stack) == 1 else None
            children, leaves, saved, ends = node.below or (0, 0, 0, None)
            if node.sid is not None:  # other shards may hold members too
                if node.ends:
                    piece(node)
                if up is not None:
                    out.append((PART, node.sid, node.conv, depth, None, up.sid, node.n, node.children, node.leaves, node.saved, node.size, ends, root, None, None, children, leaves, saved))
            else:
                children, saved = node.children + children, node.saved + saved + (node.n - 1) * node.size
                leaves = node.leaves + leaves if children else 1
                ends = node.ends.hexdigest() if node.ended else ends or EMPTY
                out.extend((*row[:4], node.conv, *row[5:]) for row in node.waiting)
                row = (NODE, None, node.conv, depth, None, up.sid, node.n, children, leaves, saved, None, ends, root, None, None, None, None, None)
                up.waiting.append(row) if up.sid is None else out.append(row)
                up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
            if up is not None:
                up.n += node.n
                up.conv = node.conv if up.conv is None else min(up.conv, node.conv)

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * len(_FOUND)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)

        for batch in batches:
            named = [batch.column(c).to_pylist() for c in ("shard", "path", "conv_id", "sizes", "goes_on", "b_children", "b_leaves", "b_saved", "b_ends")]
            for of, path, conv, sizes, goes_on, *below in zip(*named, strict=True):
                now = [path[i : i + ID] for i in range(0, len(path), ID)]
                if of != shard:
                    while stack:
                        close()
                    shard, tokens, stack = of, [], [Open(0, 0)]
                same = 0
                while same < min(len(now), len(tokens)) and now[same] == tokens[same]:
                    same += 1
                while len(stack) > same + 1:
                    close()
                tokens = now
                for i in range(same, len(now)):
                    up = stack[-1].sid
                    stack.append(Open(known.get((up, now[i])) if up is not None else None, sizes[i - 1] if i else 0))
                node = stack[-1]
                node.n += 1
                node.conv = conv if node.conv is None else min(node.conv, conv)
                if goes_on:
                    node.below = tuple(below)
                elif node.sid is None:
                    node.ends = node.ends or hashlib.sha256()
                    node.ends.update((b"," if node.ended else b"") + str(conv).encode())
                    node.ended = True
                else:
                    node.ends = [] if node.ends is None else node.ends
                    node.ends.append(str(conv))
                    if len(node.ends) * 20 >= PIECE:
                        piece(node)
                if len(out) >= 4096:
                    yield made()
        while stack:
            close()
        yield made()

    return scan


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by node, shard and number to the hash of each node's."""
    sid, chain, done = None, None, []
    for batch in batches:
        for node, text in zip(batch.column("sid").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if node != sid:
                done += [(sid, chain.hexdigest())] if chain else []
                sid, chain = node, hashlib.sha256(text.encode())
            else:
                chain.update(b"," + text.encode())
    done += [(sid, chain.hexdigest())] if chain else []
    yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.string())], ["sid", "ends"])


def _level_nodes(rows: DataFrame, level: int) -> DataFrame:
    """The nodes of one level from rows (path, conv_id, sizes, goes_on, b_*): the columns of
    _NODE and root, which holds a value in the rows of depth level * SPAN."""
    spark = rows.sparkSession
    count = rows.count()
    shards = max(1, min(SHARDS, -(-count // SHARD_ROWS)))
    sample = sorted((bytes(r.path), r.conv_id) for r in rows.select("path", "conv_id").orderBy(F.xxhash64("conv_id"), "conv_id").limit(OVERSAMPLE * shards).collect())
    splitters = sorted({sample[i * len(sample) // shards] for i in range(1, shards)})
    trie: dict[tuple[int, bytes], int] = {}
    above = [0]
    for path, _ in splitters:
        at = 0
        for i in range(0, len(path), ID):
            step = (at, path[i : i + ID])
            if step not in trie:
                trie[step] = len(above)
                above.append(at)
            at = trie[step]
    split, skeleton = spark.sparkContext.broadcast(splitters), spark.sparkContext.broadcast(trie)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)
            yield batch.append_column("shard", pa.array([bisect_right(split.value, key) for key in keys], pa.int32()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.mapInArrow(deal, f"{kinds}, shard int").repartition("shard").sortWithinPartitions("shard", "path", "conv_id")
    found = checkpointed(dealt.mapInArrow(_scan(skeleton, level), _FOUND_SQL))
    summed = [(F.sum(c) + F.max(b)).alias(n) for c, b, n in (("n_children", "b_children", "children"), ("n_leaves", "b_leaves", "leaves"), ("saved", "b_saved", "saved"))]
    same = [F.max(c).alias(c) for c in ("size", "ends", "root")]  # in all shards; what lies below a node too
    parts = found.filter(F.col("kind") == PART).groupBy("sid").agg(F.min("conv_id").alias("conv_id"), F.max("depth").cast("bigint").alias("depth"), F.sum("n_convs").alias("n"), *summed, *same)
    pieces = found.filter(F.col("kind") == PIECE_OF_ENDS).select("sid", "shard", "number", "ends").repartition("sid").sortWithinPartitions("sid", "shard", "number")
    ends = {r.sid: r.ends for r in pieces.mapInArrow(_hash_pieces, "sid int, ends string").collect()}
    held = {r.sid: r for r in parts.collect()}  # as many as the skeleton has nodes
    children, leaves, saved = ({s: r[c] for s, r in held.items()} for c in ("children", "leaves", "saved"))
    done = []
    for sid in sorted(held, reverse=True):  # a node's number is greater than its parent's
        r, up = held[sid], above[sid]
        saved[sid] += (r.n - 1) * r.size
        leaves[sid] = leaves[sid] if children[sid] else 1
        done.append((r.conv_id, r.depth, held[up].conv_id if up else None, r.n, children[sid], leaves[sid], saved[sid], ends.get(sid) or r.ends or EMPTY, r.root))
        if up:
            children[up], leaves[up], saved[up] = children[up] + 1, leaves[up] + leaves[sid], saved[up] + saved[sid]
    names = F.broadcast(spark.createDataFrame([(s, r.conv_id) for s, r in held.items()] or [(-1, None)], "parent_sid int, above bigint"))
    local = found.filter(F.col("kind") == NODE).join(names, "parent_sid", "left")
    local = local.select("conv_id", F.col("depth").cast("bigint").alias("depth"), F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"), "root")
    return local.unionByName(spark.createDataFrame(done, f"{_NODE}, root binary"))


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """Every node of the trie of conversations: conv_id (its least member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, place, id, bytes, with places from 1 without gaps; members: conv_id of every
    conversation, once.  A turn of a node is that of its conv_id at place depth."""
    spark = turns.sparkSession
    parts = checkpointed(segments(turns, members))
    last = parts.agg(F.max("level")).first()[0]
    if last is None:
        return spark.createDataFrame([], _NODE)
    goes_on = F.size("sizes") == SPAN
    if last:
        long = parts.filter((F.col("level") > 0) | goes_on).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("level", F.unhex(F.substring(F.sha2("ids", 256), 1, 2 * ID)).alias("hash")))).alias("parts"))
        chain = checkpointed(long.mapInArrow(_chain, "conv_id bigint, level int, root binary, next binary"))
        parts = parts.join(chain.hint("merge"), ["conv_id", "level"], "left").withColumn("root", F.coalesce("root", F.lit(ROOT)))
        parts = checkpointed(parts)
    else:
        parts = parts.withColumns({"root": F.lit(ROOT), "next": F.lit(None).cast("binary")})
    nodes, below = None, spark.createDataFrame([], "next binary, b_children bigint, b_leaves bigint, b_saved bigint, b_ends string")
    for level in range(last, -1, -1):
        rows = parts.filter(F.col("level") == level).select(F.concat("root", "ids").alias("path"), "conv_id", "sizes", goes_on.alias("goes_on"), "next")
        found = checkpointed(_level_nodes(rows.join(below, "next", "left").drop("next"), level))
        own = found if level == 0 else found.filter(F.col("depth") > level * SPAN)
        nodes = own.drop("root") if nodes is None else nodes.unionByName(own.drop("root"))
        if level:
            first = found.filter(F.col("depth") == level * SPAN)
            below = first.select(F.col("root").alias("next"), F.col("n_children").alias("b_children"), F.when(F.col("n_children") > 0, F.col("n_leaves")).otherwise(0).alias("b_leaves"), F.col("saved_tokens").alias("b_saved"), F.col("ends_sha256").alias("b_ends"))
    return nodes


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


ORACLE = """
WITH RECURSIVE t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS turn
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list(turn ORDER BY place) AS own,
    xor(4294967295, list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 9 AS h
  FROM t GROUP BY conv_id),
b AS (
  SELECT c.conv_id, list_slice(coalesce(o.own, []), 1, c.h) || list_slice(c.own, c.h + 1, len(c.own)) AS path FROM c LEFT JOIN c o ON o.conv_id = c.conv_id - c.conv_id % 5),
p AS (SELECT conv_id, len(path) AS n, path, unnest(range(0, len(path) + 1)) AS depth FROM b),
m AS (SELECT list_slice(path, 1, depth) AS node, depth, conv_id, n FROM p),
v AS (
  SELECT node, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN n = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM m GROUP BY node),
k AS (SELECT list_slice(node, 1, depth - 1) AS node, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY 1),
w AS (SELECT v.*, coalesce(n_children, 0) AS n_children, CASE WHEN v.depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(v.node[v.depth].t) END AS saved FROM v LEFT JOIN k USING (node)),
u AS (SELECT list_slice(node, 1, a) AS node, saved, CAST(n_children = 0 AS BIGINT) AS leaf FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM w)),
s AS (SELECT node, sum(saved) AS saved_tokens, sum(leaf) AS n_leaves FROM u GROUP BY node)
SELECT w.conv_id, w.depth, a.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN s USING (node) LEFT JOIN v a ON w.depth > 0 AND a.node = list_slice(w.node, 1, w.depth - 1)
"""
