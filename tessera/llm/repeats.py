"""Windows of tokens that also stand earlier in a corpus, found by shuffled hashes.

The documents are dealt to *blocks* (by a hash of doc_id, about ``BLOCK_BYTES`` of text
each) in one exchange, which all three passes over the texts read again:

1. Each block hashes every window and winnows the windows into runs (see ``rolling``).
   Equal runs within the block are unified; a run's (key, span) hashes and its smallest
   doc_id go to the *bucket* of its key.  A bucket tells the blocks which of their runs
   stand earlier elsewhere, and which share a key with runs of another span.
2. Runs of the latter sort can overlap in part: each bucket of *their* windows (or of
   their texts, see ``suffix_dedup``) finds which windows stand earlier elsewhere.
3. Each block marks its repeated windows and cuts the tokens which they cover.

What a key in very many documents sends is bounded by the number of blocks: a block
sends at most ``FEW`` spans of a key to its bucket.  A key with more of them in a block,
or more than ``MANY`` in all, is hot; the windows of its runs are dealt by their own
hashes, which spreads them.  Nothing is dropped, and no group of rows meets in one task
but the (bounded) runs of a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rolling
from .arrays import flat, lists, new_groups, sections, within

BLOCK_BYTES = 2 << 20
BUCKET_RUNS = 400_000
CHUNK_TOKENS = 1 << 16
FEW, MANY = 8, 2000

_RUNS = "bucket int, block int, key array<int>, span array<bigint>, doc array<bigint>"
_PARTS = "bucket int, block int, kind int, hash array<bigint>, doc array<bigint>, many array<int>, text binary"
_INFO = "bucket int, block int, phase int, x array<int>, y array<int>, z array<int>"
_RUNS_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("key", pa.list_(pa.int32())), ("span", pa.list_(pa.int64())), ("doc", pa.list_(pa.int64()))])
_PARTS_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("hash", pa.list_(pa.int64())), ("doc", pa.list_(pa.int64())), ("many", pa.list_(pa.int32())), ("text", pa.binary())])
_INFO_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("phase", pa.int32()), ("x", pa.list_(pa.int32())), ("y", pa.list_(pa.int32())), ("z", pa.list_(pa.int32()))])
DUP, PART, HOT = 1, 2, 4


@dataclass(frozen=True)
class Spec:
    """width: tokens of a window; gram: tokens of a run's key; within_doc: whether an
    earlier place in the same document counts; texts: whether runs that may overlap in
    part send their bytes (for a suffix sort) rather than the hashes of their windows;
    tokenize: joins texts, giving (tokens uint64, ends, source), source for ``cut``;
    cut: (source, number of the document in source, its first token and end, mask of its
    removed tokens) to the document's result columns; block_bytes: of text in a block."""

    width: int
    gram: int
    within_doc: bool
    texts: bool
    tokenize: Callable
    cut: Callable
    columns: tuple = ()
    buckets: int = 1
    block_bytes: int = 0


@dataclass
class Block:
    """The runs of a block, unified to classes, in an order that only the texts decide."""

    docs: np.ndarray  # doc_id of each document, sorted
    order: np.ndarray  # their rows in the table
    chunks: list = field(default_factory=list)  # (first document, tokens, ends, source, sums)
    chunk: np.ndarray | None = None  # for each run, sorted by (bucket, key, span, doc, place)
    doc: np.ndarray | None = None
    lo: np.ndarray | None = None
    hi: np.ndarray | None = None
    at: np.ndarray | None = None
    place: np.ndarray | None = None  # lo in the run's document
    key: np.ndarray | None = None
    span: np.ndarray | None = None
    bucket: np.ndarray | None = None
    of: np.ndarray | None = None  # the class of each run
    first: np.ndarray | None = None  # the first run of each class
    sent: np.ndarray | None = None  # classes sent to buckets, in order
    local_hot: np.ndarray | None = None  # of each class: its key is hot here


def read_block(spec: Spec, table: pa.Table) -> tuple[Block, list]:
    ids = table.column("doc_id").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(ids, kind="stable")
    texts = table.column("text").take(pa.array(order)).to_pylist()
    block, parts, begin = Block(ids[order], order), [], 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end] or "") <= CHUNK_TOKENS * 2):
            size += len(texts[end] or "")
            end += 1
        tokens, ends, source = spec.tokenize(texts[begin:end])
        found = rolling.runs(tokens, ends, spec.width, spec.gram)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        parts.append((np.full(len(found["lo"]), len(block.chunks), np.int32), found["doc"] + begin, found["lo"], found["hi"], found["at"], found["lo"] - starts[found["doc"]], found["key"], found["span"]))
        block.chunks.append((begin, tokens, ends, source, found["sums"]))
        begin = end
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 6 + [np.zeros(0, np.uint64)] * 2
    chunk, doc, lo, hi, at, place, key, span = columns
    bucket = (key % np.uint64(spec.buckets)).astype(np.int32)
    small = (key >> np.uint64(32)).astype(np.uint32).view(np.int32)
    value = block.docs[doc] if len(doc) else np.zeros(0, np.int64)
    order = np.lexsort((place, value, span, small, bucket))
    block.chunk, block.doc, block.lo, block.hi, block.at, block.place = (c[order] for c in (chunk, doc, lo, hi, at, place))
    block.key, block.span, block.bucket = small[order], span[order], bucket[order]
    begins = new_groups(block.bucket, block.key, block.span)
    block.of, block.first = np.cumsum(begins) - 1, np.flatnonzero(begins)
    k = new_groups(block.bucket[block.first], block.key[block.first])
    many = np.bincount(np.cumsum(k) - 1) if len(k) else np.zeros(0, np.int64)
    block.local_hot = (many > FEW)[np.cumsum(k) - 1] if len(k) else np.zeros(0, bool)
    block.sent = np.flatnonzero(~block.local_hot | k)
    return block, texts


def send_runs(spec: Spec, number: int, block: Block) -> pa.Table:
    """One row for each bucket; of a key that is hot here goes one row, marked by doc null
    (the smallest long), which is later than none."""
    runs = block.first[block.sent]
    counts = np.bincount(block.bucket[runs], minlength=1) if len(runs) else np.zeros(0, np.int64)
    used = np.flatnonzero(counts)
    doc = np.where(block.local_hot[block.sent], np.iinfo(np.int64).min, block.docs[block.doc[runs]] if len(runs) else 0)
    counts = counts[used]
    return pa.table([pa.array(used.astype(np.int32)), pa.array(np.full(len(used), number, np.int32)), lists(block.key[runs], counts, pa.int32()), lists(block.span[runs], counts, pa.int64()), lists(doc, counts, pa.int64())], schema=_RUNS_ARROW)


def _answer(table: pa.Table, phase: int, row: np.ndarray, *columns: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    """Rows of _INFO for the senders that get an answer; columns: (which values, what)."""
    n = table.num_rows
    made = []
    for mask, what in columns:
        made.append((what[mask], np.bincount(row[mask], minlength=n)))
    made += [(np.zeros(0, np.int32), np.zeros(n, np.int64))] * (3 - len(made))
    full = pa.table([table.column("bucket"), table.column("block"), pa.array(np.full(n, phase, np.int32)), *(lists(v.astype(np.int32), c, pa.int32()) for v, c in made)], schema=_INFO_ARROW)
    return full.filter(pa.array(sum(c for _, c in made) > 0))


def meet_runs(table: pa.Table) -> pa.Table:
    """For one bucket: which runs stand earlier elsewhere (x), may overlap with others in
    part (y), or have a hot key (z), by their places in what was sent."""
    key, counts = flat(table.column("key"))
    span, doc = flat(table.column("span"))[0], flat(table.column("doc"))[0]
    row, place = sections(counts), within(counts)
    order = np.lexsort((doc, span, key))
    k, s, d = key[order], span[order], doc[order]
    none = np.iinfo(np.int64).min
    # A marked key's row says nothing of its own span: take it out of the spans' minima.
    marked = d == none
    of_span = np.cumsum(new_groups(k, s)) - 1
    least = np.full(of_span[-1] + 1 if len(k) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, of_span[~marked], d[~marked])
    of_key = np.cumsum(new_groups(k)) - 1
    spans_of = np.bincount(of_key, weights=new_groups(k, s)) if len(k) else np.zeros(0)
    hot_key = np.bincount(of_key, weights=marked) > 0 if len(k) else np.zeros(0, bool)
    hot_key |= spans_of > MANY
    later = ~marked & (d > least[of_span])
    hot = ~later & ~marked & hot_key[of_key]
    part = ~later & ~marked & ~hot & (spans_of[of_key] > 1)
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    return _answer(table, 1, row, *((m[back], place) for m in (later, part, hot)))


def classes(block: Block, info: pa.Table) -> np.ndarray:
    """What phase 1 says of each class: DUP, PART, HOT or nothing."""
    state = np.zeros(len(block.first), dtype=np.int8)
    state[block.local_hot] = HOT
    if not info.num_rows:
        return state
    at = block.bucket[block.first[block.sent]]
    begin = np.searchsorted(at, info.column("bucket").to_numpy())
    for name, value in (("x", DUP), ("y", PART), ("z", HOT)):
        places, counts = flat(info.column(name))
        state[block.sent[np.repeat(begin, counts) + places]] = value
    return state


def windows_of(spec: Spec, block: Block, chosen: np.ndarray) -> dict[str, np.ndarray]:
    """Every window of the chosen runs (numbers), with its hash."""
    counts = (block.hi[chosen] - block.lo[chosen] + 1).astype(np.int64)
    run = np.repeat(chosen, counts)
    step = within(counts)
    start = block.lo[run] + step
    hashes = np.zeros(len(run), dtype=np.uint64)
    for number in np.unique(block.chunk[chosen]):
        here = block.chunk[run] == number
        hashes[here] = rolling.spans(block.chunks[number][4], start[here], start[here] + spec.width)
    return {"run": run, "step": step, "hash": hashes, "key": block.key[run], "doc": block.docs[block.doc[run]] if len(run) else hashes.view(np.int64), "place": block.place[run] + step}


def hot_windows(spec: Spec, block: Block, state: np.ndarray) -> dict[str, np.ndarray]:
    """The windows to be dealt by their hashes, sorted by (bucket, hash, key, doc, place);
    hash and key together (96 bits) stand for the window."""
    wanted = HOT if spec.texts else HOT | PART
    w = windows_of(spec, block, block.first[(state & wanted) > 0])
    bucket = (w["hash"] % np.uint64(spec.buckets)).astype(np.int32)
    order = np.lexsort((w["place"], w["doc"], w["key"], w["hash"], bucket))
    w = {k: v[order] for k, v in w.items()} | {"bucket": bucket[order]}
    begins = new_groups(w["hash"], w["key"]) if len(order) else np.zeros(0, bool)
    return w | {"of": np.cumsum(begins) - 1, "first": np.flatnonzero(begins)}


def part_texts(spec: Spec, block: Block, state: np.ndarray) -> np.ndarray:
    """The runs whose texts are sent, in order of (bucket, key, span)."""
    return block.first[(state & PART) > 0] if spec.texts else np.zeros(0, np.int64)


def send_parts(spec: Spec, number: int, block: Block, state: np.ndarray) -> Iterator[pa.Table]:
    w = hot_windows(spec, block, state)
    if len(w["first"]):
        at = w["bucket"][w["first"]]
        counts = np.bincount(at)
        used = np.flatnonzero(counts)
        yield pa.table([pa.array(used.astype(np.int32)), pa.array(np.full(len(used), number, np.int32)), pa.array(np.zeros(len(used), np.int32)), lists(w["hash"][w["first"]], counts[used], pa.int64()), lists(w["doc"][w["first"]], counts[used], pa.int64()), lists(w["key"][w["first"]], counts[used], pa.int32()), pa.nulls(len(used), pa.binary())], schema=_PARTS_ARROW)
    runs = part_texts(spec, block, state)
    if len(runs):
        counts = np.bincount(block.bucket[runs])
        used = np.flatnonzero(counts)
        group = block.key[runs].astype(np.int64) * spec.width + (block.at[runs] - block.lo[runs])
        texts = [bytes(memoryview(block.chunks[block.chunk[r]][3])[block.lo[r] : block.hi[r] + spec.width]) for r in runs]
        stops = np.cumsum(counts[used])
        blobs = [b"".join(texts[e - c : e]) for e, c in zip(stops, counts[used], strict=True)]
        # hash: the key and the place of its gram in the text; many: windows of the text.
        yield pa.table([pa.array(used.astype(np.int32)), pa.array(np.full(len(used), number, np.int32)), pa.array(np.ones(len(used), np.int32)), lists(group, counts[used], pa.int64()), lists(block.docs[block.doc[runs]], counts[used], pa.int64()), lists((block.hi[runs] - block.lo[runs] + 1).astype(np.int32), counts[used], pa.int32()), pa.array(blobs, pa.binary())], schema=_PARTS_ARROW)


def meet_windows(table: pa.Table) -> pa.Table:
    """For one bucket of windows: which stand in a smaller document (x)."""
    value, counts = flat(table.column("hash"))
    doc, key = flat(table.column("doc"))[0], flat(table.column("many"))[0]
    row, place = sections(counts), within(counts)
    order = np.lexsort((doc, key, value))
    d = doc[order]
    begins = new_groups(value[order], key[order])
    later = d > d[np.flatnonzero(begins)][np.cumsum(begins) - 1]
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    return _answer(table, 2, row, (later[back], place))


def covered(spec: Spec, block: Block, info: pa.Table) -> list[np.ndarray]:
    """For each chunk, the mask of its tokens that repeated windows cover."""
    phase = info.column("phase").to_numpy()
    state = classes(block, info.filter(pa.array(phase == 1)))
    edges = [np.zeros(len(tokens) + 1, dtype=np.int32) for _, tokens, *_ in block.chunks]

    def cover(chunk: np.ndarray, lo: np.ndarray, stop: np.ndarray) -> None:
        for number in np.unique(chunk):
            here = chunk == number
            np.add.at(edges[number], lo[here], 1)
            np.add.at(edges[number], stop[here], -1)

    if len(block.first):
        lead = block.first[block.of]
        value = block.docs[block.doc]
        later = value > value[lead]
        if spec.within_doc:
            later |= (value == value[lead]) & (block.place > block.place[lead])
        later |= state[block.of] == DUP
        cover(block.chunk[later], block.lo[later], block.hi[later] + spec.width)
        # Windows found one by one: (lead run, step), valid for the runs of its class in its document.
        lead_run, step = [], []
        w = hot_windows(spec, block, state)
        if len(w["first"]):
            again = w["doc"] > w["doc"][w["first"]][w["of"]]
            if spec.within_doc:
                again |= (w["doc"] == w["doc"][w["first"]][w["of"]]) & (w["place"] > w["place"][w["first"]][w["of"]])
            two = info.filter(pa.array(phase == 2))
            places, counts = flat(two.column("x"))
            begin = np.searchsorted(w["bucket"][w["first"]], two.column("bucket").to_numpy())
            told = np.zeros(len(w["first"]), dtype=bool)
            told[np.repeat(begin, counts) + places] = True
            again |= told[w["of"]]
            lead_run.append(w["run"][again])
            step.append(w["step"][again])
        runs = part_texts(spec, block, state)
        if len(runs):
            three = info.filter(pa.array(phase == 3))
            places, counts = flat(three.column("x"))
            begin = np.searchsorted(block.bucket[runs], three.column("bucket").to_numpy())
            lead_run.append(runs[np.repeat(begin, counts) + places])
            step.append(flat(three.column("y"))[0])
        if lead_run and len(run := np.concatenate(lead_run)):
            step = np.concatenate(step)
            cover(block.chunk[run], block.lo[run] + step, block.lo[run] + step + spec.width)
            if not spec.within_doc:  # the same run again in its document: the same windows
                twins = np.flatnonzero(~later & (lead != np.arange(len(lead))))
                if len(twins):
                    order = np.argsort(run, kind="stable")
                    left = np.searchsorted(run[order], lead[twins])
                    counts = np.searchsorted(run[order], lead[twins], side="right") - left
                    twin = np.repeat(twins, counts)
                    theirs = step[order][np.repeat(left, counts) + within(counts)]
                    cover(block.chunk[twin], block.lo[twin] + theirs, block.lo[twin] + theirs + spec.width)
    return [np.cumsum(e[:-1]) > 0 for e in edges]


def remove_repeats(docs: DataFrame, spec: Spec, meet_parts: Callable | None = None, carry: tuple = ()) -> DataFrame:
    """doc_id, spec.columns (name, SQL type, Arrow type) and the columns named in carry,
    for each row of docs.  meet_parts answers buckets of texts.  Rows without a doc_id take
    no part: their texts are neither cut nor matched."""
    size = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(size / (spec.block_bytes or BLOCK_BYTES)))
    density = spec.width - spec.gram + 2
    buckets = max(1, math.ceil(2 * size / (density if spec.texts else 6 * density) / BUCKET_RUNS))
    spec = Spec(**{**spec.__dict__, "buckets": max(buckets, 4)})
    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")]
    extra = F.struct(*(F.col(f"`{c}`") for c in carry)).alias("extra")
    dealt = docs.filter(F.col("doc_id").isNotNull()).select(*columns, *[extra] * bool(carry))

    def number(key: tuple) -> int:
        return key[0].as_py()

    def one(key: tuple, table: pa.Table) -> pa.Table:
        return send_runs(spec, number(key), read_block(spec, table)[0])

    def two(key: tuple, table: pa.Table, info: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _PARTS_ARROW.empty_table()
        block, _ = read_block(spec, table)
        made = list(send_parts(spec, number(key), block, classes(block, info)))
        return pa.concat_tables(made) if made else _PARTS_ARROW.empty_table()

    def meet_both(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        made = [f(table.filter(pa.array(kinds == k))) for k, f in ((0, meet_windows), (1, meet_parts)) if (kinds == k).any()]
        return pa.concat_tables(made)

    out = pa.schema([("doc_id", pa.int64()), *((n, a) for n, _, a in spec.columns)])

    def alone(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows without a doc_id."""
        for batch in tables:
            texts = batch.column("text").to_pylist()
            tokens, ends, source = spec.tokenize(texts)
            bounds = zip(np.concatenate([[0], ends[:-1]]), ends, strict=True) if texts else ()
            rows = [(None, *spec.cut(source, k, int(a), int(b), np.zeros(int(b - a), bool))) for k, (a, b) in enumerate(bounds)]
            made = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)] if rows else [pa.array([], f.type) for f in out]
            names = out.names + (["extra"] if carry else [])
            yield pa.RecordBatch.from_arrays(made + ([batch.column("extra")] if carry else []), names=names)

    def three(key: tuple, table: pa.Table, info: pa.Table) -> pa.Table:
        if not table.num_rows:
            return out.empty_table() if not carry else out.append(table.schema.field("extra")).empty_table()
        block, _ = read_block(spec, table)
        masks = covered(spec, block, info)
        rows: list[tuple] = []
        for (begin, _, ends, source, _), mask in zip(block.chunks, masks, strict=True):
            start = 0
            for k, end in enumerate(ends):
                rows.append((int(block.docs[begin + k]), *spec.cut(source, k, start, int(end), mask[start:end])))
                start = int(end)
        made = pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
        return made.append_column(table.schema.field("extra"), table.column("extra").take(pa.array(block.order))) if carry else made

    by_block = dealt.groupBy("block")
    info_1 = by_block.applyInArrow(one, _RUNS).groupBy("bucket").applyInArrow(meet_runs, _INFO)
    parts = by_block.cogroup(info_1.groupBy("block")).applyInArrow(two, _PARTS)
    info = info_1.unionByName(parts.groupBy("bucket").applyInArrow(meet_both, _INFO))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(n, T._parse_datatype_string(s)) for n, s, _ in spec.columns)])
    if carry:
        schema = schema.add(dealt.schema["extra"])
    kept = by_block.cogroup(info.groupBy("block")).applyInArrow(three, schema)
    nameless = docs.filter(F.col("doc_id").isNull()).select(*columns, *[extra] * bool(carry)).drop("block").mapInArrow(alone, schema)
    return kept.unionByName(nameless)
