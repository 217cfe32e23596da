"""Text, string, array and JSON functions, as columns."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.storage import checkpointed

# Patterns of chatter in generated text, escapes, words of a rejected reply.
CHATTER = [r"(?im)^(Okay,? |So,? |First,? |Well,? |Hmm,? |Alright,? )", r"(?im)Let me (explain|start|begin|clarify)", r"(?im)(As an AI|I should|I need to|I'll)", r"(?im)\(\s*internal .*?\)", r"(?im)\[.*?thinking.*?\]", r"(?im)^[A-Za-z]+:\s*"]
THINKING = r"(?is)(<think>.*?</think>|\\textless\{\}think\\textgreater\{\}.*?\\textless\{\}/think\\textgreater\{\})"
ESCAPES = {"’": "'", "“": "``", "”": "''", "–": "--", "—": "---", "，": ",", "‘": "`", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\^{}", "\\": r"\textbackslash{}", "<": r"\textless{}", ">": r"\textgreater{}"}
META = r"(?i)(think|monologue|self.reference|internal)"
STOP_WORDS = {"en": ["the", "of", "and", "is", "that", "with"], "de": ["der", "die", "und", "von", "mit", "ein"], "fr": ["le", "les", "des", "de", "qui", "dans"], "es": ["el", "los", "que", "del", "para", "una"]}

#: Bigrams of a corpus whose counts are broadcast.
COUNTS = 200_000


def paragraphs(text: Column, least: int = 50) -> Column:
    """Stripped parts between blank lines, of least characters or more."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.btrim(p, F.lit(" \t\n\r"))), lambda p: F.char_length(p) >= least)


def clean_generated(text: Column) -> Column:
    """A reply without thinking blocks, chatter, short lines, openers and bracketed lines."""
    out = F.regexp_replace(text, THINKING, "")
    for pattern in CHATTER:
        out = F.regexp_replace(out, pattern, "")
    lines = F.transform(F.split(out, "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    bad = lambda x: x.startswith("Okay") | x.startswith("So ") | x.startswith("First") | x.rlike(r"[{}<>\[\]()]")
    return F.array_join(F.filter(lines, lambda x: (F.char_length(x) > 12) & ~bad(x)), "\n")


def passes_gate(text: Column, prompt: Column, ratio: float = 0.5) -> Column:
    return ~text.rlike(META) & (F.char_length(text) >= F.char_length(prompt) * ratio)


def escape_markup(text: Column, table: Mapping[str, str] = ESCAPES) -> Column:
    """Each character replaced once; what is not ASCII then goes."""
    mapped = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    letters = F.split(text, "")
    return F.regexp_replace(F.array_join(F.transform(letters, lambda c: F.coalesce(F.element_at(mapped, c), c)), ""), r"[^\x00-\x7F]", "")


def numbered_items(text: Column, longer: int = 5, most: int = 10) -> Column:
    """Texts of `1.` or `1)` lines over a length, the first of them."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*\d+[.)][ \t]+(.+)$"), F.lit(1))
    return F.slice(F.filter(F.transform(found, lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: F.char_length(x) > longer), 1, most)


def graded_reply(text: Column) -> Column:
    """struct(grade, feedback, rest): the first line's integer (else 3, and nothing else)."""
    lines = F.transform(F.split(F.btrim(text, F.lit(" \t\n\r")), "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    grade = F.try_to_number(F.regexp_extract(F.get(lines, F.lit(0)), r"^([+-]?\d{1,9})$", 1), F.lit("S999999999")).cast("int")
    fine = grade.isNotNull()
    rest = F.filter(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), lambda x: x != "")
    return F.struct(F.coalesce(grade, F.lit(3)).alias("grade"), F.when(fine & (F.size(lines) > 1), F.get(lines, F.lit(1))).otherwise("").alias("feedback"), F.when(fine, rest).otherwise(F.array().cast("array<string>")).alias("rest"))


def sections(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """id, section, text (lines joined by a space), bullets (lines after a dash) of labelled
    sections: a line starting with a label opens it, and its own rest is not read."""
    from pyspark.sql import Window

    lines = rows.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.btrim("line", F.lit(" \t\r")))
    label = F.coalesce(*(F.when(F.col("line").startswith(f"{name}:"), F.lit(name.lower())) for name in labels))
    w = Window.partitionBy("id").orderBy("pos")
    marked = lines.withColumn("label", label).withColumn("section", F.last("label", ignorenulls=True).over(w)).filter("label is null and section is not null and line <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))
    grouped = marked.groupBy("id", "section").agg(F.transform(ordered, lambda x: x["line"]).alias("lines"))
    bullets = F.transform(F.filter("lines", lambda x: x.startswith("-")), lambda x: F.btrim(F.substr(x, F.lit(2)), F.lit(" \t")))
    return grouped.select("id", "section", F.array_join("lines", " ").alias("text"), bullets.alias("bullets"))


def title_entities(text: Column) -> Column:
    """Runs of capitalised words (a stand-in for noun chunks that start in upper case)."""
    return F.regexp_extract_all(text, F.lit(r"\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*"), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def language_of(text: Column, stop_words: Mapping[str, Sequence[str]] = STOP_WORDS) -> Column:
    """The language with the most stop words; ties to the first by name."""
    held = F.split(F.lower(text), r"[^\p{L}]+")

    def count(names: Sequence[str]) -> Column:
        return F.size(F.filter(held, lambda w: w.isin(*names))).alias("n")

    scores = [F.struct(count(names), F.lit(-i).alias("order"), F.lit(k).alias("lang")) for i, (k, names) in enumerate(sorted(stop_words.items()))]
    return F.array_max(F.array(*scores))["lang"]


def slides(text: Column) -> Column:
    """array of struct(title, visual, narration, duration) from `## Slide n:` blocks."""
    pattern = r"(?s)## Slide \d+: ([^\n]+)\n### Visual\n(.+?)\n### Narration\n(.+?)(?:\n### Duration\n(\d+))?(?=\n##|\n---|\z)"
    part = lambda i: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(i)), lambda x: F.btrim(x, F.lit(" \n\t\r")))
    zipped = F.arrays_zip(part(1).alias("title"), part(2).alias("visual"), part(3).alias("narration"), part(4).alias("duration"))
    return F.transform(zipped, lambda s: F.struct(s["title"].alias("title"), s["visual"].alias("visual"), s["narration"].alias("narration"), F.when(s["duration"] != "", s["duration"].cast("int")).alias("duration")))


def chunk_text(text: str, size: int, overlap: int, separators: Sequence[str]) -> list[str]:
    """Parts of at most size characters, cut at the first separator that is fine enough,
    each sharing up to overlap characters with the one before."""
    pieces: list[str] = [text]
    for sep in separators:
        if all(len(p) <= size for p in pieces):
            break
        pieces = [q for p in pieces for q in ([p] if len(p) <= size else [x + sep for x in p.split(sep)[:-1]] + [p.split(sep)[-1]])]
    pieces = [p[i : i + size] for p in pieces if p for i in range(0, len(p), size)]
    out, now = [], ""
    for p in pieces:
        if now and len(now) + len(p) > size:
            out.append(now)
            keep = min(overlap, size - len(p))
            now = now[len(now) - keep :] if keep > 0 else ""
        now += p
    return [*out, now] if now else out


def recursive_chunks(rows: DataFrame, size: int = 1000, overlap: int = 200, separators: Sequence[str] = ("\n\n\n", "\n\n", "\n", ". ", " ")) -> DataFrame:
    """id, chunk, text: rows (id, text) cut in Arrow batches."""
    import pyarrow as pa

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(i, k, c) for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True) for k, c in enumerate(chunk_text(t or "", size, overlap, separators))]
            yield pa.RecordBatch.from_pydict({"id": [m[0] for m in made], "chunk": pa.array([m[1] for m in made], pa.int32()), "text": pa.array([m[2] for m in made], pa.string())}, schema=pa.schema([("id", batch.schema.field("id").type), ("chunk", pa.int32()), ("text", pa.string())]))

    return rows.select("id", "text").mapInArrow(scan, f"id {dict(rows.dtypes)['id']}, chunk int, text string")


def embed_text(text: Column, dimensions: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: hashed word counts, length one.  Null of null."""
    slots = F.transform(words(F.lower(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(dimensions)).cast("int"))

    @F.arrow_udf("array<double>")
    def counted(slots: pa.Array) -> pa.Array:
        row = np.repeat(np.arange(len(slots)), pc.list_value_length(slots).fill_null(0).to_numpy())
        counts = np.bincount(row * dimensions + slots.flatten().to_numpy(), minlength=len(slots) * dimensions).reshape(-1, dimensions).astype(float)
        size = np.sqrt((counts * counts).sum(1, keepdims=True))
        held = (counts / np.where(size > 0, size, 1))[slots.is_valid().to_numpy(zero_copy_only=False)]
        offsets = np.concatenate([[0], np.cumsum(np.where(slots.is_valid(), dimensions, 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(held.ravel()), mask=slots.is_null())

    return counted(slots)


def digest(rows: DataFrame, cap: int) -> DataFrame:
    """id, digest: a heading, the first cap items in order and a "more" line per group."""
    from pyspark.sql import Window

    w = Window.partitionBy("id")
    placed = rows.withColumn("place", F.row_number().over(w.orderBy("pos"))).withColumn("n", F.count("*").over(w))
    first = placed.filter(F.col("place") <= cap)
    items = F.array_sort(F.collect_list(F.struct("place", F.concat(F.col("place").cast("string"), F.lit(". "), "item").alias("line"))))
    text = first.groupBy("id", "n").agg(F.array_join(F.transform(items, lambda x: x["line"]), "\n").alias("body"))
    more = F.when(F.col("n") > cap, F.concat(F.lit("\n... and "), (F.col("n") - cap).cast("string"), F.lit(" more"))).otherwise("")
    return text.select("id", F.concat(F.lit("ITEMS: "), F.col("n").cast("string"), F.lit("\n"), "body", more).alias("digest"))


#: Sections of a board: type of item, heading, how many are shown, what the rest is called (fixed values).
SECTIONS = [("shape", "SHAPES:", 50, "shapes"), ("sticky_note", "STICKY NOTES:", 50, "notes"), ("connector", "CONNECTIONS:", 30, "connections"), ("frame", "FRAMES (Logical Groups):", 20, "frames")]


def board_digest(items: DataFrame) -> DataFrame:
    """board, digest: a heading with the board's counts and a section for each type of item it holds,
    each with its own limit and a "more" line.  items: board, name, id, pos, type, content, shape, title,
    start, end.  Items without content are counted and numbered but not shown, and so are
    connections of which an end is no item of the board; ends are cut to 30 characters."""
    from pyspark.sql import Window

    counts = items.groupBy("board").agg(F.max("name").alias("name"), F.count("*").alias("n"), *(F.count_if(F.col("type") == t).alias(t) for t, *_ in SECTIONS))
    cap = F.lit(0)
    for kind, _, most, _ in SECTIONS:
        cap = F.when(F.col("type") == kind, most).otherwise(cap)
    order = Window.partitionBy("board", "type").orderBy("pos", "id")
    first = items.filter(F.col("type").isin([t for t, *_ in SECTIONS])).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max(c for _, _, c, _ in SECTIONS)).filter(F.col("place") <= cap)
    ends = items.select("board", F.col("id").alias("_id"), F.substring(F.coalesce("content", F.lit("Unknown")), 1, 30).alias("text"))
    joined = first.filter("type = 'connector'")
    for side in ("start", "end"):
        named = ends.select(F.col("board").alias("_board"), F.col("_id").alias("_end"), F.col("text").alias(f"{side}_text"))
        joined = joined.join(named, (F.col("board") == F.col("_board")) & (F.col(side) == F.col("_end"))).drop("_board", "_end")
    number = F.concat(F.col("place").cast("string"), F.lit(". "))
    content = F.nullif(F.btrim("content"), F.lit(""))
    line = F.when(F.col("type") == "shape", F.concat(number, F.lit("["), F.coalesce("shape", F.lit("rectangle")), F.lit("] "), content)).when(F.col("type") == "frame", F.concat(number, F.coalesce("title", F.lit("Untitled Frame")))).otherwise(F.concat(number, content))
    lines = first.filter("type <> 'connector'").select("board", "type", "place", line.alias("line"))
    lines = lines.unionByName(joined.select("board", "type", "place", F.concat(number, F.lit("'"), "start_text", F.lit("' --> '"), "end_text", F.lit("'")).alias("line"))).filter("line is not null")
    shown = lines.groupBy("board").agg(*(F.array_sort(F.collect_list(F.when(F.col("type") == t, F.struct("place", "line")))).alias(f"_{t}") for t, *_ in SECTIONS))
    whole = counts.join(shown, "board", "left")
    cat = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    header = cat("BOARD INFORMATION:\n- Name: ", F.coalesce("name", F.lit("Untitled")), "\n- Total Items: ", F.col("n"), "\n- Shapes: ", F.col("shape"), "\n- Sticky Notes: ", F.col("sticky_note"), "\n- Connectors: ", F.col("connector"), "\n- Frames: ", F.col("frame"), "\n")
    parts = [header]
    for kind, heading, most, rest in SECTIONS:
        body = F.array_join(F.transform(F.coalesce(f"_{kind}", F.array().cast("array<struct<place:int,line:string>>")), lambda x: F.concat(F.lit("\n"), x["line"])), "")
        more = F.when(F.col(kind) > most, cat("\n... and ", F.col(kind) - most, f" more {rest}")).otherwise("")
        parts.append(F.when(F.col(kind) > 0, cat("\n", heading, body, more, "" if kind == "frame" else "\n")).otherwise(""))
    return whole.select("board", F.concat(*parts).alias("digest"))


def bigram_perplexity(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """id, perplexity of each text (id, text) under add-one bigram counts of a corpus (text).

    Counts of a small corpus go to the texts, whose words then stay where they are: a sum for each
    part of a text is all that is shuffled.  Beyond that the texts' bigrams go to the counts."""

    def pairs(df: DataFrame, *keep: str) -> DataFrame:
        w = words(F.lower("text"))
        return df.select(*keep, w.alias("w")).filter("size(w) > 1").select(*keep, F.explode(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("a"), F.slice("w", 2, F.size("w") - 1).alias("b"))).alias("p")).select(*keep, F.col("p.a").alias("a"), F.col("p.b").alias("b"))

    seen = checkpointed(pairs(corpus).groupBy("a", "b").agg(F.count("*").alias("n2")))
    first = seen.groupBy("a").agg(F.sum("n2").alias("n1"))
    size = seen.select("a").union(seen.select("b")).distinct().agg(F.count("*").alias("v"))
    small = seen.limit(COUNTS + 1).count() <= COUNTS
    sent = F.broadcast if small else lambda df: df
    own = pairs(rows, "id")
    own = own.withColumn("k", F.lit(1)) if small else own.groupBy("id", "a", "b").agg(F.count("*").alias("k"))
    j = own.join(sent(seen), ["a", "b"], "left").join(sent(first), "a", "left").crossJoin(F.broadcast(size))
    cost = -F.log((F.coalesce("n2", F.lit(0)) + 1) / (F.coalesce("n1", F.lit(0)) + F.col("v") + 1))
    return j.groupBy("id").agg(F.exp(F.sum(cost * F.col("k")) / F.sum("k")).alias("perplexity"))
