"""Places of many known terms in texts, with one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import places
from .storage import checkpointed

#: Terms in one automaton; more are dealt to several, and the texts are read once for each.
TERMS = 200_000


def term_occurrences(docs: DataFrame, terms: DataFrame, doc: str, term_id: str, around: int = 30) -> DataFrame:
    """doc, term_id, start (in characters, from 0), context (the term and around characters on
    both sides) of each place of each term (term_id, term) in the texts of docs (doc, text).

    All terms are one automaton (Aho-Corasick), so the work does not grow with their number.  Places
    of one term do not overlap: a place that begins inside the one before is passed over.  Terms
    that are equal are found for each of their ids; null and empty terms and null texts have
    no places."""
    import pyarrow as pa

    spark = docs.sparkSession
    numbered = checkpointed(places(terms.filter("term <> ''").select(term_id, "term"), [], ["term", term_id]))
    count = numbered.count()
    kinds = [f"{doc} {docs.schema[doc].dataType.simpleString()}", f"{term_id} {terms.schema[term_id].dataType.simpleString()}"]

    def part(begin: int) -> DataFrame:
        own: dict[str, list] = {}
        for r in numbered.filter(F.col("place").between(begin + 1, begin + TERMS)).collect():  # TERMS at most
            own.setdefault(r["term"], []).append(r[term_id])
        shared = spark.sparkContext.broadcast(own)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for term, ids in shared.value.items():
                automaton.add_word(term, (term, ids))
            automaton.make_automaton()
            for batch in batches:
                out = []
                for name, text in zip(batch.column(doc).to_pylist(), batch.column("text").to_pylist(), strict=True):
                    free: dict[str, int] = {}
                    for last, (term, ids) in automaton.iter(text or ""):
                        start = last + 1 - len(term)
                        if start >= free.get(term, 0):
                            free[term] = last + 1
                            context = text[max(0, start - around) : last + 1 + around]
                            out += [(name, i, start, context) for i in ids]
                columns = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(doc).type), pa.array(columns[1], id_type), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], [doc, term_id, "start", "context"])

        id_type = numbered.select(term_id).limit(0).toArrow().schema.field(term_id).type
        return docs.select(doc, "text").mapInArrow(scan, f"{', '.join(kinds)}, start bigint, context string")

    if not count:
        return spark.createDataFrame([], f"{', '.join(kinds)}, start bigint, context string")
    return reduce(DataFrame.unionByName, (part(begin) for begin in range(0, count, TERMS)))
