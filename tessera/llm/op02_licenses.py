"""Operator 2: licence scans with DataFrame functions only.

Method: a positional rare-token index.  A template is a licence's sentence or whole notice
with one or more mandatory key phrases; the postings of a licence word are the templates
and places of its key words.  Document frequencies of all licence words come from the
whole corpus.  Each file's licence words are put in order of IDF, and only its highest
ones are looked up: of every template whose key words all stand in the file, the two
rarest.  Each place of such a word in the file, less the posting's place, is a start that
the word gives; the starts of both words are intersected, and a start counts if every word
of every key phrase stands at its relative place.  Its score is the share of the
template's words that stand in place; a notice counts from NOTICE_SHARE on.  No place is
lost: a phrase that stands in a file has all its words there.

Defined results: a null or empty text has no words, no labels and score 0; words joined
over line breaks or punctuation are consecutive; a text of any length is scanned whole; rows
are independent, so repeated rows, repeated and null ids need no rule (each row is
returned); an empty table gives an empty result.  Columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

NOTICE_SHARE = 0.5


@dataclass(frozen=True)
class Template:
    """text: its words; keys: mandatory phrases of it, in order; least: the share of the
    words that must stand in place."""

    label: str
    keys: tuple[str, ...]
    text: str
    least: float = 0.0

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def places(self) -> list[int]:
        """Where each key phrase starts in the text."""
        return [len(self.text[: f" {self.text} ".index(f" {key} ")].split()) for key in self.keys]

    @property
    def needed(self) -> list[tuple[str, int]]:
        """The words of the key phrases and their places."""
        return [(w, at + k) for key, at in zip(self.keys, self.places, strict=True) for k, w in enumerate(key.split())]


# The base phrases with the labels that the contract names.
BASE = [
    Template("gpl", ("gnu general public license",), "this work is licensed under the gnu general public license version 3"),
    Template("apache", ("apache license",), "licensed under the apache license version 2 0"),
    Template("cc-by", ("cc by",), "licensed under cc by 4 0"),
    Template("mit", ("mit license",), "released under the mit license"),
]
FURTHER = [
    Template("lgpl", ("gnu lesser general public license",), "licensed under the gnu lesser general public license version 3"),
    Template("agpl", ("gnu affero general public license",), "licensed under the gnu affero general public license version 3"),
    Template("gpl-3.0", ("gnu general public license version 3",), "licensed under the gnu general public license version 3"),
    Template("gpl-2.0", ("gnu general public license version 2",), "licensed under the gnu general public license version 2"),
    Template("apache-2.0", ("apache license version 2 0",), "licensed under the apache license version 2 0"),
    Template("bsd", ("bsd license",), "released under the bsd license"),
    Template("mpl", ("mozilla public license",), "subject to the terms of the mozilla public license"),
    Template("cc-by-nc", ("cc by nc",), "licensed under cc by nc 4 0"),
    Template("cc-by-sa", ("cc by sa",), "licensed under cc by sa 4 0"),
    Template("cc-by-nd", ("cc by nd",), "licensed under cc by nd 4 0"),
    Template("cc0", ("cc0 1 0 universal",), "dedicated to the public domain under cc0 1 0 universal"),
]
# The wording of the licences' own notices.
NOTICES = [
    Template(
        "mit-notice",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
        " to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell"
        " copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
        " the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        NOTICE_SHARE,
    ),
    Template(
        "bsd-notice",
        ("redistribution and use in source and binary forms", "are permitted provided that the following conditions are met"),
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
        " 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
        " 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"
        " in the documentation and or other materials provided with the distribution",
        NOTICE_SHARE,
    ),
    Template(
        "apache-notice",
        ("you may not use this file except in compliance with the license",),
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"
        " you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing"
        " software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
        " see the license for the specific language governing permissions and limitations under the license",
        NOTICE_SHARE,
    ),
    Template(
        "gpl-notice",
        ("you can redistribute it and or modify it", "gnu general public license as published by the free software foundation"),
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
        " as published by the free software foundation either version 3 of the license or at your option any later version"
        " this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of"
        " merchantability or fitness for a particular purpose see the gnu general public license for more details",
        NOTICE_SHARE,
    ),
    Template(
        "lgpl-notice",
        ("you can redistribute it and or modify it", "gnu lesser general public license as published by the free software foundation"),
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"
        " as published by the free software foundation either version 3 of the license or at your option any later version"
        " this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of"
        " merchantability or fitness for a particular purpose see the gnu lesser general public license for more details",
        NOTICE_SHARE,
    ),
    Template(
        "isc-notice",
        ("permission to use copy modify and or distribute this software for any purpose",),
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
        " provided that the above copyright notice and this permission notice appear in all copies",
        NOTICE_SHARE,
    ),
    Template(
        "mpl-notice",
        ("subject to the terms of the mozilla public license",),
        "this source code form is subject to the terms of the mozilla public license v 2 0"
        " if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
        NOTICE_SHARE,
    ),
    Template(
        "unlicense-notice",
        ("free and unencumbered software released into the public domain",),
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"
        " either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        NOTICE_SHARE,
    ),
]
TEMPLATES = BASE + FURTHER + NOTICES


def words_of(text: Column) -> Column:
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP)
    return F.filter(parts, lambda w: w != "")


def document_frequency(docs: DataFrame) -> dict[str, int]:
    """In how many rows each licence word stands; the vocabulary is fixed and small."""
    vocabulary = sorted({w for t in TEMPLATES for w, _ in t.needed})
    known = F.array(*map(F.lit, vocabulary))
    counts = docs.select(F.explode(F.array_intersect(known, words_of(F.col("text")))).alias("w")).groupBy("w").count()
    return {w: 0 for w in vocabulary} | {r["w"]: r["count"] for r in counts.collect()}


def postings(frequency: dict[str, int], total: int) -> list[list[tuple[str, int]]]:
    """Of each template the words of its key phrases with their places, the highest IDF first."""
    idf = {w: math.log((total + 1) / (n + 1)) for w, n in frequency.items()}
    return [sorted(t.needed, key=lambda p: (-idf[p[0]], p[0], p[1])) for t in TEMPLATES]


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    frequency = document_frequency(docs)
    index = postings(frequency, docs.count())
    words, own = F.col("words"), F.col("own")
    by_idf = F.array(*map(F.lit, sorted(frequency, key=lambda w: (frequency[w], w))))
    out = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    out = out.withColumn("own", F.array_intersect(by_idf, words))

    def possible(number: int) -> Column:
        return reduce(Column.__and__, (F.array_contains(own, w) for w in dict.fromkeys(w for w, _ in index[number])))

    asked = F.array_distinct(F.flatten(F.array_compact(F.array(*(F.when(possible(n), F.array(*(F.lit(w) for w, _ in index[n][:2]))) for n in range(len(TEMPLATES)))))))
    out = out.withColumn("asked", asked)
    places = F.transform(words, lambda w, i: F.when(F.array_contains("asked", w), F.struct(w.alias("w"), i.alias("i"))))
    out = out.withColumn("hits", F.when(F.size("asked") > 0, F.array_compact(places)).otherwise(F.array().cast("array<struct<w:string,i:int>>")))

    def share(number: int, start: Column) -> Column:
        whole = F.split(F.lit(TEMPLATES[number].text), " ")
        held = F.transform(whole, lambda w, k: F.get(words, start + k) == w)
        return F.size(F.filter(held, lambda h: h)) / F.size(whole)

    def starts(number: int) -> Column:
        """Where the template's text starts, by its key phrases (below 0 if a part stands before the file)."""

        def given(word: str, place: int) -> Column:
            return F.transform(F.filter(F.col("hits"), lambda h: h["w"] == word), lambda h: h["i"] - place)

        def in_place(start: Column) -> Column:
            held = reduce(Column.__and__, (F.get(words, start + p) == w for w, p in index[number]))
            least = TEMPLATES[number].least
            return F.coalesce(held & (share(number, start) >= least) if least else held, F.lit(False))

        return F.filter(F.array_intersect(*(given(*p) for p in index[number][:2])), in_place)

    def score(number: int) -> Column:
        return F.coalesce(F.array_max(F.transform(F.col(f"s{number}"), lambda s: share(number, s))), F.lit(0.0))

    out = out.select("*", *(F.when(F.size("hits") > 0, starts(n)).otherwise(F.array().cast("array<int>")).alias(f"s{n}") for n in range(len(TEMPLATES))))
    some = F.size("hits") > 0
    base = F.flatten(F.array(*(F.transform(F.col(f"s{n}"), lambda s: s + BASE[n].places[0]) for n in range(len(BASE)))))  # noqa: B023
    labels = lambda of: F.array_join(F.array_sort(F.array_compact(F.array(*(F.when(F.size(f"s{n}") > 0, F.lit(TEMPLATES[n].label)) for n in of)))), ",")
    return out.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(base).cast("bigint").alias("first_word"),
        F.array_max(base).cast("bigint").alias("last_word"),
        labels(range(len(BASE))).alias("base_labels"),
        labels(range(len(TEMPLATES))).alias("labels"),
        F.when(some, F.greatest(*(score(n) for n in range(len(TEMPLATES))))).otherwise(F.lit(0.0)).alias("score"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    """The same by plain comparison at every word, without an index."""
    places, shares = [], []
    for n, t in enumerate(TEMPLATES):
        at = t.places[0]
        keys = " AND ".join(f"w[i + {p - at + 1}] = '{x}'" for x, p in t.needed)
        whole = ", ".join(f"'{w}'" for w in t.words)
        share = f"(len(list_filter(range({len(t.words)}), lambda k: i - {at} + k >= 0 AND w[i - {at} + k + 1] = [{whole}][k + 1])) / {len(t.words)}.0::DOUBLE)"
        if t.least:
            keys += f" AND {share} >= {t.least}"
        places.append(f"list_filter(range(len(w)), lambda i: {keys}) AS s{n}")
        shares.append(f"coalesce(list_max(list_transform(s{n}, lambda i: {share})), 0.0)")
    names = lambda of: "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN len(s{n}) > 0 THEN '{TEMPLATES[n].label}' END" for n in of) + "], lambda x: x IS NOT NULL)), ',')"
    base = "flatten([" + ", ".join(f"s{n}" for n in range(len(BASE))) + "])"
    return f"""
WITH a AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT doc_id, w, {", ".join(places)} FROM a)
SELECT doc_id, len(w) AS n_words, len({base}) AS n_base, list_min({base}) AS first_word, list_max({base}) AS last_word,
       {names(range(len(BASE)))} AS base_labels, {names(range(len(TEMPLATES)))} AS labels,
       greatest({", ".join(shares)}) AS score
FROM s
"""


ORACLE = _oracle()
