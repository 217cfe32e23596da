import re

from tessera.llm import op02_licenses
from tessera.llm.op02_licenses import BASE, TEMPLATES, license_scan

from .oracle import same


def test_sql(spark, sf):
    same(op02_licenses.op2_license_scan(spark, sf), op02_licenses.ORACLE, sf)


def test_places(spark):
    texts = [
        None,
        "",
        "Released under the MIT License.",
        "the GNU\n*General* public-license and cc/by cc by-nc CC BY",
        "permit license mit licenses",
        "apache license apache license",
        "émit license",
        "by " * 50000 + "cc by",
        "cc",
    ]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, words int")
    got = {r.doc_id: r for r in license_scan(docs).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        places = [(k, t.label) for t in BASE for phrase in t.keys for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert got[2].score == 1.0 and got[3].labels == "cc-by,cc-by-nc,gpl"
    assert license_scan(docs.limit(0)).collect() == []


def plain(text: str | None) -> tuple[list[str], float]:
    """Labels and score of a text, by comparison at every word."""
    w, labels, score = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()), set(), 0.0
    for t in TEMPLATES:
        needed = t.needed
        for start in range(-len(t.words), len(w)):
            get = lambda k: w[start + k] if 0 <= start + k < len(w) else None  # noqa: B023, E731
            if all(get(p) == x for x, p in needed):
                share = sum(get(k) == x for k, x in enumerate(t.words)) / len(t.words)
                if share >= t.least:
                    labels.add(t.label)
                    score = max(score, share)
    return sorted(labels), score


def test_notices(spark, sf):
    """Whole notices, cut ones, ones with other words put in, and key phrases out of their places."""
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for t in TEMPLATES:
        w = t.words
        for k in (len(w), len(w) * 3 // 4, len(w) // 3):
            texts += [" ".join(w[:k]), " ".join(w[-k:]), "x " + " ".join(w[:k]).upper() + ".\n" + " ".join(w)]
        texts += [" ".join([*w[: len(w) // 2], "inserted", *w[len(w) // 2 :]]), " ".join(reversed(w)), " ".join(t.keys), " ".join(reversed(t.keys)), " ".join(w) + " " + " ".join(w)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "mit license"), (1, "mit license"), (1, "mit license"), (2, None)]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), ",".join(plain(t)[0]), round(plain(t)[1], 9)) for i, t in rows)
    assert sorted((str(r.doc_id), r.labels, round(r.score, 9)) for r in got) == want
    whole = {r.doc_id: r for r in got}
    first = len(texts) - len(TEMPLATES) * 14
    assert all(TEMPLATES[n].label in whole[first + n * 14].labels.split(",") and whole[first + n * 14].score == 1.0 for n in range(len(TEMPLATES)))
