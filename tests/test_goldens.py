"""Worked cases of the rules that SQL twins do not cover, and edge cases."""

import re

from pyspark.sql import functions as F

from tessera.functions import parsing as P
from tessera.functions import rules as R
from tessera.functions import texts as X
from tessera.operators import aggregates as A
from tessera.operators import changes as C
from tessera.operators import joins as J
from tessera.operators import scoring as S
from tessera.operators import topk as K
from tessera.operators import windows as W
from tessera.sources import files, sinks
from tessera.streaming import streams as S_


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_bands(spark):
    got = spark.createDataFrame([(0.75,), (0.74,), (0.60,), (0.59,)], "s double").select(S.quality_band(F.col("s")).alias("b")).collect()
    assert [r.b for r in got] == ["high", "medium", "medium", "low"]
    assert spark.createDataFrame([(0.8,), (0.7,)], "s double").agg(A.ordinal_band(F.col("s")).alias("b")).first().b == "high"
    assert spark.createDataFrame([], "s double").agg(A.ordinal_band(F.col("s")).alias("b")).first().b == "low"


def test_item_value(spark):
    args = (F.lit(0.20), F.lit("accessories"), F.lit(""), F.lit("good"), F.lit("a plain pin"))
    assert one(spark, S.item_value(*args)) == 0.20
    assert one(spark, S.item_value(F.lit(100.0), F.lit("Jewelry"), F.lit("Rolex"), F.lit("poor"), F.lit("rare vintage limited mint perfect new"))) == 210.0


def test_names_and_sizes(spark):
    assert one(spark, S.sanitize_name(F.lit("--My Project! v2-"))) == "my_project__v2"
    assert one(spark, S.sanitize_name(F.lit("a"))) == "a_collection"
    assert one(spark, S.human_bytes(F.lit(1536.0))) == "1.50 KB"
    assert one(spark, S.redact_secrets(F.lit("A=1\nTOKEN=abc\nXTOKEN=q"), ["TOKEN"])) == "A=1\nTOKEN=***REDACTED***\nXTOKEN=q"


def test_spaced_repetition(spark):
    fold = lambda *g: tuple(one(spark, W.spaced_repetition(F.array(*map(F.lit, g)))))
    assert [fold(*[5] * n)[1] for n in (1, 2, 3)] == [1, 6, 15]
    assert fold(5, 5, 5)[0] == 2.5 and fold(2) == (2.5, 1)


def test_intervals_have_no_cap(spark):
    interval, ease = 0.0, 2.5
    for _ in range(40):
        interval = 1.0 if interval == 0 else 6.0 if interval == 1 else float(round(interval * ease))
    assert one(spark, W.spaced_repetition(F.array(*[F.lit(5)] * 40)))[1] == interval > 1e12


def test_long_series(spark):
    """Over the edge of batches and of the settled gain, and beside a short series."""
    rows = [(1, i, float((i * 37) % 11)) for i in range(25_000)] + [(2, i, float(i)) for i in range(3)]
    got = {(r.s, r.t): r.smooth for r in W.kalman_series(spark.createDataFrame(rows, "s long, t long, v double"), "s", "t", "v").collect()}
    x, p, last = 0.0, 1.0, 1
    for s, t, v in rows:
        if s != last:
            x, p, last = 0.0, 1.0, s
        p += 1e-4
        k = p / (p + 1e-2)
        x += k * (v - x)
        p *= 1 - k
        assert abs(got[s, t] - x) < 1e-9


def test_lags(spark):
    a = spark.createDataFrame([(t, float(t == 3)) for t in range(10)], "t long, v double")
    b = spark.createDataFrame([(t, float(t == 8)) for t in range(10)], "t long, v double")
    got = {r.lag: r for r in W.lag_correlation(a, b).collect()}
    assert sorted(got) == list(range(-9, 10)) and [k for k, r in got.items() if r.offset] == [-5]
    assert sorted(r.lag for r in W.lag_correlation(a, b, 2).collect()) == [-2, -1, 0, 1, 2]


def test_changes_survive_a_second_run(spark, tmp_path):
    """A batch that is run again finds the same changes; parts become a whole state."""
    page = lambda *rows: spark.createDataFrame(rows, "k long, html string")
    page((1, "a"), (2, "b")).select("k", F.md5("html").alias("digest")).write.parquet(f"{tmp_path}/state/kind=whole/batch=-1")
    each = S_.change_stream(f"{tmp_path}/state", f"{tmp_path}/out", "k", compact=2)
    found = lambda n: {(r.k, r.change) for r in spark.read.parquet(f"{tmp_path}/out/batch={n}").collect()}
    for _ in range(2):
        each(page((1, "a"), (2, "c"), (3, "d")), 0)
        assert found(0) == {(2, "changed"), (3, "new")}
    for _ in range(2):
        each(page((2, "c"), (3, "e")), 1)
        assert found(1) == {(3, "changed")}
    assert (tmp_path / "state/kind=whole/batch=1").exists()
    each(page((1, "z"), (2, "c"), (3, "e")), 2)
    assert found(2) == {(1, "changed")}
    state, parts = S_.kept_state(spark, f"{tmp_path}/state", "k", 3)
    assert state.count() == 3 and parts == 1


def test_late_rows_are_counted(spark, tmp_path):
    """Rows behind the watermark are dropped and counted in the progress."""
    for n, day in enumerate(("2024-01-03", "2024-01-09", "2024-01-02")):
        spark.createDataFrame([(f"{day} 00:00:00", "view", 1.0)], "t string, event_type string, value double").select(F.col("t").cast("timestamp").alias("at"), "event_type", "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        counts = S_.windowed_counts(S_.read(spark, f"{tmp_path}/in"))
        query = counts.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(S_.append_to(f"{tmp_path}/out{n}")).start()
        query.awaitTermination()
        late = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    assert late == 1


def test_range_topk(spark):
    import random

    r = random.Random(8)
    rows = [(i, r.choice([10.0, 50.0, r.uniform(1, 90)]), r.choice("aab"), r.randrange(6)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, value double, type string, q long")
    for cell_rows in (1, 7, 5000):
        got = {(x.left_id, x.place, x.right_id) for x in J.range_topk(df, df, 1.05, 1.5, F.col("q"), 4, cell_rows).collect()}
        want = set()
        for i, v, t, _ in rows:
            near = sorted((-q, j) for j, w, u, q in rows if u != t and v * 1.05 <= w <= v * 1.5)[:4]
            want |= {(i, n + 1, j) for n, (_, j) in enumerate(near)}
        assert got == want


def test_trailing_mean_with_null_keys(spark):
    rows = spark.createDataFrame([(None, 1, 4.0), (None, 2, 8.0), ("a", 2, 1.0), (None, 5, 2.0)], "k string, day int, v double")
    got = {(r.k, r.day): r["mean"] for r in J.trailing_mean(rows, ["k"], F.col("day"), "v", 3).collect()}
    assert got == {(None, 1): None, (None, 2): 4.0, ("a", 2): None, (None, 5): 8.0}


def test_links_of_all_persons(spark):
    text = "Anna and Bert." + " x" * 180 + " Carl was born. Bert"
    d = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "no one")], "id long, text string")
    spans = J.token_spans(d, "[A-Z][a-z]+|[.]|born")
    assert [(r.text, r.start) for r in sorted(spans.collect(), key=lambda r: r.start)] == [(m.group(), m.start()) for m in re.finditer("[A-Z][a-z]+|[.]|born", text)]
    label = F.when(F.col("text") == ".", "PLACE").when(F.col("text") == "born", "BORN").otherwise("PERSON")
    got = [(r.person, r.PLACE, r.born, r.died) for r in sorted(J.proximity_link(spans.withColumn("label", label), ["PLACE"]).collect(), key=lambda r: r.start)]
    assert got == [("Anna", ".", False, False), ("Bert", ".", False, False), ("Carl", ".", True, False), ("Bert", ".", True, False)]


def test_sections(spark):
    text = "intro\nSUGGESTIONS: not read\n- one\n  text\n-" + "x" * 200_000 + "\nEXPLANATION:\nbecause\n\n- no"
    got = {r.section: r for r in X.sections(spark.createDataFrame([(1, text)], "id long, text string"), ["SUGGESTIONS", "EXPLANATION"]).collect()}
    assert got["suggestions"].bullets == ["one", "x" * 200_000] and got["explanation"].text == "because - no" and set(got) == {"suggestions", "explanation"}


def test_embedding(spark):
    v = one(spark, X.embed_text(F.lit("a b a"), 4))
    u = one(spark, X.embed_text(F.lit("A\tB  a"), 4))
    assert v == u and abs(sum(x * x for x in v) - 1) < 1e-12 and len(v) == 4
    assert one(spark, X.embed_text(F.lit(""), 4)) == [0.0] * 4


def test_linear_map_is_found(spark):
    import random

    r = random.Random(3)
    m = [[1.0, -2.0], [0.5, 3.0], [2.0, 0.0]]
    rows = []
    for _ in range(50):
        a = [r.gauss(0, 1) for _ in range(3)]
        rows.append((a, [sum(x * m[i][j] for i, x in enumerate(a)) for j in range(2)]))
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    found = K.linear_map(df, F.col("a"), F.col("b"))
    assert all(abs(x - y) < 1e-9 for p, q in zip(found, m, strict=True) for x, y in zip(p, q, strict=True))
    for x in df.select(K.apply_map(F.col("a"), found).alias("c"), "b").collect():
        size = sum(v * v for v in x.b) ** 0.5
        assert all(abs(p - q / size) < 1e-9 for p, q in zip(x.c, x.b, strict=True))


def test_nearest_by_group(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (3, [1.0, 1.0], "b"), (4, [0.0, 0.0], "b"), (5, None, "c")], "vec_id long, embedding array<double>, g string")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, q array<double>")
    got = [(r.vec_id, r.g, r.place) for r in sorted(K.nearest(rows, asked, "cosine", 5, "g").collect(), key=lambda r: r.place)]
    assert got == [(1, "a", 1), (3, "b", 2)]
    assert [r.vec_id for r in sorted(K.cosine_topk(rows, asked).collect(), key=lambda r: r.place)] == [1, 2, 3]


def test_extension_points(spark):
    """Rules, labelers and embeddings are arguments; a broken rule finds nothing."""
    texts = spark.createDataFrame([(1, "red\nblue"), (2, "green")], "id long, text string")
    rules = {"R1": ("colour", "^re"), "R2": ("broken", "([a-"), "R3": ("colour", "ee")}
    assert {(r.id, r.line, r.rule) for r in R.scan(texts, rules).collect()} == {(1, 1, "R1"), (2, 1, "R3")}
    assert R.scan(texts, {"R2": rules["R2"]}).collect() == []
    cases = spark.createDataFrame([("A red hat", "red")], "context string, target string")
    assert {r.pattern: r.hit for r in R.pattern_cases(cases, ["r.d", "([a-z", "hat"]).collect()} == {"r.d": True, "([a-z": False, "hat": False}
    label = A.majority([F.col("text").contains("e"), F.char_length("text") > 5, F.lit(True)], "yes", "no")
    assert {r.id: r.l for r in texts.select("id", label.alias("l")).collect()} == {1: "yes", 2: "yes"}
    length = lambda c: F.array(F.char_length(c).cast("double"), F.lit(1.0))
    vectors = texts.select(F.col("id").alias("vec_id"), length(F.col("text")).alias("embedding"))
    asked = texts.filter("id = 2").select(F.col("id").alias("query_id"), length(F.col("text")).alias("q"))
    assert K.l2_topk(vectors, asked, 1).first().vec_id == 2


def test_crawl_text_by_language(spark, tmp_path):
    body = {"en": "the cat and the dog of that house is with the bird ", "de": "der Hund und die Katze von dem Haus mit ein Vogel "}
    record = lambda kind, name, text: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://x/{name}\r\n\r\n{text}\r\n\r\n"
    (tmp_path / "a.wet").write_bytes("".join([record("conversion", "en", body["en"] * 10), record("conversion", "de", body["de"] * 10), record("warcinfo", "w", body["en"] * 10), record("conversion", "short", body["en"])]).encode())
    assert {r.url for r in files.wet_scan(spark, str(tmp_path / "a.wet")).collect()} == {"http://x/en"}
    assert {r.url for r in files.wet_scan(spark, str(tmp_path / "a.wet"), language=None).collect()} == {"http://x/en", "http://x/de"}


def test_kalman_forms_agree(spark):
    values = [1.0, 5.0, 2.0, 8.0, 3.0]
    array = one(spark, W.kalman(F.array(*map(F.lit, values))))
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "s long, t long, v double")
    series = [r.smooth for r in sorted(W.kalman_series(rows, "s", "t", "v").collect(), key=lambda r: r.t)]
    assert all(abs(a - b) < 1e-12 for a, b in zip(array, series, strict=True))


def test_moving_average_factors(spark):
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7])], "s long, t long, v double")
    smooth = lambda f: [round(r.smooth, 6) for r in sorted(W.moving_average(rows, "s", "t", "v", f).collect(), key=lambda r: r.t)]
    assert smooth(0) == [1, 2, 3, 4, 5, 6, 7] and smooth(1) == [4.0] * 7
    assert smooth(0.5) == [2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5]


def test_paragraphs(spark):
    text = "x" * 49 + "\n\n" + "y" * 50 + "\n \n z"
    assert one(spark, X.paragraphs(F.lit(text))) == ["y" * 50]


def test_generated_text(spark):
    text = "Okay, so here\nThis line is long enough to stay.\nshort\nA line with (brackets) goes away here.\n<think>all\nof this</think>"
    assert one(spark, X.clean_generated(F.lit(text))) == "This line is long enough to stay."
    assert one(spark, X.escape_markup(F.lit("a_b \\ 5% é"))) == r"a\_b \textbackslash{} 5\% "


def test_graded_reply(spark):
    assert tuple(one(spark, X.graded_reply(F.lit("4\nfine\n\na\n b ")))) == (4, "fine", ["a", "b"])
    assert tuple(one(spark, X.graded_reply(F.lit("no number\nfine")))) == (3, "", [])


def test_slides(spark):
    text = "## Slide 1: One\n### Visual\npicture\n### Narration\nwords here\n### Duration\n30\n---\n## Slide 2: Two\n### Visual\nb\n### Narration\nc\n"
    assert [tuple(s) for s in one(spark, X.slides(F.lit(text)))] == [("One", "picture", "words here", 30), ("Two", "b", "c", None)]


def test_chunks():
    text = " ".join(f"para {i}." for i in range(40)) + "\n\n" + " ".join(f"word{i}" for i in range(400)) + "\n" + "".join(chr(0x4E00 + i) for i in range(2500))
    chunks = X.chunk_text(text, 1000, 200, ["\n\n\n", "\n\n", "\n", ". ", " "])
    assert all(0 < len(c) <= 1000 for c in chunks)
    at = 0
    for c in chunks:  # each chunk starts within the one before or right after it
        start = text.index(c, max(0, at - 200))
        assert start <= at
        at = start + len(c)
    assert at == len(text)
    assert X.chunk_text("", 10, 2, [" "]) == []


def test_extraction_checks(spark):
    # Five inputs' expected names.
    cases = [["Uksenia (Oksenia) z d. Steczuk"], ["Jakub", "Filip", "Antoni Dymitr"], ["Wirka (Wiera)", "Anastazja"], ["Józef Łukasiewicz", "Małgorzata z d. Wróblewska"], ["Zofia (Zośka)", "Władysław"]]
    rows = [("- " + "\n2. ".join(e), e) for e in cases] + [("Malgorzata z d. Wróblewska\nJózef Łukasiewicz", cases[3]), ("żona Uksenia", cases[0])]
    got = P.extraction_checks(spark.createDataFrame(rows, "output string, expected array<string>")).collect()
    assert [r.passed for r in got] == [True] * 5 + [False, False]
    assert set(got[5].failures) == {"all_present", "marks_kept"} and "no_labels" in got[6].failures and "maiden_intact" in got[6].failures
    spoilt = P.extraction_checks(spark.createDataFrame([("Jozef Lukasiewicz", ["Józef Łukasiewicz"])], "output string, expected array<string>")).first()
    assert "no_plain_form" in spoilt.failures


def test_vital_records(spark):
    lines = ["John Smith London 1920", "15 04 1985 StMary John Smith 65 London żona Mary Smith synowie: Paul Smith, córki: Sarah Smith", "nothing here"]
    records = P.vital_records(spark.createDataFrame(list(enumerate(lines)), "id long, line string"))
    a, b = sorted(records.collect(), key=lambda r: r.id)
    assert (a.kind, a.first, a["last"], a.place, a.birth) == ("person", "John", "Smith", "London", 1920)
    assert (b.kind, b.death, b.spouse, b.children) == ("death", 1985, "Mary Smith", ["Paul Smith", "Sarah Smith"])
    people, edges = P.family_edges(records)
    assert {r.name for r in people.collect()} == {"Smith John", "Smith Mary", "Smith Paul", "Smith Sarah"}
    assert ("Smith Paul", "parent", "Smith John") in {tuple(e) for e in edges.collect()} and edges.count() == 6


def test_code(spark):
    code = "import os\nclass A:\n    def f(self, x=[]):\n        # c\n        return 'a#b', 0, 42\n"
    src = spark.createDataFrame([("p", code), ("bad", "def ("), ("none", None)], "path string, code string")
    f = P.code_functions(src).collect()
    assert len(f) == 1 and f[0].name == "f" and f[0].start_line == 3 and "'a#b'" in f[0].text and "# c" not in f[0].text
    assert {tuple(r) for r in P.code_graph(src).collect()} == {("p", "imports", "os"), ("p", "defines", "p::A"), ("p", "defines", "p::f"), ("p", "uses", "'a#b'"), ("p", "uses", "42")}
    found = R.scan(spark.createDataFrame([(1, code + "try:\n    pass\nexcept:\n    df.collect()\n")], "id long, text string"), R.CODE_RULES)
    assert {(r.rule, r.line) for r in found.collect()} == {("PY002", 3), ("PY003", 8), ("PS001", 9)}


def test_proximity(spark):
    spans = F.array(*(F.struct(F.lit(k).alias("label"), F.lit(t).alias("text"), F.lit(s).alias("start")) for k, t, s in [("LOC", "near", 120), ("LOC", "last", 400), ("LOC", "far", 401)]))
    person = F.struct(F.lit(100).alias("start"))
    assert one(spark, J.last_within(spans, person, "LOC", 300)) == "last"
    assert one(spark, J.last_within(spans, person, "LOC", 300, nearest=True)) == "near"
    assert one(spark, J.life_event(F.lit("was Born and died"))) == "born"


def test_ratio_join_is_whole(spark):
    a = spark.createDataFrame([(i, 1.0 + i * 0.37) for i in range(200)], "id long, value double")
    got = {(r.left_id, r.right_id) for r in J.within_ratio(a, a, 1.05, 1.5).collect()}
    v = {i: 1.0 + i * 0.37 for i in range(200)}
    assert got == {(i, j) for i in v for j in v if v[i] * 1.05 <= v[j] <= v[i] * 1.5}


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, t long")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k long, v string, t long")
    once = C.upsert(base, new, "k", "t")
    assert {tuple(r) for r in once.collect()} == {(1, "a", 0), (2, "d", 2), (3, "e", 1)}
    assert {tuple(r) for r in C.upsert(once, new, "k", "t").collect()} == {tuple(r) for r in once.collect()}


def test_notebook_mail_and_paths(spark, tmp_path):
    notebook = '{"cells":[{"cell_type":"markdown","source":["t"]},{"cell_type":"code","source":["a\\n","b"]},{"cell_type":"code","source":["c"]}]}'
    assert one(spark, files.notebook_code(F.lit(notebook))) == "a\nb\nc"
    (tmp_path / "m.mbox").write_text("From a\nSubject: =?utf-8?q?Caf=C3=A9?=\nFrom: A <a@x.org>\nTo: b@x.org, C <c@x.org>\nDate: Thu, 04 Jan 2024 10:00:00 +0000\n\nhello\nFrom b\nSubject: two\nFrom: b@x.org\nCc: a@x.org\n\nsecond body\n")
    m = {r.subject: r for r in files.mbox_scan(spark, str(tmp_path / "m.mbox")).collect()}
    assert set(m) == {"Café", "two"} and m["Café"].recipients == ["b@x.org", "c@x.org"] and m["two"].from_email == "b@x.org" and "second body" in m["two"].body
    paths = spark.createDataFrame([("a/x.log",), ("a/b/y.py",), (".git/z.py",), ("venv/q.py",), ("b/build/o.py",), ("c/build/o.py",)], "p string")
    kept = files.exclude_paths(paths, F.col("p"), files.ignore_patterns([("", "*.log"), ("b", "build/"), ("", "# note")]), ["venv"])
    assert {r.p for r in kept.collect()} == {"a/b/y.py", "c/build/o.py"}


def test_export_formats(spark, tmp_path):
    import pytest

    with pytest.raises(ValueError):
        sinks.export(spark.range(1), str(tmp_path / "x"), "xml")


def test_weak_labels_find_the_better_labeler(spark):
    import random

    r = random.Random(1)
    rows = [(t, r.random() < (0.9 if t else 0.1), r.random() < (0.85 if t else 0.1), r.random() < (0.6 if t else 0.5)) for t in (r.random() < 0.4 for _ in range(3000))]
    df = spark.createDataFrame(rows, "truth boolean, a boolean, b boolean, c boolean")
    fit = {x.labeler: x for x in A.weak_label_fit(df, {k: F.col(k) for k in "abc"}).collect()}
    assert fit["a"].on_yes > 0.8 > fit["c"].on_yes and abs(fit["a"].share - 0.4) < 0.08
