import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tessera.llm.fingerprints import fingerprint  # noqa: E402
from tessera.llm.op07_quality import quality_rules  # noqa: E402

from .test_packing import holds  # noqa: E402
from .test_repeats import brute_words  # noqa: E402
from .test_simhash import brute_components  # noqa: E402


def fixture(spark, folder):
    r = random.Random(11)
    vocabulary = [f"word{i}" for i in range(3000)]
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    passage, long = text(60), text(3000)
    rows = [(i, text(80) + "\nShared line here\n" + text(40), "en", "a") for i in range(14)]
    rows += [(20, long, "en", "b"), (21, long, "en", "b"), (22, long + " tail", "en", "b")]
    rows += [(30 + i, text(70) + "\n" + passage + " \n" + text(30), "en", "c") for i in range(4)]
    rows += [(40, None, "en", "d"), (41, "", "en", "d"), (42, "few words", None, None), (43, "same " * 200, "en", "d"), (45, text(90), "en", "e"), (45, rows[0][1], "en", "f"), (46, rows[5][1], "en", "g"), (46, rows[5][1], "en", "g"), (None, text(120), "en", "h")]
    docs = [(d, t, lang, source, len(t) if t is not None else None) for d, t, lang, source in rows]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_stages_against_brute_force(spark, tmp_path):
    docs = fixture(spark, tmp_path)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: tuple(map(str, r))
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(x) for x in frame.collect()]
        columns = frame.columns
        out = stage(spark, frame, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{len(results)}")
        out = spark.read.parquet(f"{tmp_path}/{len(results)}")
        got = sorted((tuple(x) for x in out.collect()), key=key) if name != "packing" else out.collect()
        if name == "quality rules":
            kept = {(x.doc_id, x.n_words) for x in quality_rules(frame, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect() if x.kept}
            want = [x for x in before if (x[0], len((x[1] or "").split())) in kept]
            assert len(want) == len(docs) - 4
        elif name == "line dedup":
            want = []
            for d, t, lang, source, n in before:
                lines = t.split("\n")
                left = [x for x in lines if x != "Shared line here"]
                new = "\n".join(left)
                want.append((d, new, lang, source, len(new) if len(left) < len(lines) else n))
        elif name == "SimHash near-dedup":
            first = {d for d, _, c in brute_components([(x[0], x[1]) for x in before if x[0] not in (None, 45)], 5, 6) if d == c}
            want = sorted({x for x in before if x[0] in first or x[0] in (None, 45)}, key=key)
            assert 21 not in first and 22 not in first and 20 in first and fingerprint(b"", 5) == 0
        elif name == "substring dedup":
            cut = {(d, kept) for d, _, _, kept in brute_words([(x[0], x[1]) for x in before], 20)}
            assert {(x[0], " ".join(x[1].split())) for x in got} == cut
            clean = {x for x in before if (x[0], " ".join(x[1].split())) in cut}
            assert clean <= set(got) and all(x[4] == len(x[1]) for x in got)
            assert re.search(r"\S\n", got[0][1] + "\n")
            want = None
        else:
            texts = {x[0]: x[1] for x in before if x[0] != 45}
            holds([x for x in got if x.doc_id != 45], texts, 1024)
            want = None
        if want is not None:
            assert got == sorted(want, key=key), name
        if name != "packing":
            assert out.columns == columns
        results[name], frame = got, out
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(x.doc_id), x.start, x.length) for x in whole if x.start) == sorted((str(x.doc_id), x.start, x.length) for x in results["packing"] if x.start)
    assert {x.doc_id for x in whole} == {x.doc_id for x in results["packing"]}


def test_empty(spark, tmp_path):
    fixture(spark, tmp_path)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
    assert frame.collect() == []
