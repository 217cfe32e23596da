"""Every operator and stage on a table whose other columns carry names used inside."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import near, op01_substring, op02_licenses, op03_packing, op04_simhash, op05_lines, op06_topk, op07_quality, op08_sentencepiece, op09_suffix, op10_lm

corpus_pipeline = pytest.importorskip("corpus_pipeline")

NAMES = "lines row twin extra block bucket kept words fp pos drop key h1 h2 salt version sid label node score rank n ids text_hash held_out vec_id_2".split()


@pytest.fixture(params=["lower", "upper"])
def table(request, spark):
    text = " ".join(f"word{i}" for i in range(90))
    rows = [(i, f"{text}\nShared line\nown{i} " + " ".join(f"x{i}y{k}" for k in range(80))) for i in range(12)]
    rows += [(20, rows[3][1]), (20, rows[3][1]), (21, None), (22, ""), (None, rows[4][1]), (23, "few words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    others = [F.lit(77 + i).alias(getattr(n, request.param)()) for i, n in enumerate(NAMES)]
    docs = docs.select(*others[:9], "doc_id", F.lit("en").alias("lang"), "text", F.lit(None).cast("string").alias("source"), F.char_length("text").cast("bigint").alias("n_chars"), *others[9:], F.array(F.lit(1)).alias("list"), F.create_map(F.lit("a"), F.lit(1)).alias("map"))
    return docs, docs.select("doc_id", "text")


def test_operators(spark, table):
    whole, plain = table
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    operators = [
        op01_substring.substring_dedup,
        op02_licenses.license_scan,
        op04_simhash.simhash_components,
        near.similar_components,
        lambda d: op05_lines.line_dedup(d).select("row.doc_id", "lines.*"),
        lambda d: op07_quality.quality_rules(d, labels),
        op08_sentencepiece.sentencepiece_codes,
        op09_suffix.suffix_dedup,
        op10_lm.lm_scores,
    ]
    for operator in operators:
        assert sorted(map(str, operator(whole).collect())) == sorted(map(str, operator(plain).collect()))
    assert sorted(str((r.doc_id, r.start, r.ids)) for r in op03_packing.pack(whole).collect()) == sorted(str((r.doc_id, r.start, r.ids)) for r in op03_packing.pack(plain).collect())
    vectors = whole.withColumns({"vec_id": F.col("doc_id"), "embedding": F.array(F.lit(1.0), F.col("doc_id").cast("double"))})
    asked = F.col("vec_id") % 10 == 0
    assert sorted(map(str, op06_topk.exact_topk(vectors, asked).collect())) == sorted(map(str, op06_topk.exact_topk(vectors.select("vec_id", "embedding"), asked).collect()))


def test_stages(spark, table, tmp_path):
    docs, _ = table
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kinds = dict(docs.dtypes)
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert dict(out.dtypes) == kinds and out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        if name != "packing":
            for r in docs.collect():
                values = r.asDict()
                assert all(values[c] == 77 + i for i, c in enumerate(x for x in docs.columns if x.lower() in NAMES)), name
    assert docs.collect()
