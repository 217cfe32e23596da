"""Work of queries over more rows than the smallest tables hold: repeated values, parts, plans."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import joins as J
from tessera.plans.registry import ORACLES, QUERIES

from .oracle import same


def test_copies_of_the_small_side_are_not_broadcast(spark):
    big = spark.range(1000).select((F.col("id") % 5).alias("k"), "id")
    small = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    joined = J.salted_join(big, small, "k", 8)
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 1000 and joined.filter("v <> 2 * k").isEmpty()


@pytest.mark.parametrize("size", [1, 2, 3])
def test_follow_lists_of_several_parts_are_whole(spark, sf, size):
    from tessera.plans.changes import g5_lists

    same(g5_lists(spark, sf, size), ORACLES["g5_follow_lists"], sf)


def test_repeated_values_are_searched_once(spark):
    """Offers of one value keep 2 k rows in the tree, whatever their number is."""
    rows = spark.range(5000).select("id", (F.col("id") % 5 * 10 + 100).cast("double").alias("value"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("type"), (F.col("id") % 7).alias("q"))
    assert J.RangeTree(rows, F.col("q"), 4).scored.count() == 5 * 8
    held = rows.collect()
    got = {(r.left_id, r.place): r.right_id for r in J.range_topk(rows, rows, 1.05, 1.5, F.col("q"), 4).collect()}
    for x in held[:40]:
        near = sorted((-y.q, y.id) for y in held if y.type != x.type and x.value * 1.05 <= y.value <= x.value * 1.5)[:4]
        assert [got.get((x.id, n + 1)) for n in range(len(near))] == [i for _, i in near]


@pytest.mark.parametrize("block, share", [(1, 1), (3, 4), (1024, 1024)])
def test_block_pairs(spark, block, share):
    rows = [(i, None if i % 11 == 0 else i % 3 * (i % 2), i * 7 % 20, None if i % 13 == 0 else "ab"[i % 2]) for i in range(60)]
    left = spark.createDataFrame(rows, "id long, k int, v long, t string")
    right = left.select("k", F.col("id").alias("id2"), F.col("v").alias("v2"), F.col("t").alias("t2"))
    same_key = [(x, y) for x in rows for y in rows if x[1] is not None and x[1] == y[1]]
    got = lambda **how: sorted((r.id, r.id2) for r in J.block_pairs(left, right, ["k"], block=block, share=share, **how).collect())
    assert got() == sorted((x[0], y[0]) for x, y in same_key)
    assert got(below=("v", "v2")) == sorted((x[0], y[0]) for x, y in same_key if x[2] < y[2])
    assert got(apart=("t", "t2")) == sorted((x[0], y[0]) for x, y in same_key if x[3] and y[3] and x[3] != y[3])


def test_pairs_of_one_key_are_spread_over_tasks(spark):
    from tessera.operators.scoring import other_category

    rows = spark.range(6000).select("id", (F.col("id") % 1).alias("k"), F.when(F.col("id") == 0, "a").otherwise("b").alias("kind"))
    pairs = other_category(rows, rows, ["k"], "kind")
    assert pairs.count() == 2 * 5999
    assert pairs.filter("item_kind = 'b'").select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_large_files_are_read_by_lines(spark, tmp_path):
    from tessera.sources import files as S

    (tmp_path / "a.txt").write_bytes("é\r\n\nend\n".encode() * 1000)
    (tmp_path / "b.TXT").write_bytes(b"no feed")
    lines = {r.path[-5:]: (r.n, r.size) for r in S.file_lines(spark, str(tmp_path), [".txt"]).groupBy("path").agg(F.count("*").alias("n"), F.first("length").alias("size")).collect()}
    assert lines == {"a.txt": (3000, 9000), "b.TXT": (1, 7)}
    assert S.file_lines(spark, str(tmp_path), [".txt"]).filter(F.col("line") == "é\r").count() == 1000
    (tmp_path / "c.txt").write_text("x\ny\n")
    (tmp_path / "d.csv").write_text("k\n1\n")
    for whole, rows in ((100, 3001), (1 << 20, 2)):
        got = S.load_documents(spark, str(tmp_path), whole).filter("kind = 'text'")
        assert got.count() == rows and got.agg(F.sum(F.char_length("text"))).first()[0] == 8004


def test_words_of_a_text_are_counted_on_arrays(spark):
    """Same values as counting word by word, in the column's rows; no fold row by row in the plan."""
    from tessera.functions import texts as X

    rows = spark.createDataFrame([(1, "a b a"), (2, None), (3, ""), (4, " \t"), (5, "b " * 5000 + "Ä"), (6, "x y z")], "id long, text string").coalesce(1)
    out = rows.filter("id > 1").select("id", X.embed_text(F.col("text"), 4).alias("v"))
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: r.v for r in out.collect()}
    slot = {(r.id, r.slot): r.n for r in rows.select("id", F.explode(X.words(F.lower("text"))).alias("w")).groupBy("id", F.pmod(F.xxhash64("w"), F.lit(4)).alias("slot")).agg(F.count("*").alias("n")).collect()}
    for i in (3, 4, 5, 6):
        counts = [float(slot.get((i, k), 0)) for k in range(4)]
        size = sum(x * x for x in counts) ** 0.5
        assert got[i] == [x / size if size else x for x in counts]
    assert set(got) == {2, 3, 4, 5, 6} and got[2] is None


def test_a_space_is_mapped_on_arrays(spark):
    from tessera.operators import topk as K

    rows = [(1, [3.0, 4.0]), (2, None), (3, [1.0]), (4, [None, 1.0]), (5, [0.0, 0.0]), (6, [1.0, 0.0, 2.0]), (7, [-1.0, 0.0]), (8, [])]
    out = spark.createDataFrame(rows, "id long, a array<double>").coalesce(1).filter("id <> 3 or size(a) = 1").select("id", K.apply_map(F.col("a"), [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]).alias("v"))
    assert "zip_with" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: r.v for r in out.collect()} == {1: [0.6, 0.8, 0.0], 7: [-1.0, 0.0, 0.0]} | dict.fromkeys((2, 3, 4, 5, 6, 8))


@pytest.mark.parametrize("counts", [200_000, 3])
def test_words_stay_with_their_text(spark, sf, monkeypatch, counts):
    """A small corpus goes to the texts: no shuffle by words.  A large one gives the same rows."""
    from tessera.functions import texts as X

    monkeypatch.setattr(X, "COUNTS", counts)
    same(out := QUERIES["i20_text_perplexity"](spark, sf), ORACLES["i20_text_perplexity"], sf)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert bool(re.search(r"Aggregate \[id#\d+L?, a#", plan)) == (counts == 3) and plan.count("strategy=broadcast") == (1 if counts == 3 else 3)


def test_pairs_are_counted_in_parts(spark, monkeypatch):
    """Tasks grow in number with the pairs, not in size, and no map of pairs is held before."""
    from tessera.operators import aggregates as A

    monkeypatch.setattr(A, "COUNTED", 100)
    mails = spark.range(300).select((F.col("id") % 150).cast("string").alias("sender"), F.array(F.lit("a"), F.lit("b"), F.lit("a")).alias("recipients"))
    out = A.pair_counts(mails, 900)
    assert out.rdd.getNumPartitions() == 9
    assert {(r.sender, r.recipient): r.n for r in out.collect()} == {(str(i), x): n for i in range(150) for x, n in (("a", 4), ("b", 2))}
    for name in ("d1_sender_recipient_counts", "f3_top_pairs"):
        assert "REPARTITION_BY_NUM" in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_graphs_are_gathered_once(spark):
    """One list of nodes and one of edges, whatever the formats are; graphs without nodes have no text."""
    from tessera.functions import parsing as P

    nodes = spark.createDataFrame([("g", "b", 'x"<', 2), ("g", "a", "y", 1), ("g", "c", None, 1), ("h", "d", "z", 1), (None, "e", "w", 1)], "graph string, id string, label string, pos int")
    edges = spark.createDataFrame([("g", "b", "a", 2), ("g", "a", "b", 1), ("k", "d", "d", 1), (None, "e", "e", 1)], "graph string, start string, end string, pos int")
    out = P.graph_texts(nodes, edges)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 2 and "Join" not in plan
    got = {r.graph: r for r in out.collect()}
    assert set(got) == {"g", "h", None}
    assert got["g"].mermaid == 'graph TD\n    a["y"]\n    b["x <"]\n    a --> b\n    b --> a'
    assert got["g"].json_schema == '{"nodes": [{"$id":"a","title":"y"},{"$id":"c"},{"$id":"b","title":"x\\"<"}], "edges": [{"from":"a","to":"b"},{"from":"b","to":"a"}]}'
    assert got["h"].types == "class d: z\n" and got[None].types == "class e: w\n" and "b" in got["g"].xmi


@pytest.mark.parametrize("name, most", [("b13_trade_score", 0.6), ("b14_listing_score", 0.3), ("b19_template_message", 11.5)])
def test_files_of_pairs_are_small(spark, sf, tmp_path, name, most):
    """Bytes of a Parquet file for each pair: the same right rows come again for each left row."""
    part, supplier = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("part", "supplier"))
    many = part.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(14)))).select(*(((F.col(c) + 200 * F.col("r")) * 47 % 3001).alias(c) if c == "p_partkey" else F.lit(7).alias(c) if c == "p_size" else c for c in part.columns))
    many.write.parquet(f"{tmp_path}/part.parquet")
    s = supplier.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(299))))
    s.select(*((F.col(c) + 10 * F.col("r")).alias(c) if c == "s_suppkey" else F.lit(7).alias(c) if c == "s_nationkey" else c for c in supplier.columns)).write.parquet(f"{tmp_path}/supplier.parquet")
    QUERIES[name](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    size = sum(f.stat().st_size for f in tmp_path.glob("out/*.parquet"))
    assert size < most * spark.read.parquet(f"{tmp_path}/out").count()
