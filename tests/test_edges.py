"""Rules of operators on nulls, ties, repeats and long inputs, against plain loops."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import texts as X
from tessera.operators import aggregates as A
from tessera.operators import changes as C
from tessera.operators import joins as J
from tessera.operators import terms as T
from tessera.operators import windows as W
from tessera.streaming import streams as S


def test_terms_are_found_wherever_they_stand(spark, monkeypatch):
    docs = [(1, "aaaa the cat, the Cat sat at the cathedral"), (2, None), (3, ""), (4, "x" * 50_000 + "the cat" + "y" * 50_000), (5, "ünder thé the cat"), (5, "the cat")]
    terms = [(1, "the cat"), (2, "aa"), (3, "cat"), (4, "cat"), (5, None), (6, ""), (7, "thé"), (8, "(the|x)")]
    want = []
    for d, text in docs:
        for i, term in terms:
            at = (text or "").find(term) if term else -1
            while at >= 0:
                want.append((d, i, at, text[max(0, at - 30) : at + len(term) + 30]))
                at = text.find(term, at + len(term))
    for most in (200_000, 3):
        monkeypatch.setattr(T, "TERMS", most)
        got = T.term_occurrences(spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(terms, "id int, term string"), "doc", "id")
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    none = T.term_occurrences(spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame([], "id int, term string"), "doc", "id")
    assert none.collect() == []


def test_gaps_and_rest(spark):
    done = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 4), ("b", 2), ("c", 1), ("c", 2), ("c", 3), ("d", None), ("d", 0)], "k string, n int")
    assert {tuple(r) for r in W.first_gaps(done, "k", "n").collect()} == {("a", 3), ("b", 1), ("c", 4)}
    keys = spark.createDataFrame([("a",), ("a",), ("z",), ("c",)], "k string")
    assert {tuple(r) for r in W.remaining(done, keys, "k", "n", 3).collect()} == {("a", 3), ("z", 1), ("z", 2), ("z", 3)}


@pytest.mark.parametrize("most", [None, 0, 20])
def test_lags_by_blocks(spark, most):
    r = random.Random(5)
    a = [(t, r.choice([None, r.random()])) for t in range(-100, 300) if r.random() < 0.4] + [(7, 1.0), (None, 2.0)]
    b = [(t, r.random()) for t in range(50, 260) if r.random() < 0.5]
    rows = lambda x: spark.createDataFrame(x, "t long, v double")
    fine = [[(t, v) for t, v in x if t is not None and v is not None] for x in (a, b)]
    mean = [sum(v for _, v in x) / len(x) for x in fine]
    want = {}
    for t, v in fine[0]:
        for u, w in fine[1]:
            if most is None or abs(t - u) <= most:
                want[t - u] = want.get(t - u, 0.0) + (v - mean[0]) * (w - mean[1])
    for block in (32, 1 << 15):
        got = {x.lag: x for x in W.lag_correlation(rows(a), rows(b), most, block).collect()}
        assert {k: pytest.approx(x.corr, abs=1e-9) for k, x in got.items()} == want
        assert [k for k, x in got.items() if x.offset] == [max(want, key=lambda k: (round(want[k], 6), -k))]
    assert W.lag_correlation(rows([]), rows(b)).collect() == []


def test_smoothing_skips_what_is_no_measurement(spark):
    z = [None, 1.0, None, float("nan"), 2.0, float("inf"), 3.0, None]
    got = W.kalman_series(spark.createDataFrame([("s", i, v) for i, v in enumerate(z)] + [("t", 0, None)], "s string, t int, v double"), "s", "t", "v").collect()
    x, p, want = 0.0, 1.0, []
    for v in z:
        if v is not None and math.isfinite(v):
            p += 1e-4
            k = p / (p + 1e-2)
            x, p = x + k * (v - x), (1 - k) * p
        want.append(pytest.approx(x))
    assert [r.smooth for r in sorted(got, key=lambda r: r.t) if r.s == "s"] == want
    assert [r.smooth for r in got if r.s == "t"] == [0.0]


def test_range_search_gives_broken_rows_nothing(spark):
    items = [(1, 100.0, "a"), (2, None, "a"), (3, 0.0, "a"), (4, -5.0, "a"), (5, float("nan"), "a"), (6, 100.0, None), (None, 100.0, "a"), (7, 1e-300, "b"), (8, float("inf"), "b")]
    offers = [(i, v, "b") for i, v in ((10, 110.0), (11, None), (12, 0.0), (13, -1.0), (14, float("nan")), (None, 120.0))] + [(15, 120.0, None), (16, 130.0, "a"), (17, 149.0, "c")]
    frame = lambda x: spark.createDataFrame(x, "id long, value double, type string")
    got = J.range_topk(frame(items), frame(offers), 1.05, 1.5, F.lit(1), 5)
    assert {(r.left_id, r.right_id, r.place) for r in got.collect()} == {(1, 10, 1), (1, 17, 2)}
    assert J.range_topk(frame(items), frame([]), 1.05, 1.5, F.lit(1), 5).collect() == []


def test_follow_lists_are_cut_in_parts(spark):
    edges = [(i, 1) for i in range(2, 27)] + [(1, 3), (1, 2), (1, 2)]
    got = {(r.user, r.part): (r.following, r.followers) for r in C.follow_lists(spark.createDataFrame(edges, "src long, dst long"), 10).collect()}
    assert got[1, 0] == ([2, 3], list(range(2, 12))) and got[1, 1] == ([], list(range(12, 22))) and got[1, 2] == ([], list(range(22, 27)))
    assert got[2, 0] == ([1], [1]) and got[4, 0] == ([1], [])


def test_sketches_estimate_and_merge(spark):
    rows = spark.range(60_000).select((F.col("id") % 6).alias("day"), (F.col("id") * 7 % 20_000).alias("user"))
    s = A.distinct_sketches(rows, "day", "user")
    true = {r.day: r.n for r in rows.groupBy("day").agg(F.count_distinct("user").alias("n")).collect()}
    for r in A.distinct_total(s, "day").collect():
        assert abs(r.distinct - true[r.day]) <= 0.05 * true[r.day]
    assert abs(A.distinct_total(s).first().distinct - 20_000) <= 0.05 * 20_000


def test_progress_has_totals_and_items(spark):
    orders = [(1, i, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i), 100.0 + 10 * i) for i in range(12)]
    r = A.user_progress(spark.createDataFrame(orders, "o_custkey long, o_orderkey long, o_orderdate timestamp, o_totalprice double")).first()
    assert r.total_value == 12 * 100 + 10 * 66 and r["items"] == 12 and r.last_five == "11,10,9,8,7"
    assert r.recent_trades == "11:10.00,10:10.00,9:10.00,8:10.00,7:10.00" and r.current_items.split(",")[-1] == "2:120.00" and r.current_items.count(",") == 9


def test_board_sections_and_limits(spark):
    item = lambda i, kind, content=None, title=None, start=None, end=None: ("b", "Plan", i, i, kind, content, None, title, start, end)
    rows = [item(i, "shape", f"s{i}" if i != 1 else "  ") for i in range(52)] + [item(100 + i, "sticky_note", f"n{i}") for i in range(2)]
    rows += [item(200, "connector", start=0, end=100), item(201, "connector", start=0, end=999), item(202, "connector", start=2, end=300), item(300, "text", "a text of more than thirty characters in all")]
    rows += [item(400 + i, "frame", title=None if i else "first") for i in range(21)]
    columns = "board string, name string, id long, pos long, type string, content string, shape string, title string, start long, end long"
    got = X.board_digest(spark.createDataFrame([*rows, ("empty", None, 1, 1, "text", None, None, None, None, None)], columns)).collect()
    text = {r.board: r.digest for r in got}
    shapes = "\n".join(f"{i + 1}. [rectangle] s{i}" for i in range(50) if i != 1)
    frames = "\n".join(f"{i + 1}. {'Untitled Frame' if i else 'first'}" for i in range(20))
    head = "BOARD INFORMATION:\n- Name: Plan\n- Total Items: 79\n- Shapes: 52\n- Sticky Notes: 2\n- Connectors: 3\n- Frames: 21\n"
    assert text["b"] == f"{head}\nSHAPES:\n{shapes}\n... and 2 more shapes\n\nSTICKY NOTES:\n1. n0\n2. n1\n\nCONNECTIONS:\n1. 's0' --> 'n0'\n3. 's2' --> 'a text of more than thirty cha'\n\nFRAMES (Logical Groups):\n{frames}\n... and 1 more frames"
    assert text["empty"].endswith("- Frames: 0\n") and "Untitled" in text["empty"]


def test_learners_expire(spark, tmp_path):
    day = lambda n: datetime.datetime(2024, 1, n, 12)
    batches = [[(1, "t", day(1), 1, 5), (1, "t", day(1), 2, 4), (2, "t", day(2), 3, 1), (1, "t", day(2), 4, 4), (1, "t", day(2), 5, None)], [(3, "t", day(25), 6, 3)], [(1, "t", day(26), 7, 5)]]
    seen = []
    with S.with_state(spark):
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp, event_id long, grade int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = S.read(spark, f"{tmp_path}/in").withWatermark("ts", "1 hour")
            S.run(S.mastery(stream, forget_days=7), f"{tmp_path}/state", lambda b, i, n=n: seen.extend((n, tuple(r)) for r in b.collect()), "update")
    state = lambda n, user: [r for k, r in seen if k == n and r[0] == user]
    first = state(0, 1)[-1]
    assert (first[5], first[6], first[7], first[8], first[4]) == (3, 0, "review", datetime.date(2024, 1, 3), 15.0)
    assert state(0, 2)[-1][5:8] == (0, 1, "learning")
    expired = [r for _, r in seen if r[7] == "expired"]
    assert {r[0] for r in expired} == {1, 2} and all(r[9] is None for r in expired)
    again = state(2, 1)[-1]
    assert (again[5], again[4], again[9]) == (1, 1.0, 7)  # from the beginning


def test_every_code_rule_is_met(spark, sf):
    from tessera.functions import rules as R
    from tessera.plans.texts import d2_code

    found = {r.rule: r.n for r in d2_code(spark, sf).collect()}
    assert set(found) == set(R.CODE_RULES) and min(found.values()) > 100


def test_learners_come_as_rows(spark, tmp_path):
    """No table is made for a learner; equal times go by event_id, whatever the order of rows is."""
    ts = datetime.datetime(2024, 1, 1, 23, 59, 59, 999_999)
    rows = [(1, "t", ts, 9, 1), (1, "t", ts, 2, 5), (1, "t", ts, 3, 5), (1, None, ts, 4, 5), (2, "t", None, 5, 5)]
    spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp, event_id long, grade int").coalesce(1).write.parquet(f"{tmp_path}/in")
    seen, plans = [], []
    with S.with_state(spark):
        S.run(S.mastery(S.read(spark, f"{tmp_path}/in")), f"{tmp_path}/state", lambda b, n: (seen.extend(b.collect()), plans.append(S.mastery(b.sparkSession.readStream.schema("user_id long, event_type string, ts timestamp, event_id long, grade int").parquet(f"{tmp_path}/in"))._jdf.queryExecution().analyzed().toString())), "update")
    got = {r.event_type: r for r in seen}
    assert (got["t"].at, got["t"].right, got["t"].wrong, got["t"].event_id) == (ts, 0, 1, 9) and got[None].right == 1 and len(seen) == 2
    assert "Pandas" not in plans[0]


def test_unreadable_files_are_errors(spark, tmp_path):
    """A file whose bytes are not those of its checksum cannot be read: it is not left out."""
    from tessera.sources import files as P

    spark.createDataFrame([("one",), ("two",)], "value string").coalesce(1).write.text(f"{tmp_path}/a")
    (tmp_path / "b.txt").write_text("whole\n")
    assert P.file_scan(spark, str(tmp_path), [".txt"]).count() == 2
    next((tmp_path / "a").glob("part-*.txt")).write_text("six\nbytes\n")
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "true")
    try:
        for column, found in (("content", P.file_scan(spark, str(tmp_path), [".txt"])), ("line", P.file_lines(spark, str(tmp_path), [".txt"]))):
            with pytest.raises(Exception, match="(?i)checksum"):
                found.select(F.max(column)).collect()
    finally:
        spark.conf.unset("spark.sql.files.ignoreCorruptFiles")
