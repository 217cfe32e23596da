import collections

import pytest

from tessera.llm import op05_lines
from tessera.llm.op05_lines import line_dedup

from .oracle import same


def test_sql(spark, sf):
    same(op05_lines.op5_line_dedup(spark, sf), op05_lines.ORACLE, sf)


def brute(rows, at_least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    seen = collections.defaultdict(set)
    for d, t, _ in rows:
        for line in (t or "").split("\n"):
            if d is not None:
                seen[key(line)].add(d)
    often = {k for k, v in seen.items() if k and len(v) >= at_least}
    out = []
    for d, t, x in rows:
        lines = (t or "").split("\n")
        kept = [line for line in lines if key(line) not in often]
        out.append((d, x, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [10, -1])
def test_cases(spark, limit):
    rows = [(i, f"Same LINE\n own {i}\n\n\tsame line \r\nÉcole\n", "e") for i in range(9)]
    rows += [(9, "same line", "x"), (9, "two\nsame line", "y"), (9, "same line", "x"), (None, "same line\nother", "n"), (10, None, None), (11, "", "e"), (12, "\n\n", "e"), (13, "same line\n" * 3000 + "end", "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = line_dedup(docs, min_docs=10, broadcast_hashes=limit).collect()
    assert sorted(((r.row.doc_id, r.row.kept, r.lines.n_lines, r.lines.n_dropped, r.lines.kept) for r in got), key=str) == brute(rows, 10)
    assert line_dedup(docs.limit(0)).collect() == []
