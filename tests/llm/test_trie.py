import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm import op11_trie
from tessera.llm.op11_trie import numbered_turns, op11_prefix_trie, prefix_trie, rebuilt

from .oracle import same


def brute(rows):
    """rows: conv_id, turn, role, text."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    base = lambda c: c - (c % 5 if c >= 0 else -(-c % 5))
    new = {c: (*own.get(base(c), [])[: h[c]], *own[c][h[c] :]) for c in own}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(new):
        for d in range(len(new[c]) + 1):
            members[new[c][:d]].append(c)
        ends[new[c]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1].encode()) if node else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(map(str, ((m[0], len(n), members[n[:-1]][0] if n else None, len(m), children[n], leaves[n], saved[n], sha(ends.get(n, []))) for n, m in members.items())))


def table():
    r = random.Random(6)
    common = ("user", "the first turn of a third of all conversations")
    rows = []
    for c in [*range(-12, 150), 10**12]:
        turns = [common] * (c % 3 == 0) + [(r.choice(["user", "assistant"]), r.choice(["a", "ä", "bb", ""])) for _ in range(r.choice([0, 1, 2, 5, 12]))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    rows += [(c, i, "user", f"copy {i}") for c in range(200, 260, 5) for i in range(12)]  # copies of a group's first, whole
    rows += [(c, i, "user", f"copy {i}") for c in range(261, 265) for i in range(30)] + [(270, i, "user", f"long {i}") for i in range(40)]
    rows += [(300, None, None, None), (300, None, "user", "x"), (300, 1, "b", "y"), (300, 1, "a", "z"), (300, 1, "a", "z"), (None, 1, "user", "no id"), (301, 0, "user", "w" * 100_000)]
    r.shuffle(rows)
    return rows


def test_cases(spark, monkeypatch):
    rows = table()
    want = brute(rows)
    held = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    held = held.withColumns({c: F.lit(1) for c in ("place", "id", "bytes", "level", "path", "shard", "root", "next", "sid", "h", "head", "base")})
    for span, shard_rows in ((256, 4096), (256, 9), (4, 11), (3, 4096)):
        monkeypatch.setattr(op11_trie, "SPAN", span)
        monkeypatch.setattr(op11_trie, "SHARD_ROWS", shard_rows)
        monkeypatch.setattr(op11_trie, "PIECE", 60)
        got = prefix_trie(*rebuilt(numbered_turns(held)))
        assert sorted(str(tuple(x)) for x in got.collect()) == want, (span, shard_rows)
    assert prefix_trie(*rebuilt(numbered_turns(held.limit(0)))).collect() == []
    alone = spark.createDataFrame([(1, 0, "user", "x")], held.select("conv_id", "turn", "role", "text").schema)  # loses its only turn
    assert [tuple(x)[:7] for x in prefix_trie(*rebuilt(numbered_turns(alone))).collect()] == [(1, 0, None, 1, 0, 1, 0)]


def test_sql(spark, sf):
    out = op11_prefix_trie(spark, sf)
    assert [t for _, t in out.dtypes] == ["bigint"] * 7 + ["string"]
    same(out, op11_trie.ORACLE, sf)
