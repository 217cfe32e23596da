import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.op03_packing import ByteTokenizer, best_fit, op3_packing, pack

ODD = ["", " ", "  a  b ", "\n\n a\t b\x00c", "①②ﬁ é é", "日本語 テスト 🙂🙂", "a​b 　 c", "x" * 5000, " " * 40 + "z", "\x1ca \x1c b\x85c", "it's we're I'LL", "tab\t\tx \r\n y", "end  ", "x <|endoftext|> y"]


def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_the_librarys(spark, sf):
    ours, theirs = ByteTokenizer(public_tokenizers.path("byte_bpe_50k.json")), library()
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for t in texts:
        assert list(memoryview(ours.encode(t)).cast("I")) == theirs.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("part", [" ", "\t", "\n", "x"])
def test_very_long_runs(part):
    ours, theirs = ByteTokenizer(public_tokenizers.path("byte_bpe_50k.json")), library()
    for text in (part * (2_000_000 // len(part)), "a word " + part * 19_999 + " end"):
        assert ours.encode(text) == b"".join(i.to_bytes(4, "little") for i in theirs.encode(text, add_special_tokens=False).ids)


def test_runs_just_below_the_switch_take_no_longer():
    import time

    ours, theirs = ByteTokenizer(public_tokenizers.path("byte_bpe_50k.json")), library()
    for unit in (" " * 19_999 + "x", "a" * 19_999 + " "):
        text, began = unit * 60, time.time()
        got = ours.encode(text)
        assert time.time() - began < 5
        assert got == b"".join(i.to_bytes(4, "little") for i in theirs.encode(text, add_special_tokens=False).ids)


def test_best_fit_takes_the_tightest_window():
    r = random.Random(2)
    lengths = [r.randrange(1, 101) for _ in range(700)]
    window, offset, count = best_fit(lengths, 100)
    # Plainly: of the windows with room, the one with the least room.
    room, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [c for c in room if c >= lengths[i]]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - lengths[i])
            want[i] = min(fits)
        else:
            room.append(100 - lengths[i])
            want[i] = 100
    assert count == len(room)
    assert {i: 100 - offset[i] for i in want} == want
    used = [0] * count
    for i in want:
        used[window[i]] += lengths[i]
    assert sorted(100 - u for u in used) == sorted(room)


def holds(rows, texts, size):
    """texts: (doc_id, text) as often as it stands in the table."""
    theirs = library()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for key, text in texts.items():
        ids = theirs.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(pieces.pop(key), key=lambda r: r.start)
        at = 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids)
            data = b"".join(i.to_bytes(4, "little") for i in ids[at : at + r.length])
            assert zlib.crc32(data) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    assert not pieces
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return sum(size - sum(n for _, n in parts) for parts in sequences.values()) / (size * len(sequences))


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert holds(op3_packing(spark, sf).collect(), texts, 1024) < 0.05


@pytest.mark.parametrize("size", [8, 1024])
def test_cases(spark, size):
    texts = dict(enumerate([*ODD, None, "word " * 30000]))
    docs = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id long, text string, ids int").repartition(3)
    from pyspark.sql import functions as F

    holds(pack(docs, window=size).withColumn("ids_crc32", F.crc32("ids")).collect(), texts, size)
    twice = docs.limit(0).union(spark.createDataFrame([(None, "a b", 1), (7, "a b", 1), (7, "a b", 1)], docs.schema))
    assert sorted((str(r.doc_id), r.length) for r in pack(twice).collect()) == [("7", 3), ("7", 3), ("None", 3)]
    assert pack(docs.limit(0)).collect() == []
