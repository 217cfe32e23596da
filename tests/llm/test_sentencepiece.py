import hashlib

import public_tokenizers
import pytest

from tessera.llm.op08_sentencepiece import Agenda, op8_sentencepiece, sentencepiece_codes

from .test_packing import ODD

CASES = [*ODD, None, "▁x", "▁▁ y▁", "\n", "a\n\nb \n c", "zx" * 200 + " " * 70 + "the", "word " * 30000]


@pytest.fixture(scope="module")
def agenda():
    return Agenda(public_tokenizers.path("piece_bpe_32k.model"))


def want(agenda, text):
    ids = agenda.library.encode(text or "", add_bos=True, add_eos=True)
    return ids, agenda.library.decode(ids)


def test_agenda_is_the_librarys(agenda, spark, sf):
    texts = CASES + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    ids, decoded = agenda.encode(texts)
    for t, i, d in zip(texts, ids, decoded, strict=True):
        assert (list(memoryview(i).cast("I")), d.decode()) == want(agenda, t)
    assert agenda.differed == 0
    for word in {w for t in texts if t for w in t.split()[:50]}:
        chunk = "▁" + word[:300].replace("▁", "")
        assert agenda.by_heap(chunk).tolist() == agenda.library.encode(chunk[1:]) or chunk == "▁"


def test_a_difference_takes_the_librarys_ids(agenda, monkeypatch):
    other = Agenda(public_tokenizers.path("piece_bpe_32k.model"))
    other.table.rank[:] = other.table.rank[::-1].copy()
    ids, _ = other.encode(["the quick brown fox jumps over"])
    assert list(memoryview(ids[0]).cast("I")) == want(agenda, "the quick brown fox jumps over")[0]
    assert other.differed


def test_query_and_cases(agenda, spark, sf):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op8_sentencepiece(spark, sf).collect():
        ids, text = want(agenda, texts[r.doc_id])
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(data), sha(text.encode()))
    docs = spark.createDataFrame([(i % 5 or None, t, "e") for i, t in enumerate(CASES)], "doc_id long, text string, ids string")
    got = sorted((bytes(r.ids), r.decoded) for r in sentencepiece_codes(docs).collect())
    assert got == sorted((b"".join(i.to_bytes(4, "little") for i in ids), text) for ids, text in (want(agenda, t) for t in CASES))
    assert sentencepiece_codes(docs.limit(0)).collect() == []
