import pytest

from firmweave.llm import token_counts
from tests.llm.samples import SF, awkward, none

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def check(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    want = {}
    for r in docs.select("doc_id", "text").collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want.setdefault(r.doc_id, set()).add((len((r.text or "").encode()), n, n > 2048))
    got = token_counts.token_counts(docs, PATH).collect()
    assert len(got) == docs.count()
    assert all(tuple(r[1:]) in want[r.doc_id] for r in got)


def test_awkward_rows(spark):
    texts = [
        "<|endoftext|> a<|startoftext|>b <|endoftext|", "İstanbul ΣΑΣ ſtraße Å é é ́x", "it's we'll 's't",
        "tab\tnew\nline\x0bvt\x0cff\x85nel nbsp ls\x1cfs", "漢字かな 한국어 한 😀👍🏽", "12345 x1y2 !!??",
        "a" * 200 + " " + "b" * 70,
    ]
    check(awkward(spark, [(50 + k, t, "a") for k, t in enumerate(texts)]))
    assert token_counts.token_counts(none(spark), PATH).count() == 0


def test_given_documents(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "TASK_PIECES", 300)
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED", 5)
    lengths = token_counts.Lengths(PATH, {b"the": 1})
    pieces = [b"w%d" % k for k in range(40)] + [b"the"]
    assert [lengths[p] for p in pieces] == [token_counts.length_of(PATH, p) for p in pieces]
    assert len(lengths) <= 6
