import random
import re
import string

import pytest
import zstandard

from firmweave.llm import compression
from tests.llm.samples import SF, awkward, none, sentence


def plain(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = set()
    for i, run in enumerate(runs):
        if runs.count(run) > 1:
            covered |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(re.search("[^\x20\x09-\x0d]", line))
        seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def check(docs):
    got = compression.quality_rules(docs).collect()
    want = {}
    for r in docs.select("doc_id", "text").collect():
        if r.text is None or len(r.text.split()) < 3000:
            want.setdefault(r.doc_id, []).append(plain(r.text))
    for r in got:
        if r.doc_id in want:
            assert tuple(r[1:6]) in want[r.doc_id]
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert len(got) == docs.count()


def test_base_counts(spark):
    rng = random.Random(1)
    twice = sentence(rng, 12)
    extra = [
        (40, f"{twice} middle {twice}", "a"), (41, "l 1 \nl 1 \n\n \n \nl 1 \nl 1", "a"),
        (42, "a b " * 30, "a"), (43, "#$% & <a>|* " * 3, "a"), (44, "   x\u0085y\x1cz", "a"),
    ]
    check(awkward(spark, extra))
    assert compression.quality_rules(none(spark)).count() == 0


def test_given_documents(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.mark.parametrize("text, kept", [
    ("the same words " * 300, False),
    ("".join(random.Random(2).choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/ ") for _ in range(3000)), False),
    (" ".join(sentence(random.Random(k), 9) + "." for k in range(60)), True),
])
def test_bands(text, kept):
    assert compression.in_bands(text.encode(), zstandard.ZstdCompressor(level=compression.LEVEL))[0] is kept


def random_words(rng, size):
    out = ""
    while len(out) < size:
        out += "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randrange(4, 12))) + " "
    return out[:size]


def test_random_words_of_any_length_are_rejected():
    squeeze = zstandard.ZstdCompressor(level=compression.LEVEL)
    for size in (200, 256, 400, 512, 900, 1024, 1500, 4000, 4096, 6000, 8100, 40_000):
        for seed in range(5):
            text = random_words(random.Random(seed), size)
            assert not compression.in_bands(text.encode(), squeeze)[0], (size, seed)


def test_random_half_or_tail_is_rejected(spark):
    squeeze = zstandard.ZstdCompressor(level=compression.LEVEL)
    long = max((r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1"), "doc_id").collect()), key=len)
    real, rng = long.encode()[:8192], random.Random(6)
    assert compression.in_bands(real[:4096], squeeze)[0] and compression.in_bands(real, squeeze)[0]
    for good, bad in ((4096, 4000), (2000, 2000), (8192, 4000), (4096, 2500)):
        assert not compression.in_bands(real[:good] + random_words(rng, bad).encode(), squeeze)[0], (good, bad)


def test_cuts_of_good_documents_stay(spark):
    """The limits of each length hold for natural text of it."""
    squeeze = zstandard.ZstdCompressor(level=compression.LEVEL)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    texts = [r.text.encode() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(labels, "doc_id").collect()]
    for size in (150, 256, 400, 700, 1024, 1500, 3000, 4096, 5000, 8192):
        cuts = [t[:size] for t in texts if len(t) >= size]
        assert cuts and sum(compression.in_bands(c, squeeze)[0] for c in cuts) >= 0.99 * len(cuts), size


def test_good_documents_stay(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = compression.quality_rules(docs).join(labels, "doc_id").where("quality = 1 AND NOT base_failed").collect()
    assert sum(r.kept for r in rows) >= 0.99 * len(rows)


def test_words_are_numbered_alike_in_any_blocks(monkeypatch):
    """Numbers do not depend on the block size, nor on words longer than a block."""
    from firmweave.llm import wordhash

    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abCé1.", k=rng.randint(1, 9))) for _ in range(n)).encode() for n in (0, 3, 4000)]
    texts += [b"x" * 70_000 + b" y " + b"z" * 5000, b"w" * 40_000]
    whole = [(w.number, w.prefix(4), w.first) for fold in (False, True) for w in [wordhash.Words(texts, fold)]]
    monkeypatch.setattr(wordhash, "BLOCK", 1 << 10)
    parts = [(w.number, w.prefix(4), w.first) for fold in (False, True) for w in [wordhash.Words(texts, fold)]]
    assert all((a == b).all() for x, y in zip(whole, parts) for a, b in zip(x, y))
    alone = [wordhash.Words([t]).number for t in texts]
    assert (whole[0][0] == [n for own in alone for n in own]).all()
