import random
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from firmweave.llm import jaccard
from firmweave.llm.wordhash import Words, windows
from tests.llm.samples import SF, awkward, collected, none, sentence

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UPPER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def plain(rows):
    """Components by all pairs; rows of one id are one document."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if None in (a, b) or not x or not y:
                continue
            if 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return sorted(((d, len(s), None if d is None else root(d)) for d, s in sets), key=repr)


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def made(seed=5):
    rng = random.Random(seed)
    rows, doc = [], 100
    for size in (3, 5, 6, 9, 14, 30, 80, 200, 700, 1500):
        for _ in range(3):
            base = sentence(rng, size)
            passage = sentence(rng, 60)
            rows.append((doc, base))
            for k in range(6):
                doc += 1
                rows.append((doc, edited(rng, base, rng.randrange(1 + size // 40) + (k % 2))))
            doc += 1
            rows.append((doc, base.upper()))
            doc += 1
            rows.append((doc, base + " " + sentence(rng, max(1, size // 5))))
            doc += 1
            rows.append((doc, sentence(rng, size) + " " + passage))
            doc += 1
    rng.shuffle(rows)
    return rows


def test_components_against_all_pairs(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert collected(jaccard.jaccard_join(docs)) == plain(rows)


def test_no_link_is_lost_when_everything_is_frequent(spark, monkeypatch):
    """Tables of frequent shingles and near copies of one text do not change the result."""
    monkeypatch.setattr(jaccard, "OFTEN", 2)
    rng = random.Random(8)
    base = sentence(rng, 120)
    rows = [(k, edited(rng, base, rng.randrange(6))) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert collected(jaccard.jaccard_join(docs)) == plain(rows)


def test_awkward_rows(spark):
    docs = awkward(spark, [(30, "same words here now", "a"), (9, "other text of this id", "a")])
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert collected(jaccard.jaccard_join(docs)) == plain(rows)
    assert jaccard.jaccard_join(none(spark)).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.select("doc_id").collect()), key=repr)
    assert ids == sorted([1, 2, 3, 4, 5, 6, 8, 9, 9, None], key=repr)


def test_one_of_a_group_whatever_the_order(spark):
    """An id with unlike texts keeps them all; equal rows keep one; the choice is fixed."""
    rng = random.Random(5)
    base, other, third = (sentence(rng, 60) for _ in range(3))
    rows = [
        (1, base, "a"), (1, other, "b"), (1, other, "a"),  # unlike texts; one of them twice
        (2, edited(rng, other, 1), "a"),                   # goes: linked with 1's second text
        (3, third, "a"), (3, edited(rng, third, 1), "b"),  # linked with each other
        (4, "few words", "a"), (4, None, "a"), (4, "", "a"), (None, base, "a"), (None, base, "a"),
        (2**63 - 1, edited(rng, base, 1), "c"),
    ]
    seen = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(1 + 2 * seed)
        seen.add(tuple(collected(jaccard.keep_one(docs))))
    (kept,) = seen
    assert sorted((r[0], r[2]) for r in kept if r[0] is not None) == [
        (1, "a"), (1, "a"), (3, kept[[r[0] for r in kept].index(3)][2]),
        (4, "a"), (4, "a"), (4, "a")]
    assert {r[1] for r in kept if r[0] == 1} == {base, other}
    assert len([r for r in kept if r[0] is None]) == 2


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert collected(jaccard.jaccard_join(docs)) == plain(rows)


sets = st.sets(st.integers(0, 400), min_size=1, max_size=90)


@settings(max_examples=300, deadline=None)
@given(sets, st.integers(0, 12), st.integers(0, 12), st.randoms())
def test_linked_sets_meet_in_a_probed_key(base, drop, add, rng):
    """The pigeonhole argument: linked sets share a key that one of them probes."""
    other = set(base)
    for x in rng.sample(sorted(base), min(drop, len(base) - 1)):
        other.discard(x)
    other |= {1000 + k for k in range(add)}
    both = len(base & other)
    if 100 * both < 80 * len(base | other):
        return
    frequent = np.sort(windows(np.arange(100, 250, dtype=np.uint64), 1, 1))
    found = []
    for s in (base, other):
        numbers = np.unique(windows(np.array(sorted(s), np.uint64), 1, 1))
        keys, probes = jaccard.keys_of(numbers, frequent=frequent)
        found.append((set(keys.tolist()), set(keys[probes].tolist())))
    (x, px), (y, py) = found
    assert (px & y) or (x & py)


@settings(max_examples=100, deadline=None)
@given(sets, sets)
def test_sketch_never_exceeds_the_difference(a, b):
    sketches = [
        jaccard.sketch_of(np.unique(windows(np.array(sorted(s), np.uint64), 1, 1))) for s in (a, b)
    ]
    apart = int(np.bitwise_count((sketches[0] ^ sketches[1]).view(np.uint64)).sum())
    assert apart <= len(a ^ b)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab \n\téA", max_size=30), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    raw = [t.encode() for t in texts]
    words = Words(raw, fold=True)
    flat = [w for t in texts for w in re.findall("[^\x20\x09-\x0d]+", t.translate(UPPER))]
    assert len(words.number) == len(flat)
    names = {}
    for number, word in zip(words.number.tolist(), flat, strict=True):
        assert names.setdefault(number, word) == word
    assert len(set(names.values())) == len(names)
