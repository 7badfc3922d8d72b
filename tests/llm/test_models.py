import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmweave.llm import quality, toxicity
from tests.llm.samples import awkward, none

SF = "/root/testdata/sf0.1"


def fold(i, parts):
    return zlib.crc32(str(i).encode()) % parts


@pytest.mark.parametrize("run, label, parts, held", [
    (quality.classify, "quality", 3, 1), (toxicity.toxicity, "toxic", 5, 0),
])
def test_held_out_accuracy(spark, run, label, parts, held):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = run(docs, labels).join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", label).collect()
    assert all(r.held_out == (fold(r.doc_id, parts) == held) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    for of in (0, 1):
        own = [r for r in rows if r.held_out and r[label] == of]
        assert sum(r.predicted == of for r in own) >= 0.85 * len(own)


@pytest.mark.parametrize("run, label", [(quality.classify, "quality"), (toxicity.toxicity, "toxic")])
def test_awkward_rows_and_labels(spark, run, label):
    docs = awkward(spark)
    kind = f"doc_id long, {label} int, text string"
    one = spark.createDataFrame([(4, 1, "clash"), (4, 0, "clash"), (None, 0, ""), (5, None, ""), (77, 1, "")], kind)
    only = [spark.createDataFrame([(7, y, "clash")], kind) for y in (0, 1)]
    assert fold(7, 3) != 1 and fold(7, 5) != 0  # held out in neither
    for labels, score in ((one.limit(0), 0.5), (one, None), (only[0], 0.0), (only[1], 1.0)):
        rows = run(docs, labels).collect()
        assert len(rows) == docs.count()
        if score is not None:
            assert all(abs(r.score - score) < 1e-6 for r in rows)
        assert all(0 <= r.score <= 1 for r in rows)
    assert run(none(spark), one).count() == 0


def test_held_out_labels_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flipped = labels.withColumn(
        "quality",
        F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")),
    )
    one, two = (sorted((r.doc_id, r.score) for r in quality.classify(docs, x).collect()) for x in (labels, flipped))
    assert one == two


def test_offending_sentences_are_located():
    weight = np.zeros(1 << toxicity.BITS)
    text = "Ärger is here. You vile thing!\nAll is well."
    (number, sentence, _, _), = toxicity.sentences(["vile"])
    weight[number[0]] = 20
    model = toxicity.Model(weight, -8.0)
    (begin, end), = toxicity.offending(model, text)
    assert text[begin:end] == "You vile thing!"
    number, sentence, _, _ = next(toxicity.sentences([text]))
    assert model.score(number, sentence) > 0.99
    number, sentence, _, _ = next(toxicity.sentences([None]))
    assert model.score(number, sentence) == 0


def test_places_are_part_of_the_result(spark):
    """The sentences that the query names are those that the model finds offending, and no other."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    rows = toxicity.toxicity(docs, labels).join(docs.select("doc_id", "text"), "doc_id").collect()
    named = 0
    for r in rows:
        places = [tuple(map(int, p.split(":"))) for p in r.toxic_sentences.split(",") if p]
        assert len(places) == r.n_toxic_sentences
        assert not places or r.score >= 0.5
        if places and named < 50:
            assert places == toxicity.offending(model, r.text)
            assert all(model.score(*next(toxicity.sentences([r.text[a:b]]))[:2]) >= 0.5 for a, b in places)
            named += 1
    assert named > 20


def test_noisy_or_training_finds_the_words():
    """Only documents are labelled; the weight settles on the word they share."""
    rng = np.random.default_rng(1)
    texts, y = [], []
    for k in range(300):
        parts = [" ".join(f"w{rng.integers(60)}" for _ in range(6)) for _ in range(5)]
        y.append(k % 4 == 0)
        if y[-1]:
            parts[rng.integers(5)] += " vile"
        texts.append(". ".join(parts))
    model = toxicity.fit([f.astype(np.int32) for f in toxicity.features(texts)], np.array(y, np.int8))
    scores = [model.score(n, s) for n, s, _, _ in toxicity.sentences(texts)]
    assert all((s >= 0.5) == t for s, t in zip(scores, y, strict=True))


def test_dual_coordinate_descent_separates():
    rows = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])] * 5
    model = quality.fit(rows, np.array([1, 1, 0, 0] * 5, np.int8))
    assert [model.score(r) > 0.5 for r in rows[:4]] == [True, True, False, False]
