"""Toxicity by multiple-instance learning: sentences combined by noisy-or.

A document is a bag of sentences (cut after ``.!?`` and line feeds).  A sentence's
chance of being toxic is a logistic function of the summed weights of its words;
the document's is one minus the product of the sentences' chances of being clean.
Only document labels are seen in training: the gradient reaches each sentence by
its share in the document's chance, so weights settle on the words that tell
labelled documents apart, and the same weights then locate offending sentences.
Weights are kept sparse by an L1 term, and features of fewer than ``LEAST_DOCS``
sampled documents have none.

Words are runs of letters and digits, A-Z lower-cased.  The features of a word are
itself and its beginnings of ``STEMS`` bytes, which stand in for its stem, so that
unseen endings still count; all are held as hashed numbers.  The model is fit on at most ``EACH`` labelled documents per class
outside the held-out fold, in hash order from all labels; scoring covers every
whole text.

Defined cases: missing or empty text, or one without words -> score 0; labels of one
class only -> every document, empty ones too, gets that class's certain score, and
without labels 0.5; no sentence is located then; rows that repeat an id are scored one
by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from firmweave.llm.tables import map_batches
from firmweave.llm.training import collect_features, fold_of, sampled_ids
from firmweave.llm.wordhash import U, Words, chunks, mix

FOLDS, HELD_OUT = 5, 0
EACH = 1500
BITS = 20
STEMS = (4, 5)
LEAST_DOCS = 4
SPARSE = 2e-4
STEPS = 150
RATE = 0.3
BIAS = -8.0

_CUT = np.zeros(256, bool)
_CUT[list(b".!?\n")] = True
_LETTERS = np.ones(256, bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _LETTERS[_low:_high] = False


def sentences(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """For each text: features, the sentence and byte place of each, and the text."""
    for _, run in chunks(texts):
        words = Words(run, fold=True, space=_LETTERS)
        sentence = np.cumsum(_CUT[words.buffer])[words.start] if len(words.start) else np.zeros(0, int)
        kinds = [words.number, *(mix(words.prefix(k) + U(k)) for k in STEMS)]
        number = np.stack([(n >> U(64 - BITS)).astype(np.int64) for n in kinds], axis=1).ravel()
        sentence, start = np.repeat(sentence, len(kinds)), np.repeat(words.start, len(kinds))
        for i, raw in enumerate(run):
            own = slice(int(words.first[i]) * len(kinds), int(words.first[i + 1]) * len(kinds))
            yield number[own], sentence[own], start[own] - words.offset[i], raw


def features(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Features of each text, the first of each sentence marked by a minus sign."""
    for number, sentence, _, _ in sentences(texts):
        first = np.ones(len(sentence), bool)
        first[1:] = sentence[1:] != sentence[:-1]
        yield np.where(first, -number - 1, number)


class Model:
    def __init__(self, weight: np.ndarray, bias: float, constant: float | None = None):
        """``constant``: the score of every text, where the labels know one class at most."""
        self.weight, self.bias, self.constant = weight.astype(np.float32), bias, constant

    def chances(self, number: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of the sentences that hold words, and the first word of each."""
        if not len(number):
            return np.zeros(0), np.zeros(0, int)
        first = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
        return np.add.reduceat(self.weight[number].astype(float), first) + self.bias, first

    def score(self, number: np.ndarray, sentence: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        logit, _ = self.chances(number, sentence)
        return float(-np.expm1(-np.logaddexp(0, logit).sum()))


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    size = 1 << BITS
    if len(np.unique(y)) < 2:
        return Model(np.zeros(size), BIAS, 0.5 if not len(y) else float(y[0]))
    held = [r for r in rows if len(r)]
    label = y[[len(r) > 0 for r in rows]].astype(float)
    seen = np.zeros(size, np.int32)
    for row in held:
        seen[np.unique(np.where(row < 0, -row - 1, row))] += 1
    often = np.flatnonzero(seen >= LEAST_DOCS)
    place = np.full(size, -1, np.int32)
    place[often] = np.arange(len(often), dtype=np.int32)
    # features of enough documents: their column and their sentence, numbered over all rows
    column, sentence, doc_of, begun = [], [], [], 0
    for k, row in enumerate(held):
        own = place[np.where(row < 0, -row - 1, row)]
        at = np.cumsum(row < 0, dtype=np.int32) - 1 + begun
        column.append(own[own >= 0])
        sentence.append(at[own >= 0])
        doc_of.append(np.full(int(at[-1]) + 1 - begun, k, np.int32))
        begun = int(at[-1]) + 1
    column, sentence, doc_of = (np.concatenate(x) for x in (column, sentence, doc_of))
    importance = np.where(label == 1, 0.5 / max(label.mean(), 1e-9), 0.5 / max(1 - label.mean(), 1e-9))
    importance /= len(label)
    weight, bias = np.zeros(len(often)), BIAS
    speed, bias_speed = np.full(len(often), 1e-8), 1e-8
    for _ in range(STEPS):
        logit = np.bincount(sentence, weights=weight[column], minlength=begun) + bias
        whole = np.bincount(doc_of, weights=np.logaddexp(0, logit), minlength=len(held))
        slope = np.where(label == 1, -1 / np.expm1(np.clip(whole, 1e-6, 50)), 1.0)
        each = (importance * np.clip(slope, -50, 50))[doc_of] / (1 + np.exp(-np.clip(logit, -50, 50)))
        gradient = np.bincount(column, weights=each[sentence], minlength=len(weight))
        speed += gradient**2
        step = RATE / np.sqrt(speed)
        weight -= step * gradient
        weight = np.sign(weight) * np.maximum(np.abs(weight) - step * SPARSE, 0)
        total = each.sum()
        bias_speed += total**2
        bias -= RATE * total / np.sqrt(bias_speed)
    full = np.zeros(size)
    full[often] = weight
    return Model(full, bias)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", each: int = EACH) -> Model:
    ids = sampled_ids(labels, label, FOLDS, HELD_OUT, each)
    return fit(*collect_features(docs, ids, features))


def offending(model: Model, text: str | None, least: float = 0.5) -> list[tuple[int, int]]:
    """Code-point places (begin, end) of the sentences with a chance of ``least`` or more."""
    (number, sentence, start, raw), = sentences([text])
    logit, first = model.chances(number, sentence)
    return _places(raw, start[first[1 / (1 + np.exp(-logit)) >= least]])


def _places(raw: bytes, begins: np.ndarray) -> list[tuple[int, int]]:
    """The sentences whose first words stand at these bytes, as code points."""
    if not len(begins):
        return []
    cuts = np.flatnonzero(_CUT[np.frombuffer(raw, np.uint8)])
    found, at, seen = [], 0, 0
    for begin in begins.tolist():
        k = np.searchsorted(cuts, begin)
        end = int(cuts[k]) + 1 if k < len(cuts) else len(raw)
        seen += len(raw[at:begin].decode())
        size = len(raw[begin:end].decode())
        found.append((seen, seen + size))
        at, seen = end, seen + size
    return found


def toxicity(docs: DataFrame, labels: DataFrame, each: int = EACH) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, and its offending sentences.

    These are sentences with a chance of a half or more: their number
    (n_toxic_sentences) and places (toxic_sentences: ``begin:end`` in code points, ends
    exclusive, joined by commas).
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, each=each))
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, counts, places = [], [], []
            fixed = model.value.constant
            for number, sentence, start, raw in sentences(batch.column(1).to_pylist()):
                logit, first = model.value.chances(number, sentence)
                known = -np.expm1(-np.logaddexp(0, logit).sum()) if fixed is None else fixed
                found = _places(raw, start[first[logit >= 0]])
                scores.append(float(known))
                counts.append(len(found))
                places.append(",".join(f"{a}:{b}" for a, b in found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()),
                 pa.array(places, pa.string())],
                names=["doc_id", "score", "n_toxic_sentences", "toxic_sentences"],
            )

    columns = f"doc_id {kind}, score double, n_toxic_sentences long, toxic_sentences string"
    return map_batches(texts, run, columns).select(
        "doc_id",
        F.coalesce(fold_of("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_toxic_sentences",
        "toxic_sentences",
    )
