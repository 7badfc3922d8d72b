"""Quality classifier: naive Bayes support vectors on n-gram indicators.

Features are indicators of hashed n-grams: single words and pairs of words, and
runs of one to three word shapes.  A shape holds the kinds of characters in a
word, whether it begins with a capital, its length class and whether it repeats
the word before, so that style counts even in unseen vocabulary.  An indicator
is scaled by the log ratio of its smoothed frequencies in the two classes; rows
have unit length.  A linear model with hinge loss is then fit by dual coordinate
descent (each step solves one document's dual variable exactly), with a larger
bound for the rarer class.

The model is fit on at most ``EACH`` labelled documents per class outside the
held-out fold, taken in hash order from all labels; scoring covers every whole
text with the model's weights, a table of fixed size.

Defined cases: missing or empty text -> the score of the bias alone; no labels of
one of the classes -> every document gets that class's certain score (0.5 if
there are no labels); rows that repeat an id are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from firmweave.llm.tables import map_batches
from firmweave.llm.training import collect_features, fold_of, sampled_ids
from firmweave.llm.wordhash import U, Words, chunks, constants, mix

FOLDS, HELD_OUT = 3, 1
EACH = 3000
WORD_BITS, SHAPE_BITS = 17, 15
SIZE = (1 << WORD_BITS) + (1 << SHAPE_BITS)
SMOOTH = 1.0
BOUND = 1.0
PASSES = 15
STEEP = 4.0

_KIND = np.zeros(256, np.uint8)
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("a") : ord("z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 4
_KIND[list(b"#$%&*@^~_+=\\/")] = 8
_KIND[list(b".,;:'\"()-")] = 16
_KIND[list(b"!?")] = 32
_KIND[list(b"|<>{}[]`")] = 64
_KIND[128:] = 2


def _shapes(words: Words) -> np.ndarray:
    """A small number for each word."""
    kinds = np.bitwise_or.reduceat(_KIND[words.buffer], words.start).astype(np.int64)
    capital = _KIND[words.buffer[words.start]] == 1
    length = np.minimum((words.end - words.start) // 6, 3)
    again = np.zeros(len(kinds), bool)
    again[1:] = words.number[1:] == words.number[:-1]
    return kinds | (capital.astype(np.int64) << 8) | (again.astype(np.int64) << 9) | (length << 10)


def _grams(number: np.ndarray, n: int, bits: int, seed: int) -> np.ndarray:
    """Hashed runs of ``n`` numbers; run ``i`` begins at place ``i``."""
    factors = constants(n, seed)
    size = max(0, len(number) - n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(size, U)
        for k in range(n):
            total += number[k : k + size] * factors[k]
        return (mix(total) >> U(64 - bits)).astype(np.int64)


def features(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The distinct features of each text, sorted."""
    for _, run in chunks(texts):
        words = Words(run)
        if not len(words.start):
            yield from (np.zeros(0, np.int64) for _ in run)
            continue
        shapes = mix(_shapes(words).astype(U) + U(77))
        grams = [(_grams(words.number, n, WORD_BITS, 70 + n), n) for n in (1, 2)]
        grams += [(_grams(shapes, n, SHAPE_BITS, 80 + n) + (1 << WORD_BITS), n) for n in (1, 2, 3)]
        met = np.zeros(SIZE, bool)
        for i in range(len(run)):
            first, last = int(words.first[i]), int(words.first[i + 1])
            own = [g[first : max(first, last - n + 1)] for g, n in grams]
            for g in own:
                met[g] = True
            if last - first > 4000:
                found = np.flatnonzero(met)
            else:  # cheaper than a look at the whole table
                found = np.unique(np.concatenate(own))
            yield found
            met[found] = False


class Model:
    """Weights by feature, ratios of the length normalisation, bias."""

    def __init__(self, ratio: np.ndarray, weight: np.ndarray, bias: float):
        self.square = (ratio * ratio).astype(np.float32)
        self.weight = (ratio * weight).astype(np.float32)
        self.bias = bias

    def score(self, found: np.ndarray) -> float:
        length = float(np.sqrt(self.square[found].sum())) or 1.0
        margin = float(self.weight[found].sum()) / length + self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(STEEP * margin, -50, 50))))


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """Log-count ratios, then dual coordinate descent on the scaled rows."""
    counts = np.full((2, SIZE), SMOOTH)
    for found, label in zip(rows, y, strict=True):
        counts[label][found] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    ratio = np.log(shares[1] / shares[0])
    if len(np.unique(y)) < 2:
        sign = 0.0 if not len(y) else (1.0 if y[0] else -1.0)
        return Model(np.zeros(SIZE), np.zeros(SIZE), 10.0 * sign)
    share = y.mean()
    bound = np.where(y == 1, BOUND * 0.5 / share, BOUND * 0.5 / (1 - share))
    sign = np.where(y == 1, 1.0, -1.0)
    scaled = []
    for found in rows:
        value = ratio[found]
        length = np.sqrt((value * value).sum()) or 1.0
        scaled.append(value / length)
    weight, bias = np.zeros(SIZE), 0.0
    dual = np.zeros(len(rows))
    order = np.random.default_rng(7)
    for _ in range(PASSES):
        moved = 0.0
        for i in order.permutation(len(rows)):
            found, value = rows[i], scaled[i]
            slope = sign[i] * (weight[found] @ value + bias) - 1
            norm = value @ value + 1.0
            new = min(max(dual[i] - slope / norm, 0.0), bound[i])
            step = (new - dual[i]) * sign[i]
            if step:
                weight[found] += step * value
                bias += step
                dual[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return Model(ratio, weight, bias)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", each: int = EACH) -> Model:
    ids = sampled_ids(labels, label, FOLDS, HELD_OUT, each)
    return fit(*collect_features(docs, ids, features))


def _scored(df: DataFrame, model: Model) -> DataFrame:
    """Column ``score`` for a frame of (doc, text)."""
    model = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.value.score
        for batch in batches:
            found = [score(f) for f in features(batch.column("text").to_pylist())]
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(found, pa.float64())], names=[*batch.schema.names[:-1], "score"]
            )

    schema = df.drop("text").schema.add("score", "double")
    return map_batches(df, run, schema)


def classify(docs: DataFrame, labels: DataFrame, each: int = EACH) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, each=each)
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _scored(texts, model).select(
        "doc_id",
        F.coalesce(fold_of("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, each: int = EACH) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    model = train(docs, labels, each=each)
    packed = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"),
        F.col("text").cast("string").alias("text"),
    )
    return _scored(packed, model).where("score >= 0.5").select("doc.*")
