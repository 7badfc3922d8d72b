"""Token counts by a map-side two-tier lookup of pre-token lengths.

A text is cut at ASCII white space, which the tokenizer drops and never crosses,
so the tokens of a text are those of its pieces; a piece may hold several of the
tokenizer's pre-tokens ("word," is one of its own).  Tier one is a compact table of
the lengths of frequent pieces, found by counting pieces of all documents
map-side (a task forwards its ``TASK_PIECES`` most frequent ones, not the pieces)
and broadcast; it holds ``TABLE_PIECES`` entries whatever the input.  Tier two is
each worker's own cache of pieces that it had to encode.  Both only save work:
every length is what the tokenizer gives, whether or not it was looked up.  No text
is shuffled, and of the pieces only the ``TASK_PIECES`` a task that may enter the table.

Defined cases: missing or empty text -> 0 bytes, 0 tokens; special strings inside
a text count as the library has them by default; pieces longer than
``LONGEST_KEPT`` bytes are encoded each time, so that caches stay small.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from firmweave.llm.tables import map_batches

TASK_PIECES = 4096
TABLE_PIECES = 32768
#: distinct pieces a counting task holds before it drops the rarer half
COUNTED = 400_000
#: pieces in a worker's own cache before it starts anew
CACHED = 600_000
LONGEST_KEPT = 64
LIMIT = 2048

_TOKENIZERS: dict[str, object] = {}


def tokenizer(path: str):
    if path not in _TOKENIZERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _TOKENIZERS[path] = loaded
    return _TOKENIZERS[path]


def length_of(path: str, piece: bytes) -> int:
    text = piece.decode("utf-8", "replace")
    return len(tokenizer(path).encode(text, add_special_tokens=False).ids)


class Lengths(dict):
    """Piece -> tokens: the frequent ones, and those this worker has met."""

    def __init__(self, path: str, frequent: dict[bytes, int]):
        super().__init__(frequent)
        self.path, self.frequent = path, frequent

    def __missing__(self, piece: bytes) -> int:
        length = length_of(self.path, piece)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= CACHED:
                self.clear()
                self.update(self.frequent)
            self[piece] = length
        return length


def frequent_lengths(docs: DataFrame, path: str) -> dict[bytes, int]:
    """The table of tier one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    met.update(text.encode("utf-8").split())
                    if len(met) > COUNTED:
                        met = Counter(dict(met.most_common(COUNTED // 2)))
        top = [(p, n) for p, n in met.most_common(TASK_PIECES) if len(p) <= LONGEST_KEPT]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())],
            names=["piece", "n"],
        )

    top = (
        map_batches(docs.select("text"), count, "piece binary, n long")
        .groupBy("piece").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "piece").limit(TABLE_PIECES)
    )
    return {bytes(r.piece): length_of(path, bytes(r.piece)) for r in top.select("piece").collect()}


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    texts = docs.select(
        F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(texts, path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(path, table.value)
        at = lengths.__getitem__
        for batch in batches:
            raws = [t.encode("utf-8") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(r) for r in raws], pa.int64()),
                    pa.array([sum(map(at, r.split())) for r in raws], pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return map_batches(texts, count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
