"""Quality rules: base counts, and compression bands of whole texts and fixed chunks.

Words are ``[^\\x20\\x09-\\x0D]+``.  Base counts per text: words, code points in
words, characters of ``[#*$%&|<>]``, lines (split at line feeds) that hold a word
and equal an earlier line, and words inside eight-word windows that occur twice
or more in the text.  A text fails the base rules with fewer than 20 words, or
with more than 30 % of its words in repeated windows.

The method: the zstandard ratio (bytes / compressed bytes) of the whole text must
lie in the band for its length, and chunks of ``CHUNK`` bytes, the last one as long
as what is left, that leave the band for theirs may hold at most ``BAD_CHUNKS`` of
its bytes.  A ratio above a band means repetition, below it text that does not
compress as language does.  The least ratio rises with the length; it lies above
that of random letters and digits, and below that of natural text.  Under some 128
bytes, where both are mostly the frame, it hardly tells them apart.

Defined cases: missing or empty text -> all counts 0, base_failed; a text of one
very long word is one word; repeated rows give repeated results; empty table ->
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from firmweave.llm.tables import map_batches
from firmweave.llm.wordhash import SPACE, Words, chunks, windows

LEVEL = 3
CHUNK = 4096
BAD_CHUNKS = 0.2
#: (bytes, least ratio), by the logarithm of the length between them.  Measured at
#: level 3, largest of 60 random texts of letters and digits in words, and smallest
#: of 3,341 good documents: 256 bytes 1.13 and 1.24, 512 bytes 1.22 and 1.40,
#: 1024 bytes 1.31 and 1.66, 4096 bytes 1.36 and 2.07, 8192 bytes 1.37 and 2.21
LEAST = (
    (64, 0.85), (128, 1.0), (256, 1.16), (512, 1.26), (1024, 1.42), (2048, 1.5), (4096, 1.6),
)
#: (bytes below which the limit holds, largest ratio)
MOST = ((256, 2.6), (1024, 3.2), (4096, 3.8), (16384, 4.2), (1 << 62, 5.0))
CHUNK_MOST = 3.8  # of a whole chunk
LEAST_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def dup_lines(raw: bytes) -> int:
    lines = raw.split(b"\n")
    if len(lines) < 2:
        return 0
    seen: set[bytes] = set()
    found = 0
    for line in lines:
        if line in seen:
            found += bool(line.split())
        else:
            seen.add(line)
    return found


def repeat_words(seen: np.ndarray, n_words: int) -> int:
    """Words covered by windows whose number occurs twice or more in ``seen``."""
    if len(seen) < 2:
        return 0
    order = np.argsort(seen, kind="stable")
    ranked = seen[order]
    equal = ranked[1:] == ranked[:-1]
    if not equal.any():
        return 0
    twice = np.zeros(len(seen), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    begun = np.zeros(n_words + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(begun, at, 1)
    np.add.at(begun, at + WINDOW, -1)
    return int((np.cumsum(begun)[:n_words] > 0).sum())


def base_counts(run: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
    """The base counts of each text, in the order of ``COUNTS``."""
    words = Words(run)
    buffer = words.buffer
    points = ((buffer & 0xC0) != 0x80) & ~SPACE[buffer]
    symbols = _SYMBOL[buffer]
    number = windows(words.number, WINDOW, 3)
    for i, raw in enumerate(run):
        a, b = int(words.offset[i]), int(words.offset[i + 1])
        first, last = int(words.first[i]), int(words.first[i + 1])
        n = last - first
        yield (
            n,
            int(np.count_nonzero(points[a:b])),
            int(np.count_nonzero(symbols[a:b])),
            dup_lines(raw),
            repeat_words(number[first : last - WINDOW + 1], n) if n > WINDOW else 0,
        )


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > REPEAT_PERCENT * n_words


def ratio(squeeze: zstandard.ZstdCompressor, raw: bytes) -> float:
    return len(raw) / len(squeeze.compress(raw))


def least_ratio(size: int) -> float:
    places, limits = zip(*LEAST, strict=True)
    return float(np.interp(np.log2(size), np.log2(places), limits))


LEAST_OF_CHUNK = least_ratio(CHUNK)


def chunk_in_band(raw: bytes, squeeze: zstandard.ZstdCompressor) -> bool:
    if len(raw) == CHUNK:
        return LEAST_OF_CHUNK <= ratio(squeeze, raw) <= CHUNK_MOST
    most = next(high for size, high in MOST if len(raw) < size)
    return least_ratio(len(raw)) <= ratio(squeeze, raw) <= most


def in_bands(raw: bytes, squeeze: zstandard.ZstdCompressor) -> tuple[bool, float]:
    """Whether a text that isn't empty lies within the bands, and its ratio."""
    whole = ratio(squeeze, raw)
    most = next(high for size, high in MOST if len(raw) < size)
    if not least_ratio(len(raw)) <= whole <= most:
        return False, whole
    if len(raw) <= CHUNK:
        return True, whole
    pieces = (raw[k : k + CHUNK] for k in range(0, len(raw), CHUNK))
    bad = sum(len(p) for p in pieces if not chunk_in_band(p, squeeze))
    return bad <= BAD_CHUNKS * len(raw), whole


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, ratio."""
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            rows = []
            for _, texts_of in chunks(batch.column(1).to_pylist()):
                for raw, counts in zip(texts_of, base_counts(texts_of), strict=True):
                    failed = base_failed(counts[0], counts[4])
                    kept, whole = in_bands(raw, squeeze) if raw else (False, 0.0)
                    rows.append((*counts, failed, kept and not failed, whole))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                names=["doc_id", *COUNTS, "base_failed", "kept", "ratio"],
            )

    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS)
    return map_batches(texts, run, schema + ", base_failed boolean, kept boolean, ratio double")
