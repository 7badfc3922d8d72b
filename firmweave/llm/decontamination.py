"""Benchmark decontamination with spaced seeds (native DataFrame functions only).

A seed is the hash of the words of a window at the positions a fixed mask keeps;
masked-out positions may differ, so a passage with substituted words still has
windows that agree.  Words are runs of letters, digits and non-ASCII characters,
lower-cased.

1. The seeds of all benchmark windows and masks, and the pairs of adjacent words
   that every mask begins with, set bits of one bit table.  It has ``PER_SEED`` bits a
   seed, within 2**``BITS`` (128 KB) and 2**``MOST_BITS`` (1 MB): a benchmark of some
   100,000 items of 15 words fits; a larger one fills the table, and the join does more.
2. In each document row, positions whose word pair and then whose seed are in the
   bit table remain; only these leave the row, as (doc_id, place, seed).
3. They are joined with the benchmark's seeds, and reduced map-side to one row per
   document, item and diagonal (place in the document minus place in the item).
4. The documents so found are read again, and each diagonal is verified on the
   words themselves: the best run of aligned words, +1 for equal and -2 for
   different ones, must reach the score asked for.

By default that is ``LEAST_SCORE`` for all items.  With ``least=None``, as in the
query and the pipeline, it depends on the item's length (``asked``): 40 % of its
words, within 6 and ``LEAST_SCORE``; and an item of 9 words or more is also found where
all but a fifth of its words stand in their places, however the others are spread.
Items below 15 words then have two further masks, so that those of 9 to 14 words with
a fifth of their words substituted share a seed wherever these are.  Items of 5 to 8
words, shorter than the masks, must occur whole and unchanged, since a few of their
words are a phrase that any text may hold; those of 1 to 4 words must be the document's
only words.

The bit table only saves work; all documents are searched whole.  No text is
shuffled but that of documents with candidates (and, if these are too many to be
sent to all tasks, the documents they are looked up in).

Defined cases: missing text or id -> not searched, and kept by ``clean``; items
without words, and with a fixed score items of fewer words than a mask's span ->
never found; rows
that repeat an id share its candidates and are each verified; empty benchmark or
documents -> no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from firmweave.functions.once import with_once
from firmweave.llm.tables import materialize

BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MASKS = ("1101101011", "11100110011", "110010111")
#: further masks of items below SHORT words, if the score depends on the length
SHORT_MASK, LOOSE_MASK = "11111", "110011"
SHORT = 15
SPAN = min(map(len, MASKS))
BITS, MOST_BITS, PER_SEED = 20, 23, 4
#: one in so many words may be substituted anywhere
SUBSTITUTED = 5
LEAST_SCORE = 10
SHARE, LOWEST = 0.4, 6
MISS = 2


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), BETWEEN), "")


def hashes_of(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def _seed(words: Column, at: Column, mask: int) -> Column:
    """The seed of the window at ``at`` (from 0); null past the end."""
    shape = (*MASKS, SHORT_MASK, LOOSE_MASK)[mask]
    kept = [k for k, c in enumerate(shape) if c == "1"]
    seed = F.xxhash64(F.lit(mask), *[F.get(words, at + k) for k in kept])
    return F.when(F.size(words) >= at + len(shape), seed)


def _whole(words: Column) -> Column:
    """The seed of all words of a text that is shorter than every mask."""
    return F.xxhash64(F.lit(-2), words)


def asked(n_words: Column) -> Column:
    """The score asked for by an item's length."""
    share = F.least(F.lit(LEAST_SCORE), F.greatest(F.lit(LOWEST), F.ceil(n_words * SHARE)))
    return F.when(n_words < SPAN, n_words).otherwise(share)


def _pair(words: Column, at: Column) -> Column:
    return F.xxhash64(F.lit(-1), F.get(words, at), F.get(words, at + 1))


def _bit(table: Column, bits: int, value: Column) -> Column:
    """Whether the bit of a hash is set in a table of 64-bit numbers."""
    at = value.bitwiseAND(F.lit((1 << bits) - 1))
    word = F.get(table, F.shiftright(at, 6).cast("int"))
    # the bit of a place: a look-up is cheaper than a shift by a column
    return F.call_function("getbit", word, at.bitwiseAND(F.lit(63)).cast("int")) == 1


def item_seeds(benchmark: DataFrame, by_length: bool = False) -> DataFrame:
    """(item_id, n_words, at, pair, seed): a row per mask, and one without a seed."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("item_id").alias("item_id"), hashes_of(F.col("text").cast("string")).alias("w")
    )
    places = items.where(F.size("w") > 1).select(
        "item_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 2)).alias("at")
    )
    seeds = [_seed(F.col("w"), F.col("at"), m) for m in range(len(MASKS))]
    if by_length:
        # items below the masks' span must match from their first word on
        due = (F.size("w") < SHORT) & ((F.size("w") >= SPAN) | (F.col("at") == 0))
        seeds.append(F.when(due, _seed(F.col("w"), F.col("at"), len(MASKS))))
        due = (F.size("w") < SHORT) & (F.size("w") >= SPAN)
        seeds.append(F.when(due, _seed(F.col("w"), F.col("at"), len(MASKS) + 1)))
    found = places.select(
        "item_id", F.size("w").alias("n_words"), "at", _pair(F.col("w"), F.col("at")).alias("pair"),
        F.explode(F.array_compact(F.array(*seeds))).alias("seed"),
    )
    if not by_length:
        return found
    seed = _whole(F.col("w"))
    return found.unionByName(
        items.where(F.size("w").between(1, len(SHORT_MASK) - 1)).select(
            "item_id", F.size("w").alias("n_words"), F.lit(0).alias("at"), seed.alias("pair"), seed.alias("seed")
        )
    )


def bit_table(seeds: DataFrame) -> tuple[Column, int]:
    """A constant array of 64-bit numbers, and how many bits (a power of two) it has."""
    wanted = PER_SEED * seeds.count()
    size = min(MOST_BITS, max(BITS, wanted.bit_length()))
    bits = seeds.select(F.explode(F.array("pair", "seed")).alias("h")).select(
        F.col("h").bitwiseAND(F.lit((1 << size) - 1)).alias("h")
    )
    words = [0] * (1 << (size - 6))
    for part in bits.groupBy(F.shiftright("h", 6).cast("int").alias("i")).agg(
        F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("word")
    ).collect():
        words[part.i] = part.word
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>"), size


def candidates(docs: DataFrame, benchmark: DataFrame, by_length: bool = False) -> DataFrame:
    """(doc_id, item_id, n_words, diagonal) of every pair that shares a seed."""
    seeds = materialize(item_seeds(benchmark, by_length), "seeds")
    bits, size = bit_table(seeds)
    # evaluated once a row: the optimizer would copy them into each use, down to
    # the lambdas that run for each position
    w = F.col("w")
    hashed = with_once(
        docs.where("doc_id IS NOT NULL AND text IS NOT NULL"), w=hashes_of(F.col("text").cast("string"))
    ).select("doc_id", "w")
    tiny = F.size(w) < len(SHORT_MASK)
    paired = F.filter(F.sequence(F.lit(0), F.size(w) - 2), lambda at: _bit(bits, size, _pair(w, at)))
    places = with_once(
        hashed.where(F.size(w) > (0 if by_length else 1)),
        places=F.when(tiny, F.array(F.lit(0))).otherwise(paired) if by_length else paired,
    ).select("doc_id", "w", "places")
    masks = range(len(MASKS) + 2 * by_length)
    met = F.flatten(F.transform(
        "places",
        lambda at: F.filter(
            F.array(*[F.struct(at.alias("at"), _seed(w, at, m).alias("seed")) for m in masks]),
            lambda s: s["seed"].isNotNull() & _bit(bits, size, s["seed"]),
        ),
    ))
    if by_length:
        met = F.when(tiny, F.array(F.struct(F.lit(0).alias("at"), _whole(w).alias("seed")))).otherwise(met)
    hits = places.where(F.size("places") > 0).select("doc_id", F.explode(met).alias("hit"))
    hits = hits.select("doc_id", F.col("hit.at").alias("place"), F.col("hit.seed").alias("seed"))
    item = seeds.select(
        F.col("seed").alias("item_seed"), "item_id", "n_words", F.col("at").alias("item_at")
    ).distinct()
    return (
        hits.join(item, F.col("seed") == F.col("item_seed"))
        .select("doc_id", "item_id", "n_words", (F.col("place") - F.col("item_at")).alias("diagonal"))
        .distinct()
    )


def _best_run(a: Column, b: Column) -> Column:
    """Best sum over runs of two equally long arrays: +1 equal, -MISS different."""
    steps = F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(-MISS))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(state: Column, value: Column) -> Column:
        now = F.greatest(state["now"] + value, F.lit(0))
        return F.struct(now.alias("now"), F.greatest(state["best"], now).alias("best"))

    return F.aggregate(steps, start, step, lambda state: state["best"])


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int | None = LEAST_SCORE) -> DataFrame:
    """(doc_id, item_id, score) of documents that hold a passage of an item.

    ``least`` is the score asked for; None asks by the item's length.  ``score`` is the best
    run's, also where the number of equal words decides.
    """
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    )
    found = materialize(candidates(plain, items, least is None), "seed-candidates")
    again = found.withColumnRenamed("doc_id", "found_id")
    aligned = with_once(
        plain.join(again, F.col("doc_id") == F.col("found_id")), w=hashes_of(F.col("text"))
    ).select(
        "doc_id", "item_id", "n_words", "diagonal",
        F.slice("w", F.greatest(F.col("diagonal"), F.lit(0)) + 1,
                F.col("n_words") + F.least(F.col("diagonal"), F.lit(0))).alias("own"),
    )
    words = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("item_id").alias("words_id"), hashes_of(F.col("text")).alias("item_words")
    )
    across = F.slice("item_words", F.greatest(-F.col("diagonal"), F.lit(0)) + 1, F.size("own"))
    scored = aligned.join(words, F.col("item_id") == F.col("words_id")).select(
        "doc_id", "item_id", "n_words",
        _best_run(F.col("own"), across).alias("score"),
        F.size(F.filter(F.zip_with("own", across, lambda x, y: x == y), lambda same: same)).alias("equal"),
    )
    enough = F.col("score") >= (asked(F.col("n_words")) if least is None else F.lit(least))
    if least is None:
        all_but = F.col("n_words") - F.floor(F.col("n_words") / SUBSTITUTED)
        enough = enough | ((F.col("n_words") >= SPAN) & (F.col("equal") >= all_but))
    return scored.where(enough).groupBy("doc_id", "item_id").agg(
        F.max("score").cast("long").alias("score")
    )


def clean(docs: DataFrame, benchmark: DataFrame, least: int | None = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` without a passage of the benchmark."""
    leaking = materialize(
        overlaps(docs, benchmark, least).select(F.col("doc_id").alias("leaking_id")).distinct(),
        "leaking",
    )
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"))
    return packed.join(
        leaking, F.col("doc.doc_id").cast("long") == F.col("leaking_id"), "left_anti"
    ).select("doc.*")
