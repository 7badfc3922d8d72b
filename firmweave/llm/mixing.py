"""Mixing sources to target weights (native DataFrame functions only).

The size of a document is its number of words ``[^\\x20\\x09-\\x0D]+``; a missing
text has size 0.  Sources in code-point order, the missing source last, weigh
1, 2, 3, 1, 2, 3, ...  Together they share all words of the corpus by weight; no
source may take more than ``CAP`` times its own words, and what it cannot take
goes to the others by weight.  A source repeats its documents at the rate target
/ size: each document is taken floor(rate) times, and once more with the
probability of the fraction.  That draw is a hash of seed and doc_id, so reruns
agree, and rows that repeat a doc_id share its draw.

Only one row per source is ever ranked in one place.  No document text is
shuffled: sizes are summed map-side, and the table of sources joins back by its
measured size.

Defined cases: empty table -> no rows; a source without words -> target 0,
nothing taken; missing doc_id -> drawn as the empty string; extra columns of any
name pass through ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from firmweave.llm.tables import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) fixed by the id: the first 52 bits of an MD5."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10)
    return bits.cast("double") / F.lit(float(2**52))


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP
) -> DataFrame:
    """(source, source_size, target, rate) from one row per source (source, source_size).

    A source is held at its cap when its fair share of what is left, after all
    sources of lower size per weight took theirs, is no less than the cap.  Those
    sources are the first ones by size per weight, so one ordered pass settles it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn(
        "weight",
        F.element_at(
            F.array(*[F.lit(w) for w in weights]),
            ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"),
        ),
    )
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    wide = lambda c: c.cast("decimal(38,0)")  # noqa: E731  products of two totals
    ranked = weighed.select(
        "*",
        (F.sum("source_size").over(everything)
         - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left_words"),
        (F.sum("weight").over(everything)
         - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"),
    ).withColumn(
        "held",
        wide(cap * F.col("source_size")) * F.col("left_weight")
        <= wide(F.col("left_words")) * F.col("weight"),
    )
    # the first source that is not held sees what the held ones left over
    share = F.max(
        F.when(
            ~F.col("held"),
            F.col("left_words").cast("double") / F.col("left_weight").cast("double"),
        )
    ).over(everything)
    target = F.when(
        F.col("held"), (cap * F.col("source_size")).cast("double")
    ).otherwise(F.col("weight") * share)
    return ranked.withColumn("target", target).select(
        "source",
        "source_size",
        "target",
        F.when(
            F.col("source_size") > 0,
            F.least(F.col("target") / F.col("source_size"), F.lit(float(cap))),
        ).otherwise(0.0).alias("rate"),
    )


def with_copies(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc, size, source_size, target, copies): each row whole in the struct ``doc``."""
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"))
    sized = packed.withColumn("size", size_of(F.col("doc.text")))
    sizes = sized.groupBy(F.col("doc.source").alias("source")).agg(
        F.sum("size").alias("source_size")
    )
    targets = materialize(source_targets(sizes), "mix-targets")
    floor = F.floor("rate").cast("long")
    extra = (draw(F.col("doc.doc_id"), seed) < F.col("rate") - floor).cast("long")
    return sized.join(
        targets, F.col("doc.source").eqNullSafe(targets["source"])
    ).select("doc", "size", "source_size", "target", (floor + extra).alias("copies"))


def mix_report(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies."""
    return with_copies(docs, seed).select(
        F.col("doc.doc_id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        "copies",
    )


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixture itself: the rows of ``docs``, each as often as it is taken."""
    return (
        with_copies(docs, seed)
        .select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
        .select("doc.*")
    )
