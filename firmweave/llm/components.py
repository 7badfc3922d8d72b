"""Smallest id reachable over links, by distributed label passing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from firmweave.llm.tables import materialize


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b), ``a`` and ``b`` not equal.

    Each round a node takes the smallest label among its neighbours' and its own,
    then the label of that label, so that long chains shorten by powers of two.
    Sums are combined map-side, and a hub's many links are plain join rows that
    Spark can split.  Every round is written out, which cuts the lineage.
    """
    both = materialize(
        links.select(F.col("a").alias("node"), F.col("b").alias("other"))
        .unionAll(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        .distinct(),
        "links",
    )
    labels = materialize(
        both.groupBy("node").agg(F.least(F.min("node"), F.min("other")).alias("label")), "labels"
    )
    while True:
        seen = both.join(
            labels.select(F.col("node").alias("other"), F.col("label").alias("theirs")), "other"
        ).groupBy("node").agg(F.min("theirs").alias("theirs"))
        lower = labels.join(seen, "node").select(
            "node", "label", F.least("label", "theirs").alias("next")
        )
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("beyond"))
        after = materialize(
            lower.join(jump, "next").select(
                "node", "label", F.least("next", "beyond").alias("next")
            ),
            "labels",
        )
        labels = after.select("node", F.col("next").alias("label"))
        if after.where("next < label").isEmpty():
            return labels
