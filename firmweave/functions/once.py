"""Evaluate an expensive expression exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose values later expressions read instead of recomputing.

    The optimizer merges adjacent projections and moves filters towards the
    scan, rewriting every use of a column into its definition; for a parsed
    document or a merged record that multiplies the work with each use.  It
    leaves generators alone, and exploding a one-element array keeps every row
    as it is.  The array holds an already computed column, since generators are
    evaluated outside generated code.  The columns cannot be pruned either, so
    add only what is used.
    """
    held = {f"_once_{name}": column for name, column in columns.items()}
    packed = F.struct(*[F.col(h).alias(n) for h, n in zip(held, columns)])
    return df.withColumns(held).select("*", F.inline(F.array(packed))).drop(*held)
