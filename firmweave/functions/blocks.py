"""Running counts within keys, one of which may hold a third of all rows.

A window over a key runs in one task.  Here rows are first dealt by range over key and
order, so a hot key is cut into blocks of consecutive rows; windows run within a key's
block, and what the key's earlier blocks add comes from a small table.  A range boundary
is straddled by one key at most, so that table has fewer rows than there are blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

BLOCK = "_block"


def dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` by range over ``keys`` and ``order``, with the number of each row's block.

    Write the result before use (``materialized``): the number is a task's, so a plan that
    runs twice would number twice.  ``order`` must tell rows of a key apart.
    """
    return df.repartitionByRange(*keys, *order).withColumn(BLOCK, F.spark_partition_id())


def within(keys: list[str], order: list[str]) -> WindowSpec:
    """The rows of a key's block in their order."""
    return Window.partitionBy(*keys, BLOCK).orderBy(*order)


def ahead(df: DataFrame, keys: list[str], **totals: Column) -> DataFrame:
    """For each block in which a key goes on: aggregates over the key's earlier blocks.

    ``totals`` are sums, minima or maxima that fold again under the same name: a
    ``sum``, ``min`` or ``max`` prefix of the name says how.
    """
    folds = {"sum": F.sum, "min": F.min, "max": F.max}
    parts = df.groupBy(*keys, BLOCK).agg(*[c.alias(n) for n, c in totals.items()])
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(
        *keys, BLOCK,
        F.count("*").over(before).alias("_blocks"),
        *[folds[n.split("_")[0]](F.col(n)).over(before).alias(n) for n in totals],
    ).where("_blocks > 0").drop("_blocks")


def join_ahead(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns of ``ahead``, NULL in the first block of a key."""
    extra = [c for c in table.columns if c not in (*keys, BLOCK)]
    named = table.select(*[F.col(k).alias(f"_of_{k}") for k in (*keys, BLOCK)], *extra)
    same = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in (*keys, BLOCK)]
    )
    # fewer rows than blocks
    return df.join(F.broadcast(named), same, "left").drop(*[f"_of_{k}" for k in (*keys, BLOCK)])


def running_sum(df: DataFrame, keys: list[str], order: list[str], name: str, value: Column) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over a key's rows ahead of each row."""
    valued = df.withColumn("_value", value)
    table = ahead(valued, keys, sum_ahead=F.sum("_value"))
    earlier = within(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("_value").over(earlier), F.lit(0))
    return join_ahead(valued.withColumn(name, own), table, keys).withColumn(
        name, F.col(name) + F.coalesce("sum_ahead", F.lit(0))
    ).drop("_value", "sum_ahead")
