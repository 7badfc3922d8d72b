"""C1-C4 and key reduction: batches of changes against any keyed table.

Changes are reduced to one row per key before they meet the table, with partial
aggregation on the map side, so a key changed by a third of the batch costs one
row per task.  The table side is shuffled at most once, by its key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from firmweave.session import materialize


def co_locate(df: DataFrame, key: str = "request_id") -> DataFrame:
    """Shuffle by the key now, so that parsing and joining happen after it.

    The joins that follow use the same key and add no shuffle of their own.
    Only for inputs of at most one row per key: AQE splits a hot key in shuffles
    that it inserted itself, not in this one.  Not for inputs that are bucketed
    by the key already.
    """
    return df.repartition(key)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one greatest in ``order``.

    ``order`` must decide every tie for the result to be deterministic.
    """
    rest = [c for c in df.columns if c not in keys]
    if set(rest) <= set(order):  # the order holds the row: nothing travels beside it
        picked = F.max(F.struct(*order)).alias("_row")
    else:
        picked = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def list_sorted(table: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows by ascending key, one-row total)."""
    return table.orderBy(key), table.agg(F.count("*").alias("total"))


def _reduced(changes: DataFrame, keys: Sequence[str], order: Sequence[str] | None) -> DataFrame:
    return latest_per_key(changes, keys, order) if order else changes


def upsert(
    table: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] | None = None,
    new_id: str = "id",
    top: Column | None = None,
) -> DataFrame:
    """Replace the values of existing keys, insert the others.

    ``changes`` carries the keys, (some of) the table's value columns and the
    ``order`` columns deciding which change of a key is last; without ``order``
    the keys must be unique.  Columns a change does not carry keep their value
    on update and are NULL on insert, except ``new_id``: where the table has that
    integer column, an inserted row gets a number of its own above all given
    ones (or above ``top``).  The number is the rank of its key among the inserted ones,
    found by a range sort, a count per partition and a sum of those counts.
    Changes with a NULL key are left out, as they match nothing.
    """
    keys = list(keys)
    changes = changes.dropna(subset=keys)
    carried = [c for c in changes.columns if c in table.columns and c not in keys]
    new = _reduced(changes, keys, order).select(
        *keys, *[F.col(c).alias(f"_new_{c}") for c in carried], F.lit(True).alias("_changed")
    )
    marked = table.withColumn("_there", F.lit(True)).join(new, keys, "full_outer")

    def columns(**given: Column) -> list[Column]:
        return [
            given[c].alias(c) if c in given
            else F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in carried
            else F.col(c)
            for c in table.columns
        ]

    if new_id not in table.columns or new_id in [*carried, *keys]:
        return marked.select(*columns())
    # both halves read the same two shuffles; only inserted rows are sorted and written
    kept = marked.where("_there").select(*columns())
    fresh = with_rank(marked.where("_there IS NULL").drop("_there"), keys)
    if top is None:
        top = table.agg(F.coalesce(F.max(new_id), F.lit(0)).cast("bigint").alias("_top")).scalar()
    number = (top + F.col("_rank")).cast(table.schema[new_id].dataType)
    return kept.unionByName(fresh.select(*columns(**{new_id: number})))


def with_rank(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``_rank``: 1, 2, ... in the order of the (unique) keys, without one big sort task."""
    ranged = materialize(
        rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranks"
    )
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select(
        "_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before")
    )
    in_part = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return ranged.join(before, "_part").select(
        *rows.columns, (F.col("_before") + in_part).alias("_rank")
    )


def update_existing(
    table: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Update known keys only; the unknown keys are reported, not inserted."""
    keys = list(keys)
    carried = [c for c in changes.columns if c in table.columns and c not in keys]
    reduced = _reduced(changes, keys, order)
    new = reduced.select(
        *keys, *[F.col(c).alias(f"_new_{c}") for c in carried], F.lit(True).alias("_changed")
    )
    joined = table.join(new, keys, "left")
    columns = [
        F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
        if c in carried
        else F.col(c)
        for c in table.columns
    ]
    not_found = reduced.select(*keys).join(table.select(*keys), keys, "left_anti")
    return joined.select(*columns), not_found


def delete_keys(
    table: DataFrame, doomed: DataFrame, keys: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """C4: (remaining rows, keys that matched nothing)."""
    keys = list(keys)
    wanted = doomed.select(*keys).distinct()
    return (
        table.join(wanted, keys, "left_anti"),
        wanted.join(table.select(*keys), keys, "left_anti"),
    )
