"""Runs of a request in its step log, numbered by running counts that split hot requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from firmweave import schemas as S
from firmweave.functions.blocks import ahead, join_ahead, running_sum, within

KEY, ORDER = ["request_id"], ["timestamp", "id"]


def closes() -> Column:
    """Whether a log row ends its run: success of the closing step, or any failure."""
    ended = (F.col("step_name") == S.STEP_NAMES[-1]) & (F.col("status") == "success")
    return F.coalesce((F.col("status") == "failed") | ended, F.lit(False))


def number_runs(blocks: DataFrame, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Log rows with ``closed``, run, place and opened_at, and the state they leave behind.

    A run opens at a request's first row and goes on to the row that closes it; the next
    row opens the next run.  ``blocks`` are log rows dealt by ``functions.blocks`` over
    (request_id, timestamp, id) and written.  ``state`` has a row per request that was
    seen before: number (of its newest run), shown (rows of that run, 0 if it is
    closed), opened, last.  The new state has the requests of ``blocks``.
    """
    rows = blocks.withColumn("closed", closes())
    rows = running_sum(rows, KEY, ORDER, "_run", F.col("closed").cast("long"))
    run = [*KEY, "_run"]
    table = ahead(rows, run, sum_rows=F.count("*"), min_time=F.min("timestamp"))
    rows = join_ahead(rows, table, run).withColumns(
        {
            "_place": F.row_number().over(within(run, ORDER))
            + F.coalesce("sum_rows", F.lit(0)),
            "_opened": F.coalesce("min_time", F.first("timestamp").over(within(run, ORDER))),
        }
    )
    known = _known(state, rows)
    rows = rows.join(known, KEY, "left")
    going_on = (F.col("_run") == 0) & (_shown() > 0)
    messages = rows.select(
        "request_id", "id", "step_name", "status", "timestamp", "closed",
        (_base() + F.col("_run")).alias("run"),
        (F.col("_place") + F.when(going_on, _shown()).otherwise(0)).alias("place"),
        F.when(going_on, F.col("opened")).otherwise(F.col("_opened")).alias("opened_at"),
    )
    return messages, _left(blocks, rows, known)


def _known(state: DataFrame | None, rows: DataFrame) -> DataFrame:
    if state is not None:
        return state.select("request_id", "number", "shown", "opened")
    none = rows.select("request_id", F.lit(0).cast("long").alias("number"),
                       F.lit(0).cast("long").alias("shown"), F.col("timestamp").alias("opened"))
    return none.where(F.lit(False))


def _shown() -> Column:
    return F.coalesce("shown", F.lit(0))


def _base() -> Column:
    """The number of the run that the first row belongs to."""
    return F.coalesce("number", F.lit(0)) + F.when(_shown() > 0, 0).otherwise(1)


def _left(blocks: DataFrame, rows: DataFrame, known: DataFrame) -> DataFrame:
    """What each request of these rows leaves behind; every step combines on the map side."""
    per_run = rows.groupBy("request_id", "_run").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
        F.count_if("closed").alias("ended"),
    )
    per_request = per_run.groupBy("request_id").agg(
        F.max_by(F.struct("_run", "n", "first", "ended"), "_run").alias("top"),
        F.max("last").alias("last"),
    ).join(known, KEY, "left")
    open_run = F.col("top.ended") == 0
    carried = (F.col("top._run") == 0) & (_shown() > 0)
    return per_request.select(
        "request_id",
        (_base() + F.col("top._run")).alias("number"),
        F.when(open_run, F.col("top.n") + F.when(carried, _shown()).otherwise(0))
        .otherwise(0).cast("long").alias("shown"),
        F.when(open_run, F.when(carried, F.col("opened")).otherwise(F.col("top.first"))).alias("opened"),
        "last",
    )
