"""Intake and append-only sinks.

Row builders (``*_rows``) are lazy; ``append`` writes them.  Nothing rewrites a
path it reads: changed tables go to a new path.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F

from firmweave import schemas as S
from firmweave.plans import completion as C
from firmweave.session import materialized


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_run(df: DataFrame, path: str, run: int | str) -> None:
    """Append the rows of one run; written again, say after a failure, they replace themselves."""
    df.write.mode("overwrite").parquet(f"{path}/run={run}")


def intake(
    requests: DataFrame, key: Column | None = None, now: Column | None = None
) -> DataFrame:
    """Requests (raw_input) -> pending leads.

    Without ``key`` each row gets a random id, which must be written before the
    plan forks; a deterministic ``key`` (say, a digest of the message) makes a
    re-run give the same ids.  Companies are not de-duplicated.
    """
    now = F.current_timestamp() if now is None else now
    request_id = F.uuid() if key is None else key
    return requests.select(
        request_id.alias("request_id"),
        "raw_input",
        F.lit("pending").alias("status"),
        now.alias("created_at"),
        now.alias("updated_at"),
    ).withColumn("id", F.col("request_id"))


def with_id(df: DataFrame, *parts: str, run: int | str | None = None) -> DataFrame:
    """Rows with an integer ``id``: their own, or a hash of their run and what identifies them.

    A hash needs no counter that all tasks share.  ``run`` names the write, so that the
    same step of a later run gets another id, and a run that is written again, in place
    of its first attempt, the same ones.
    """
    if "id" in df.columns:
        return df
    named = [] if run is None else [F.lit(str(run))]
    return df.withColumn("id", F.xxhash64(*named, *parts))


def log_rows(
    df: DataFrame, now: Column | None = None, run: int | str | None = None
) -> DataFrame:
    """S3: step-log rows stamped with the time of writing.

    ``seq`` is the place of a row within its run; rows that were written together
    share their time and are ordered by it.  Rows without one are told apart by their
    place in the write.  Without ``run`` the time of writing stands for it in the ids.
    """
    stamped = df if now is None else df.withColumn("timestamp", now)
    if "timestamp" not in stamped.columns:
        stamped = stamped.withColumn("timestamp", F.current_timestamp())
    if "seq" not in stamped.columns:
        stamped = stamped.withColumn("seq", F.lit(None).cast("int"))
    if "id" not in stamped.columns:
        stamped = with_id(
            stamped.withColumn(
                "_place", F.coalesce(F.col("seq").cast("long"), -1 - F.monotonically_increasing_id())
            ),
            "request_id", "_place", "step_name", "status", *([] if run is not None else ["timestamp"]),
            run=run,
        )
    return stamped.select(
        "id", "request_id", "seq", "step_name", "status", "payload", "timestamp"
    )


def append_logs(
    df: DataFrame, path: str, now: Column | None = None, run: int | str | None = None
) -> None:
    rows = log_rows(df, now, run)
    append(rows, path) if run is None else append_run(rows, path, run)


def usage_ledger_rows(
    df: DataFrame, now: Column | None = None, run: int | str | None = None
) -> DataFrame:
    """Ledger rows; the total is fixed when written."""
    if "created_at" not in df.columns:
        df = df.withColumn("created_at", F.current_timestamp() if now is None else now)
    parts = ["request_id", "step_name", *([] if run is not None else ["created_at"])]
    df = with_id(df, *parts, run=run)
    return df.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")).select(
        "id", "request_id", "model_name", "input_tokens", "output_tokens", "total_tokens",
        "step_name", "created_at",
    )


def append_usage(
    df: DataFrame, path: str, now: Column | None = None, run: int | str | None = None
) -> None:
    rows = usage_ledger_rows(df, now, run)
    append(rows, path) if run is None else append_run(rows, path, run)


def append_embeddings(
    df: DataFrame, path: str, now: Column | None = None, run: int | str | None = None
) -> None:
    """Summary and vector are added; earlier vectors of the lead stay."""
    if "created_at" not in df.columns:
        df = df.withColumn("created_at", F.current_timestamp() if now is None else now)
    rows = embedding_rows(df, run)
    append(rows, path) if run is None else append_run(rows, path, run)


def embedding_rows(df: DataFrame, run: int | str | None = None) -> DataFrame:
    parts = ["lead_id", "content_summary", *([] if run is not None else ["created_at"])]
    df = with_id(df, *parts, run=run)
    return df.select("id", "lead_id", "embedding", "content_summary", "created_at")


def write_leads(leads: DataFrame, completed: DataFrame, path: str, now: Column | None = None) -> None:
    """Set enriched_data and status of the completed leads, at a new path."""
    from firmweave.operators.records import update_leads

    done = completed.select(
        "request_id", F.lit("completed").alias("status"), F.col("enriched_data")
    )
    update_leads(leads, done, now=now).write.mode("errorifexists").parquet(path)


def write_completion(
    traced: DataFrame,
    path: str,
    now: Column | None = None,
    vectors: DataFrame | None = None,
    model_name: str = C.MODEL_NAME,
    dim: int = S.EMBEDDING_DIM,
) -> None:
    """Write leads, logs, rejects, usage and embeddings of one trace below ``path``.

    The trace is written once to the shared folder and projected from there, so
    the outputs agree and a lost executor only re-reads files.  All rows carry one
    time of writing unless ``now`` is given.
    """
    now = F.lit(datetime.now(timezone.utc)) if now is None else now
    with materialized(C.output_columns(traced), "trace") as stored:
        outputs = {
            "leads": C.leads_of(stored, now),
            "logs": log_rows(C.derive_logs(stored, now)),
            "rejected": C.rejects_of(stored),
            "usage": usage_ledger_rows(C.usage_of(stored, now, model_name)),
            "embeddings": embedding_rows(C.embeddings_of(stored, vectors, now, dim)),
        }
        for name, df in outputs.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
