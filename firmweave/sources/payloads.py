"""S2 and the table readers: explicit schemas, no inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from firmweave import schemas as S

TABLES = {
    "requests": S.REQUESTS_DDL,
    "provider_payloads": S.PAYLOADS_DDL,
    "fetch_attempts": S.ATTEMPTS_DDL,
    "responses": S.RESPONSES_DDL,
    "leads": S.LEADS_DDL,
    "pipeline_logs": S.LOGS_DDL,
    "token_usage": S.USAGE_DDL,
    "vector_embeddings": S.EMBEDDINGS_DDL,
    "admin_config": S.CONFIG_DDL,
}


def read_table(spark: SparkSession, path: str, table: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(TABLES[table]).format(fmt).load(path)


def read_provider(
    spark: SparkSession, path: str, provider: str, fmt: str = "parquet"
) -> DataFrame:
    """The landed rows of one provider (role name such as ``profile``).

    The provider filter reaches the scan, and prunes folders where the table is
    partitioned by provider.
    """
    source = S.PROVIDER_SOURCES[provider]
    return (
        spark.read.schema(S.PAYLOADS_DDL)
        .format(fmt)
        .load(path)
        .filter(F.col("provider") == source)
        .drop("provider")
    )


def split_providers(payloads: DataFrame) -> dict[str, DataFrame]:
    """One long payload table as the role -> DataFrame map the plans take."""
    return {
        role: payloads.filter(F.col("provider") == source).drop("provider")
        for role, source in S.PROVIDER_SOURCES.items()
    }
