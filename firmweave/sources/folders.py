"""Keyed tables in hash folders, of which a batch of changes rewrites only those it touches.

A table is written by ``create`` into a fixed number of folders, each row by the hash of
its key.  A change reads the folders that hold its keys, applies the batch operator to
them, writes the result to the shared scratch folder and then puts it in the place of
those folders; all others keep their files.  The work follows the changes, not the table,
as long as these touch few folders.  Repeating a change after a failure gives the same
table, because the operators replace by key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from firmweave.operators import keyed, records
from firmweave.session import discard, file_system, materialized

FOLDER = "_folder"


@dataclass(frozen=True)
class FolderTable:
    """A table below ``path``, by the hash of ``keys``."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]

    @staticmethod
    def create(df: DataFrame, path: str, keys: Sequence[str], folders: int = 256) -> FolderTable:
        """Write ``df`` anew; one shuffle by the folder and, within, by the key."""
        table = FolderTable(df.sparkSession, path, tuple(keys))
        table._dealt(df, folders).write.mode("errorifexists").partitionBy(FOLDER).parquet(f"{path}/rows")
        df.limit(0).write.mode("errorifexists").parquet(f"{path}/columns")
        df.sparkSession.range(folders, folders + 1).write.mode("errorifexists").parquet(f"{path}/folders")
        return table

    def _place(self, folders: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(folders)).cast("int")

    def _dealt(self, df: DataFrame, folders: int) -> DataFrame:
        """Rows with their folder, each folder in one task; keys are unique, so folders are even."""
        return df.withColumn(FOLDER, self._place(folders)).repartition(FOLDER)

    @property
    def folders(self) -> int:
        return self.spark.read.parquet(f"{self.path}/folders").first()["id"]

    def _all(self) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/columns").schema
        if not self._present():
            return self.spark.createDataFrame([], schema).withColumn(FOLDER, F.lit(0))
        return self.spark.read.schema(schema.add(FOLDER, "integer")).parquet(f"{self.path}/rows")

    def _present(self) -> set[int]:
        files, root = file_system(self.spark, f"{self.path}/rows")
        names = [s.getPath().getName() for s in files.listStatus(root)]
        return {int(n.split("=")[1]) for n in names if n.startswith(f"{FOLDER}=")}

    def read(self) -> DataFrame:
        return self._all().drop(FOLDER)

    def change(self, changes: DataFrame, apply: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Replace the folders of the changes' keys by ``apply`` of their rows; their numbers."""
        count = self.folders
        touched = sorted(
            r[0] for r in changes.select(self._place(count).alias(FOLDER)).distinct().collect()
        )
        if not touched:
            return []
        rows = self._all().where(F.col(FOLDER).isin(touched)).drop(FOLDER)
        with materialized(self._dealt(apply(rows), count), "folders") as new:
            kept = {r[0] for r in new.select(FOLDER).distinct().collect()}
            new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                FOLDER
            ).parquet(f"{self.path}/rows")
        for folder in set(touched) & self._present() - kept:  # all its rows are gone
            discard(self.spark, f"{self.path}/rows/{FOLDER}={folder}")
        return touched

    def update_leads(self, updates: DataFrame, order: Sequence[str] | None = None, now: Column | None = None) -> list[int]:
        """U1 on the touched folders."""
        return self.change(updates, lambda rows: records.update_leads(rows, updates, order, now))

    def upsert(self, changes: DataFrame, order: Sequence[str] | None = None, new_id: str = "id") -> list[int]:
        """C2 on the touched folders; new ids lie above those of the whole table."""
        changes = changes.dropna(subset=list(self.keys))
        top = None
        if new_id in self.read().columns:
            top = F.lit(self.read().agg(F.max(new_id)).first()[0] or 0).cast("bigint")
        return self.change(
            changes, lambda rows: keyed.upsert(rows, changes, self.keys, order, new_id, top)
        )

    def update_existing(self, changes: DataFrame, order: Sequence[str] | None = None) -> list[int]:
        """C3 on the touched folders."""
        return self.change(
            changes, lambda rows: keyed.update_existing(rows, changes, self.keys, order)[0]
        )

    def delete(self, doomed: DataFrame) -> list[int]:
        """C4 on the touched folders."""
        return self.change(doomed, lambda rows: keyed.delete_keys(rows, doomed, self.keys)[0])
