"""A change of a few keys equals the full rewrite and leaves the other folders' files alone."""

import os

import pytest
from pyspark.sql import functions as F

from firmweave.operators import keyed, records
from firmweave.sources.folders import FolderTable

SCHEMA = "id long, setting_key string, setting_value string"


def config(spark, n=200):
    return spark.createDataFrame([(k, f"k{k}", f"v{k}") for k in range(1, n + 1)], SCHEMA)


def files(path):
    return {
        folder: {(f, os.stat(f"{path}/rows/{folder}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/rows/{folder}")}
        for folder in os.listdir(f"{path}/rows") if folder.startswith("_folder=")
    }


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(*a.columns).collect()), key=repr)


@pytest.fixture()
def table(spark, tmp_path):
    return FolderTable.create(config(spark), f"{tmp_path}/t", ["setting_key"], folders=16)


CHANGES = [("k3", "new", 1), ("k3", "newer", 2), ("n1", "w", 1), ("n0", "v", 1), (None, "lost", 1)]


def test_upsert_touches_its_folders_only(spark, table):
    assert same(config(spark), table.read())
    before = files(table.path)
    changes = spark.createDataFrame(CHANGES, "setting_key string, setting_value string, seq int")
    want = keyed.upsert(config(spark), changes, ["setting_key"], ["seq"])
    touched = table.upsert(changes, ["seq"])
    assert same(want, table.read()) and 1 <= len(touched) <= 3
    after = files(table.path)
    assert {f for f in after if after[f] != before.get(f)} == {f"_folder={t}" for t in touched}
    # the same change again gives the same table
    table.update_existing(changes.where("setting_key = 'k3'"), ["seq"])
    assert same(want, table.read())


def test_update_and_delete(spark, table):
    changes = spark.createDataFrame(CHANGES, "setting_key string, setting_value string, seq int").dropna()
    table.update_existing(changes, ["seq"])
    want, _ = keyed.update_existing(config(spark), changes, ["setting_key"], ["seq"])
    assert same(want, table.read())
    doomed = spark.createDataFrame([("k7",), ("zz",)], "setting_key string")
    before = files(table.path)
    touched = table.delete(doomed)
    left, _ = keyed.delete_keys(want, doomed, ["setting_key"])
    assert same(left, table.read())
    assert {f for f in before if files(table.path).get(f) != before[f]} <= {f"_folder={t}" for t in touched}
    table.delete(config(spark).select("setting_key"))
    assert table.read().count() == 0 and table.read().columns == ["id", "setting_key", "setting_value"]
    table.upsert(changes, ["seq"])
    assert sorted(r.setting_key for r in table.read().collect()) == ["k3", "n0", "n1"]
    assert table.change(changes.where("false"), lambda rows: rows) == []


def test_leads(spark, tmp_path):
    leads = spark.range(100).select(
        F.format_string("r%d", "id").alias("request_id"), F.lit("pending").alias("status"),
        F.lit("old").alias("enriched_data"), F.timestamp_seconds("id").alias("updated_at"))
    table = FolderTable.create(leads, f"{tmp_path}/leads", ["request_id"], folders=32)
    updates = spark.createDataFrame(
        [("r5", "failed", None), ("r6", "completed", "new"), ("zz", "failed", None)],
        "request_id string, status string, enriched_data string")
    now = F.timestamp_seconds(F.lit(10_000))
    assert len(table.update_leads(updates, now=now)) <= 3
    assert same(records.update_leads(leads, updates, now=now), table.read())
