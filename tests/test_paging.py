"""Pages found by counting are those of the full sort."""

import random
from datetime import date, datetime as dt, timedelta

import pytest
from pyspark.sql import functions as F

from firmweave import schemas as S
from firmweave.operators import paging, records

START = dt(2024, 3, 9, 22)


def made(spark, n=400, kind="timestamp"):
    """A third of the rows share one time; some have no time, no status or an unknown one."""
    rng = random.Random(2)
    rows = []
    for k in range(n):
        at = START + timedelta(seconds=rng.randrange(40_000), microseconds=rng.randrange(1000))
        if k % 3 == 0:
            at = START + timedelta(hours=5)
        if k % 29 == 0:
            at = None
        rows.append((f"r{rng.randrange(10**6):06d}", rng.choice([*S.LEAD_STATUSES, "odd", None]), at))
    df = spark.createDataFrame(rows, f"request_id string, status string, created_at {'timestamp_ntz' if kind == 'date' else kind}")
    return df.withColumn("created_at", F.col("created_at").cast(kind)).repartition(4)


def plain(df, status):
    rows = [tuple(r) for r in df.collect() if not status or r.status == status]
    first = date.min if rows and any(type(r[2]) is date for r in rows) else dt.min
    rows.sort(key=lambda r: r[0])
    return sorted(rows, key=lambda r: (r[2] is not None, r[2] or first), reverse=True) if not rows else [
        r for r in sorted(rows, key=lambda r: r[2] or first, reverse=True) if r[2]] + [r for r in rows if not r[2]]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_every_page(spark, kind):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # clocks change on 10 March
    try:
        df = made(spark, kind=kind).cache()
        pages = paging.count_pages(df, ranges=4, held=10)
        for status in ("", "completed", "odd", "none"):
            want = plain(df, status)
            assert pages.info(status, 7) == (len(want), max(1, -(-len(want) // 7)))
            skips = range(0, len(want) + 40, 37 if status == "" else 61)
            for skip in skips:
                got = [tuple(r) for r in pages.page(skip, 20, status).collect()]
                assert got == want[skip:skip + 20], (status, skip)
        df.unpersist()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_few_or_no_rows(spark):
    df = made(spark)
    none = paging.count_pages(df.where("false"), held=1)
    assert none.info() == (0, 1) and none.page(5, 3).count() == 0
    timeless = paging.count_pages(df.where("created_at IS NULL"), held=2)
    n = timeless.info()[0]
    assert n > 5 and timeless.page(3, 200).count() == n - 3
    with pytest.raises(ValueError):
        none.page(-1, 3)


def test_equal_and_missing_ids(spark):
    """Rows that tie in both time and id stay in one range; missing ids come first."""
    rows = [("same", "failed", START)] * 50 + [(None, "failed", START)] * 30 + [(f"t{k}", "failed", START) for k in range(50)]
    df = spark.createDataFrame(rows, "request_id string, status string, created_at timestamp").repartition(3)
    pages = paging.count_pages(df, held=10)
    ids = [r.request_id for s in range(0, 130, 13) for r in pages.page(s, 13).collect()]
    assert ids == [None] * 30 + ["same"] * 50 + sorted(f"t{k}" for k in range(50))


def test_a_deep_page_sorts_few_rows(spark):
    """The plan's top rows are those of the last range and a page, not all before it."""
    df = spark.range(100_000).select(
        F.format_string("r%06d", "id").alias("request_id"), F.lit("failed").alias("status"),
        F.timestamp_seconds(F.col("id")).alias("created_at"))
    page = paging.count_pages(df, held=1000).page(60_000, 20)
    assert [r.request_id for r in page.collect()] == [f"r{99_999 - k:06d}" for k in range(60_000, 60_020)]
    top = [line for line in page._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Limit" in line or "Offset" in line]
    assert all(int(line.split("Limit")[1].split()[0]) <= 1020 for line in top if "Limit" in line and line.split("Limit")[1].split()[0].isdigit())
    assert records.page(df, 60_000, 20).collect() == page.collect()
