"""Q2, Q3 at any depth: order statistics by counted time ranges.

A page deep in a list is found by counting, not by sorting what comes before it.  Rows are
counted once per range of creation time and status (``count_pages``); a page skips whole
ranges, counts again within the one it begins in until that holds few rows, and sorts
from there.  Where many rows share one time, their ids are dealt by range and counted
instead.  So a task, and the driver, hold ``HELD`` rows and a page at most, however deep
the page lies; only counts, and the ids of a crowded time, are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from firmweave import schemas as S
from firmweave.operators import records as R
from firmweave.operators.validation import check_page
from firmweave.session import materialized

#: ranges that time is cut into at once, and the rows that a last range may hold
RANGES, HELD = 4096, 10_000
_DAY = 86_400_000_000


def _micros(df: DataFrame) -> Column:
    """Creation time as microseconds; wall-clock times are not moved into a time zone."""
    at = F.col("created_at")
    if df.schema["created_at"].dataType.simpleString() == "timestamp_ntz":
        seconds = F.expr("CAST(extract(SECOND FROM created_at) * 1000000 AS BIGINT)")
        return (
            F.datediff(at, F.lit("1970-01-01").cast("date")).cast("long") * _DAY
            + F.hour(at).cast("long") * (_DAY // 24) + F.minute(at).cast("long") * (_DAY // 1440) + seconds
        )
    return F.unix_micros(at.cast("timestamp"))


def _time(df: DataFrame, micros: int) -> Column:
    """A time as a literal of the column's type, so that comparisons reach the scan."""
    kind = df.schema["created_at"].dataType.simpleString()
    if kind == "timestamp_ntz":
        return F.expr(f"timestampadd(MICROSECOND, {micros}L, TIMESTAMP_NTZ '1970-01-01 00:00:00')")
    return F.timestamp_micros(F.lit(micros).cast("long"))


def _between(df: DataFrame, low: int, high: int) -> DataFrame:
    return df.where((F.col("created_at") >= _time(df, low)) & (F.col("created_at") <= _time(df, high)))


@dataclass(frozen=True)
class PageCounts:
    """Counts per time range, newest first: at most ``ranges`` per known status."""

    rows: DataFrame
    high: int
    width: int
    counts: dict[str, dict[int, int]]  # status ('' for all) -> range -> rows
    timeless: dict[str, int]
    ranges: int = RANGES
    held: int = HELD

    def _of(self, status: str | None) -> tuple[dict[int, int], int]:
        """Counts of a status; of one that is not known, counted now."""
        name = status or ""
        if name in self.counts:
            return self.counts[name], self.timeless[name]
        own = count_pages(self.rows.where(F.col("status") == name), self.ranges, self.held, (self.high, self.width))
        return own.counts[""], own.timeless[""]

    def info(self, status: str | None = None, per_page: int = S.PER_PAGE) -> tuple[int, int]:
        """Q3: (rows, pages, at least one) from the counts alone."""
        counts, timeless = self._of(status)
        total = sum(counts.values()) + timeless
        return total, max(1, -(-total // per_page))

    def page(self, skip: int = 0, limit: int = 50, status: str | None = None) -> DataFrame:
        """Q2: the rows that ``records.page`` gives, found by counting."""
        check_page(skip, limit)
        rows = R._with_status(self.rows, status)
        if skip + limit <= self.held:
            return R.page(rows, skip, limit)
        counts, _ = self._of(status)
        place, skip = _covering(counts, skip)
        if place is None:  # rows without a time come last
            rows = rows.where(F.col("created_at").isNull())
            return self._among_ids(rows, skip).limit(limit)
        high = self.high - place * self.width
        low, count = high - self.width + 1, counts[place]
        last, _ = _covering(counts, sum(n for p, n in counts.items() if p < place) + skip + limit - 1)
        # without a last range the page runs into the rows without a time
        end = None if last is None else self.high - (last + 1) * self.width + 1
        while count > self.held and low < high:
            width = -(-(high - low + 1) // self.ranges)
            inner = _counted(_between(rows, low, high), high, width)
            place, skip = _covering(inner, skip)
            high, low = high - place * width, max(low, high - (place + 1) * width + 1)
            count = inner[place]
        at = F.col("created_at")
        start = at <= _time(rows, high)
        from_id = None
        if count > self.held:
            from_id, skip = self._id_at(_between(rows, low, high), skip)
        if from_id is not None:
            start = (at < _time(rows, high)) | ((at == _time(rows, high)) & (F.col("request_id") >= from_id))
        inside = start | at.isNull() if end is None else start & (at >= _time(rows, end))
        return rows.where(inside).orderBy(*R._newest_first()).offset(skip).limit(limit)

    def _among_ids(self, rows: DataFrame, skip: int) -> DataFrame:
        from_id, skip = self._id_at(rows, skip)
        if from_id is not None:
            rows = rows.where(F.col("request_id") >= from_id)
        return rows.orderBy("request_id").offset(skip)

    def _id_at(self, rows: DataFrame, skip: int):
        """(an id, rows to skip from it on): the rows share one time, and ids order them.

        Missing ids come first and are only counted.
        """
        ids = rows.select("request_id")
        while True:
            parts = max(2, -(-ids.count() // self.held))
            dealt = ids.repartitionByRange(parts, "request_id").withColumn("part", F.spark_partition_id())
            with materialized(dealt, "ids") as stored:
                found = stored.groupBy("part").agg(
                    F.count("*").alias("n"), F.count("request_id").alias("known"),
                    F.min("request_id").alias("first"), F.max("request_id").alias("last"),
                ).orderBy("part").collect()
            for part in found:
                if skip < part["n"]:
                    break
                skip -= part["n"]
            else:
                return (F.lit(found[-1]["last"]), found[-1]["n"] + skip) if found else (None, skip)
            if part["known"] < part["n"]:
                return None, skip  # begins among the missing ids, in the first part
            if part["n"] <= 2 * self.held or part["first"] == part["last"]:
                return F.lit(part["first"]), skip
            ids = ids.where((F.col("request_id") >= part["first"]) & (F.col("request_id") <= part["last"]))


def _covering(counts: dict[int, int], skip: int) -> tuple[int | None, int]:
    """(the range that holds row ``skip``, rows to skip in it); None beyond the last."""
    for place in sorted(counts):
        if skip < counts[place]:
            return place, skip
        skip -= counts[place]
    return None, skip


def _counted(rows: DataFrame, high: int, width: int) -> dict[int, int]:
    off = rows.select(
        (F.lit(high).cast("long") - _micros(rows)).alias("_off"), F.lit(width).cast("long").alias("_width")
    )
    found = off.groupBy(F.expr("_off div _width").alias("place")).agg(F.count("*").alias("n"))
    return {r["place"]: r["n"] for r in found.collect()}


def count_pages(
    df: DataFrame, ranges: int = RANGES, held: int = HELD, grid: tuple[int, int] | None = None
) -> PageCounts:
    """Count ``df`` (created_at, status, ...) per time range and known status, in two passes.

    ``grid`` gives the newest time and the width of a range; else they come from the rows.
    """
    micros = _micros(df)
    if grid is None:
        first, last = df.agg(F.min(micros), F.max(micros)).first()
        grid = (0, 1) if last is None else (last, -(-(last - first + 1) // ranges))
    high, width = grid
    known = F.when(F.col("status").isin(*S.LEAD_STATUSES), F.col("status"))
    off = df.select(
        (F.lit(high).cast("long") - micros).alias("_off"), F.lit(width).cast("long").alias("_width"),
        known.alias("status"),
    )
    found = off.groupBy(F.expr("_off div _width").alias("place"), "status").agg(F.count("*").alias("n"))
    counts = {name: {} for name in ("", *S.LEAD_STATUSES)}
    timeless = dict.fromkeys(counts, 0)
    for r in found.collect():
        for name in {"", r["status"] or ""}:
            if r["place"] is None:
                timeless[name] += r["n"]
            else:
                counts[name][r["place"]] = counts[name].get(r["place"], 0) + r["n"]
    return PageCounts(df, high, width, counts, timeless, ranges, held)
