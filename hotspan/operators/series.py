"""Daily counts and gap-filled daily series, for the whole table or for any key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotspan.functions.temporal import elapsed_days

WHOLE_TABLE = "all"


def series_key(by: list[str]) -> Column:
    """Text key of a series; the whole table is the series ``all``."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by]
    return F.concat_ws("|", *parts) if by else F.lit(WHOLE_TABLE)


def _counted_days(incidents: DataFrame, by: list[str] | None) -> DataFrame:
    return incidents.where(F.col("occurred_at").isNotNull()).groupBy(
        series_key(by or []).alias("series_key"), F.to_date("occurred_at").alias("ds")
    ).agg(F.count(F.lit(1)).alias("y"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))


def daily_counts(incidents: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows per (series_key, ds), days without incidents missing."""
    return _counted_days(incidents, by).select("series_key", "ds", "y")


def daily_series(incidents: DataFrame, by: list[str] | None = None, min_rows: int = 0,
                 min_span_days: int = 0) -> DataFrame:
    """Dense (series_key, ds, y) from the first to the last day of each series, absent days as 0.

    Each counted day is stretched up to the day before the next one. A series is at most one row per calendar
    day by then, so the window groups stay small however many incidents a key has, and no calendar is joined.
    Series with fewer incidents than ``min_rows`` or a shorter elapsed span than ``min_span_days`` are left out.
    """
    key = Window.partitionBy("series_key")
    until = F.coalesce(F.date_sub(F.lead("ds").over(key.orderBy("ds")), 1), F.col("ds"))
    counted = _counted_days(incidents, by).withColumn("until", until)
    if min_rows > 0 or min_span_days > 0:
        span = elapsed_days(F.max("last_at").over(key), F.min("first_at").over(key))
        counted = counted.withColumns({"rows": F.sum("y").over(key), "span": span}).where(
            (F.col("rows") >= min_rows) & (F.col("span") >= min_span_days))
    return counted.select("series_key", "y", F.posexplode(F.sequence("ds", "until"))).select(
        "series_key", F.col("col").alias("ds"), F.when(F.col("pos") == 0, F.col("y")).otherwise(0).alias("y"))
