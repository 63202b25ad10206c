"""Trends over the whole table and timing profiles per type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspan.functions.temporal import TIME_PERIODS, is_weekend, time_period
from hotspan.functions.tiers import bround, change_verdict, weekend_verdict as weekend_rule
from hotspan.operators.distributions import number_of, rank_within, ranked_list
from hotspan.operators.recency import date_span

MIN_TREND_ROWS = 10


def _trend_row(halves: DataFrame, min_rows: int) -> DataFrame:
    """Verdict row from columns n, first_half and second_half."""
    pct = (F.col("second_half") - F.col("first_half")) / F.nullif(F.col("first_half"), F.lit(0)) * 100
    gated = F.when(F.col("n") >= min_rows, pct)
    return halves.select("first_half", "second_half", bround(gated, 1).alias("trend_change_pct"),
                         change_verdict(gated, "rising", "falling").alias("recent_trend"))


def row_half_trend(incidents: DataFrame, min_rows: int = MIN_TREND_ROWS) -> DataFrame:
    """Compare the earlier and the later half of the dated rows by count.

    The halves of n sorted rows hold n // 2 and n - n // 2 of them whatever the dates, so only the row count is needed.
    """
    halves = incidents.agg(F.count("occurred_at").alias("n")).select(
        "n", F.floor(F.col("n") / 2).alias("first_half"), (F.col("n") - F.floor(F.col("n") / 2)).alias("second_half"))
    return _trend_row(halves, min_rows)


def time_half_trend(incidents: DataFrame, min_rows: int = MIN_TREND_ROWS) -> DataFrame:
    """Compare the counts before and from the midpoint of the covered time span."""
    span = date_span(incidents)
    first, last = F.unix_micros(span["oldest"]), F.unix_micros(span["newest"])
    twice = F.unix_micros("occurred_at") * 2
    halves = incidents.agg(
        F.count("occurred_at").alias("n"), F.count_if(twice < first + last).alias("first_half"),
        F.count_if(twice >= first + last).alias("second_half"))
    return _trend_row(halves, min_rows)


def weekend_verdict(incidents: DataFrame) -> DataFrame:
    """Weekday and weekend counts of the whole table and which is busier per day."""
    weekend = is_weekend(F.col("day_of_week"))
    counted = incidents.agg(number_of(incidents, ~weekend).alias("weekday_count"), number_of(incidents, weekend).alias("weekend_count"))
    return counted.withColumn("weekend_vs_weekday", weekend_rule(F.col("weekday_count"), F.col("weekend_count")))


def type_patterns(incidents: DataFrame, k: int = 5) -> DataFrame:
    """Timing profile of the k most frequent types: peak hours, days and period, weekend verdict.

    One scan counts (type, hour, day of week); that table has at most 200 rows per type and everything else
    is derived from it.
    """
    facts = incidents.where(F.col("incident_type").isNotNull()).groupBy(
        "incident_type", "hour", "day_of_week").agg(number_of(incidents).alias("count"))
    best = facts.groupBy("incident_type").agg(F.sum("count").alias("count")).orderBy(
        F.desc("count"), "incident_type").limit(k)
    kept = facts.join(F.broadcast(best.select("incident_type")), "incident_type", "left_semi")
    return timing_profile(kept, ["incident_type"], best)


def timing_profile(facts: DataFrame, keys: list[str], base: DataFrame, k: int = 2) -> DataFrame:
    """Add peak_hours, peak_days, peak_period and weekend_vs_weekday to one row per group.

    ``facts`` holds a count per (keys, hour, day_of_week); ``base`` has one row per group.
    """
    def best(column: str, out: str) -> DataFrame:
        counts = facts.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.sum("count").alias("count"))
        return ranked_list(rank_within(counts, keys, column, k), keys, F.col(column), out)

    per_period = [F.sum(F.when(time_period(F.col("hour")) == p, F.col("count")).otherwise(0)) for p in TIME_PERIODS]
    candidates = F.array(*[
        F.struct(n.alias("n"), F.lit(-i).alias("o"), F.lit(p).alias("p")) for i, (p, n) in
        enumerate(zip(TIME_PERIODS, per_period))])
    weekend = is_weekend(F.col("day_of_week"))
    flags = facts.groupBy(*keys).agg(
        F.when(F.sum(F.when(F.col("hour").isNotNull(), F.col("count"))) > 0, F.array_max(candidates)["p"])
        .alias("peak_period"),
        F.sum(F.when(~weekend, F.col("count")).otherwise(0)).alias("_weekday"),
        F.sum(F.when(weekend, F.col("count")).otherwise(0)).alias("_weekend"))
    return (
        base.join(best("hour", "peak_hours"), keys, "left").join(best("day_of_week", "peak_days"), keys, "left")
        .join(flags, keys, "left")
        .withColumn("weekend_vs_weekday", weekend_rule(F.col("_weekday"), F.col("_weekend")))
        .drop("_weekday", "_weekend"))
