"""Age, exponential recency weights and recency statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotspan.functions.temporal import days_ago, elapsed_days
from hotspan.functions.tiers import bround, recency_tier
from hotspan.operators.distributions import percent_of

HALF_LIFE_DAYS = 30


def date_span(incidents: DataFrame) -> Column:
    """Oldest and newest date of the table as one struct-valued scalar subquery."""
    return incidents.select(F.struct(F.min("occurred_at").alias("oldest"), F.max("occurred_at").alias("newest"))).scalar()


def recency_weight(incidents: DataFrame, half_life_days: int = HALF_LIFE_DAYS, out: str = "recency_weight") -> DataFrame:
    """Add ``0.5 ** (age / half life)``.

    The newest row has age 0, so the maximum is already 1. A row without a date gets the oldest age; a table
    without dates gets weight 1 throughout.
    """
    span = date_span(incidents)
    age = F.coalesce(days_ago(F.col("occurred_at"), span["newest"]), days_ago(span["oldest"], span["newest"]))
    weight = F.pow(F.lit(0.5), age / F.lit(float(half_life_days)))
    return incidents.withColumn(out, F.coalesce(weight, F.lit(1.0)))


def recency_band(age: Column) -> Column:
    """Disjoint age bands of the hotspot trend."""
    return F.when(age <= 30, "recent").when(age <= 90, "older").when(age > 90, "very_old")


def recency_stats(incidents: DataFrame) -> DataFrame:
    """One row: date range, counts by age, share of the last 30 days, and a 0-100 recency score."""
    newest = incidents.select(F.max("occurred_at")).scalar()
    aged = incidents.where(F.col("occurred_at").isNotNull()).select(
        "occurred_at", days_ago(F.col("occurred_at"), newest).alias("age"))
    age = F.col("age")
    counted = aged.agg(
        F.count(F.lit(1)).alias("n"), F.min("occurred_at").alias("oldest"), F.max("occurred_at").alias("newest"),
        F.count_if(age <= 7).alias("last_7_days"), F.count_if(age <= 30).alias("last_30_days"),
        F.count_if(age <= 90).alias("last_90_days"), F.count_if(age > 90).alias("older_than_90_days"),
        F.sum("age").alias("age_sum"))
    span = elapsed_days(F.col("newest"), F.col("oldest"))
    mean_age = F.col("age_sum") / F.col("n")
    score = F.when(span > 0, bround(F.lit(100) * (F.lit(1) - mean_age / span), 1))
    return counted.select(
        (F.col("n") > 0).alias("has_date_data"), span.alias("date_range_days"),
        F.date_format("oldest", "yyyy-MM-dd").alias("oldest_date"),
        F.date_format("newest", "yyyy-MM-dd").alias("newest_date"),
        "last_7_days", "last_30_days", "last_90_days", "older_than_90_days",
        percent_of(F.col("last_30_days"), F.col("n")).alias("recent_activity_pct"),
        score.alias("recency_score"), recency_tier(score).alias("recency_tier"))
