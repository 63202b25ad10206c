"""Verdicts and tiers: short decision chains over already aggregated numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bounds of the high and medium tiers, in percent.
HIGH_FROM, MEDIUM_FROM = 70, 40


def risk_tier(likelihood: Column) -> Column:
    return (
        F.when(likelihood.isNull(), "UNKNOWN").when(likelihood >= HIGH_FROM, "HIGH")
        .when(likelihood >= MEDIUM_FROM, "MEDIUM").otherwise("LOW")
    )


def risk_color(likelihood: Column) -> Column:
    return (
        F.when(likelihood.isNull(), "gray").when(likelihood >= HIGH_FROM, "red")
        .when(likelihood >= MEDIUM_FROM, "orange").otherwise("green")
    )


def recency_tier(score: Column) -> Column:
    return F.when(score >= HIGH_FROM, "HIGH").when(score >= MEDIUM_FROM, "MEDIUM").when(score.isNotNull(), "LOW")


def change_verdict(pct: Column, up: str, down: str, flat: str = "stable", band: float = 10.0) -> Column:
    """Direction of a percentage change outside a symmetric band; NULL stays NULL."""
    return F.when(pct > band, up).when(pct < -band, down).when(pct.isNotNull(), flat)


def ratio_verdict(ratio: Column) -> Column:
    """Compare two rates: higher above 1.2, lower below 0.8."""
    return F.when(ratio > 1.2, "higher").when(ratio < 0.8, "lower").when(ratio.isNotNull(), "similar")


def weekend_verdict(weekday_count: Column, weekend_count: Column) -> Column:
    """Average weekday against average weekend day, with a factor of 1.2 either way."""
    weekday, weekend = weekday_count / F.lit(5.0), weekend_count / F.lit(2.0)
    return (
        F.when((weekday_count + weekend_count) == 0, None)
        .when(weekend > weekday * 1.2, "weekend").when(weekday > weekend * 1.2, "weekday").otherwise("balanced")
    )


def hotspot_trend(recent: Column, older: Column, very_old: Column) -> Column:
    """Momentum from counts of the last 30 days, days 31 to 90, and everything before.

    NULL when nothing is dated.
    """
    per_month = older / F.lit(2.0)
    growth = (
        F.when(recent > per_month * 1.5, "growing").when(recent < per_month * 0.5, "shrinking").otherwise("stable")
    )
    return (
        F.when(recent + older + very_old == 0, None)
        .when(older + very_old == 0, "new")
        .when(recent == 0, "inactive")
        .when(older > 0, growth)
        .otherwise("stable")
    )


def bround(col: Column, digits: int) -> Column:
    """Half-even rounding of the decimal text."""
    return F.bround(col, digits)


def whole_count(col: Column) -> Column:
    """Rounded to a whole number, never below zero."""
    return F.greatest(F.lit(0), F.bround(col, 0).cast("long"))
