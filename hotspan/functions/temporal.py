"""Calendar and elapsed-time expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000

# Labels, in the order that breaks ties between equal counts.
TIME_PERIODS = ("morning", "afternoon", "evening", "night")
SEASONS = ("winter", "spring", "summer", "fall")

# Days of the month counted as paydays.
PAYDAYS = (1, 2, 15, 16)


def calendar_columns(df: DataFrame, ts: str = "occurred_at") -> DataFrame:
    """Add day_of_week (0 = Monday), month, quarter, day_of_month and year."""
    at = F.col(ts)
    return df.withColumns({
        "day_of_week": F.weekday(at), "month": F.month(at), "quarter": F.quarter(at),
        "day_of_month": F.dayofmonth(at), "year": F.year(at),
    })


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole days between two timestamps, floored (not a calendar-day difference)."""
    micros = F.unix_micros(later) - F.unix_micros(earlier)
    return ((micros - F.pmod(micros, F.lit(MICROS_PER_DAY))) / F.lit(MICROS_PER_DAY)).cast("long")


def days_ago(ts: Column, newest: Column) -> Column:
    """Age in whole days against the newest record."""
    return elapsed_days(newest, ts)


def time_period(hour: Column) -> Column:
    """Part of the day; a NULL hour has none."""
    return (
        F.when((hour >= 6) & (hour < 12), "morning")
        .when((hour >= 12) & (hour < 18), "afternoon")
        .when((hour >= 18) & (hour < 22), "evening")
        .when((hour >= 22) | (hour < 6), "night")
    )


def season(month: Column) -> Column:
    """Northern-hemisphere season of a month number."""
    return (
        F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer").when(month.isin(9, 10, 11), "fall")
    )


def is_weekend(day_of_week: Column) -> Column:
    return day_of_week >= 5


def is_payday(day_of_month: Column) -> Column:
    return day_of_month.isin(*PAYDAYS)


def month_name(month: Column) -> Column:
    """1 -> Jan."""
    return F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMM")


def day_name(day_of_week: Column) -> Column:
    """0 -> Monday. The third of January 2000 was a Monday."""
    return F.date_format(F.date_add(F.lit("2000-01-03").cast("date"), day_of_week), "EEEE")


def quarter_label(quarter: Column) -> Column:
    """1 -> Q1."""
    return F.concat(F.lit("Q"), quarter.cast("string"))
