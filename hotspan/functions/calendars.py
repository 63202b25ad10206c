"""Holiday calendars.

``FIXED`` repeats the same month and day every year. ``RULE`` moves the floating holidays to their real
weekday. Both are constants, so proximity to them is a plain expression: no join and no Python function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotspan.functions.temporal import elapsed_days

# Fixed values: (month, day) of each holiday.
FIXED = (
    (1, 1), (1, 15), (2, 19), (5, 27), (7, 4), (9, 2), (10, 14), (11, 11), (11, 28), (12, 25), (12, 31),
)

# Fixed values: (month, day, weekday). With a weekday, the holiday is the first such weekday on or after the day.
RULE = (
    (1, 1, None), (1, 15, "MON"), (2, 15, "MON"), (5, 25, "MON"), (7, 4, None), (9, 1, "MON"),
    (10, 8, "MON"), (11, 11, None), (11, 22, "THU"), (12, 25, None), (12, 31, None),
)

CALENDARS = {"fixed": FIXED, "rule": RULE}

# Fixed value: proximity is never reported beyond this many days.
FARTHEST_DAYS = 365


def holiday_dates(year: Column, calendar: str | tuple = "fixed") -> list[Column]:
    """One date expression per holiday of the given year."""
    entries = CALENDARS[calendar] if isinstance(calendar, str) else calendar
    dates = []
    for month, day, *weekday in entries:
        base = F.make_date(year, F.lit(month), F.lit(day))
        floating = bool(weekday) and weekday[0] is not None
        dates.append(F.next_day(F.date_sub(base, 1), weekday[0]) if floating else base)
    return dates


def days_to_holiday(ts: Column, calendar: str | tuple = "fixed") -> Column:
    """Days to the nearest holiday of the same year. Elapsed time is floored before the sign is dropped."""
    gaps = [F.abs(elapsed_days(ts, d.cast("timestamp"))) for d in holiday_dates(F.year(ts), calendar)]
    return F.when(ts.isNotNull(), F.least(*gaps, F.lit(FARTHEST_DAYS)))


def near_holiday(ts: Column, calendar: str | tuple = "fixed", days: int = 3) -> Column:
    return days_to_holiday(ts, calendar) <= days


def is_holiday(day: Column, calendar: str | tuple = "rule") -> Column:
    """Whether a date is itself a holiday."""
    return day.isin(*holiday_dates(F.year(day), calendar))


def days_to_calendar_day(df: DataFrame, calendar: DataFrame, day: str = "day", ts: str = "occurred_at",
                         out: str = "days_to_holiday") -> DataFrame:
    """Proximity to a calendar held in a table with one date column.

    The calendar folds into one row per year holding at most 366 distinct days, so the broadcast side is bounded by
    the range of the date type and the incidents are not shuffled.
    """
    by_year = (
        calendar.select(F.col(day).cast("date").alias("d")).where(F.col("d").isNotNull()).distinct()
        .groupBy(F.year("d").alias("_year")).agg(F.collect_list("d").alias("_days")))
    at = F.col(ts)
    gaps = F.transform("_days", lambda d: F.abs(elapsed_days(at, d.cast("timestamp"))))
    nearest = F.coalesce(F.array_min(gaps), F.lit(FARTHEST_DAYS))
    joined = df.withColumn("_year", F.year(at)).join(F.broadcast(by_year), "_year", "left")
    return joined.withColumn(out, F.when(at.isNotNull(), F.least(nearest, F.lit(FARTHEST_DAYS)))).drop("_year", "_days")
