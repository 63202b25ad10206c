"""Holiday, payday and year-over-year effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotspan.functions.calendars import days_to_holiday
from hotspan.functions.temporal import PAYDAYS, elapsed_days, is_payday
from hotspan.functions.tiers import bround, ratio_verdict
from hotspan.operators.distributions import number_of

MIN_SEASONAL_ROWS = 10

# Days of a year counted as holiday time, and the usual number of other days in a month.
HOLIDAY_DAYS = 77
ORDINARY_DAYS_PER_MONTH = 26


def holiday_effect(incidents: DataFrame, calendar: str | tuple = "fixed", days: int = 3,
                   holiday_days: int = HOLIDAY_DAYS, min_rows: int = MIN_SEASONAL_ROWS) -> DataFrame:
    """Daily rate near holidays against the rate on all other days. NULL throughout below ``min_rows`` dated rows."""
    gap = days_to_holiday(F.col("occurred_at"), calendar)
    counted = incidents.where(F.col("occurred_at").isNotNull()).select("occurred_at", gap.alias("gap")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("gap") <= days).alias("near"),
        F.count_if(F.col("gap") > days).alias("far"),
        (elapsed_days(F.max("occurred_at"), F.min("occurred_at")) + 1).alias("span"))
    enough = F.col("n") >= min_rows
    rated = counted.select(
        F.when(enough, F.col("near")).alias("near"), F.when(enough, F.col("far")).alias("far"),
        F.least(F.lit(holiday_days), F.col("span")).alias("near_days"), "span").select(
        "near", "far", (F.col("near") / F.col("near_days")).alias("near_rate"),
        (F.col("far") / F.greatest(F.lit(1), F.col("span") - F.col("near_days"))).alias("far_rate"))
    return rated.select(
        F.col("near").alias("near_holiday_count"), F.col("far").alias("normal_days_count"),
        bround(F.col("near_rate"), 2).alias("near_holiday_rate"), bround(F.col("far_rate"), 2).alias("normal_rate"),
        ratio_verdict(F.col("near_rate") / F.nullif(F.col("far_rate"), F.lit(0.0))).alias("holiday_spike"))


def payday_effect(incidents: DataFrame, min_rows: int = MIN_SEASONAL_ROWS) -> DataFrame:
    """Rate on paydays against the rate on the other days of the month. NULL throughout below ``min_rows`` dated rows."""
    payday = is_payday(F.dayofmonth("occurred_at"))
    enough = F.count("occurred_at") >= min_rows
    counted = incidents.where(F.col("occurred_at").isNotNull()).agg(
        F.when(enough, F.count_if(payday)).alias("payday_count"),
        F.when(enough, F.count_if(~payday)).alias("non_payday_count"))
    pay = F.col("payday_count") / F.lit(float(len(PAYDAYS)))
    other = F.col("non_payday_count") / F.lit(float(ORDINARY_DAYS_PER_MONTH))
    return counted.select(
        "payday_count", "non_payday_count", bround(pay, 2).alias("payday_rate"),
        bround(other, 2).alias("non_payday_rate"),
        ratio_verdict(pay / F.nullif(other, F.lit(0.0))).alias("payday_spike"))


def yearly_counts(incidents: DataFrame) -> DataFrame:
    return incidents.where(F.col("year").isNotNull()).groupBy("year").agg(number_of(incidents).alias("count"))


def _change_text(years: Column, first: Column, last: Column) -> Column:
    """Change from the first year's count to the last one's in words, NULL for fewer than two years."""
    pct = (last - first) / first * 100
    whole = F.bround(pct, 0).cast("long").cast("string")
    return (
        F.when(years < 2, None)
        .when(pct > 10, F.concat(F.lit("increasing (+"), whole, F.lit("%)")))
        .when(pct < -10, F.concat(F.lit("decreasing ("), whole, F.lit("%)")))
        .when(years >= 2, "stable"))


def year_over_year(incidents: DataFrame) -> DataFrame:
    """Last year present against the first one; the text is NULL when only one year is present."""
    ends = yearly_counts(incidents).agg(
        F.count(F.lit(1)).alias("years"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.min_by("count", "year").alias("first_count"), F.max_by("count", "year").alias("last_count"))
    return ends.select("years", "first_year", "last_year", "first_count", "last_count",
                       _change_text(F.col("years"), F.col("first_count"), F.col("last_count")).alias("year_over_year"))


def seasonal_verdicts(incidents: DataFrame, calendar: str | tuple = "fixed", holiday_days: int = HOLIDAY_DAYS, days: int = 3) -> DataFrame:
    """One row with every seasonal conclusion, from one scan: counts per year first, conclusions from their sums."""
    gap, payday = days_to_holiday(F.col("occurred_at"), calendar), is_payday(F.dayofmonth("occurred_at"))
    months = [f"m{m}" for m in range(1, 13)]
    counts = ["n", "near", "paydays", *months]
    yearly = incidents.where(F.col("occurred_at").isNotNull()).select("year", "month", "occurred_at", gap.alias("gap"), payday.alias("payday"))
    yearly = yearly.groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("gap") <= days).alias("near"), F.count_if("payday").alias("paydays"),
        *[F.count_if(F.col("month") == i + 1).alias(m) for i, m in enumerate(months)],
        F.min("occurred_at").alias("oldest"), F.max("occurred_at").alias("newest"))
    one = yearly.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts], F.count("year").alias("years"),
        F.min_by("n", "year").alias("first_count"), F.max_by("n", "year").alias("last_count"),
        (elapsed_days(F.max("newest"), F.min("oldest")) + 1).alias("span"))

    def summed(*numbers: int) -> Column:
        return sum((F.col(f"m{m}") for m in numbers[1:]), F.col(f"m{numbers[0]}"))

    def first_of_most(labels: dict[str, Column]) -> Column:
        """Label with the highest count; ties go to the earlier one."""
        ranked = F.array(*[F.struct((-c).alias("c"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, c) in enumerate(labels.items())])
        return F.array_min(ranked)["name"]

    by_month = F.array(*[F.struct((-F.col(m)).alias("c"), F.lit(i + 1).alias("month")) for i, m in enumerate(months)])
    top = F.slice(F.array_sort(F.filter(by_month, lambda s: s["c"] < 0)), 1, 3)
    near_days = F.least(F.lit(holiday_days), F.col("span"))
    near_rate = F.col("near") / near_days
    far_rate = (F.col("n") - F.col("near")) / F.greatest(F.lit(1), F.col("span") - near_days)
    pay_rate = F.col("paydays") / F.lit(float(len(PAYDAYS)))
    other_rate = (F.col("n") - F.col("paydays")) / F.lit(float(ORDINARY_DAYS_PER_MONTH))
    verdicts = {
        "peak_months": F.transform(top, lambda s: s["month"]),
        "peak_quarter": first_of_most({f"Q{q}": summed(3 * q - 2, 3 * q - 1, 3 * q) for q in (1, 2, 3, 4)}),
        "dominant_season": first_of_most({"winter": summed(12, 1, 2), "spring": summed(3, 4, 5), "summer": summed(6, 7, 8), "fall": summed(9, 10, 11)}),
        "holiday_spike": ratio_verdict(near_rate / F.nullif(far_rate, F.lit(0.0))),
        "payday_spike": ratio_verdict(pay_rate / F.nullif(other_rate, F.lit(0.0))),
        "year_over_year": _change_text(F.col("years"), F.col("first_count"), F.col("last_count"))}
    enough = F.col("n") >= MIN_SEASONAL_ROWS
    return one.select(enough.alias("has_seasonal_data"), *[F.when(enough, v).alias(name) for name, v in verdicts.items()])
