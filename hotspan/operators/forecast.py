"""Daily forecasts from a multiplicative decomposition, fitted for every series of a table in one job.

    yhat = trend(t) * weekday factor * month factor * holiday factor

Each factor is a ratio of sums within its series. A series has one row per calendar day, all its rows share one
shuffle by ``series_key``, and the factors are window sums over that partitioning.
The trend is a straight line and the interval is analytic, normal around the fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotspan.functions.calendars import is_holiday
from hotspan.functions.temporal import day_name
from hotspan.functions.tiers import bround, change_verdict, whole_count
from hotspan.operators.distributions import percent_of
from hotspan.operators.series import daily_series

HORIZON_DAYS = 14
CONFIDENCE = 0.80
# Data needed before a forecast is made, and before its yearly term is.
MIN_ROWS, MIN_SPAN_DAYS, YEARLY_FROM_DAYS = 14, 14, 365
# Normal quantile of the two-sided 80 % interval, and the floor that keeps the trend positive.
INTERVAL_Z, TREND_FLOOR = 1.2816, 1e-6
MIN_HOLIDAYS = 2


def _ratio(num: Column, den: Column) -> Column:
    return num / F.nullif(den, F.lit(0.0))


def forecast_series(incidents: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Daily series with enough data to forecast: 14 incidents over at least 14 elapsed days."""
    return daily_series(incidents, by, MIN_ROWS, MIN_SPAN_DAYS)


def fit_decomposition(series: DataFrame, calendar: str | tuple = "rule") -> DataFrame:
    """One row per series: trend line, seven weekday factors, twelve month factors, holiday factor, residual spread.

    A series of a single day gets no row; ``forecast_series`` applies the full data minimum.
    """
    key = Window.partitionBy("series_key")
    by_dow, by_month = Window.partitionBy("series_key", "dow"), Window.partitionBy("series_key", "mon")
    by_holiday = Window.partitionBy("series_key", "hol")
    y = F.col("y").cast("double")
    base = (
        series.select("series_key", "ds", y.alias("y"), F.weekday("ds").alias("dow"), F.month("ds").alias("mon"),
                      is_holiday(F.col("ds"), calendar).cast("int").alias("hol"))
        .withColumns({"first_ds": F.min("ds").over(key), "last_ds": F.max("ds").over(key),
                      "n": F.count(F.lit(1)).over(key), "total": F.sum("y").over(key),
                      "holidays": F.sum("hol").over(key)})
        .where(F.col("n") >= 2)
        .withColumn("t", F.date_diff("ds", "first_ds").cast("double"))
        .withColumns({"slope": F.regr_slope("y", "t").over(key), "intercept": F.regr_intercept("y", "t").over(key)})
        .withColumn("trend", F.greatest(F.col("intercept") + F.col("slope") * F.col("t"), F.lit(TREND_FLOOR))))
    weekly = (
        base.withColumns({"w_raw": _ratio(F.sum("y").over(by_dow), F.sum("trend").over(by_dow)),
                          "in_dow": F.count(F.lit(1)).over(by_dow).cast("double")})
        # Summed once per weekday, this is the plain mean of the raw factors of the weekdays that occur.
        .withColumn("w", _ratio(F.col("w_raw"), F.sum(F.col("w_raw") / F.col("in_dow")).over(key)
                                / F.least(F.col("n"), F.lit(7)).cast("double")))
        .withColumn("level", F.col("trend") * F.col("w")))
    monthly = weekly.withColumn(
        "m", F.when(F.col("n") >= YEARLY_FROM_DAYS,
                    _ratio(F.sum("y").over(by_month), F.sum("level").over(by_month))).otherwise(F.lit(1.0)))
    held = (
        monthly.withColumn("level2", F.col("level") * F.col("m"))
        .withColumn("h_raw", _ratio(F.sum("y").over(by_holiday), F.sum("level2").over(by_holiday)))
        .withColumn("h", F.when((F.col("hol") == 1) & (F.col("holidays") >= MIN_HOLIDAYS), F.col("h_raw"))
                    .otherwise(F.lit(1.0)))
        .withColumn("residual", F.col("y") - F.col("level2") * F.col("h")))
    return held.groupBy("series_key").agg(
        F.first("first_ds").alias("first_ds"), F.first("last_ds").alias("last_ds"), F.first("n").alias("n_days"),
        F.first("total").cast("long").alias("n_incidents"),
        F.first("slope").alias("slope"), F.first("intercept").alias("intercept"),
        F.array(*[F.max(F.when(F.col("dow") == d, F.col("w"))) for d in range(7)]).alias("weekday_factors"),
        F.array(*[F.coalesce(F.max(F.when(F.col("mon") == m, F.col("m"))), F.lit(1.0)) for m in range(1, 13)])
        .alias("month_factors"),
        F.coalesce(F.max(F.when(F.col("hol") == 1, F.col("h"))), F.lit(1.0)).alias("holiday_factor"),
        F.stddev_samp("residual").alias("sigma"))


def predict(fit: DataFrame, horizon: int = HORIZON_DAYS, calendar: str | tuple = "rule") -> DataFrame:
    """The next ``horizon`` days of each fitted series, with unrounded yhat and bounds."""
    future = fit.withColumn("ds", F.explode(F.sequence(F.date_add("last_ds", 1), F.date_add("last_ds", horizon))))
    t = F.date_diff("ds", "first_ds").cast("double")
    trend = F.greatest(F.col("intercept") + F.col("slope") * t, F.lit(TREND_FLOOR))
    yhat = (trend * F.element_at("weekday_factors", F.weekday("ds") + 1)
            * F.element_at("month_factors", F.month("ds"))
            * F.when(is_holiday(F.col("ds"), calendar), F.col("holiday_factor")).otherwise(1.0))
    margin = F.lit(INTERVAL_Z) * F.col("sigma")
    return future.select("series_key", "ds", yhat.alias("yhat"), (yhat - margin).alias("yhat_lower"),
                         (yhat + margin).alias("yhat_upper"))


def forecast(incidents: DataFrame, by: list[str] | None = None, horizon: int = HORIZON_DAYS,
             calendar: str | tuple = "rule") -> DataFrame:
    """forecast_daily: whole, non-negative predictions with bounds and the height relative to the series' best day."""
    return forecast_daily(fit_decomposition(forecast_series(incidents, by), calendar), horizon, calendar)


def forecast_daily(fit: DataFrame, horizon: int = HORIZON_DAYS, calendar: str | tuple = "rule") -> DataFrame:
    """Rounded predictions of every fitted series."""
    return predict(fit, horizon, calendar).select(
        "series_key", "ds", day_name(F.weekday("ds")).alias("day_name"), whole_count(F.col("yhat")).alias("predicted"),
        whole_count(F.col("yhat_lower")).alias("lower"), whole_count(F.col("yhat_upper")).alias("upper"))


def forecast_chart(daily: DataFrame, digits: int = 4) -> DataFrame:
    """Each predicted day relative to the highest one of its series."""
    best = F.max("predicted").over(Window.partitionBy("series_key"))
    height = F.when(best > 0, bround(F.col("predicted") / best, digits)).otherwise(0.0)
    return daily.withColumn("relative_height", height)


def forecast_summary(daily: DataFrame, fit: DataFrame) -> DataFrame:
    """Total, average, best and worst day (the first on a tie) and the trend against the historical mean."""
    parts = daily.groupBy("series_key").agg(
        F.sum("predicted").alias("total_predicted"), bround(F.avg("predicted"), 1).alias("avg_daily"),
        F.max_by("ds", F.struct("predicted", -F.unix_date("ds"))).alias("peak_ds"), F.max("predicted").alias("peak_count"),
        F.min_by("ds", F.struct("predicted", "ds")).alias("low_ds"), F.min("predicted").alias("low_count"))
    history = fit.select("series_key", (F.col("n_incidents") / F.col("n_days")).alias("historical_avg"))
    pct = (F.col("avg_daily") - F.col("historical_avg")) / F.nullif(F.col("historical_avg"), F.lit(0.0)) * 100
    return parts.join(history, "series_key").select(
        "series_key", "total_predicted", "avg_daily", _day_text("peak_ds").alias("peak_day"), "peak_count",
        _day_text("low_ds").alias("low_day"), "low_count",
        change_verdict(pct, "increasing", "decreasing").alias("trend"), bround(pct, 1).alias("trend_pct"),
        F.lit(CONFIDENCE).alias("confidence_level"))


def _day_text(ds: str) -> Column:
    return F.date_format(ds, "EEEE, yyyy-MM-dd")


def forecast_weekly(daily: DataFrame) -> DataFrame:
    """Mean prediction per weekday."""
    return daily.groupBy("series_key", "day_name").agg(bround(F.avg("predicted"), 1).alias("avg_predicted"))


def forecast_by_type(incidents: DataFrame, daily: DataFrame, k: int = 3) -> DataFrame:
    """Split the whole-table forecast over the k most frequent types by their share of the dated rows."""
    dated = incidents.where(F.col("occurred_at").isNotNull())
    rows = dated.select(F.count(F.lit(1))).scalar()
    total = daily.select(F.sum("predicted")).scalar()
    best = dated.where(F.col("incident_type").isNotNull()).groupBy("incident_type").agg(
        F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "incident_type").limit(k)
    return best.select("incident_type", F.bround(total * (F.col("count") / rows), 0).cast("long").alias("predicted"),
                       percent_of(F.col("count"), rows).alias("pct_of_total"))
