"""Daily series and forecasts."""

from pyspark.sql import functions as F

from checks.ingest import RULE_DAYS
from checks.registry import query
from checks.tables import EVENTS, ORDERS, inc_events, inc_orders
from hotspan.functions.tiers import bround
from hotspan.operators import forecast as FC
from hotspan.operators import series as S


def series_sql(inc: str, key: str) -> str:
    """CTEs up to ``ser(series_key, ds, y)`` with every day of each series."""
    return f"""{inc}, keyed AS (SELECT {key} AS series_key, CAST(occurred_at AS DATE) AS ds, occurred_at FROM inc WHERE occurred_at IS NOT NULL),
  cnt AS (SELECT series_key, ds, count(*) AS y FROM keyed GROUP BY 1, 2),
  rng AS (SELECT series_key, min(ds) AS lo, max(ds) AS hi, count(*) AS total,
    floor((epoch_us(max(occurred_at)) - epoch_us(min(occurred_at))) / 86400000000.0) AS span FROM keyed GROUP BY 1),
  cal AS (SELECT series_key, total, span, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ds FROM rng),
  ser AS (SELECT series_key, ds, coalesce(y, 0) AS y, total, span FROM cal LEFT JOIN cnt USING (series_key, ds))"""


def fit_sql(inc: str, key: str) -> str:
    """CTEs up to ``pred(series_key, ds, yhat, lo, hi)`` by successive grouped joins."""
    return f"""WITH {series_sql(inc, key)}, {RULE_DAYS},
  pts AS (SELECT series_key, ds, y::DOUBLE AS y, isodow(ds) - 1 AS dow, month(ds) AS mon, ds IN (SELECT d FROM rule_days) AS hol,
    (ds - min(ds) OVER (PARTITION BY series_key))::DOUBLE AS t FROM ser WHERE total >= 14 AND span >= 14),
  lin AS (SELECT series_key, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept, count(*) AS n, min(ds) AS lo, max(ds) AS hi, sum(y) AS total,
    count(*) FILTER (hol) AS hols FROM pts GROUP BY 1),
  t1 AS (SELECT p.*, l.n, l.hols, greatest(l.intercept + l.slope * p.t, 1e-6::DOUBLE) AS trend FROM pts p JOIN lin l USING (series_key)),
  w0 AS (SELECT series_key, dow, sum(y) / sum(trend) AS w FROM t1 GROUP BY 1, 2),
  w1 AS (SELECT series_key, dow, w / avg(w) OVER (PARTITION BY series_key) AS w FROM w0),
  t2 AS (SELECT t1.*, trend * w AS level FROM t1 JOIN w1 USING (series_key, dow)),
  m1 AS (SELECT series_key, mon, CASE WHEN max(n) >= 365 THEN sum(y) / sum(level) ELSE 1.0::DOUBLE END AS m FROM t2 GROUP BY 1, 2),
  t3 AS (SELECT t2.*, level * m AS level2 FROM t2 JOIN m1 USING (series_key, mon)),
  h1 AS (SELECT series_key, CASE WHEN max(hols) >= 2 THEN sum(y) FILTER (hol) / sum(level2) FILTER (hol) ELSE 1.0::DOUBLE END AS h FROM t3 GROUP BY 1),
  s1 AS (SELECT series_key, stddev_samp(y - level2 * CASE WHEN hol THEN h ELSE 1 END) AS sigma FROM t3 JOIN h1 USING (series_key) GROUP BY 1),
  fut AS (SELECT series_key, CAST(unnest(generate_series(hi + INTERVAL 1 DAY, hi + INTERVAL 14 DAY, INTERVAL 1 DAY)) AS DATE) AS ds, lo, slope, intercept FROM lin),
  pred AS (SELECT f.series_key, f.ds, greatest(intercept + slope * (ds - lo), 1e-6::DOUBLE) * w * coalesce(m, 1) *
      CASE WHEN ds IN (SELECT d FROM rule_days) THEN h ELSE 1 END AS yhat, 1.2816::DOUBLE * sigma AS margin
    FROM fut f JOIN w1 ON w1.series_key = f.series_key AND w1.dow = isodow(f.ds) - 1
    LEFT JOIN m1 ON m1.series_key = f.series_key AND m1.mon = month(f.ds) JOIN h1 ON h1.series_key = f.series_key JOIN s1 ON s1.series_key = f.series_key),
  daily AS (SELECT series_key, ds, strftime(ds, '%A') AS day_name, greatest(0, round_even(yhat, 0)::BIGINT) AS predicted,
    greatest(0, round_even(yhat - margin, 0)::BIGINT) AS lower, greatest(0, round_even(yhat + margin, 0)::BIGINT) AS upper FROM pred)"""


_DAILY = "SELECT series_key, strftime(ds, '%Y-%m-%d') AS ds, day_name, predicted, lower, upper FROM daily"


def with_text_date(df):
    return df.withColumn("ds", F.date_format("ds", "yyyy-MM-dd"))


def fitted(df, by=None):
    return FC.fit_decomposition(FC.forecast_series(df, by))


@query(f"WITH {EVENTS} SELECT incident_type AS series_key, strftime(occurred_at, '%Y-%m-%d') AS ds, count(*) AS y FROM inc GROUP BY 1, 2")
def daily_counts(spark, sf_dir):
    return with_text_date(S.daily_counts(inc_events(spark, sf_dir), ["incident_type"]))


@query(f"WITH {series_sql(ORDERS, chr(39) + 'all' + chr(39))} SELECT series_key, strftime(ds, '%Y-%m-%d') AS ds, y FROM ser")
def daily_series(spark, sf_dir):
    return with_text_date(S.daily_series(inc_orders(spark, sf_dir)))


_PLACE = "concat_ws('|', CAST(day_of_week AS VARCHAR), incident_type)"
_CELL_KEY = "CAST(CAST(round_even(latitude * 100, 0) AS BIGINT) AS VARCHAR)"


@query(f"WITH {series_sql(ORDERS, _PLACE)} SELECT series_key, strftime(ds, '%Y-%m-%d') AS ds, y FROM ser")
def daily_series_by_key(spark, sf_dir):
    return with_text_date(S.daily_series(inc_orders(spark, sf_dir), ["day_of_week", "incident_type"]))


@query(f"""{fit_sql(ORDERS, "'all'")} SELECT lin.series_key, strftime(lo, '%Y-%m-%d') AS first_ds, strftime(hi, '%Y-%m-%d') AS last_ds, n AS n_days,
  total::BIGINT AS n_incidents, round_even(slope, 8) AS slope, round_even(intercept, 6) AS intercept, round_even(h, 6) AS holiday_factor, round_even(sigma, 6) AS sigma,
  (SELECT string_agg(CAST(round_even(w * 10000, 0) AS BIGINT), ',' ORDER BY dow) FROM w1) AS weekday_factors,
  (SELECT string_agg(CAST(round_even(m * 10000, 0) AS BIGINT), ',' ORDER BY mon) FROM m1) AS month_factors
  FROM lin JOIN h1 USING (series_key) JOIN s1 USING (series_key)""")
def fit_decomposition(spark, sf_dir):
    df = fitted(inc_orders(spark, sf_dir))
    scaled = {c: F.array_join(F.transform(c, lambda x: F.bround(x * 10000, 0).cast("long").cast("string")), ",")
              for c in ("weekday_factors", "month_factors")}
    digits = {"slope": 8, "intercept": 6, "holiday_factor": 6, "sigma": 6}
    dates = {c: F.date_format(c, "yyyy-MM-dd") for c in ("first_ds", "last_ds")}
    return df.withColumns(scaled | dates | {c: bround(F.col(c), d) for c, d in digits.items()})


@query(f"{fit_sql(ORDERS, chr(39) + 'all' + chr(39))} {_DAILY}")
def forecast_daily(spark, sf_dir):
    return with_text_date(FC.forecast(inc_orders(spark, sf_dir)))


@query(f"{fit_sql(EVENTS, chr(39) + 'all' + chr(39))} {_DAILY}")
def forecast_daily_short_history(spark, sf_dir):
    return with_text_date(FC.forecast(inc_events(spark, sf_dir)))


@query(f"{fit_sql(ORDERS, 'incident_type')} {_DAILY}")
def forecast_daily_by_type(spark, sf_dir):
    return with_text_date(FC.forecast(inc_orders(spark, sf_dir), ["incident_type"]))


@query(f"{fit_sql(ORDERS, _CELL_KEY)} {_DAILY}")
def forecast_daily_many_series(spark, sf_dir):
    df = inc_orders(spark, sf_dir).withColumn("cell", F.rint(F.col("latitude") * 100).cast("long"))
    return with_text_date(FC.forecast(df, ["cell"]))


@query(f"""{fit_sql(ORDERS, 'incident_type')}, best AS (SELECT series_key, max(predicted) AS top FROM daily GROUP BY 1)
  SELECT series_key, strftime(ds, '%Y-%m-%d') AS ds, predicted, CASE WHEN top > 0 THEN round_even(predicted / top, 4) ELSE 0 END AS relative_height
  FROM daily JOIN best USING (series_key)""")
def forecast_chart(spark, sf_dir):
    return with_text_date(FC.forecast_chart(FC.forecast(inc_orders(spark, sf_dir), ["incident_type"]))).select(
        "series_key", "ds", "predicted", "relative_height")


@query(f"""{fit_sql(ORDERS, 'incident_type')},
  hi AS (SELECT series_key, ds, row_number() OVER (PARTITION BY series_key ORDER BY predicted DESC, ds) AS r FROM daily),
  lo AS (SELECT series_key, ds, row_number() OVER (PARTITION BY series_key ORDER BY predicted, ds) AS r FROM daily),
  a AS (SELECT series_key, sum(predicted)::BIGINT AS total_predicted, round_even(avg(predicted), 1) AS avg_daily, max(predicted) AS peak_count, min(predicted) AS low_count FROM daily GROUP BY 1),
  p AS (SELECT a.*, (avg_daily - total / n) / (total / n) * 100 AS pct FROM a JOIN lin USING (series_key))
  SELECT series_key, total_predicted, avg_daily, strftime(hi.ds, '%A, %Y-%m-%d') AS peak_day, peak_count, strftime(lo.ds, '%A, %Y-%m-%d') AS low_day, low_count,
    CASE WHEN pct > 10 THEN 'increasing' WHEN pct < -10 THEN 'decreasing' ELSE 'stable' END AS trend, round_even(pct, 1) AS trend_pct, 0.8::DOUBLE AS confidence_level
  FROM p JOIN hi USING (series_key) JOIN lo USING (series_key) WHERE hi.r = 1 AND lo.r = 1""")
def forecast_summary(spark, sf_dir):
    fit = fitted(inc_orders(spark, sf_dir), ["incident_type"])
    return FC.forecast_summary(FC.forecast_daily(fit), fit)


@query(f"{fit_sql(ORDERS, chr(39) + 'all' + chr(39))} SELECT series_key, day_name, round_even(avg(predicted), 1) AS avg_predicted FROM daily GROUP BY 1, 2")
def forecast_weekly(spark, sf_dir):
    return FC.forecast_weekly(FC.forecast(inc_orders(spark, sf_dir)))


@query(f"""{fit_sql(ORDERS, chr(39) + 'all' + chr(39))}, tot AS (SELECT sum(predicted) AS s FROM daily), rows_ AS (SELECT count(*) AS n FROM inc)
  SELECT incident_type, round_even(s * (count(*) / n), 0)::BIGINT AS predicted, round_even(count(*) / n * 100, 1) AS pct_of_total
  FROM inc, tot, rows_ GROUP BY incident_type, s, n ORDER BY count(*) DESC, incident_type LIMIT 3""")
def forecast_by_type(spark, sf_dir):
    df = inc_orders(spark, sf_dir)
    return FC.forecast_by_type(df, FC.forecast(df))
