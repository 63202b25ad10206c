"""Totals, distributions, peaks, trends and recency."""

from pyspark.sql import functions as F

from checks.registry import query
from checks.tables import EVENTS, ORDERS, inc_events, inc_orders
from hotspan.functions.tiers import bround
from hotspan.operators import distributions as D
from hotspan.operators import patterns, recency, seasonal

PERIOD = ("CASE WHEN hour >= 6 AND hour < 12 THEN 'morning' WHEN hour >= 12 AND hour < 18 THEN 'afternoon'"
          " WHEN hour >= 18 AND hour < 22 THEN 'evening' WHEN hour IS NOT NULL THEN 'night' END")
SEASON = ("CASE WHEN month IN (12, 1, 2) THEN 'winter' WHEN month IN (3, 4, 5) THEN 'spring'"
          " WHEN month IN (6, 7, 8) THEN 'summer' WHEN month IN (9, 10, 11) THEN 'fall' END")
_PERIODS = "(VALUES ('morning', 0), ('afternoon', 1), ('evening', 2), ('night', 3)) AS l(label, ordinal)"
_SEASONS = "(VALUES ('winter', 0), ('spring', 1), ('summer', 2), ('fall', 3)) AS l(label, ordinal)"


def _labelled(inc: str, expr: str, labels: str) -> str:
    return (f"WITH {inc}, c AS (SELECT {expr} AS label, count(*) AS n FROM inc GROUP BY 1),"
            f" f AS (SELECT label, CAST(ordinal AS INT) AS ordinal, coalesce(n, 0) AS count FROM {labels} LEFT JOIN c USING (label))")


@query(f"WITH {EVENTS} SELECT count(*) AS total_records, count(DISTINCT incident_type) AS distinct_types FROM inc")
def summary(spark, sf_dir):
    return D.summary(inc_events(spark, sf_dir))


@query(f"""WITH {EVENTS} SELECT min(latitude) AS lat_min, max(latitude) AS lat_max, min(longitude) AS lon_min,
  max(longitude) AS lon_max, round_even(avg(latitude), 6) AS center_lat, round_even(avg(longitude), 6) AS center_lon FROM inc""")
def geo_bounds(spark, sf_dir):
    df = D.geo_bounds(inc_events(spark, sf_dir))
    return df.withColumns({c: bround(F.col(c), 6) for c in ("center_lat", "center_lon")})


@query(f"""WITH {EVENTS} SELECT incident_type, count(*) AS count,
  round_even(count(*) / (SELECT count(*) FROM inc) * 100, 1) AS percentage FROM inc GROUP BY 1""")
def type_distribution(spark, sf_dir):
    return D.type_distribution(inc_events(spark, sf_dir))


@query(f"""WITH {ORDERS} SELECT incident_type, count(*) AS count,
  round_even(count(*) / (SELECT count(*) FROM inc) * 100, 1) AS percentage FROM inc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def top_types(spark, sf_dir):
    return D.top_types(inc_orders(spark, sf_dir), 5)


@query(f"WITH {EVENTS} SELECT hour, count(*) AS count FROM inc GROUP BY 1")
def hourly_distribution(spark, sf_dir):
    return D.hourly_distribution(inc_events(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT day_of_week, count(*) AS count FROM inc GROUP BY 1")
def daily_distribution(spark, sf_dir):
    return D.daily_distribution(inc_events(spark, sf_dir))


@query(f"WITH {ORDERS} SELECT month, strftime(make_date(2000, month, 1), '%b') AS month_name, count(*) AS count FROM inc GROUP BY 1, 2")
def monthly_distribution(spark, sf_dir):
    return D.monthly_distribution(inc_orders(spark, sf_dir))


@query(_labelled(EVENTS, PERIOD, _PERIODS) + " SELECT label AS time_period, ordinal, count,"
       " round_even(count / (SELECT sum(count) FROM f) * 100, 4) AS share FROM f")
def time_periods(spark, sf_dir):
    return D.time_periods(inc_events(spark, sf_dir))


@query(_labelled(EVENTS, PERIOD, _PERIODS) + " SELECT label AS dominant_time_period FROM f ORDER BY count DESC, ordinal LIMIT 1")
def dominant_time_period(spark, sf_dir):
    return D.dominant_time_period(inc_events(spark, sf_dir))


@query(_labelled(ORDERS, SEASON, _SEASONS) + " SELECT label AS season, ordinal, count,"
       " round_even(count / (SELECT sum(count) FROM f) * 100, 4) AS share FROM f")
def season_comparison(spark, sf_dir):
    return D.season_comparison(inc_orders(spark, sf_dir))


@query(_labelled(ORDERS, SEASON, _SEASONS) + " SELECT label AS dominant_season FROM f ORDER BY count DESC, ordinal LIMIT 1")
def dominant_season(spark, sf_dir):
    return D.dominant_season(inc_orders(spark, sf_dir))


@query(f"""WITH {EVENTS}, c AS (SELECT hour, count(*) AS count FROM inc GROUP BY 1)
  SELECT hour, count, round_even(count / (SELECT sum(count) FROM c) * 100, 4) AS share FROM c""")
def hourly_share(spark, sf_dir):
    return D.with_share(D.hourly_distribution(inc_events(spark, sf_dir)))


_TREND = """SELECT a AS first_half, b AS second_half, round_even(pct, 1) AS trend_change_pct,
  CASE WHEN pct > 10 THEN 'rising' WHEN pct < -10 THEN 'falling' ELSE 'stable' END AS recent_trend
  FROM (SELECT a, b, (b - a) / a * 100 AS pct FROM h)"""


@query(f"WITH {EVENTS}, h AS (SELECT count(occurred_at) // 2 AS a, count(occurred_at) - count(occurred_at) // 2 AS b FROM inc) {_TREND}")
def row_half_trend(spark, sf_dir):
    return patterns.row_half_trend(inc_events(spark, sf_dir))


@query(f"""WITH {ORDERS}, s AS (SELECT epoch_us(min(occurred_at)) + epoch_us(max(occurred_at)) AS twice FROM inc),
  h AS (SELECT count(*) FILTER (2 * epoch_us(occurred_at) < twice) AS a, count(*) FILTER (2 * epoch_us(occurred_at) >= twice) AS b FROM inc, s) {_TREND}""")
def time_half_trend(spark, sf_dir):
    return patterns.time_half_trend(inc_orders(spark, sf_dir))


def profile_sql(source: str, key: str) -> str:
    """Oracle for timing profiles: peak hours and days as text, peak period, weekend verdict, per key of a CTE."""
    return f"""
  ph AS (SELECT {key}, string_agg(hour, ',' ORDER BY n DESC, hour) AS peak_hours FROM (
      SELECT {key}, hour, count(*) AS n, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, hour) AS r
      FROM {source} WHERE hour IS NOT NULL GROUP BY 1, 2) WHERE r <= 2 GROUP BY 1),
  pd AS (SELECT {key}, string_agg(day_of_week, ',' ORDER BY n DESC, day_of_week) AS peak_days FROM (
      SELECT {key}, day_of_week, count(*) AS n, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, day_of_week) AS r
      FROM {source} WHERE day_of_week IS NOT NULL GROUP BY 1, 2) WHERE r <= 2 GROUP BY 1),
  pp AS (SELECT {key}, p AS peak_period FROM (SELECT {key}, {PERIOD} AS p, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC,
      CASE {PERIOD} WHEN 'morning' THEN 0 WHEN 'afternoon' THEN 1 WHEN 'evening' THEN 2 ELSE 3 END) AS r
      FROM {source} WHERE hour IS NOT NULL GROUP BY 1, 2) WHERE r = 1),
  wk AS (SELECT {key}, count(*) AS count, count(*) FILTER (day_of_week >= 5) / 2.0::DOUBLE AS we, count(*) FILTER (day_of_week < 5) / 5.0::DOUBLE AS wd
      FROM {source} GROUP BY 1)"""


@query(f"""WITH {EVENTS}, {profile_sql('inc', 'incident_type')}
  SELECT incident_type, count, peak_hours, peak_days, peak_period,
    CASE WHEN we > wd * 1.2::DOUBLE THEN 'weekend' WHEN wd > we * 1.2::DOUBLE THEN 'weekday' ELSE 'balanced' END AS weekend_vs_weekday
  FROM wk JOIN ph USING (incident_type) JOIN pd USING (incident_type) JOIN pp USING (incident_type) ORDER BY count DESC, incident_type LIMIT 5""")
def type_patterns(spark, sf_dir):
    return as_text(patterns.type_patterns(inc_events(spark, sf_dir)), "peak_hours", "peak_days")


def as_text(df, *arrays):
    """Arrays as comma-separated text, which both engines can hash."""
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in arrays})


@query(f"""WITH {EVENTS}, w AS (SELECT count(*) FILTER (day_of_week < 5) AS wd, count(*) FILTER (day_of_week >= 5) AS we FROM inc)
  SELECT wd AS weekday_count, we AS weekend_count, CASE WHEN we / 2.0::DOUBLE > wd / 5.0::DOUBLE * 1.2::DOUBLE THEN 'weekend'
    WHEN wd / 5.0::DOUBLE > we / 2.0::DOUBLE * 1.2::DOUBLE THEN 'weekday' ELSE 'balanced' END AS weekend_vs_weekday FROM w""")
def weekend_verdict(spark, sf_dir):
    return patterns.weekend_verdict(inc_events(spark, sf_dir))


_AGE = "CAST(floor((epoch_us((SELECT max(occurred_at) FROM inc)) - epoch_us(occurred_at)) / 86400000000.0) AS BIGINT)"


def _recency(inc: str) -> str:
    return f"""WITH {inc}, a AS (SELECT occurred_at, {_AGE} AS age FROM inc WHERE occurred_at IS NOT NULL),
  s AS (SELECT count(*) AS n, min(occurred_at) AS lo, max(occurred_at) AS hi, max(age) AS span, sum(age) / count(*) AS mean_age,
    count(*) FILTER (age <= 7) AS last_7_days, count(*) FILTER (age <= 30) AS last_30_days, count(*) FILTER (age <= 90) AS last_90_days,
    count(*) FILTER (age > 90) AS older_than_90_days FROM a),
  t AS (SELECT *, round_even(100 * (1 - mean_age / span), 1) AS recency_score FROM s)
  SELECT n > 0 AS has_date_data, span AS date_range_days, strftime(lo, '%Y-%m-%d') AS oldest_date, strftime(hi, '%Y-%m-%d') AS newest_date,
    last_7_days, last_30_days, last_90_days, older_than_90_days, round_even(last_30_days / n * 100, 1) AS recent_activity_pct, recency_score,
    CASE WHEN recency_score >= 70 THEN 'HIGH' WHEN recency_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS recency_tier FROM t"""


@query(_recency(EVENTS))
def recency_stats(spark, sf_dir):
    return recency.recency_stats(inc_events(spark, sf_dir))


@query(_recency(ORDERS))
def recency_stats_long_history(spark, sf_dir):
    return recency.recency_stats(inc_orders(spark, sf_dir))


@query(f"""WITH {ORDERS} SELECT 'month' AS section, strftime(make_date(2000, month, 1), '%b') AS key, month AS ordinal, count(*) AS count FROM inc GROUP BY month
  UNION ALL SELECT 'quarter', concat('Q', quarter), quarter, count(*) FROM inc GROUP BY quarter""")
def seasonal_distribution(spark, sf_dir):
    return D.seasonal_distribution(inc_orders(spark, sf_dir))


@query(f"WITH {ORDERS} SELECT concat('Q', quarter) AS peak_quarter FROM inc GROUP BY quarter ORDER BY count(*) DESC, quarter LIMIT 1")
def peak_quarter(spark, sf_dir):
    return D.peak_quarter(inc_orders(spark, sf_dir))


@query(f"""WITH {EVENTS} SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, hour) AS INT) AS rank, hour, count(*) AS count
  FROM inc GROUP BY hour ORDER BY rank LIMIT 3""")
def peak_hours(spark, sf_dir):
    return D.peaks(inc_events(spark, sf_dir), "hour")


@query(f"""WITH {EVENTS} SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, day_of_week) AS INT) AS rank, day_of_week, count(*) AS count
  FROM inc GROUP BY day_of_week ORDER BY rank LIMIT 3""")
def peak_days(spark, sf_dir):
    return D.peaks(inc_events(spark, sf_dir), "day_of_week")


@query(f"""WITH {ORDERS} SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, month) AS INT) AS rank, month, count(*) AS count
  FROM inc GROUP BY month ORDER BY rank LIMIT 3""")
def peak_months(spark, sf_dir):
    return D.peaks(inc_orders(spark, sf_dir), "month")


@query(f"""WITH {EVENTS} SELECT * FROM (SELECT incident_type, hour, count(*) AS count,
  CAST(row_number() OVER (PARTITION BY incident_type ORDER BY count(*) DESC, hour) AS INT) AS rank FROM inc GROUP BY 1, 2) WHERE rank <= 2""")
def top_hours_per_type(spark, sf_dir):
    return D.top_k_per_group(inc_events(spark, sf_dir), ["incident_type"], "hour", 2)


def _cube(inc: str) -> str:
    base = f"SELECT *, {SEASON} AS season, {PERIOD} AS time_period FROM inc"
    parts = []
    columns = ["day_of_week", "hour", "incident_type", "month", "quarter", "season", "time_period"]
    for name, group in D.CUBE_SETS.items():
        shown = ", ".join(c if c in group else f"CAST(NULL AS {'VARCHAR' if c in ('incident_type', 'season', 'time_period') else 'INT'}) AS {c}"
                          for c in columns)
        known = " AND ".join(f"{c} IS NOT NULL" for c in group)
        parts.append(f"SELECT '{name}' AS marginal, {shown}, count(*) AS count FROM b WHERE {known} GROUP BY {', '.join(group)}")
    text = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-') AS {c}" for c in columns)
    return f"WITH {inc}, b AS ({base}), u AS ({' UNION ALL '.join(parts)}) SELECT marginal, {text}, count FROM u"


@query(_cube(EVENTS))
def incident_cube(spark, sf_dir):
    df = D.incident_cube(inc_events(spark, sf_dir))
    return df.select("marginal", "count", *[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c)
                                            for c in df.columns if c not in ("marginal", "count")])


@query(_cube(EVENTS))
def incident_cube_from_facts(spark, sf_dir):
    df = D.incident_cube(D.fact_table(inc_events(spark, sf_dir)))
    return df.select("marginal", "count", *[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c)
                                            for c in df.columns if c not in ("marginal", "count")])


# --- calendar effects -------------------------------------------------------------------------------------------

_FIXED = ((1, 1), (1, 15), (2, 19), (5, 27), (7, 4), (9, 2), (10, 14), (11, 11), (11, 28), (12, 25), (12, 31))
_NEAR = "least(" + ", ".join(
    f"abs(floor((epoch_us(occurred_at) - epoch_us(make_timestamp(year, {m}, {d}, 0, 0, 0.0))) / 86400000000.0))" for m, d in _FIXED) + ")"
_RATIO = "CASE WHEN {r} > 1.2 THEN 'higher' WHEN {r} < 0.8 THEN 'lower' ELSE 'similar' END"


@query(f"""WITH {ORDERS}, s AS (SELECT count(*) FILTER ({_NEAR} <= 3) AS near, count(*) FILTER ({_NEAR} > 3) AS far,
    CAST(floor((epoch_us(max(occurred_at)) - epoch_us(min(occurred_at))) / 86400000000.0) AS BIGINT) + 1 AS span FROM inc),
  r AS (SELECT near, far, near / least(77, span) AS nr, far / greatest(1, span - least(77, span)) AS fr FROM s)
  SELECT near AS near_holiday_count, far AS normal_days_count, round_even(nr, 2) AS near_holiday_rate, round_even(fr, 2) AS normal_rate,
    {_RATIO.format(r='(nr / fr)')} AS holiday_spike FROM r""")
def holiday_effect(spark, sf_dir):
    return seasonal.holiday_effect(inc_orders(spark, sf_dir))


@query(f"""WITH {ORDERS}, s AS (SELECT count(*) FILTER (day_of_month IN (1, 2, 15, 16)) AS p,
    count(*) FILTER (day_of_month NOT IN (1, 2, 15, 16)) AS o FROM inc), r AS (SELECT *, p / 4.0::DOUBLE AS pr, o / 26.0::DOUBLE AS orr FROM s)
  SELECT p AS payday_count, o AS non_payday_count, round_even(pr, 2) AS payday_rate, round_even(orr, 2) AS non_payday_rate,
    {_RATIO.format(r='(pr / orr)')} AS payday_spike FROM r""")
def payday_effect(spark, sf_dir):
    return seasonal.payday_effect(inc_orders(spark, sf_dir))


_YOY = f"""WITH {ORDERS}, y AS (SELECT year, count(*) AS n FROM inc GROUP BY 1), e AS (SELECT count(*) AS years, min(year) AS first_year,
    max(year) AS last_year, min_by(n, year) AS first_count, max_by(n, year) AS last_count FROM y),
  p AS (SELECT *, (last_count - first_count) / first_count * 100 AS pct FROM e),
  yoy AS (SELECT years, first_year, last_year, first_count, last_count, CASE WHEN pct > 10 THEN concat('increasing (+', CAST(round_even(pct, 0) AS BIGINT), '%)')
    WHEN pct < -10 THEN concat('decreasing (', CAST(round_even(pct, 0) AS BIGINT), '%)') ELSE 'stable' END AS year_over_year FROM p)"""


@query(f"{_YOY} SELECT * FROM yoy")
def year_over_year(spark, sf_dir):
    return seasonal.year_over_year(inc_orders(spark, sf_dir))


@query(f"WITH {ORDERS} SELECT year, count(*) AS count FROM inc GROUP BY year")
def yearly_counts(spark, sf_dir):
    return seasonal.yearly_counts(inc_orders(spark, sf_dir))


@query(f"""{_YOY}, hs AS (SELECT count(*) FILTER ({_NEAR} <= 3) / 77 AS nr, count(*) FILTER ({_NEAR} > 3) /
    (CAST(floor((epoch_us(max(occurred_at)) - epoch_us(min(occurred_at))) / 86400000000.0) AS BIGINT) + 1 - 77) AS fr FROM inc),
  ps AS (SELECT count(*) FILTER (day_of_month IN (1, 2, 15, 16)) / 4.0::DOUBLE AS pr, count(*) FILTER (day_of_month NOT IN (1, 2, 15, 16)) / 26.0::DOUBLE AS orr FROM inc),
  m AS (SELECT month, count(*) AS n FROM inc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)
  SELECT true AS has_seasonal_data, (SELECT string_agg(month, ',' ORDER BY n DESC, month) FROM m) AS peak_months,
    (SELECT concat('Q', quarter) FROM inc GROUP BY quarter ORDER BY count(*) DESC, quarter LIMIT 1) AS peak_quarter,
    (SELECT {SEASON} AS s FROM inc GROUP BY 1 ORDER BY count(*) DESC, CASE s WHEN 'winter' THEN 0 WHEN 'spring' THEN 1 WHEN 'summer' THEN 2 ELSE 3 END LIMIT 1) AS dominant_season,
    (SELECT {_RATIO.format(r='(nr / fr)')} FROM hs) AS holiday_spike, (SELECT {_RATIO.format(r='(pr / orr)')} FROM ps) AS payday_spike,
    (SELECT year_over_year FROM yoy) AS year_over_year""")
def seasonal_verdicts(spark, sf_dir):
    return as_text(seasonal.seasonal_verdicts(inc_orders(spark, sf_dir)), "peak_months")
