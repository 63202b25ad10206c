"""Ingest, scalar expressions and row-level columns."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import query
from checks.tables import EVENTS, ORDERS, RAW_ROWS, inc_events, inc_orders, raw_rows, table
from hotspan.functions import calendars, geo, temporal, tiers
from hotspan.functions.parsing import parse_pct
from hotspan.operators import distributions, recency
from hotspan.sources.layers import sample_incidents
from hotspan.sources.normalize import dataset_profile, dated, ingest_report, normalize_incidents
from hotspan.sources.reader import read_incidents
from hotspan.storage import shared_folder

_NULLS = "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"
_CLEAN = f"""
  typed AS (SELECT event_id,
      CASE WHEN trim(lat) NOT IN {_NULLS} THEN try_cast(trim(lat) AS DOUBLE) END AS latitude,
      CASE WHEN trim(lon) NOT IN {_NULLS} THEN try_cast(trim(lon) AS DOUBLE) END AS longitude,
      CASE WHEN trim(offense) NOT IN {_NULLS} THEN offense END AS incident_type,
      try_strptime(occurred, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d', '%m/%d/%Y']) AS occurred_at,
      CAST(hour(try_strptime(hour_text, '%H:%M')) AS INT) AS hour
    FROM raw)"""


@query("SELECT count(*) AS records, CAST(5 AS INT) AS columns FROM raw".join([f"WITH {RAW_ROWS} ", ""]))
def dataset_profile_raw(spark, sf_dir):
    return dataset_profile(raw_rows(spark, sf_dir).drop("event_id"))


@query(f"""WITH {RAW_ROWS}, {_CLEAN}
  SELECT count(*) AS rows_read, count(*) FILTER (latitude IS NULL OR longitude IS NULL) AS rows_dropped,
    count(*) FILTER (latitude IS NOT NULL AND longitude IS NOT NULL) AS rows_kept,
    count(occurred_at) FILTER (latitude IS NOT NULL AND longitude IS NOT NULL) AS valid_dates,
    count(hour) FILTER (latitude IS NOT NULL AND longitude IS NOT NULL) AS valid_hours FROM typed""")
def ingest_quality(spark, sf_dir):
    return ingest_report(raw_rows(spark, sf_dir)).drop("failed_dates", "failed_hours", "damaged")


@query(f"""WITH {RAW_ROWS}, {_CLEAN}
  SELECT count(*) FILTER (r.occurred IS NOT NULL AND t.occurred_at IS NULL) AS failed_dates,
    count(*) FILTER (r.hour_text IS NOT NULL AND t.hour IS NULL) AS failed_hours
  FROM raw r JOIN typed t USING (event_id) WHERE latitude IS NOT NULL AND longitude IS NOT NULL""")
def ingest_failures(spark, sf_dir):
    return ingest_report(raw_rows(spark, sf_dir)).select("failed_dates", "failed_hours")


@query(f"""WITH {RAW_ROWS}, {_CLEAN}
  SELECT event_id AS incident_id, latitude, longitude, coalesce(incident_type, '-') AS incident_type,
    coalesce(strftime(occurred_at, '%Y-%m-%d %H:%M:%S'), '-') AS occurred_at,
    CAST(coalesce(isodow(occurred_at) - 1, -1) AS INT) AS day_of_week,
    CAST(coalesce(month(occurred_at), -1) AS INT) AS month, CAST(coalesce(quarter(occurred_at), -1) AS INT) AS quarter,
    CAST(coalesce(day(occurred_at), -1) AS INT) AS day_of_month, CAST(coalesce(year(occurred_at), -1) AS INT) AS year,
    CAST(coalesce(hour, -1) AS INT) AS hour
  FROM typed WHERE latitude IS NOT NULL AND longitude IS NOT NULL""")
def normalized_incidents(spark, sf_dir):
    df = normalize_incidents(raw_rows(spark, sf_dir), id_col="event_id")
    shown = df.withColumn("occurred_at", F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss"))
    return shown.fillna("-", ["incident_type", "occurred_at"]).fillna(
        -1, ["day_of_week", "month", "quarter", "day_of_month", "year", "hour"])


@query(f"""WITH {RAW_ROWS}, {_CLEAN}, fmt AS (SELECT unnest(['csv', 'json', 'orc', 'parquet']) AS format),
  j AS (SELECT format, format = 'json' AND event_id % 9 = 0 AS broken, t.* FROM typed t, fmt)
  SELECT format, count(*) AS rows_read, count(*) FILTER (NOT broken AND latitude IS NOT NULL AND longitude IS NOT NULL) AS rows_kept,
    count(occurred_at) FILTER (NOT broken AND latitude IS NOT NULL AND longitude IS NOT NULL) AS valid_dates,
    count(*) FILTER (broken) AS damaged FROM j GROUP BY format""")
def read_back_formats(spark, sf_dir):
    """The raw rows written in every format and read again; every ninth JSON record is cut short."""
    raw, folder = raw_rows(spark, sf_dir), f"{shared_folder(spark)}/formats-{uuid.uuid4().hex}"
    for fmt in ("csv", "orc", "parquet"):
        raw.write.format(fmt).options(header=True, escape='"').save(f"{folder}/rows.{fmt}")
    line = F.to_json(F.struct(*raw.columns))
    raw.select(F.when(F.col("event_id") % 9 == 0, F.substring(line, 1, 25)).otherwise(line)).write.text(f"{folder}/rows.json")
    reports = [ingest_report(read_incidents(spark, f"{folder}/rows.{fmt}", damaged="_damaged"), damaged="_damaged").select(
        F.lit(fmt).alias("format"), "rows_read", "rows_kept", "valid_dates", "damaged") for fmt in ("csv", "json", "orc", "parquet")]
    return reduce(DataFrame.unionByName, reports)


# One layout per 24th of the rows; what each can hold of the time is what comes back.
_LAYOUTS = (  # Spark, DuckDB, unit that is left
    ("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") || '+00:00'", "strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00'", "second"),
    ("date_format(ts + interval 2 hours, \"yyyy-MM-dd'T'HH:mm:ss\") || '+02'", "strftime(ts + interval 2 hours, '%Y-%m-%dT%H:%M:%S') || '+02'", "second"),
    ("date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS')", "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')", "microsecond"),
    ("date_format(ts, 'MMMM d, yyyy')", "strftime(ts, '%B %-d, %Y')", "day"),
    ("date_format(ts, 'MMM d, yyyy')", "strftime(ts, '%b %-d, %Y')", "day"),
    ("date_format(ts, 'd MMM yyyy')", "strftime(ts, '%-d %b %Y')", "day"),
    ("upper(date_format(ts, 'dd-MMM-yy'))", "upper(strftime(ts, '%d-%b-%y'))", "day"),
    ("date_format(ts, 'yyyy-M-d')", "strftime(ts, '%Y-%-m-%-d')", "day"),
    ("date_format(ts, 'MM.dd.yyyy')", "strftime(ts, '%m.%d.%Y')", "day"),
    ("date_format(ts, 'M/d/yy HH:mm')", "strftime(ts, '%-m/%-d/%y %H:%M')", "minute"),
    ("date_format(ts, 'MM-dd-yyyy')", "strftime(ts, '%m-%d-%Y')", "day"),
    ("date_format(ts, 'yyyy-MM-dd HH:mm:ss') || ' UTC'", "strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC'", "second"),
    ("date_format(ts, 'yyyy/M/d')", "strftime(ts, '%Y/%-m/%-d')", "day"),
    ("date_format(ts - interval 330 minutes, 'yyyy-MM-dd HH:mm') || '-0530'", "strftime(ts - interval 330 minutes, '%Y-%m-%d %H:%M') || '-0530'", "minute"),
    ("date_format(ts, 'M/d/yyyy h:mm:ss a')", "strftime(ts, '%-m/%-d/%Y %-I:%M:%S %p')", "second"),
    ("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")", "strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'", "millisecond"),
    ("date_format(ts, 'yyyyMMdd')", "strftime(ts, '%Y%m%d')", "day"),
    ("date_format(ts, 'MMM d, yyyy h:mm a')", "strftime(ts, '%b %-d, %Y %-I:%M %p')", "minute"),
    ("date_format(ts, 'd MMMM yyyy HH:mm')", "strftime(ts, '%-d %B %Y %H:%M')", "minute"),
    ("date_format(ts, 'yyyy.MM.dd')", "strftime(ts, '%Y.%m.%d')", "day"),
    ("date_format(ts, '13/dd/yyyy')", "strftime(ts, '13/%d/%Y')", None),
    ("date_format(ts, 'yyyy-02-30')", "strftime(ts, '%Y-02-30')", None),
    ("date_format(ts, 'yyyy-MM-dd') || ' 13:05 PM'", "strftime(ts, '%Y-%m-%d') || ' 13:05 PM'", None),
    ("'Maybe 5, 2024'", "'Maybe 5, 2024'", None),
)
_KEPT = " ".join(f"WHEN {i} THEN " + (f"date_trunc('{u}', ts)" if u else "NULL") for i, (_, _, u) in enumerate(_LAYOUTS))


@query(f"""SELECT event_id AS incident_id, event_id % {len(_LAYOUTS)} AS layout,
    coalesce(strftime(CASE event_id % {len(_LAYOUTS)} {_KEPT} END, '%Y-%m-%d %H:%M:%S.%f'), '-') AS occurred_at FROM events""")
def date_layouts(spark, sf_dir):
    texts = " ".join(f"WHEN {i} THEN {text}" for i, (text, _, _) in enumerate(_LAYOUTS))
    raw = table(spark, sf_dir, "events").selectExpr(
        "event_id", "'1.0' AS lat", "'2.0' AS lon", "event_type AS offense", f"CASE event_id % {len(_LAYOUTS)} {texts} END AS occurred")
    return normalize_incidents(raw, id_col="event_id").select(
        "incident_id", (F.col("incident_id") % len(_LAYOUTS)).alias("layout"),
        F.coalesce(F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("-")).alias("occurred_at"))


_GOOD = "latitude IS NOT NULL AND longitude IS NOT NULL"


@query(f"""WITH {RAW_ROWS}, {_CLEAN}
  SELECT count(*) AS rows, count(DISTINCT event_id) AS ids FROM typed WHERE {_GOOD}""")
def incidents_with_text_keys(spark, sf_dir):
    keyed = raw_rows(spark, sf_dir).withColumn("report", F.concat(F.lit("JA"), F.col("event_id").cast("string")))
    return normalize_incidents(keyed, id_col="report").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("incident_id").alias("ids"))


@query(f"""WITH {RAW_ROWS}, {_CLEAN}, kept AS (SELECT r.lat, r.lon, r.offense, r.occurred, r.hour_text
    FROM raw r JOIN typed t ON r.event_id = t.event_id WHERE {_GOOD})
  SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM kept)) AS ids FROM kept""")
def incidents_without_key(spark, sf_dir):
    return normalize_incidents(raw_rows(spark, sf_dir).drop("event_id")).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("incident_id").alias("ids"))


@query(f"""WITH {RAW_ROWS}, {_CLEAN}
  SELECT event_id AS incident_id, strftime(occurred_at, '%Y-%m-%d %H:%M:%S') AS occurred_at FROM typed
  WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND occurred_at IS NOT NULL""")
def dated_incidents(spark, sf_dir):
    rows = dated(normalize_incidents(raw_rows(spark, sf_dir), id_col="event_id"))
    return rows.select("incident_id", F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss").alias("occurred_at"))


@query(f"""WITH {ORDERS}
  SELECT incident_id, day_of_week, month, quarter, day_of_month, year,
    strftime(occurred_at, '%b') AS month_name, concat('Q', quarter) AS quarter_label,
    strftime(occurred_at, '%A') AS day_name,
    CASE WHEN month IN (12, 1, 2) THEN 'winter' WHEN month IN (3, 4, 5) THEN 'spring'
      WHEN month IN (6, 7, 8) THEN 'summer' ELSE 'fall' END AS season,
    day_of_week >= 5 AS weekend, day_of_month IN (1, 2, 15, 16) AS payday FROM inc""")
def calendar_labels(spark, sf_dir):
    c = F.col
    return inc_orders(spark, sf_dir).select(
        "incident_id", "day_of_week", "month", "quarter", "day_of_month", "year",
        temporal.month_name(c("month")).alias("month_name"), temporal.quarter_label(c("quarter")).alias("quarter_label"),
        temporal.day_name(c("day_of_week")).alias("day_name"), temporal.season(c("month")).alias("season"),
        temporal.is_weekend(c("day_of_week")).alias("weekend"), temporal.is_payday(c("day_of_month")).alias("payday"))


@query(f"""WITH {EVENTS}
  SELECT incident_id, hour, CASE WHEN hour >= 6 AND hour < 12 THEN 'morning' WHEN hour >= 12 AND hour < 18 THEN 'afternoon'
    WHEN hour >= 18 AND hour < 22 THEN 'evening' ELSE 'night' END AS time_period FROM inc""")
def time_period_labels(spark, sf_dir):
    return inc_events(spark, sf_dir).select("incident_id", "hour", temporal.time_period(F.col("hour")).alias("time_period"))


_AGE = "CAST(floor((epoch_us((SELECT max(occurred_at) FROM inc)) - epoch_us(occurred_at)) / 86400000000.0) AS BIGINT)"


@query(f"""WITH {EVENTS}, aged AS (SELECT incident_id, {_AGE} AS age FROM inc)
  SELECT incident_id, age, round_even(pow(0.5::DOUBLE, age / 30.0::DOUBLE), 6) AS recency_weight,
    CASE WHEN age <= 30 THEN 'recent' WHEN age <= 90 THEN 'older' ELSE 'very_old' END AS band FROM aged""")
def recency_weights(spark, sf_dir):
    df = inc_events(spark, sf_dir)
    newest = df.select(F.max("occurred_at")).scalar()
    return recency.recency_weight(df).withColumn("age", temporal.days_ago(F.col("occurred_at"), newest)).select(
        "incident_id", "age", tiers.bround(F.col("recency_weight"), 6).alias("recency_weight"),
        recency.recency_band(F.col("age")).alias("band"))


# Month and day of the holidays.
_FIXED = ((1, 1), (1, 15), (2, 19), (5, 27), (7, 4), (9, 2), (10, 14), (11, 11), (11, 28), (12, 25), (12, 31))
_GAPS = ", ".join(f"abs(floor((epoch_us(occurred_at) - epoch_us(make_timestamp(year, {m}, {d}, 0, 0, 0.0))) / 86400000000.0))"
                  for m, d in _FIXED)


@query(f"""WITH {EVENTS} SELECT incident_id, CAST(least({_GAPS}, 365) AS BIGINT) AS days_to_holiday,
    least({_GAPS}, 365) <= 3 AS near_holiday FROM inc""")
def holiday_proximity(spark, sf_dir):
    at = F.col("occurred_at")
    return inc_events(spark, sf_dir).select(
        "incident_id", calendars.days_to_holiday(at).cast("long").alias("days_to_holiday"),
        calendars.near_holiday(at).alias("near_holiday"))


# The holidays of each year by weekday rule, enumerated from a dense day table.
RULE_DAYS = """
  years AS (SELECT year(o_orderdate) AS y FROM orders UNION SELECT year(ts) FROM events),
  days AS (SELECT CAST(unnest(generate_series(make_date(min(y), 1, 1), make_date(max(y) + 1, 12, 31), INTERVAL 1 DAY)) AS DATE) AS d FROM years),
  rule_days AS (SELECT d FROM days WHERE strftime(d, '%m-%d') IN ('01-01', '07-04', '11-11', '12-25', '12-31')
    OR (isodow(d) = 1 AND ((month(d) = 1 AND day(d) BETWEEN 15 AND 21) OR (month(d) = 2 AND day(d) BETWEEN 15 AND 21)
      OR (month(d) = 5 AND day(d) >= 25) OR (month(d) = 9 AND day(d) <= 7) OR (month(d) = 10 AND day(d) BETWEEN 8 AND 14)))
    OR (isodow(d) = 4 AND month(d) = 11 AND day(d) BETWEEN 22 AND 28))"""


@query(f"""WITH {ORDERS}, {RULE_DAYS}
  SELECT incident_id, CAST(min(least(abs(date_diff('day', d, CAST(occurred_at AS DATE))), 365)) AS BIGINT) AS days_to_holiday
  FROM inc JOIN rule_days ON year(d) = year GROUP BY incident_id""")
def holiday_proximity_rule(spark, sf_dir):
    return inc_orders(spark, sf_dir).select(
        "incident_id", calendars.days_to_holiday(F.col("occurred_at"), "rule").cast("long").alias("days_to_holiday"))


@query(f"""WITH {ORDERS}, cal AS (SELECT CAST(max(l_shipdate) AS DATE) AS d FROM lineitem GROUP BY year(l_shipdate), month(l_shipdate))
  SELECT incident_id, CAST(coalesce(min(least(abs(date_diff('day', d, CAST(occurred_at AS DATE))), 365)), 365) AS BIGINT)
    AS days_to_holiday FROM inc LEFT JOIN cal ON year(d) = year GROUP BY incident_id""")
def calendar_table_proximity(spark, sf_dir):
    shipped = F.col("l_shipdate")  # the last shipping day of every month is the calendar
    days = table(spark, sf_dir, "lineitem").groupBy(F.year(shipped), F.month(shipped)).agg(F.max(shipped).alias("day")).select("day")
    return calendars.days_to_calendar_day(inc_orders(spark, sf_dir), days).select(
        "incident_id", F.col("days_to_holiday").cast("long").alias("days_to_holiday"))


@query(f"""WITH {EVENTS}, c AS (SELECT round_even(avg(latitude), 4) AS clat, round_even(avg(longitude), 4) AS clon FROM inc)
  SELECT incident_id, round_even(latitude * 100, 0) / 100.0::DOUBLE AS lat_cell,
    round_even(longitude * 100, 0) / 100.0::DOUBLE AS lon_cell,
    round_even(12742.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(latitude - clat) / 2), 2)
      + cos(radians(clat)) * cos(radians(latitude)) * pow(sin(radians(longitude - clon) / 2), 2)))), 6) AS km_to_centre
  FROM inc, c""")
def grid_and_distance(spark, sf_dir):
    df = inc_events(spark, sf_dir)
    centre = df.agg(tiers.bround(F.avg("latitude"), 4).alias("a"), tiers.bround(F.avg("longitude"), 4).alias("b")).select(
        F.struct("a", "b")).scalar()
    lat, lon = F.col("latitude"), F.col("longitude")
    return df.select("incident_id", geo.snap_grid(lat).alias("lat_cell"), geo.snap_grid(lon).alias("lon_cell"),
                     tiers.bround(geo.haversine_km(centre["a"], centre["b"], lat, lon), 6).alias("km_to_centre"))


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'n/a' ELSE concat(CAST(event_id % 120 AS VARCHAR), '%') END AS txt FROM events),
  v AS (SELECT event_id, try_cast(rtrim(txt, '%') AS DOUBLE) AS pct FROM t)
  SELECT event_id, coalesce(pct, -1) AS pct, CASE WHEN pct IS NULL THEN 'UNKNOWN' WHEN pct >= 70 THEN 'HIGH' WHEN pct >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
    CASE WHEN pct IS NULL THEN 'gray' WHEN pct >= 70 THEN 'red' WHEN pct >= 40 THEN 'orange' ELSE 'green' END AS color,
    CASE WHEN pct >= 70 THEN 'HIGH' WHEN pct >= 40 THEN 'MEDIUM' WHEN pct IS NOT NULL THEN 'LOW' ELSE '-' END AS recency FROM v""")
def risk_tiers(spark, sf_dir):
    txt = F.expr("CASE WHEN event_id % 9 = 0 THEN 'n/a' ELSE concat(CAST(event_id % 120 AS STRING), '%') END")
    pct = F.col("pct")
    return table(spark, sf_dir, "events").select("event_id", parse_pct(txt).alias("pct")).select(
        "event_id", F.coalesce(pct, F.lit(-1.0)).alias("pct"), tiers.risk_tier(pct).alias("risk"),
        tiers.risk_color(pct).alias("color"), F.coalesce(tiers.recency_tier(pct), F.lit("-")).alias("recency"))


@query(f"""WITH {EVENTS} SELECT incident_id, latitude, longitude, incident_type FROM inc
  ORDER BY md5(concat(CAST(incident_id AS VARCHAR), ':0')), incident_id LIMIT 500""")
def incident_sample(spark, sf_dir):
    return sample_incidents(inc_events(spark, sf_dir)).select("incident_id", "latitude", "longitude", "incident_type")


@query(f"""WITH {EVENTS}, top AS (SELECT incident_type FROM inc GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)
  SELECT incident_id, incident_type FROM inc WHERE incident_type IN (SELECT incident_type FROM top)""")
def incidents_of_top_types(spark, sf_dir):
    return distributions.of_top_types(inc_events(spark, sf_dir), 3).select("incident_id", "incident_type")
