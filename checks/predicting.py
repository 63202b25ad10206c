"""Prediction tables, map layers and the report."""

from pyspark.sql import functions as F

from checks.hotspot import _RANK, cluster_sql, profile_ctes
from checks.registry import query
from checks.tables import EVENTS, RESPONSES, inc_events, raw_responses
from hotspan.operators import hotspots as H
from hotspan.operators import predictions as P
from hotspan.plans.report import analysis_report
from hotspan.sources.layers import map_layers

# The JSON side uses the engine's own JSON functions, the line side its own regular expressions.
_EXTRACT = f"""{RESPONSES},
  arr AS (SELECT response_id, raw, regexp_extract(raw, '(?s)\\[\\s*\\{{.*?\\}}\\s*\\]') AS txt FROM responses),
  obj AS (SELECT response_id, unnest(from_json(txt, '["JSON"]')) AS o, generate_subscripts(from_json(txt, '["JSON"]'), 1) - 1 AS pos FROM arr WHERE json_valid(txt) AND txt <> ''),
  js AS (SELECT response_id, pos, try_cast(o->>'latitude' AS DOUBLE) AS latitude, try_cast(o->>'longitude' AS DOUBLE) AS longitude,
    coalesce(o->>'crime_type', 'Unknown') AS incident_type, coalesce(o->>'prediction', 'No details') AS prediction, coalesce(o->>'likelihood', '50') AS lk FROM obj),
  jk AS (SELECT * FROM js WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
  ln AS (SELECT response_id, unnest(string_split(raw, chr(10))) AS x, generate_subscripts(string_split(raw, chr(10)), 1) AS pos FROM responses
    WHERE response_id NOT IN (SELECT response_id FROM jk)),
  lk AS (SELECT response_id, pos, try_cast(regexp_extract(x, '(?i)latitude[:\\s]+(-?\\d+\\.?\\d*)', 1) AS DOUBLE) AS latitude,
    try_cast(regexp_extract(x, '(?i)longitude[:\\s]+(-?\\d+\\.?\\d*)', 1) AS DOUBLE) AS longitude,
    coalesce(nullif(trim(regexp_extract(x, '(?i)crime[_\\s]?type[:\\s]+([^,]+)', 1)), ''), 'Unknown') AS incident_type,
    'Predicted crime location' AS prediction, coalesce(nullif(regexp_extract(x, '(?i)likelihood[:\\s]+(\\d+)', 1), ''), '50') AS lk
    FROM ln WHERE lower(x) LIKE '%latitude%' AND lower(x) LIKE '%longitude%'),
  both_ AS (SELECT * FROM jk UNION ALL SELECT * FROM lk WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
  ext AS (SELECT response_id, CAST(row_number() OVER (PARTITION BY response_id ORDER BY pos) - 1 AS INT) AS ordinal, latitude, longitude, incident_type, prediction,
    try_cast(trim(lk, '%') AS DOUBLE) AS likelihood FROM both_)"""
_VALID = f"""{_EXTRACT}, box AS (SELECT min(latitude) AS a, max(latitude) AS b, min(longitude) AS c, max(longitude) AS d FROM inc),
  val AS (SELECT response_id, ordinal, latitude, longitude, incident_type, prediction,
    CASE WHEN likelihood BETWEEN 0 AND 100 THEN likelihood ELSE 50.0::DOUBLE END AS likelihood FROM ext, box
    WHERE latitude BETWEEN a - (b - a) * 0.1::DOUBLE AND b + (b - a) * 0.1::DOUBLE AND longitude BETWEEN c - (d - c) * 0.1::DOUBLE AND d + (d - c) * 0.1::DOUBLE)"""
_TIERS = """CASE WHEN likelihood >= 70 THEN 'HIGH' WHEN likelihood >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
  CASE WHEN likelihood >= 70 THEN 'red' WHEN likelihood >= 40 THEN 'orange' ELSE 'green' END AS color"""
_NUMBER = "CAST(row_number() OVER (PARTITION BY response_id ORDER BY ordinal) AS INT) AS number"
_HISTORY = f"""top AS (SELECT {_RANK}, * FROM prof ORDER BY rank LIMIT 10),
  hist AS (SELECT rank - 1 AS ordinal, latitude, longitude, dominant_type AS incident_type, concat('Historical hotspot with ', incident_count, ' incidents') AS prediction,
    CAST(least(90, 50 + incident_count) AS DOUBLE) AS likelihood FROM top)"""


@query(f"WITH {_EXTRACT} SELECT * FROM ext")
def extract_predictions(spark, sf_dir):
    return P.extract_predictions(raw_responses(spark, sf_dir))


def validated(spark, sf_dir):
    return P.validate_predictions(P.extract_predictions(raw_responses(spark, sf_dir)), inc_events(spark, sf_dir))


@query(f"WITH {EVENTS}, {_VALID} SELECT * FROM val")
def validate_predictions(spark, sf_dir):
    return validated(spark, sf_dir)


@query(f"WITH {EVENTS}, {_VALID} SELECT response_id, {_NUMBER}, latitude, longitude, incident_type, prediction, likelihood, {_TIERS} FROM val")
def prediction_table(spark, sf_dir):
    return P.prediction_table(validated(spark, sf_dir))


@query(f"""{cluster_sql(EVENTS, 0.5, 3)} {profile_ctes()}, {_HISTORY} SELECT * FROM hist""")
def hotspot_predictions(spark, sf_dir):
    return P.hotspot_predictions(H.hotspots(inc_events(spark, sf_dir))).drop("response_id")


@query(f"""{cluster_sql(EVENTS, 0.5, 3)} {profile_ctes()}, {_HISTORY}, {_EXTRACT}
  SELECT response_id, ordinal, latitude, longitude, incident_type, prediction, likelihood FROM ext
  UNION ALL SELECT response_id, ordinal, latitude, longitude, incident_type, prediction, likelihood FROM responses, hist
    WHERE response_id NOT IN (SELECT response_id FROM ext)""")
def predictions_with_history(spark, sf_dir):
    """Responses without a prediction, one in six, repeat the strongest hotspots."""
    spots = H.hotspots(inc_events(spark, sf_dir))
    return P.extract_predictions(raw_responses(spark, sf_dir), spots)


_REPORT = """tt AS (SELECT incident_type, count(*) AS n, round_even(count(*) / (SELECT count(*) FROM inc) * 100, 1) AS pct FROM inc GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5),
  num AS (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY ordinal) AS number FROM val),
  rep AS (SELECT 'summary' AS section, 0 AS ordinal, 'total_records' AS label, CAST(count(*) AS VARCHAR) AS value FROM inc
    UNION ALL SELECT 'summary', 1, 'distinct_types', CAST(count(DISTINCT incident_type) AS VARCHAR) FROM inc
    UNION ALL SELECT 'top_types', row_number() OVER (ORDER BY n DESC, incident_type) - 1, incident_type, concat(n, ' (', pct, '%)') FROM tt
    UNION ALL SELECT 'predictions', (number - 1) * 4, concat('Prediction #', response_id, '.', number, ' location'), concat('(', round_even(latitude, 4), ', ', round_even(longitude, 4), ')') FROM num
    UNION ALL SELECT 'predictions', (number - 1) * 4 + 1, concat('Prediction #', response_id, '.', number, ' type'), incident_type FROM num
    UNION ALL SELECT 'predictions', (number - 1) * 4 + 2, concat('Prediction #', response_id, '.', number, ' likelihood'), concat(likelihood, '%') FROM num
    UNION ALL SELECT 'predictions', (number - 1) * 4 + 3, concat('Prediction #', response_id, '.', number, ' analysis'), prediction FROM num)"""


@query(f"WITH {EVENTS}, {_VALID}, {_REPORT} SELECT section, CAST(ordinal AS BIGINT) AS ordinal, label, value FROM rep")
def report(spark, sf_dir):
    return analysis_report(inc_events(spark, sf_dir), validated(spark, sf_dir))


@query(f"""WITH {EVENTS}, {_VALID}, {_REPORT} SELECT section, CAST(ordinal AS BIGINT) AS ordinal, label, value FROM rep
  UNION ALL SELECT 'raw_output', 0, concat('Response #', response_id), raw FROM responses""")
def report_with_raw_output(spark, sf_dir):
    return analysis_report(inc_events(spark, sf_dir), validated(spark, sf_dir), responses=raw_responses(spark, sf_dir))


@query(f"""{cluster_sql(EVENTS, 0.5, 3)} {profile_ctes()}, {_HISTORY}, {_VALID},
  smp AS (SELECT * FROM inc ORDER BY md5(concat(CAST(incident_id AS VARCHAR), ':0')), incident_id LIMIT 500),
  cell AS (SELECT round_even(latitude * 100, 0) / 100.0::DOUBLE AS latitude, round_even(longitude * 100, 0) / 100.0::DOUBLE AS longitude, count(*) AS n FROM inc GROUP BY 1, 2)
  SELECT 'incident' AS layer, latitude, longitude, incident_type AS label, '-' AS detail, 'blue' AS color, 1.0::DOUBLE AS weight FROM smp
  UNION ALL SELECT 'hotspot', latitude, longitude, dominant_type, concat(incident_count, ' incidents'), 'purple', weighted_score FROM top
  UNION ALL SELECT 'prediction', latitude, longitude, incident_type, prediction, CASE WHEN likelihood >= 70 THEN 'red' WHEN likelihood >= 40 THEN 'orange' ELSE 'green' END, likelihood FROM val
  UNION ALL SELECT 'density', latitude, longitude, '-', '-', '-', round_even(n / (SELECT max(n) FROM cell), 4) FROM cell""")
def layers(spark, sf_dir):
    df = inc_events(spark, sf_dir)
    return map_layers(df, H.hotspots(df), validated(spark, sf_dir)).fillna("-", ["label", "detail", "color"])
