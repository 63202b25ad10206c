"""Prediction tables: extraction from free text, validation against the data bounds, and risk tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotspan.functions.parsing import parse_pct, to_double
from hotspan.functions.tiers import risk_color, risk_tier
from hotspan.operators.distributions import geo_bounds

# Patterns of the accepted response layouts.
JSON_ARRAY = r"(?s)(\[\s*\{.*?\}\s*\])"
LINE_LATITUDE = r"(?i)latitude[:\s]+(-?\d+\.?\d*)"
LINE_LONGITUDE = r"(?i)longitude[:\s]+(-?\d+\.?\d*)"
LINE_TYPE = r"(?i)crime[_\s]?type[:\s]+([^,]+)"
LINE_LIKELIHOOD = r"(?i)likelihood[:\s]+(\d+)"

# Keys of a prediction object, and what stands in for a missing one.
JSON_SCHEMA = "array<struct<latitude:string,longitude:string,crime_type:string,prediction:string,likelihood:string>>"
UNKNOWN_TYPE, NO_DETAILS, LINE_DETAILS, DEFAULT_LIKELIHOOD = "Unknown", "No details", "Predicted crime location", "50"

# Margin around the data bounds, and the ceiling and base of the historical likelihood.
BOUNDS_MARGIN = 0.1
HISTORY_MAX, HISTORY_BASE = 90, 50


def _prediction(lat: Column, lon: Column, kind: Column, text: Column, likelihood: Column) -> Column:
    return F.struct(to_double(lat).alias("latitude"), to_double(lon).alias("longitude"), kind.alias("incident_type"),
                    text.alias("prediction"), likelihood.alias("likelihood_text"))


def _located(items: Column) -> Column:
    return F.filter(items, lambda p: p["latitude"].isNotNull() & p["longitude"].isNotNull())


def _from_json(raw: Column) -> Column:
    objects = F.from_json(F.regexp_extract(raw, JSON_ARRAY, 1), JSON_SCHEMA, {"allowSingleQuotes": "false"})
    return _located(F.transform(objects, lambda o: _prediction(
        o["latitude"], o["longitude"], F.coalesce(o["crime_type"], F.lit(UNKNOWN_TYPE)),
        F.coalesce(o["prediction"], F.lit(NO_DETAILS)), F.coalesce(o["likelihood"], F.lit(DEFAULT_LIKELIHOOD)))))


def _from_lines(raw: Column) -> Column:
    lines = F.filter(F.split(raw, "\n"), lambda x: F.lower(x).contains("latitude") & F.lower(x).contains("longitude"))
    return _located(F.transform(lines, lambda x: _prediction(
        F.regexp_extract(x, LINE_LATITUDE, 1), F.regexp_extract(x, LINE_LONGITUDE, 1),
        F.when(x.rlike(LINE_TYPE), F.regexp_replace(F.regexp_extract(x, LINE_TYPE, 1), r"^\s+|\s+$", ""))
        .otherwise(F.lit(UNKNOWN_TYPE)),
        F.lit(LINE_DETAILS),
        F.when(x.rlike(LINE_LIKELIHOOD), F.regexp_extract(x, LINE_LIKELIHOOD, 1)).otherwise(F.lit(DEFAULT_LIKELIHOOD)))))


def extract_predictions(responses: DataFrame, hotspots: DataFrame | None = None) -> DataFrame:
    """Predictions found in a table (response_id, raw): the objects of the first JSON array, else ``key: value`` lines.

    Both layouts are read from the row itself, so the texts are neither joined nor shuffled. Objects without two
    numeric coordinates are left out; a response whose array yields nothing falls back to its lines. Given ``hotspots``,
    a response that yields nothing at all, a null one included, expects more of the same at the best of them; these few
    rows reach every response as one scalar array.
    """
    found = responses.select("response_id", _from_json(F.col("raw")).alias("j"), F.col("raw")).select(
        "response_id", F.when(F.size("j") > 0, F.col("j")).otherwise(_from_lines(F.col("raw"))).alias("p"))
    if hotspots is not None:
        history = hotspot_predictions(hotspots).withColumn("likelihood_text", F.col("likelihood").cast("string"))
        fields = ["latitude", "longitude", "incident_type", "prediction", "likelihood_text"]
        ordered = history.agg(F.array_sort(F.collect_list(F.struct("ordinal", *fields))).alias("h")).select(
            F.transform("h", lambda x: F.struct(*[x[f].alias(f) for f in fields])))
        found = found.withColumn("p", F.when(F.size("p") > 0, F.col("p")).otherwise(ordered.scalar()))
    rows = found.select("response_id", F.posexplode("p").alias("ordinal", "s"))
    return rows.select("response_id", "ordinal", "s.latitude", "s.longitude", "s.incident_type", "s.prediction",
                       "s.likelihood_text").select(
        "response_id", "ordinal", "latitude", "longitude", "incident_type", "prediction",
        parse_pct(F.col("likelihood_text")).alias("likelihood"))


def repaired_likelihood(likelihood: Column) -> Column:
    """Percent between 0 and 100; anything else becomes 50."""
    return F.when(likelihood.between(0, 100), likelihood).otherwise(F.lit(50.0))


def validate_predictions(predictions: DataFrame, incidents: DataFrame, margin: float = BOUNDS_MARGIN) -> DataFrame:
    """Predictions inside the data bounds plus a margin per axis, with repaired likelihoods."""
    box = geo_bounds(incidents).select(F.struct("lat_min", "lat_max", "lon_min", "lon_max")).scalar()

    def inside(value: Column, low: Column, high: Column) -> Column:
        slack = (high - low) * margin
        return value.between(low - slack, high + slack)

    kept = predictions.where(inside(F.col("latitude"), box["lat_min"], box["lat_max"])
                             & inside(F.col("longitude"), box["lon_min"], box["lon_max"]))
    return kept.withColumn("likelihood", repaired_likelihood(F.col("likelihood")))


def prediction_table(predictions: DataFrame) -> DataFrame:
    """Numbered predictions with risk tier and marker colour; numbering restarts for every response."""
    number = F.row_number().over(Window.partitionBy("response_id").orderBy("ordinal"))
    return predictions.select(
        "response_id", number.alias("number"), "latitude", "longitude", "incident_type", "prediction", "likelihood",
        risk_tier(F.col("likelihood")).alias("risk"), risk_color(F.col("likelihood")).alias("color"))


def hotspot_predictions(hotspots: DataFrame, n: int = 10) -> DataFrame:
    """Predictions that simply expect more of the same at the n best hotspots."""
    likelihood = F.least(F.lit(HISTORY_MAX), F.lit(HISTORY_BASE) + F.col("incident_count")).cast("double")
    return hotspots.where(F.col("rank") <= n).select(
        F.lit(None).cast("long").alias("response_id"), (F.col("rank") - 1).alias("ordinal"), "latitude", "longitude",
        F.col("dominant_type").alias("incident_type"),
        F.concat(F.lit("Historical hotspot with "), F.col("incident_count").cast("string"), F.lit(" incidents"))
        .alias("prediction"), likelihood.alias("likelihood"))
