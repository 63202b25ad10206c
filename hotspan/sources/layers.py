"""Map layers: predictions, hotspots, a bounded incident sample and the density surface as one tidy table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspan.functions.tiers import risk_color
from hotspan.operators.hotspots import density_grid

SAMPLE_SIZE = 500


def sample_incidents(incidents: DataFrame, n: int = SAMPLE_SIZE, seed: int = 0) -> DataFrame:
    """At most ``n`` incidents in a fixed pseudo-random order, so that a rerun draws the same rows."""
    order = F.md5(F.concat_ws(":", F.col("incident_id").cast("string"), F.lit(str(seed))))
    return incidents.orderBy(order, "incident_id").limit(n)


def map_layers(incidents: DataFrame, hotspots: DataFrame, predictions: DataFrame,
               n: int = SAMPLE_SIZE, seed: int = 0) -> DataFrame:
    """Rows (layer, latitude, longitude, label, detail, color, weight)."""
    points = sample_incidents(incidents, n, seed).select(
        F.lit("incident").alias("layer"), "latitude", "longitude", F.col("incident_type").alias("label"),
        F.lit(None).cast("string").alias("detail"), F.lit("blue").alias("color"), F.lit(1.0).alias("weight"))
    spots = hotspots.select(
        F.lit("hotspot").alias("layer"), "latitude", "longitude", F.col("dominant_type").alias("label"),
        F.concat(F.col("incident_count").cast("string"), F.lit(" incidents")).alias("detail"),
        F.lit("purple").alias("color"), F.col("weighted_score").alias("weight"))
    expected = predictions.select(
        F.lit("prediction").alias("layer"), "latitude", "longitude", F.col("incident_type").alias("label"),
        F.col("prediction").alias("detail"), risk_color(F.col("likelihood")).alias("color"),
        F.col("likelihood").alias("weight"))
    heat = density_grid(incidents).select(
        F.lit("density").alias("layer"), F.col("lat_cell").alias("latitude"), F.col("lon_cell").alias("longitude"),
        F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("detail"),
        F.lit(None).cast("string").alias("color"), F.col("intensity").alias("weight"))
    return points.unionByName(spots).unionByName(expected).unionByName(heat)


def geojson_features(layers: DataFrame) -> DataFrame:
    """One GeoJSON feature per row, as text in column ``value``."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")).alias("geometry"),
        F.struct("layer", "label", "detail", "color", "weight").alias("properties"))
    return layers.select(F.to_json(feature).alias("value"))


def write_layers(layers: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    """Write the layers as parquet, json, csv or orc, or as one GeoJSON feature per line with ``geojson``."""
    if format == "geojson":
        geojson_features(layers).write.mode(mode).text(path)
    elif format in ("parquet", "json", "csv", "orc"):
        layers.write.mode(mode).format(format).option("header", True).save(path)
    else:
        raise ValueError(f"unsupported layer format {format!r}")
