"""Hotspots: profiled density clusters ranked by recency-weighted activity, and the grid surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspan.functions.geo import haversine_km, snap_grid
from hotspan.functions.temporal import days_ago
from hotspan.functions.tiers import bround, hotspot_trend
from hotspan.operators.clusters import EPS_KM, MIN_SAMPLES, Clustering, fit_clusters
from hotspan.operators.distributions import rank_within
from hotspan.operators.patterns import timing_profile
from hotspan.operators.recency import recency_band, recency_weight
from hotspan.storage import write_once

TOP_HOTSPOTS = 10
CELLS_PER_DEGREE = 100
# Coordinates are summed as decimals (a tenth of a millimetre), so a centroid does not depend on the order of the rows.
# There is no range check on coordinates, so the type leaves room for any that a person might enter.
EXACT = "decimal(27,9)"

COLUMNS = [
    "rank", "latitude", "longitude", "incident_count", "weighted_score", "cluster_radius_km", "dominant_type",
    "type_breakdown", "peak_hours", "peak_days", "temporal_pattern", "recency_score", "recent_incidents",
    "older_incidents", "trend", "is_emerging", "cluster_method",
]


def _weighted(incidents: DataFrame, use_recency: bool) -> DataFrame:
    if use_recency:
        return recency_weight(incidents)
    return incidents.withColumn("recency_weight", F.lit(1.0))


def density_grid(incidents: DataFrame, cells_per_degree: int = CELLS_PER_DEGREE) -> DataFrame:
    """Incidents per grid cell and their intensity relative to the busiest cell."""
    cells = incidents.groupBy(snap_grid(F.col("latitude"), cells_per_degree).alias("lat_cell"),
                              snap_grid(F.col("longitude"), cells_per_degree).alias("lon_cell")
                              ).agg(F.count(F.lit(1)).alias("count"))
    best = cells.select(F.max("count")).scalar()
    return cells.withColumn("intensity", bround(F.col("count") / best, 4))


def grid_cells(incidents: DataFrame, use_recency: bool = True) -> DataFrame:
    """Incidents with a known type and total recency weight per 0.01 degree cell."""
    return _weighted(incidents, use_recency).groupBy(
        snap_grid(F.col("latitude")).alias("latitude"), snap_grid(F.col("longitude")).alias("longitude")
    ).agg(F.count("incident_type").alias("incident_count"), bround(F.sum("recency_weight"), 2).alias("weighted_score"))


def grid_hotspots(incidents: DataFrame, n: int = TOP_HOTSPOTS, use_recency: bool = True) -> DataFrame:
    """The n heaviest grid cells in the hotspot schema: the stand-in where nothing clusters."""
    best = grid_cells(incidents, use_recency).orderBy(F.desc("weighted_score"), "latitude", "longitude").limit(n)
    order = F.struct((-F.col("weighted_score")).alias("s"), "latitude", "longitude", "incident_count", "weighted_score")
    ranked = best.agg(F.array_sort(F.collect_list(order)).alias("a")).select(F.posexplode("a").alias("pos", "c"))
    nothing = {
        "cluster_radius_km": "double", "type_breakdown": "array<struct<type:string,count:bigint>>",
        "peak_hours": "array<int>", "peak_days": "array<int>", "temporal_pattern": "string",
        "recency_score": "double", "trend": "string"}
    return ranked.select(
        (F.col("pos") + 1).alias("rank"), "c.latitude", "c.longitude", "c.incident_count", "c.weighted_score",
        F.lit("Unknown").alias("dominant_type"), F.lit(0).cast("long").alias("recent_incidents"),
        F.lit(0).cast("long").alias("older_incidents"), F.lit(False).alias("is_emerging"),
        F.lit("grid_fallback").alias("cluster_method"),
        *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()]).select(*COLUMNS)


def cluster_facts(incidents: DataFrame, fitted: Clustering, use_recency: bool = True) -> DataFrame:
    """One pass over the clustered incidents: sums per (cluster, type, hour, day of week).

    Everything a profile needs except the radius is derived from this small table.
    """
    newest = incidents.select(F.max("occurred_at")).scalar()
    columns = ["incident_id", "latitude", "longitude", "incident_type", "occurred_at", "hour", "day_of_week",
               "recency_weight"]
    labelled = fitted.label(_weighted(incidents, use_recency).select(*columns))
    band = recency_band(days_ago(F.col("occurred_at"), newest)) if use_recency else F.lit(None).cast("string")
    members = labelled.where(F.col("cluster_id").isNotNull()).withColumn("band", band)
    return members.groupBy("cluster_id", "incident_type", "hour", "day_of_week").agg(
        F.count(F.lit(1)).alias("count"), F.sum("recency_weight").alias("weight"),
        *[F.sum(F.col(c).try_cast(EXACT)).alias(f"{c[:3]}_sum") for c in ("latitude", "longitude")],
        F.min("incident_id").alias("first_id"),
        *[F.count_if(F.col("band") == b).alias(b) for b in ("recent", "older", "very_old")])


def hotspot_profiles(incidents: DataFrame, fitted: Clustering, n: int | None = None,
                     use_recency: bool = True) -> DataFrame:
    """Profile of every cluster, or of the n best; with ``first_incident_id`` and ``cluster_id`` for ranking and joins."""
    facts = write_once(cluster_facts(incidents, fitted, use_recency))
    totals = facts.groupBy("cluster_id").agg(
        F.sum("count").alias("incident_count"), F.sum("weight").alias("weight"),
        (F.sum("lat_sum").cast("double") / F.sum("count")).alias("lat"),
        (F.sum("lon_sum").cast("double") / F.sum("count")).alias("lon"),
        F.min("first_id").alias("first_incident_id"),
        *[F.sum(b).alias(b) for b in ("recent", "older", "very_old")]
    ).withColumn("weighted_score", bround(F.col("weight"), 2))
    if n is not None:
        totals = totals.orderBy(F.desc("weighted_score"), "first_incident_id").limit(n)
        facts = facts.join(F.broadcast(totals.select("cluster_id")), "cluster_id", "left_semi")
    by_type = facts.where(F.col("incident_type").isNotNull()).groupBy("cluster_id", "incident_type").agg(
        F.sum("count").alias("count"))
    best = F.array_sort(F.collect_list(F.struct("rank", F.col("incident_type").alias("type"), "count")))
    types = rank_within(by_type, ["cluster_id"], "incident_type", 3).groupBy("cluster_id").agg(
        F.transform(best, lambda s: F.struct(s["type"].alias("type"), s["count"].alias("count"))).alias("type_breakdown"))
    profile = timing_profile(facts, ["cluster_id"], totals).join(types, "cluster_id", "left").join(
        _radius(fitted, totals), "cluster_id", "left")
    trend = hotspot_trend(F.col("recent"), F.col("older"), F.col("very_old"))
    dated = F.col("recent") + F.col("older") + F.col("very_old") > 0
    return profile.select(
        "cluster_id", "first_incident_id", bround(F.col("lat"), 6).alias("latitude"),
        bround(F.col("lon"), 6).alias("longitude"), "incident_count", "weighted_score", "cluster_radius_km",
        F.coalesce(F.try_element_at("type_breakdown", F.lit(1))["type"], F.lit("Unknown")).alias("dominant_type"),
        F.coalesce("type_breakdown", F.array().cast("array<struct<type:string,count:bigint>>")).alias("type_breakdown"),
        "peak_hours", "peak_days", F.col("peak_period").alias("temporal_pattern"),
        F.when(dated, bround(F.col("weight") / F.col("incident_count") * 100, 1)).alias("recency_score"),
        F.col("recent").alias("recent_incidents"), F.col("older").alias("older_incidents"), trend.alias("trend"),
        F.coalesce(trend.isin("new", "growing"), F.lit(False)).alias("is_emerging"),
        F.lit("dbscan").alias("cluster_method"))


def _radius(fitted: Clustering, totals: DataFrame) -> DataFrame:
    """Largest distance of a member location from the centroid of its cluster. The locations carry their cluster."""
    joined = fitted.places.where(F.col("cluster_id").isNotNull()).join(totals.select("cluster_id", "lat", "lon"), "cluster_id")
    distance = haversine_km(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude"))
    return joined.groupBy("cluster_id").agg(bround(F.max(distance), 3).alias("cluster_radius_km"))


def hotspots(incidents: DataFrame, n: int = TOP_HOTSPOTS, use_recency: bool = True, eps_km: float = EPS_KM,
             min_samples: int = MIN_SAMPLES, fitted: Clustering | None = None) -> DataFrame:
    """The n hotspots with the highest total recency weight; grid cells when nothing clusters.

    ``fitted`` is a clustering of these incidents made before, which then decides instead of ``eps_km`` and ``min_samples``.
    """
    fitted = fit_clusters(incidents, eps_km, min_samples) if fitted is None else fitted
    if fitted.is_empty():
        return grid_hotspots(incidents, n, use_recency)
    best = hotspot_profiles(incidents, fitted, n, use_recency)
    order = F.struct((-F.col("weighted_score")).alias("s"), F.col("first_incident_id").alias("f"),
                     *[c for c in COLUMNS if c != "rank"])
    return best.agg(F.array_sort(F.collect_list(order)).alias("a")).select(F.posexplode("a").alias("pos", "h")).select(
        (F.col("pos") + 1).alias("rank"), "h.*").select(*COLUMNS)
