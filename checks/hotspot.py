"""Grids, density clusters and hotspots."""

from pyspark.sql import functions as F

from checks.distribution import as_text, profile_sql
from checks.registry import query
from checks.tables import CROWDED, EVENTS, ORDERS, inc_crowded, inc_events, inc_orders
from hotspan.operators import clusters as C
from hotspan.operators import hotspots as H

_AGE = "floor((epoch_us((SELECT max(occurred_at) FROM inc)) - epoch_us(occurred_at)) / 86400000000.0)"
_WEIGHT = f"pow(0.5::DOUBLE, {_AGE} / 30.0::DOUBLE)"
_CELL = "round_even(latitude * 100, 0) / 100.0::DOUBLE AS {a}, round_even(longitude * 100, 0) / 100.0::DOUBLE AS {b}"


def _km(a: str, b: str) -> str:
    return (f"12742.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude))"
            f" * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2))))")


def cluster_sql(inc: str, eps: float, min_samples: int) -> str:
    """CTEs up to ``clu(incident_id, cluster_id, is_core)``, by brute force over nearby location pairs."""
    return f"""WITH RECURSIVE {inc},
  loc AS (SELECT latitude, longitude, count(*) AS n, min(incident_id) AS id, CAST(floor(latitude * 100) AS BIGINT) AS bx,
    CAST(floor(longitude * 100) AS BIGINT) AS by_ FROM inc GROUP BY 1, 2),
  shifted AS (SELECT loc.*, bx + dx AS sx, by_ + dy AS sy FROM loc, (VALUES (-1), (0), (1)) AS a(dx), (VALUES (-1), (0), (1)) AS b(dy)),
  pairs AS (SELECT s.id AS a, l.id AS b, l.n AS n FROM shifted s JOIN loc l ON s.sx = l.bx AND s.sy = l.by_ WHERE {_km('s', 'l')} <= {eps}),
  core AS (SELECT a AS id FROM pairs GROUP BY a HAVING sum(n) >= {min_samples}),
  edges AS (SELECT a, b FROM pairs WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
  reach(id, label) AS (SELECT id, id FROM core UNION SELECT e.b, r.label FROM reach r JOIN edges e ON r.id = e.a WHERE r.label < e.b),
  named AS (SELECT id, min(label) AS cluster_id FROM reach GROUP BY 1),
  border AS (SELECT p.a AS id, min(n.cluster_id) AS cluster_id FROM pairs p JOIN named n ON p.b = n.id
    WHERE p.a NOT IN (SELECT id FROM core) GROUP BY 1),
  owned AS (SELECT id, cluster_id, true AS is_core FROM named UNION ALL SELECT id, cluster_id, false FROM border),
  clu AS (SELECT i.incident_id, o.cluster_id, coalesce(o.is_core, false) AS is_core FROM inc i
    JOIN loc l ON i.latitude = l.latitude AND i.longitude = l.longitude LEFT JOIN owned o ON o.id = l.id)"""


def profile_ctes(use_recency: bool = True) -> str:
    """CTEs from ``clu`` up to ``prof``: the full hotspot profile of every cluster."""
    weight = _WEIGHT if use_recency else "1.0::DOUBLE"
    return f""", mem AS (SELECT i.*, c.cluster_id, {_AGE} AS age, {weight} AS w FROM inc i JOIN clu c USING (incident_id) WHERE c.cluster_id IS NOT NULL),
  agg AS (SELECT cluster_id, count(*) AS incident_count, sum(w) AS weight, sum(latitude::DECIMAL(13,9))::DOUBLE / count(*) AS latitude, sum(longitude::DECIMAL(13,9))::DOUBLE / count(*) AS longitude,
    min(incident_id) AS first_incident_id, count(*) FILTER (age <= 30) AS r, count(*) FILTER (age > 30 AND age <= 90) AS o,
    count(*) FILTER (age > 90) AS v FROM mem GROUP BY 1),
  rad AS (SELECT a.cluster_id, round_even(max({_km('a', 'm')}), 3) AS cluster_radius_km FROM agg a JOIN mem m USING (cluster_id) GROUP BY 1),
  ty AS (SELECT cluster_id, string_agg(concat(incident_type, ':', n), ',' ORDER BY rk) AS type_breakdown,
    min(incident_type) FILTER (rk = 1) AS dominant_type FROM (SELECT cluster_id, incident_type, count(*) AS n,
      row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, incident_type) AS rk FROM mem GROUP BY 1, 2) WHERE rk <= 3 GROUP BY 1),
  {profile_sql('mem', 'cluster_id')},
  prof AS (SELECT cluster_id, first_incident_id, round_even(latitude, 6) AS latitude, round_even(longitude, 6) AS longitude, incident_count,
    round_even(weight, 2) AS weighted_score, cluster_radius_km, dominant_type, type_breakdown, coalesce(peak_hours, '-') AS peak_hours, peak_days,
    coalesce(peak_period, '-') AS temporal_pattern, round_even(weight / incident_count * 100, 1) AS recency_score, r AS recent_incidents, o AS older_incidents,
    CASE WHEN o + v = 0 THEN 'new' WHEN r = 0 THEN 'inactive' WHEN o = 0 THEN 'stable' WHEN r > o / 2.0::DOUBLE * 1.5::DOUBLE THEN 'growing'
      WHEN r < o / 2.0::DOUBLE * 0.5::DOUBLE THEN 'shrinking' ELSE 'stable' END AS trend
    FROM agg JOIN rad USING (cluster_id) JOIN ty USING (cluster_id) LEFT JOIN ph USING (cluster_id) LEFT JOIN pd USING (cluster_id)
    LEFT JOIN pp USING (cluster_id))"""


_SHOWN = ("latitude, longitude, incident_count, weighted_score, cluster_radius_km, dominant_type, type_breakdown, peak_hours, peak_days,"
          " temporal_pattern, recency_score, recent_incidents, older_incidents, trend, trend IN ('new', 'growing') AS is_emerging, 'dbscan' AS cluster_method")
_RANK = "CAST(row_number() OVER (ORDER BY weighted_score DESC, first_incident_id) AS INT) AS rank"


def shown(df):
    """Profiles with arrays as text and missing hour patterns as a dash."""
    types = F.array_join(F.transform("type_breakdown", lambda s: F.concat(s["type"], F.lit(":"), s["count"].cast("string"))), ",")
    return as_text(df.withColumn("type_breakdown", types), "peak_hours", "peak_days").fillna("-", ["peak_hours", "temporal_pattern"])


@query(f"""WITH {EVENTS}, c AS (SELECT {_CELL.format(a='lat_cell', b='lon_cell')}, count(*) AS count FROM inc GROUP BY 1, 2)
  SELECT lat_cell, lon_cell, count, round_even(count / (SELECT max(count) FROM c), 4) AS intensity FROM c""")
def density_grid(spark, sf_dir):
    return H.density_grid(inc_events(spark, sf_dir))


_GRID = f"g AS (SELECT {_CELL.format(a='latitude', b='longitude')}, count(incident_type) AS incident_count, round_even(sum({_WEIGHT}), 2) AS weighted_score FROM inc GROUP BY 1, 2)"


@query(f"WITH {EVENTS}, {_GRID} SELECT * FROM g")
def grid_cells(spark, sf_dir):
    return H.grid_cells(inc_events(spark, sf_dir))


@query(f"""WITH {EVENTS}, {_GRID} SELECT CAST(row_number() OVER (ORDER BY weighted_score DESC, latitude, longitude) AS INT) AS rank,
  latitude, longitude, incident_count, weighted_score, 'Unknown' AS dominant_type, 'grid_fallback' AS cluster_method FROM g ORDER BY rank LIMIT 10""")
def grid_hotspots(spark, sf_dir):
    return H.grid_hotspots(inc_events(spark, sf_dir)).select(
        "rank", "latitude", "longitude", "incident_count", "weighted_score", "dominant_type", "cluster_method")


@query(f"""WITH {EVENTS}, {_GRID} SELECT CAST(row_number() OVER (ORDER BY weighted_score DESC, latitude, longitude) AS INT) AS rank,
  latitude, longitude, incident_count, weighted_score, 'Unknown' AS dominant_type, 'grid_fallback' AS cluster_method FROM g ORDER BY rank LIMIT 10""")
def hotspots_without_clusters(spark, sf_dir):
    """No point has that many neighbours within a metre, so the grid takes over."""
    df = inc_events(spark, sf_dir)
    return H.hotspots(df, eps_km=0.001, min_samples=1_000_000_000).select(
        "rank", "latitude", "longitude", "incident_count", "weighted_score", "dominant_type", "cluster_method")


@query(f"{cluster_sql(EVENTS, 0.1, 8)} SELECT incident_id, coalesce(cluster_id, -1) AS cluster_id, is_core FROM clu")
def density_clusters(spark, sf_dir):
    return C.density_clusters(inc_events(spark, sf_dir), 0.1, 8).fillna(-1, ["cluster_id"])


@query(f"{cluster_sql(ORDERS, 0.5, 3)} SELECT incident_id, coalesce(cluster_id, -1) AS cluster_id, is_core FROM clu")
def density_clusters_orders(spark, sf_dir):
    return C.density_clusters(inc_orders(spark, sf_dir)).fillna(-1, ["cluster_id"])


@query(f"{cluster_sql(CROWDED, 0.25, 700)} SELECT incident_id, coalesce(cluster_id, -1) AS cluster_id, is_core FROM clu")
def density_clusters_crowded(spark, sf_dir):
    """Hundreds of neighbours are asked for, so no cube is core by its own size."""
    return C.density_clusters(inc_crowded(spark, sf_dir), 0.25, 700).fillna(-1, ["cluster_id"])


@query(f"""{cluster_sql(EVENTS, 0.1, 10)} SELECT count(*) AS points, count(DISTINCT cluster_id) AS clusters, count(cluster_id) AS clustered,
  count(*) FILTER (is_core) AS core, count(*) FILTER (NOT is_core AND cluster_id IS NOT NULL) AS border, count(*) FILTER (cluster_id IS NULL) AS noise FROM clu""")
def cluster_summary(spark, sf_dir):
    return C.cluster_summary(C.density_clusters(inc_events(spark, sf_dir), 0.1, 10))


@query(f"{cluster_sql(EVENTS, 0.5, 3)} {profile_ctes()} SELECT {_RANK}, {_SHOWN} FROM prof ORDER BY rank LIMIT 10")
def hotspots(spark, sf_dir):
    return shown(H.hotspots(inc_events(spark, sf_dir)))


@query(f"""{cluster_sql(EVENTS, 0.5, 3)} {profile_ctes(False)} SELECT {_RANK}, latitude, longitude, incident_count, weighted_score, cluster_radius_km,
  dominant_type, type_breakdown, peak_hours, peak_days, temporal_pattern, '-' AS trend, CAST(0 AS BIGINT) AS recent_incidents, false AS is_emerging
  FROM prof ORDER BY rank LIMIT 10""")
def hotspots_unweighted(spark, sf_dir):
    df = shown(H.hotspots(inc_events(spark, sf_dir), use_recency=False)).fillna("-", ["trend"])
    return df.drop("recency_score", "older_incidents", "cluster_method")


@query(f"{cluster_sql(ORDERS, 0.5, 3)} {profile_ctes()} SELECT cluster_id, first_incident_id, {_SHOWN} FROM prof")
def hotspot_profiles(spark, sf_dir):
    df = inc_orders(spark, sf_dir)
    return shown(H.hotspot_profiles(df, C.fit_clusters(df)))


@query(f"{cluster_sql(ORDERS, 0.5, 3)} {profile_ctes()} SELECT trend, count(*) AS clusters, sum(incident_count)::BIGINT AS incidents FROM prof GROUP BY 1")
def hotspot_trends(spark, sf_dir):
    df = inc_orders(spark, sf_dir)
    return H.hotspot_profiles(df, C.fit_clusters(df)).groupBy("trend").agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("incident_count").alias("incidents"))
