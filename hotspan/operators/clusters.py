"""Exact density-based clustering of points on the sphere.

A point is core when at least ``min_samples`` points, itself included, lie within ``eps_km``; core points within
``eps_km`` of each other share a cluster, a non-core point within ``eps_km`` of a core point belongs to the
cluster with the smallest id among those it touches, and everything else is noise. A cluster is named by its
smallest core ``incident_id``.

How it is spread over a cluster of machines:

* Rows with equal coordinates collapse to one location first, so copies never travel.
* Locations fall into cubes on the unit sphere whose diagonal is shorter than the radius. All points of one cube
  are neighbours, so a cube with ``min_samples`` points is all core, and its internal pairs are never produced.
* Whether the locations of any other cube are core is settled for whole boxes first: the points in boxes that lie within
  the radius of all of a box bound its neighbours from below, those in boxes that come within the radius bound them
  from above. Only boxes that these bounds leave open are split into octants, down to small leftovers that are
  compared point by point.
* The core points of a cube form one node of the graph. Nodes of neighbouring cubes are compared by their tight boxes:
  wholly within the radius, wholly out of it, or open; open pairs are split into octants and compared again. Points
  that are not core are compared with such nodes only, never with each other.
* A coordinate or cube with a large share of all rows is left to adaptive execution, which splits such partitions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotspan.functions.geo import EARTH_RADIUS_KM, haversine_km, unit_sphere
from hotspan.operators.components import connected_components
from hotspan.storage import spread_out, write_measured, write_once

EPS_KM, MIN_SAMPLES = 0.5, 3

# Slack on box comparisons, far above rounding error; pairs inside it are decided by the exact distance.
SLACK = 1e-6
# Cubes of this side (in units of the cube side) have a diagonal just under the radius.
REACH = math.sqrt(3) / (1 - SLACK)
# Two boxes with at most this many location pairs are compared point by point.
LEAF_PAIRS = 4096

AXES = ("x", "y", "z")
# The cubes around a cube, and the half of them that follows it.
BLOCK, HALF_BLOCK = ("inline(array(%s)) as (dx, dy, dz)" % ", ".join(
    f"struct({i // 25 - 2}L, {i // 5 % 5 - 2}L, {i % 5 - 2}L)" for i in range(first, 125) if i != 62) for first in (0, 63))
BOX = [f"{side}_{a}" for side in ("lo", "hi") for a in AXES]
SIDE = ["gid", "cube", "n", "m", "latitude", "longitude", *BOX]

# What is known of a box: all core, all not core, to be compared point by point, or to be split.
CORE, OTHER, LEAF, SPLIT = "core", "other", "leaf", "split"


@dataclass(frozen=True)
class Clustering:
    """A fitted clustering. ``places`` holds every distinct coordinate pair with its cluster_id (NULL for noise) and is_core."""

    places: DataFrame

    def label(self, df: DataFrame) -> DataFrame:
        """Add cluster_id and is_core to a table with latitude and longitude; noise gets a NULL cluster."""
        found = df.join(self.places, ["latitude", "longitude"], "left")
        return found.select(*df.columns, "cluster_id", F.coalesce("is_core", F.lit(False)).alias("is_core"))

    def is_empty(self) -> bool:
        """Whether everything is noise. Runs one short job over the places."""
        return self.places.where(F.col("cluster_id").isNotNull()).isEmpty()


def density_clusters(incidents: DataFrame, eps_km: float = EPS_KM, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """(incident_id, cluster_id, is_core) for every incident."""
    fitted = fit_clusters(incidents, eps_km, min_samples)
    return fitted.label(incidents.select("incident_id", "latitude", "longitude")).select("incident_id", "cluster_id", "is_core")


def cluster_summary(clusters: DataFrame) -> DataFrame:
    """One row: clusters, clustered, core and border rows, noise rows."""
    inside = F.col("cluster_id").isNotNull()
    return clusters.agg(
        F.count(F.lit(1)).alias("points"), F.countDistinct("cluster_id").alias("clusters"),
        F.count_if(inside).alias("clustered"), F.count_if(F.col("is_core")).alias("core"),
        F.count_if(inside & ~F.col("is_core")).alias("border"), F.count_if(~inside).alias("noise"))


def _scale(eps_km: float) -> float:
    """Radius of the sphere in units of the cube side."""
    return REACH / (2 * math.sin(min(eps_km / (2 * EARTH_RADIUS_KM), math.pi / 2)))


def _position(lat: Column, lon: Column, eps_km: float) -> list[Column]:
    """Position on the sphere in units of the cube side."""
    return [c * F.lit(_scale(eps_km)) for c in unit_sphere(lat, lon)]


def _deepest_level(eps_km: float) -> int:
    """Level whose octants are no larger than the spacing of double-precision positions: nothing is left to split there."""
    return max(1, 52 - math.frexp(_scale(eps_km))[1])


def _cube(position: list[Column], level: int = 0) -> Column:
    """Cube (or, at a deeper level, octant) that holds a position."""
    return F.struct(*[F.floor(c * F.lit(float(2 ** level))).cast("long").alias(a) for a, c in zip(AXES, position)])


def _box_of(position: list[Column]) -> dict[str, Column]:
    return {f"lo_{a}": F.min(c) for a, c in zip(AXES, position)} | {f"hi_{a}": F.max(c) for a, c in zip(AXES, position)}


def _bounds(locations: DataFrame, *keys: Column) -> DataFrame:
    """Rows, locations, smallest id and tight box of each group of locations. One aggregation with map-side combine."""
    return locations.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("m"), F.min("loc_id").alias("gid"),
        # Only read where m = 1, and then they are the location's own coordinates.
        F.min("latitude").alias("latitude"), F.min("longitude").alias("longitude"),
        *[c.alias(name) for name, c in _box_of([F.col(a) for a in AXES]).items()])


def _boxes(locations: DataFrame, level: int) -> DataFrame:
    """Occupied cubes of a level with their bounds."""
    return _bounds(locations, _cube([F.col(a) for a in AXES], level).alias("cube"))


def _single(locations: DataFrame, *more: Column | str) -> DataFrame:
    """Every location as a box of its own."""
    return locations.select(
        *more, F.col("loc_id").alias("gid"), "n", F.lit(1).cast("long").alias("m"), "latitude", "longitude",
        *[F.col(a).alias(f"{side}_{a}") for side in ("lo", "hi") for a in AXES])


def fit_clusters(incidents: DataFrame, eps_km: float = EPS_KM, min_samples: int = MIN_SAMPLES,
                 leaf_pairs: int = LEAF_PAIRS) -> Clustering:
    """Cluster the incidents. ``incident_id`` must be unique; the coordinates must not be NULL."""
    positions = _position(F.col("latitude"), F.col("longitude"), eps_km)
    locations = write_once(
        incidents.groupBy("latitude", "longitude").agg(
            F.count(F.lit(1)).alias("n"), F.min("incident_id").alias("loc_id"))
        .withColumns(dict(zip(AXES, positions))))
    flagged = _flagged(locations, eps_km, min_samples, leaf_pairs)
    core, rest = flagged.where("is_core"), flagged.where(~F.col("is_core"))
    cubes = write_once(_boxes(core, 0))
    others = _single(rest, "cube")
    touching = _links(others, core, cubes, eps_km, leaf_pairs)
    return Clustering(_labelled(core, rest, cubes, touching))


# --- which locations are core -----------------------------------------------------------------------------------

def _flagged(locations: DataFrame, eps_km: float, min_samples: int, leaf_pairs: int) -> DataFrame:
    """The locations with their ``cube`` and ``is_core``."""
    position = [F.col(a) for a in AXES]
    columns = [*locations.columns, "cube"]
    cubes = write_once(_boxes(locations, 0))
    few = F.col("n") < min_samples
    pairs = write_once(_neighbour_pairs(cubes.where(few), cubes, eps_km, BLOCK))
    verdicts = _verdicts(cubes.where(few).withColumn("sure", F.col("n")), pairs, min_samples, leaf_pairs)
    verdicts = verdicts.select("cube", "gid", "verdict", "sure").unionByName(
        cubes.where(~few).select("cube", "gid", F.lit(CORE).alias("verdict"), F.col("n").alias("sure")))
    cubed = locations.withColumn("cube", _cube(position))
    placed, left = write_measured(cubed.join(verdicts.withColumnRenamed("gid", "box"), "cube"), _undecided())
    found, level, deepest = [], 0, _deepest_level(eps_km)
    while True:
        is_core = F.when(F.col("verdict").isin(CORE, OTHER), F.col("verdict") == CORE)
        found.append(placed.where(is_core.isNotNull()).select(*columns, is_core.alias("is_core")))
        if left == 0:
            break
        open_ = pairs.where(F.col("near").isNull()).drop("near")
        found.append(_by_points(placed.where(F.col("verdict") == LEAF), open_, locations, level, eps_km, min_samples).select(*columns, "is_core"))
        large = placed.where(F.col("verdict") == SPLIT)
        if large.isEmpty():
            break
        # Both sides one level down: octants of the boxes in question against octants of what comes near them.
        child = _cube(position, level + 1).alias("child")
        parts = write_once(_bounds(large, "box", "sure", child))
        finer = _boxes(locations, level + 1).withColumnRenamed("cube", "part")
        finer = finer.withColumn("cube", F.struct(*[F.shiftright(F.col(f"part.{a}"), 1).alias(a) for a in AXES]))
        halfway = _judged(_replaced(open_, parts), eps_km).drop("near")
        pairs = write_once(_judged(_opened(halfway, "b", finer), eps_km))
        level += 1
        verdicts = _verdicts(parts.drop("box"), pairs, min_samples, leaf_pairs if level < deepest else None)
        placed, left = write_measured(
            large.select(*columns, child).join(verdicts.select("child", F.col("gid").alias("box"), "verdict", "sure"), "child"), _undecided())
    flagged = found[0]
    for more in found[1:]:
        flagged = flagged.unionByName(more)
    return write_once(flagged)


def _undecided() -> Column:
    return F.count_if(F.col("verdict").isin(LEAF, SPLIT))


def _verdicts(boxes: DataFrame, pairs: DataFrame, min_samples: int, leaf_pairs: int | None) -> DataFrame:
    """Add the verdict to boxes with ``sure``, the neighbours that all their points are known to have, and bring it up to date."""
    near = F.col("near").isNotNull()
    votes = pairs.groupBy(F.col("a_gid").alias("gid")).agg(
        F.sum(F.when(near, F.col("b_n"))).alias("near_n"), F.sum(F.when(~near, F.col("b_n"))).alias("open_n"),
        F.sum(F.when(~near, F.col("b_m"))).alias("open_m"))
    sure = F.col("sure") + F.coalesce("near_n", F.lit(0))
    small = F.lit(True) if leaf_pairs is None else F.col("m") * F.coalesce("open_m", F.lit(0)) <= leaf_pairs
    verdict = F.when(sure >= min_samples, CORE).when(sure + F.coalesce("open_n", F.lit(0)) < min_samples, OTHER).when(
        small, LEAF).otherwise(SPLIT)
    return boxes.join(votes, "gid", "left").withColumn("verdict", verdict).withColumn("sure", sure)


def _by_points(small: DataFrame, open_: DataFrame, locations: DataFrame, level: int, eps_km: float, min_samples: int) -> DataFrame:
    """``is_core`` of the locations in small boxes, each compared with the locations of the boxes still open to it."""
    members = _single(locations, _cube([F.col(a) for a in AXES], level).alias("cube")).withColumn("part", F.col("cube"))
    pairs = _opened(_replaced(open_, _single(small, "box")), "b", members)
    near = _judged(pairs, eps_km).groupBy(F.col("a_gid").alias("loc_id")).agg(F.sum("b_n").alias("k"))
    return small.join(near, "loc_id", "left").withColumn("is_core", F.col("sure") + F.coalesce("k", F.lit(0)) >= min_samples)


def _replaced(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Replace the first box of each pair by its parts, which name it as ``box`` and have ids of their own."""
    inner = [c for c in SIDE if c != "cube"]
    keyed = parts.select(F.col("box").alias("a_gid"), *[F.col(c).alias(f"_{c}") for c in inner])
    finer = {f"a_{c}": F.col(f"_{c}").alias(f"a_{c}") for c in inner}
    return pairs.join(keyed, "a_gid").select(*[finer.get(c, F.col(c)) for c in pairs.columns])


# --- which neighbouring items lie within the radius -------------------------------------------------------------

def _gap2(a: str, b: str) -> Column:
    """Squared smallest distance between two boxes."""
    zero = F.lit(0.0)
    return sum((F.pow(F.greatest(F.col(f"{b}lo_{x}") - F.col(f"{a}hi_{x}"),
                                 F.col(f"{a}lo_{x}") - F.col(f"{b}hi_{x}"), zero), 2) for x in AXES), zero)


def _span2(a: str, b: str) -> Column:
    """Squared largest distance between points of two boxes."""
    return sum((F.pow(F.greatest(F.col(f"{b}hi_{x}") - F.col(f"{a}lo_{x}"),
                                 F.col(f"{a}hi_{x}") - F.col(f"{b}lo_{x}")), 2) for x in AXES), F.lit(0.0))


def _judged(pairs: DataFrame, eps_km: float) -> DataFrame:
    """Keep pairs not provably apart; ``near`` is true when wholly within the radius and NULL when open."""
    exact = haversine_km(F.col("a_latitude"), F.col("a_longitude"), F.col("b_latitude"), F.col("b_longitude")) <= eps_km
    near = F.when((F.col("a_m") == 1) & (F.col("b_m") == 1), exact).when(
        _span2("a_", "b_") <= REACH ** 2 * (1 - SLACK), True)
    return pairs.where(_gap2("a_", "b_") <= REACH ** 2 * (1 + SLACK)).withColumn("near", near).where(
        F.coalesce("near", F.lit(True)))


def _side(df: DataFrame, side: str, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{side}_{c}") for c in columns])


def _neighbour_pairs(first: DataFrame, second: DataFrame, eps_km: float, offsets: str) -> DataFrame:
    """Pairs of boxes of two tables in different cubes at most two cubes apart, not provably apart."""
    a = _side(spread_out(first), "a", SIDE).select("*", F.expr(offsets))
    a = a.withColumns({f"b_lo_{x}": F.col(f"a_cube.{x}") + F.col(f"d{x}") for x in AXES})
    a = a.withColumns({f"b_hi_{x}": F.col(f"b_lo_{x}") + 1 for x in AXES})
    # Only cubes that reach the surface of the sphere and come within the radius of this box can matter.
    chord = 2 * math.sin(min(eps_km / (2 * EARTH_RADIUS_KM), math.pi / 2))
    centre2 = sum((F.pow(F.col(f"b_lo_{x}") + 0.5, 2) for x in AXES), F.lit(0.0))
    shell = centre2.between(max(0.0, REACH / chord - 1) ** 2, (REACH / chord + 1) ** 2)
    a = a.where(shell & (_gap2("a_", "b_") <= REACH ** 2 * (1 + SLACK)))
    a = a.select(*[f"a_{c}" for c in SIDE], F.struct(*[F.col(f"b_lo_{x}").alias(x) for x in AXES]).alias("b_cube"))
    # Partitioning by the join key here also keeps the two expression-heavy halves in separate stages.
    return _judged(a.repartition("b_cube").join(_side(second, "b", SIDE), "b_cube"), eps_km)


def _opened(pairs: DataFrame, side: str, parts: DataFrame) -> DataFrame:
    """Replace the boxes of one side by their parts; single locations stay as they are.

    ``parts`` has the same columns as an item without its owner, keyed by ``cube``, plus the part's own ``part``.
    """
    inner = ["n", "m", "latitude", "longitude", *BOX]
    keyed = parts.select(F.col("cube").alias("_cube"), F.col("part").alias("_cube_in"),
                         *[F.col(c).alias(f"_{c}_in") for c in inner])
    joined = pairs.join(keyed, (F.col(f"{side}_cube") == F.col("_cube")) & (F.col(f"{side}_m") > 1), "left")
    finer = {f"{side}_{c}": F.coalesce(f"_{c}_in", f"{side}_{c}").alias(f"{side}_{c}") for c in ["cube", *inner]}
    return joined.select(*[finer.get(c, F.col(c)) for c in pairs.columns])


def _links(others: DataFrame, core: DataFrame, cubes: DataFrame, eps_km: float, leaf_pairs: int) -> DataFrame:
    """Which boxes touch, (a_gid, b_gid, both_core): cubes of core points with each other, and single other points with them."""
    position = [F.col(a) for a in AXES]
    pairs = _neighbour_pairs(cubes, cubes, eps_km, HALF_BLOCK).withColumn("both_core", F.lit(True)).unionByName(
        _neighbour_pairs(others, cubes, eps_km, BLOCK).withColumn("both_core", F.lit(False)))
    level, deepest, undecided = 0, _deepest_level(eps_km), F.count_if(F.col("near").isNull())
    pairs, left = write_measured(pairs, undecided)
    link = ["a_gid", "b_gid", "both_core"]
    found = [pairs.where("near").select(*link)]
    while left > 0:
        # A pair that already touches needs no further look.
        open_ = pairs.where(F.col("near").isNull()).join(pairs.where("near").select("a_gid", "b_gid").distinct(), ["a_gid", "b_gid"], "left_anti")
        open_ = open_.drop("near")
        small = F.lit(True) if level >= deepest else F.col("a_m") * F.col("b_m") <= leaf_pairs
        members = _single(core, _cube(position, level).alias("cube")).withColumn("part", F.col("cube"))
        leaves = _judged(_opened(_opened(open_.where(small), "a", members), "b", members), eps_km)
        found.append(write_once(leaves.select(*link).distinct()))
        if level >= deepest or pairs.where(F.col("near").isNull() & ~small).isEmpty():
            break
        large = write_once(open_.where(~small))
        level += 1
        parts = _boxes(core, level).withColumnRenamed("cube", "part")
        parts = write_once(parts.withColumn("cube", F.struct(*[F.shiftright(F.col(f"part.{a}"), 1).alias(a) for a in AXES])))
        halfway = _judged(_opened(large, "a", parts), eps_km).drop("near")
        pairs, left = write_measured(_judged(_opened(halfway, "b", parts), eps_km), undecided)
        found.append(pairs.where("near").select(*link))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return write_once(links.distinct())


# --- from links to cluster labels -------------------------------------------------------------------------------

def _labelled(core: DataFrame, rest: DataFrame, cubes: DataFrame, links: DataFrame) -> DataFrame:
    """Every location with its cluster and whether it is core."""
    parts = connected_components(links.where("both_core").select(F.col("a_gid").alias("u"), F.col("b_gid").alias("v")))
    named = write_once(cubes.select("gid", "cube").join(parts.withColumnRenamed("node", "gid"), "gid", "left").select(
        "gid", "cube", F.coalesce("component", "gid").alias("cluster_id")))
    # Other points touch the core points of their own cube by its size, those of further cubes by a link.
    inside = rest.join(named, "cube").select("loc_id", "cluster_id")
    across = links.where(~F.col("both_core")).select(F.col("a_gid").alias("loc_id"), F.col("b_gid").alias("gid")).join(
        named.select("gid", "cluster_id"), "gid").select("loc_id", "cluster_id")
    border = inside.unionByName(across).groupBy("loc_id").agg(F.min("cluster_id").alias("cluster_id"))
    columns = ["latitude", "longitude", "cluster_id", "is_core"]
    return write_once(core.join(named.select("cube", "cluster_id"), "cube").select(*columns).unionByName(
        rest.join(border, "loc_id", "left").select(*columns)))
