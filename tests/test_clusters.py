"""Density clustering against brute force, on awkward geometry and with every shortcut forced on and off."""

import numpy as np
import pytest

from hotspan.operators.clusters import cluster_summary, density_clusters, fit_clusters
from hotspan.operators.components import connected_components


def brute_force(points, eps_km, min_samples):
    """Labels by definition: id -> (smallest core id of the cluster or None, is_core)."""
    ids = np.array([p[0] for p in points])
    lat, lon = np.radians([p[1] for p in points]), np.radians([p[2] for p in points])
    h = (np.sin((lat[:, None] - lat) / 2) ** 2
         + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2)
    near = 2 * 6371.0 * np.arcsin(np.sqrt(np.clip(h, 0, 1))) <= eps_km
    core = near.sum(1) >= min_samples
    label = np.where(core, ids, np.iinfo(np.int64).max)
    while True:
        lowest = np.where(core, np.where(near & core, label, np.iinfo(np.int64).max).min(1), label)
        if (lowest == label).all():
            break
        label = lowest
    touched = np.where(near & core, label, np.iinfo(np.int64).max).min(1)
    label = np.where(core, label, touched)
    return {int(i): (int(c) if c < np.iinfo(np.int64).max else None, bool(k)) for i, c, k in zip(ids, label, core)}


def labelled(spark, points, eps_km, min_samples, **options):
    df = spark.createDataFrame(points, "incident_id long, latitude double, longitude double")
    fitted = fit_clusters(df, eps_km, min_samples, **options)
    return {r.incident_id: (r.cluster_id, r.is_core) for r in fitted.label(df).collect()}


def numbered(coords, seed=1):
    ids = np.random.default_rng(seed).permutation(len(coords))
    return [(int(i), float(a), float(b)) for i, (a, b) in zip(ids, coords)]


def blobs(seed, n, centre, spread, clumps=8):
    rng = np.random.default_rng(seed)
    hubs = rng.normal(centre, spread * 6, (clumps, 2))
    return np.concatenate([hubs[rng.integers(clumps, size=n)] + rng.normal(0, spread, (n, 2)),
                           rng.uniform(np.array(centre) - spread * 30, np.array(centre) + spread * 30, (n // 5, 2))])


# Far-apart places share one run: clumps, copies of coordinates, a chain, the antimeridian, and a pole.
PLACES = np.concatenate([
    blobs(1, 250, (33.7, -84.4), 0.003), blobs(9, 100, (5.0, 5.0), 0.01),
    np.repeat(blobs(4, 60, (51.5, -0.1), 0.004), [1 + i % 5 for i in range(72)], axis=0),
    np.column_stack([np.full(200, 10.0), 20 + np.arange(200) * 0.004]),
    np.column_stack([np.random.default_rng(5).normal(0, 0.01, 200),
                     (np.random.default_rng(6).normal(180, 0.01, 200) + 180) % 360 - 180]),
    np.column_stack([90 - np.abs(np.random.default_rng(7).normal(0, 0.01, 200)),
                     np.random.default_rng(8).uniform(-180, 180, 200)])])

CASES = {
    "places": (numbered(PLACES), 0.5, 4),
    "dense": (numbered(blobs(2, 400, (33.7, -84.4), 0.001)), 0.3, 3),
    "many_samples": (numbered(blobs(3, 400, (-37.8, 145.0), 0.002)), 0.4, 15),
    "crowded": (numbered(blobs(11, 500, (33.7, -84.4), 0.0012, clumps=3)), 0.4, 120),
    "one_sample": (numbered(blobs(9, 100, (0.0, 0.0), 0.01)), 0.5, 1),
    "continental": (numbered(blobs(10, 150, (45.0, 10.0), 1.5)), 120.0, 4),
    "lonely": (numbered(np.column_stack([np.arange(20.0), np.arange(20.0)])), 0.5, 3),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_matches_brute_force(spark, name):
    points, eps_km, min_samples = CASES[name]
    assert labelled(spark, points, eps_km, min_samples) == brute_force(points, eps_km, min_samples)


@pytest.mark.parametrize("name, leaf_pairs", [("dense", 100), ("many_samples", 1), ("crowded", 20)])
def test_refinement_changes_nothing(spark, name, leaf_pairs):
    """Small leaves force the octant loops."""
    points, eps_km, min_samples = CASES[name]
    assert labelled(spark, points, eps_km, min_samples, leaf_pairs=leaf_pairs) == brute_force(points, eps_km, min_samples)


@pytest.mark.parametrize("share", [0.3, 2.0])
def test_compared_pairs_grow_with_the_locations(spark, monkeypatch, share):
    """Crowded points below ``min_samples`` are settled by bounds; comparing them with each other would be quadratic."""
    from hotspan.operators import clusters

    judged, compared = clusters._judged, []

    def counted(pairs, eps_km):
        compared.append(pairs.count())
        return judged(pairs, eps_km)

    monkeypatch.setattr(clusters, "_judged", counted)
    totals = {}
    for n in (500, 2000):
        compared.clear()
        rng = np.random.default_rng(n)
        labelled(spark, numbered(rng.uniform((33.7, -84.4), (33.705, -84.395), (n, 2))), 0.5, int(n * share), leaf_pairs=256)
        totals[n] = sum(compared)
    assert totals[500] < 30_000 and totals[2000] < 8 * totals[500] + 2000


def test_summary_counts(spark):
    points, eps_km, min_samples = CASES["one_sample"]
    df = spark.createDataFrame(points, "incident_id long, latitude double, longitude double")
    got = cluster_summary(density_clusters(df, eps_km, min_samples)).first()
    want = brute_force(points, eps_km, min_samples).values()
    assert got.points == len(points)
    assert got.clusters == len({c for c, _ in want if c is not None})
    assert got.core == sum(k for _, k in want)
    assert got.noise == sum(c is None for c, _ in want)


def components_by_search(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = np.random.default_rng(3)
    edges = {
        "path": [(i, i + 1) for i in range(-50, 250)],
        "star": [(0, i) for i in range(1, 300)] + [(1000, 1000 + i) for i in range(1, 40)],
        "random": [tuple(map(int, rng.integers(0, 400, 2))) for _ in range(260)],
        "none": [(5, 5)],
    }[shape]
    edges = [e for e in edges if e[0] != e[1]]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == components_by_search(edges)


def test_component_plans_stay_small(spark, monkeypatch):
    """No plan of any round has more than two joins or three scans, on a long path as on a star."""
    from hotspan import storage
    from hotspan.operators import components

    plans = []

    def recorded(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, *args, **kwargs)

    write = storage.write_once
    monkeypatch.setattr(components, "write_once", recorded)
    monkeypatch.setattr(storage, "write_once", recorded)
    n = 3000
    path = spark.range(n).selectExpr("id u", "id + 1 v")
    star = spark.range(1, n).selectExpr("1000000 u", "1000000 + id v")
    got = {r.node: r.component for r in components.connected_components(path.union(star)).collect()}
    assert set(got.values()) == {0, 1000000} and len(got) == 2 * n + 1
    assert len(plans) > 10
    for text in plans:
        assert text.count("Join") <= 2 and text.count("Relation [") <= 3
