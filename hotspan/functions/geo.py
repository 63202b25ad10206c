"""Spherical geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), h))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(clamped))


def snap_grid(coord: Column, cells_per_degree: int = 100) -> Column:
    """Coordinate snapped to the grid, half to even."""
    return F.rint(coord * cells_per_degree) / F.lit(float(cells_per_degree))


def unit_sphere(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Cartesian position on the unit sphere."""
    la, lo = F.radians(lat), F.radians(lon)
    return F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)
