"""Queries over the given tables and the SQL they are checked against."""

from checks import distribution, forecasting, hotspot, ingest, predicting
from checks.registry import QUERIES

__all__ = ["QUERIES"]
