"""hotspan: incident analytics as DataFrame operators."""

from hotspan.plans.analyze import analyze
from hotspan.sources.normalize import normalize_incidents, resolve_roles
from hotspan.sources.reader import read_incidents

__all__ = ["analyze", "normalize_incidents", "read_incidents", "resolve_roles"]
