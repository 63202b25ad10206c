"""The full analysis of one incident table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hotspan.operators import distributions as D
from hotspan.operators import forecast as FC
from hotspan.operators import patterns, predictions as P, recency, seasonal
from hotspan.operators.clusters import cluster_summary, fit_clusters
from hotspan.operators.hotspots import density_grid, hotspots
from hotspan.plans.report import analysis_report
from hotspan.sources.layers import map_layers
from hotspan.sources.normalize import dataset_profile, ingest_report, normalize_incidents, require_rows
from hotspan.storage import write_once


def analyze(df: DataFrame, roles: dict[str, str] | None = None, id_col: str | None = None,
            responses: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every result table of the analysis, by name. The normalised table is written once and so are its counts by type, hour
    and day, from which everything that only counts is derived. Beyond that only the clustering, the hotspots and the
    forecast's fit run at once. Raises when no row has coordinates.

    ``responses`` is an optional table (response_id, raw) of model answers. Without one, and for every response from which
    nothing can be extracted, the predictions repeat the strongest hotspots.
    """
    incidents = require_rows(write_once(normalize_incidents(df, roles, id_col)))
    fit = write_once(FC.fit_decomposition(FC.forecast_series(incidents)))
    daily = FC.forecast_daily(fit)
    facts = write_once(D.fact_table(incidents))
    clusters = fit_clusters(incidents)
    spots = write_once(hotspots(incidents, fitted=clusters))
    extracted = P.hotspot_predictions(spots) if responses is None else P.extract_predictions(responses, spots)
    expected = P.validate_predictions(extracted, incidents)
    return {
        "incidents": incidents, "dataset_profile": dataset_profile(df), "ingest_report": ingest_report(df, roles),
        "summary": D.summary(facts), "geo_bounds": D.geo_bounds(incidents),
        "type_distribution": D.type_distribution(facts), "top_types": D.top_types(facts),
        "recency_stats": recency.recency_stats(incidents), "marginals": D.incident_cube(facts),
        "peak_hours": D.peaks(facts, "hour"), "peak_days": D.peaks(facts, "day_of_week"),
        "peak_months": D.peaks(facts, "month"), "weekend_verdict": patterns.weekend_verdict(facts),
        "time_periods": D.time_periods(facts), "dominant_time_period": D.dominant_time_period(facts), "recent_trend": patterns.row_half_trend(incidents),
        "time_half_trend": patterns.time_half_trend(incidents), "type_patterns": patterns.type_patterns(facts),
        "seasonal_distribution": D.seasonal_distribution(facts), "season_comparison": D.season_comparison(facts),
        "holiday_effect": seasonal.holiday_effect(incidents), "payday_effect": seasonal.payday_effect(incidents),
        "year_over_year": seasonal.year_over_year(facts), "seasonal_verdicts": seasonal.seasonal_verdicts(incidents),
        "forecast_daily": FC.forecast_chart(daily), "forecast_summary": FC.forecast_summary(daily, fit),
        "forecast_weekly": FC.forecast_weekly(daily), "forecast_by_type": FC.forecast_by_type(incidents, daily),
        "hotspots": spots, "cluster_summary": cluster_summary(clusters.label(incidents)), "density_grid": density_grid(incidents),
        "predictions": P.prediction_table(expected),
        "layers": map_layers(incidents, spots, expected), "report": analysis_report(facts, expected, responses=responses),
    }
