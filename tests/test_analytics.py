"""Edge cases of distributions, trends, recency, seasons and tiers."""

import pytest
from pyspark.sql import functions as F

from hotspan.functions import tiers
from hotspan.functions.calendars import days_to_holiday
from hotspan.functions.temporal import days_ago
from hotspan.operators import distributions as D
from hotspan.operators import patterns, recency, seasonal
from hotspan.operators.hotspots import hotspots

TREND_CASES = [
    (3, 0, 0, "new"), (0, 0, 0, None), (0, 2, 0, "inactive"), (0, 0, 5, "inactive"), (4, 0, 2, "stable"),
    (4, 4, 0, "growing"), (3, 4, 0, "stable"), (1, 4, 9, "stable"), (1, 5, 0, "shrinking"),
]


@pytest.mark.parametrize("recent, older, very_old, want", TREND_CASES)
def test_hotspot_trend(spark, recent, older, very_old, want):
    row = spark.range(1).select(tiers.hotspot_trend(F.lit(recent), F.lit(older), F.lit(very_old)).alias("t")).first()
    assert row.t == want


@pytest.fixture(scope="module")
def undated(incidents_of):
    return incidents_of([(i, 33.0, -84.0, "a" if i % 3 else None, None, None) for i in range(12)])


def test_tables_without_dates(undated):
    assert not recency.recency_stats(undated).first().has_date_data
    assert recency.recency_stats(undated).first().recency_score is None
    assert {r.recency_weight for r in recency.recency_weight(undated).collect()} == {1.0}
    assert patterns.row_half_trend(undated).first().recent_trend is None
    assert patterns.time_half_trend(undated).first().recent_trend is None
    assert seasonal.year_over_year(undated).first().year_over_year is None
    for effect in (seasonal.holiday_effect(undated), seasonal.payday_effect(undated)):
        assert [set(r) for r in effect.collect()] == [{None}]
    verdicts = seasonal.seasonal_verdicts(undated).first()
    assert not verdicts.has_seasonal_data and verdicts.peak_quarter is None
    assert D.dominant_time_period(undated).first().dominant_time_period is None
    assert [r["count"] for r in D.time_periods(undated).collect()] == [0, 0, 0, 0]
    profile = patterns.type_patterns(undated).first()
    assert (profile["count"], profile.peak_hours, profile.peak_period, profile.weekend_vs_weekday) == (8, None, None, None)
    assert D.incident_cube(undated).count() == 1  # only the type marginal has values


def test_null_types_stay_in_the_denominator(undated):
    row = D.type_distribution(undated).first()
    assert (row.incident_type, row["count"], row.percentage) == ("a", 8, 66.7)


def test_one_day_of_data_has_no_score(incidents_of):
    df = incidents_of([(i, 1.0, 1.0, "a", "2024-05-05 10:00:00", 10) for i in range(20)])
    row = recency.recency_stats(df).first()
    assert (row.date_range_days, row.last_7_days, row.recency_score) == (0, 20, None)
    assert seasonal.year_over_year(df).first().year_over_year is None


def test_missing_dates_get_the_oldest_weight(incidents_of):
    df = incidents_of([(1, 1.0, 1.0, "a", "2024-03-01", 1), (2, 1.0, 1.0, "a", "2024-01-31", 1), (3, 1.0, 1.0, "a", None, 1)])
    got = {r.incident_id: r.recency_weight for r in recency.recency_weight(df).collect()}
    assert got == {1: 1.0, 2: 0.5, 3: 0.5}


def test_age_floors_elapsed_time(spark):
    df = spark.sql("select timestamp'2024-01-01 23:00:00' a, timestamp'2024-01-02 01:00:00' b")
    assert df.select(days_ago(F.col("a"), F.col("b")).alias("d")).first().d == 0
    # The afternoon before a holiday floors to minus one day.
    eve = spark.sql("select timestamp'2024-07-03 15:00:00' a")
    assert eve.select(days_to_holiday(F.col("a")).alias("d")).first().d == 1


@pytest.mark.parametrize("rows, verdict", [(9, None), (10, "stable"), (11, "rising"), (19, "rising"), (21, "stable")])
def test_row_half_trend(incidents_of, rows, verdict):
    df = incidents_of([(i, 1.0, 1.0, "a", "2024-01-01", 0) for i in range(rows)])
    assert patterns.row_half_trend(df).first().recent_trend == verdict


def test_ties_go_to_the_first_label(incidents_of):
    df = incidents_of([(1, 1.0, 1.0, "b", "2024-01-01", 23), (2, 1.0, 1.0, "a", "2024-04-01", 7)])
    assert D.dominant_time_period(df).first().dominant_time_period == "morning"
    assert D.dominant_season(df).first().dominant_season == "winter"
    assert D.peak_quarter(df).first().peak_quarter == "Q1"
    assert [r.incident_type for r in D.top_types(df).collect()] == ["a", "b"]
    assert [(r.rank, r.hour) for r in D.peaks(df, "hour").collect()] == [(1, 7), (2, 23)]


def test_hotspots_fall_back_to_cells(incidents_of):
    df = incidents_of([(i, float(i), float(i), "a", "2024-01-01", 1) for i in range(12)])
    rows = hotspots(df, n=5).collect()
    assert len(rows) == 5 and {r.cluster_method for r in rows} == {"grid_fallback"}
    assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]


def test_hotspot_without_dates_or_types(incidents_of):
    df = incidents_of([(i, 33.0, -84.0, None, None, None) for i in range(5)])
    row = hotspots(df).first()
    assert (row.incident_count, row.weighted_score, row.dominant_type, row.trend) == (5, 5.0, "Unknown", None)
    assert row.recency_score is None and not row.is_emerging and row.type_breakdown == [] and row.peak_hours is None
    assert row.cluster_radius_km == 0.0


@pytest.mark.parametrize("rows", [9, 10])
def test_seasonal_effects_need_ten_rows(incidents_of, rows):
    df = incidents_of([(i, 1.0, 1.0, "a", f"2024-0{1 + i % 2}-0{1 + i % 5}", 1) for i in range(rows)])
    pay, near = seasonal.payday_effect(df).first(), seasonal.holiday_effect(df).first()
    assert (pay.payday_count is None) == (near.near_holiday_count is None) == (near.normal_rate is None) == (rows < 10)
    if rows == 10:
        assert pay.payday_count + pay.non_payday_count == near.near_holiday_count + near.normal_days_count == 10


def test_coordinates_out_of_range_do_not_stop_the_hotspots(incidents_of):
    rows = [(i, 99999.0, 99999.0, "a", "2024-01-01", 1) for i in range(4)] + [(9 + i, 1e30, 2.0, "b", "2024-01-01", 1) for i in range(3)]
    spots = {r.dominant_type: r for r in hotspots(incidents_of(rows)).collect()}
    assert (spots["a"].latitude, spots["a"].incident_count) == (99999.0, 4) and spots["b"].incident_count == 3


def test_shares_add_up(incidents_of):
    df = incidents_of([(i, 1.0, 1.0, "a", "2024-01-01", i % 24) for i in range(77)])
    assert sum(r.share for r in D.with_share(D.hourly_distribution(df)).collect()) == pytest.approx(100, abs=0.01)
