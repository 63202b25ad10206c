"""Series gates, gap filling and forecast sanity."""

import datetime as dt

import pytest

from hotspan.operators import forecast as FC
from hotspan.operators.series import daily_series


def on_days(days, per_day=1, start=dt.date(2023, 1, 2), hour="00:00:00"):
    return [(d * 1000 + i, 1.0, 1.0, "a", f"{start + dt.timedelta(days=d)} {hour}", None)
            for d in days for i in range(per_day)]


def test_gaps_are_filled(incidents_of):
    rows = daily_series(incidents_of(on_days([0, 3, 4, 20], 2))).orderBy("ds").collect()
    assert len(rows) == 21 and sum(r.y for r in rows) == 8
    assert [r.y for r in rows[:5]] == [2, 0, 0, 2, 2]


@pytest.mark.parametrize("days, per_day, ok", [
    (range(13), 1, False), (range(14), 1, False), (range(15), 1, True), ([0, 14], 6, False), ([0, 14], 7, True), ([0, 13], 9, False)])
def test_minimum_data(incidents_of, days, per_day, ok):
    assert FC.forecast(incidents_of(on_days(days, per_day))).isEmpty() != ok


def test_span_is_elapsed_time(incidents_of):
    """From late on day 0 to early on day 14 is less than 14 full days."""
    rows = on_days([0], 10, hour="23:00:00") + on_days([14], 10, hour="01:00:00")
    assert FC.forecast(incidents_of(rows)).isEmpty()


def test_flat_series_stays_flat(incidents_of):
    df = incidents_of(on_days(range(60), 5))
    daily = FC.forecast(df).orderBy("ds").collect()
    assert len(daily) == 14 and {r.predicted for r in daily} == {5}
    assert all(r.lower <= r.predicted <= r.upper for r in daily)
    assert daily[0].ds == dt.date(2023, 1, 2) + dt.timedelta(days=60)
    fit = FC.fit_decomposition(FC.forecast_series(df))
    row = FC.forecast_summary(FC.forecast_daily(fit), fit).first()
    assert (row.total_predicted, row.trend, row.peak_day) == (70, "stable", daily[0].ds.strftime("%A, %Y-%m-%d"))


def test_weekly_shape_is_kept(incidents_of):
    """Mondays carry three times the load of the other days."""
    rows = [r for d in range(70) for r in on_days([d], 30 if d % 7 == 0 else 10)]
    daily = {r.day_name: r.predicted for r in FC.forecast(incidents_of(rows), horizon=7).collect()}
    assert daily["Monday"] == pytest.approx(30, abs=2) and daily["Tuesday"] == pytest.approx(10, abs=1)


def test_never_negative(incidents_of):
    rows = [r for d in range(30) for r in on_days([d], max(1, 30 - d))]
    daily = FC.forecast(incidents_of(rows)).collect()
    assert all(r.predicted >= 0 and r.lower >= 0 for r in daily)


def test_keys_are_independent(incidents_of, spark):
    df = incidents_of(on_days(range(40), 4))
    from pyspark.sql import functions as F
    other = df.withColumn("incident_type", F.lit("b")).where("day_of_week < 5")
    both = {(r.series_key, r.ds): r.predicted for r in FC.forecast(df.unionByName(other), ["incident_type"]).collect()}
    alone = {("a", r.ds): r.predicted for r in FC.forecast(df).collect()}
    assert {k: v for k, v in both.items() if k[0] == "a"} == alone
