"""Extraction from text, validation and the full analysis."""

import pytest

from hotspan import analyze
from hotspan.operators import distributions as D
from hotspan.operators import patterns, seasonal
from hotspan.operators.seasonal import seasonal_verdicts
from hotspan.plans.report import SECTIONS, write_report
from hotspan.operators import predictions as P

OBJECT = '{"latitude": 33.7, "longitude": -84.4, "crime_type": "Theft", "prediction": "a {brace", "likelihood": 80}'
RESPONSES = [
    (1, f"Sure!\n[{OBJECT}]\nBye [1]", [(33.7, -84.4, "Theft", "a {brace", 80.0)]),
    (2, '[ {"latitude": "33.5", "longitude": "-84"} , {"longitude": 1} ]', [(33.5, -84.0, "Unknown", "No details", 50.0)]),
    (3, '[{"latitude": "x", "longitude": 1}]', []),
    (4, '[{"latitude": 1, "longitude": 2,}]\nLatitude: 3, longitude 4.5, Crime_Type: Arson\t, likelihood: 9%',
     [(3.0, 4.5, "Arson", "Predicted crime location", 9.0)]),
    (5, "latitude: 1 longitude: 2\nlatitude only: 3\nLATITUDE -1.5, LONGITUDE: -2.5, crime type: x", [
        (1.0, 2.0, "Unknown", "Predicted crime location", 50.0), (-1.5, -2.5, "x", "Predicted crime location", 50.0)]),
    (6, "", []), (7, None, []),
    (8, '[{"latitude": 1, "longitude": 2, "likelihood": "85%"}]', [(1.0, 2.0, "Unknown", "No details", 85.0)]),
]


def test_extraction(spark):
    df = spark.createDataFrame([(i, t) for i, t, _ in RESPONSES], "response_id long, raw string")
    got = {i: [] for i, _, _ in RESPONSES}
    for r in P.extract_predictions(df).orderBy("response_id", "ordinal").collect():
        got[r.response_id].append((r.latitude, r.longitude, r.incident_type, r.prediction, r.likelihood))
    assert got == {i: want for i, _, want in RESPONSES}


def test_validation(spark, incidents_of):
    incidents = incidents_of([(1, 0.0, 0.0, "a", None, None), (2, 10.0, 20.0, "a", None, None)])
    cases = [(11.0, 22.0, 70.0), (11.1, 0.0, 70.0), (-1.0, -2.0, -5.0), (5.0, 22.1, 70.0), (5.0, 5.0, 150.0), (5.0, 5.0, None)]
    preds = spark.createDataFrame(cases, "latitude double, longitude double, likelihood double")
    got = sorted(tuple(r) for r in P.validate_predictions(preds, incidents).collect())
    assert got == [(-1.0, -2.0, 50.0), (5.0, 5.0, 50.0), (5.0, 5.0, 50.0), (11.0, 22.0, 70.0)]


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(f"{33.7 + (i % 7) * 1e-4:.4f}", f"{-84.4 + (i % 5) * 1e-4:.4f}", "Theft" if i % 3 else "Arson",
             f"2024-0{1 + i % 6}-{1 + i % 28:02d}", f"{i % 24}:05") for i in range(300)]
    return spark.createDataFrame(rows, "Latitude string, Longitude string, CrimeType string, Date string, Time string")


def test_full_analysis(spark, raw):
    out = analyze(raw)
    assert out["summary"].first().total_records == 300
    assert out["hotspots"].first().incident_count == 300
    only = out["predictions"].first()
    assert (only.prediction, only.likelihood, only.risk) == ("Historical hotspot with 300 incidents", 90.0, "HIGH")
    for name, df in out.items():
        assert df.count() > 0, name


def test_full_analysis_with_responses(spark, raw, tmp_path):
    texts = spark.createDataFrame([(1, f"[{OBJECT}]"), (2, "nothing")], "response_id long, raw string")
    out = analyze(raw, responses=texts)
    # The response without a prediction repeats the one hotspot, the other one stands for itself.
    assert {(r.response_id, r.incident_type, r.prediction.split()[0]) for r in out["predictions"].collect()} == {
        (1, "Theft", out["predictions"].where("response_id = 1").first().prediction.split()[0]), (2, "Theft", "Historical")}
    values = {r.label: r.value for r in out["report"].collect()}
    assert values["Prediction #1.1 location"] == "(33.7, -84.4)" and values["total_records"] == "300"
    assert values["Response #2"] == "nothing"
    write_report(out["report"], str(tmp_path / "report"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert len(lines) == out["report"].count() and set(x.split("\t")[0] for x in lines) == set(SECTIONS)


def test_nothing_extracted_without_hotspots_is_empty(spark):
    from hotspan.operators.predictions import extract_predictions
    texts = spark.createDataFrame([(1, None), (None, "nothing"), (3, "")], "response_id long, raw string")
    assert extract_predictions(texts).isEmpty()


def test_results_that_count_read_the_fact_table(spark, raw):
    """Of all results only those that need single incidents join or aggregate them; the others read the small table of counts.

    Predictions and report take the bounds of the incidents as a scalar, which is no input file of theirs.
    """
    out = analyze(raw)
    folder = out["incidents"].inputFiles()[0].rsplit("/", 1)[0]
    reading = {name for name, df in out.items() if any(f.startswith(folder) for f in df.inputFiles())}
    assert reading == {"incidents", "geo_bounds", "recency_stats", "recent_trend", "time_half_trend", "holiday_effect", "payday_effect",
                       "seasonal_verdicts", "forecast_by_type", "cluster_summary", "density_grid", "layers"}


def test_facts_stand_for_incidents(incidents_of):
    rows = [(i, 1.0, 1.0, [None, "a", "b"][i % 3], None if i % 7 == 0 else f"202{i % 3}-0{1 + i % 9}-{1 + i % 28:02d} 10:00:00", [None, *range(24)][i % 25])
            for i in range(200)]
    df = incidents_of(rows)
    facts = D.fact_table(df)
    for operator in (D.summary, D.type_distribution, D.top_types, D.hourly_distribution, D.daily_distribution, D.monthly_distribution,
                     D.time_periods, D.season_comparison, D.dominant_time_period, D.dominant_season, D.seasonal_distribution,
                     D.peak_quarter, D.incident_cube, patterns.weekend_verdict, patterns.type_patterns, seasonal.year_over_year,
                     lambda x: D.peaks(x, "hour"), lambda x: D.top_k_per_group(x, ["incident_type"], "month", 2)):
        got, want = operator(facts), operator(df)
        assert got.columns == want.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        empty = operator(D.fact_table(df.limit(0)))
        assert sorted(map(repr, empty.collect())) == sorted(map(repr, operator(df.limit(0)).collect()))


def test_verdicts_take_one_scan(incidents_of):
    df = incidents_of([(i, 1.0, 1.0, "a", f"2024-0{1 + i % 6}-05 10:00:00", 10) for i in range(20)])
    text = seasonal_verdicts(df)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("LogicalRDD") + text.count("LocalRelation") == 1 and "Subquery" not in text


def test_single_quoted_text_is_not_json(spark):
    from hotspan.operators.predictions import extract_predictions
    df = spark.createDataFrame([("a", "[{'latitude': 1, 'longitude': 2}]"), ("b", '[{"latitude": 1, "longitude": 2}]')], "response_id string, raw string")
    assert [r.response_id for r in extract_predictions(df).collect()] == ["b"]
