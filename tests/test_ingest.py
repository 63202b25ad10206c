"""Readers, role guessing, cleaning, and writers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from hotspan.functions.parsing import parse_hour, parse_pct, to_double
from hotspan.schema import INCIDENTS
from hotspan.sources.layers import geojson_features, map_layers, sample_incidents, write_layers
from hotspan.sources.normalize import (dataset_profile, ingest_report, normalize_incidents, require_rows,
                                       resolve_roles)
from hotspan.sources.reader import read_incidents

DIRTY = [
    # lat, lon, offense, occurred, hour_text
    ("33.7", "-84.4", "Theft", "2024-01-02", "2:15"),
    (" 33.8 ", "-84.5", "N/A", "2024-01-02 23:30:00", "23:59"),
    ("NaN", "-84.4", "Theft", "2024-01-03", "10:00"),
    ("inf", "-84.4", "Theft", "2024-01-03", "10:00"),
    ("1d", "-84.4", "Theft", "2024-01-03", "10:00"),
    ("north", "-84.4", "Theft", "2024-01-03", "10:00"),
    ("33.9", "", "Theft", "2024-01-03", "10:00"),
    ("34.0", "-84.6", "Arson", "1/5/2024", "25:00"),
    ("34.1", "-84.7", "Arson", "soon", "14:30:05"),
    ("34.2", "-84.8", "  ", None, None),
]


@pytest.fixture
def dirty(spark):
    return spark.createDataFrame(DIRTY, "lat string, lon string, offense string, occurred string, hour_text string")


def test_roles_from_names():
    assert resolve_roles(["lat", "lon", "offense", "occurred", "hour_text"]) == {
        "latitude": "lat", "longitude": "lon", "incident_type": "offense", "date": "occurred", "time": "hour_text"}
    # One column may fill several roles, 'datetime' is a date but not a time, and the first match wins.
    assert resolve_roles(["Category Latitude", "LONG", "report_datetime", "date2"]) == {
        "latitude": "Category Latitude", "longitude": "LONG", "incident_type": "Category Latitude", "date": "report_datetime"}


def test_missing_role_names_the_columns(spark):
    df = spark.createDataFrame([(1.0, "x")], "lat double, kind string")
    with pytest.raises(ValueError, match=r"longitude.*'lat', 'kind'"):
        normalize_incidents(df, {"latitude": "lat", "longitude": "lng", "incident_type": "kind"})


def test_normalize_dirty_rows(dirty):
    got = normalize_incidents(dirty)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in INCIDENTS]
    rows = sorted(got.collect(), key=lambda r: r.latitude)
    assert [(r.latitude, r.longitude, r.incident_type) for r in rows] == [
        (33.7, -84.4, "Theft"), (33.8, -84.5, None), (34.0, -84.6, "Arson"), (34.1, -84.7, "Arson"), (34.2, -84.8, None)]
    assert [r.occurred_at for r in rows] == [
        dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2, 23, 30), dt.datetime(2024, 1, 5), None, None]
    # The column-wide layout is H:m, so the one row with seconds has no hour.
    assert [r.hour for r in rows] == [2, 23, None, None, None]
    assert [r.day_of_week for r in rows] == [1, 1, 4, None, None]
    assert len({r.incident_id for r in rows}) == 5


def test_no_date_role_gives_null_dates(dirty):
    roles = {"latitude": "lat", "longitude": "lon", "incident_type": "offense"}
    assert normalize_incidents(dirty, roles).where("occurred_at is not null or hour is not null").isEmpty()


@pytest.mark.parametrize("texts, column, row", [
    (["14:30", "2:15", "14:30:05"], [14, 2, None], [14, 2, 14]),
    (["14:30:05", "x", "01:00:00"], [14, None, 1], [14, None, 1]),
    (["2:15 PM", "2024-03-01 09:00:00", "x"], [14, 9, None], [14, 9, None]),
])
def test_hour_layout_is_chosen_per_column_or_row(spark, texts, column, row):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for policy, want in (("column", column), ("row", row)):
        got = df.select("i", parse_hour(df, F.col("t"), policy).alias("h")).orderBy("i").collect()
        assert [r.h for r in got] == want


def test_ingest_report_and_profile(dirty):
    r = ingest_report(dirty).first()
    assert (r.rows_read, r.rows_dropped, r.rows_kept, r.valid_dates, r.valid_hours) == (10, 5, 5, 3, 2)
    assert (r.failed_dates, r.failed_hours) == (1, 2)
    assert tuple(dataset_profile(dirty).first()) == (10, 5)
    with pytest.raises(ValueError):
        require_rows(normalize_incidents(dirty.where("lat = 'north'")))


def test_number_and_percent_parsing(spark):
    df = spark.createDataFrame([("85%",), ("%",), ("n/a",), (" 7.5 % ",), ("85%%",), ("2f",)], "t string")
    assert [r.p for r in df.select(parse_pct(F.col("t")).alias("p")).collect()] == [85.0, None, None, 7.5, 85.0, None]
    assert df.select(to_double(F.lit("-1e3")).alias("d")).first().d == -1000.0


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json", "orc"])
def test_read_formats(spark, dirty, tmp_path, fmt):
    path = str(tmp_path / f"rows.{fmt}")
    dirty.write.format(fmt).option("header", True).option("escape", '"').save(path)
    got = read_incidents(spark, path)
    assert normalize_incidents(got).count() == 5


def test_csv_is_latin1_with_doubled_quotes(spark, tmp_path):
    path = tmp_path / "one.csv"
    path.write_bytes('lat,lon,type\n1.5,2.5,"caf\xe9 ""bar"""\n'.encode("latin-1"))
    assert read_incidents(spark, str(path)).first()["type"] == 'caf\xe9 "bar"'


def test_damaged_csv_lines_are_kept_apart(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text("lat,lon,type,date\n1.5,2.5,a,2024-01-02\n3.5\n4.5,5.5,b,soon,more,fields\n6.5,7.5,c,2024-01-03\n")
    df = read_incidents(spark, str(path), damaged="broken")
    assert sorted(r.broken for r in df.collect() if r.broken) == ["3.5", "4.5,5.5,b,soon,more,fields"]
    r = ingest_report(df, damaged="broken").first()
    assert (r.rows_read, r.rows_kept, r.valid_dates, r.failed_dates, r.damaged) == (4, 3, 2, 1, 2)
    assert ingest_report(read_incidents(spark, str(path))).first().damaged == 0
    typed = read_incidents(spark, str(path), schema="lat double, lon double, type string, date string", damaged="broken")
    assert len([r for r in typed.select("lat", "broken").collect() if r.broken]) == 2


def test_reader_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="unsupported"):
        read_incidents(spark, str(tmp_path / "a.xlsx"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_incidents(spark, str(tmp_path / "missing.csv"))


def test_layers(spark, incidents_of, tmp_path):
    df = incidents_of([(i, 33 + i / 1000, -84.0, "a", "2024-01-01", 1) for i in range(700)])
    spots = spark.createDataFrame([(33.0, -84.0, "a", 7, 1.5)],
                                  "latitude double, longitude double, dominant_type string, incident_count long, weighted_score double")
    preds = spark.createDataFrame([(33.1, -84.1, "b", "text", 71.0)],
                                  "latitude double, longitude double, incident_type string, prediction string, likelihood double")
    layers = map_layers(df, spots, preds)
    counts = {r.layer: r["count"] for r in layers.groupBy("layer").count().collect()}
    assert counts["incident"] == 500 and counts["hotspot"] == 1 and counts["prediction"] == 1
    assert sample_incidents(df, 10).exceptAll(sample_incidents(df.repartition(7), 10)).isEmpty()
    for fmt in ("parquet", "json", "csv", "geojson"):
        write_layers(layers, str(tmp_path / fmt), fmt)
    with pytest.raises(ValueError):
        write_layers(layers, str(tmp_path / "x"), "html")
    feature = json.loads(geojson_features(layers.where("layer = 'prediction'")).first().value)
    assert feature["geometry"] == {"type": "Point", "coordinates": [-84.1, 33.1]}
    assert feature["properties"]["color"] == "red"


@pytest.mark.parametrize("text,want", [
    ("01/05/2024 11:30:00 PM", "2024-01-05 23:30:00"), ("2024-01-05T23:30:00.000", "2024-01-05 23:30:00"),
    ("2024-01-05T23:30:00Z", "2024-01-05 23:30:00"), ("2024-01-05T23:30", "2024-01-05 23:30:00"), ("2024/01/05", "2024-01-05 00:00:00"),
    ("05-Jan-2024", "2024-01-05 00:00:00"), ("20240105", "2024-01-05 00:00:00"), ("1/5/24", "2024-01-05 00:00:00"),
    ("1/5/2024 1:05 am", "2024-01-05 01:05:00"), ("2024/01/05 07:08", "2024-01-05 07:08:00"), ("2024-13-05", None), ("soon", None),
    ("January 5, 2024", "2024-01-05 00:00:00"), ("Sept. 5 2024 1:02 pm", "2024-09-05 13:02:00"), ("5 Jan 2024 23:30", "2024-01-05 23:30:00"),
    ("05-JAN-99", "1999-01-05 00:00:00"), ("2024-01-05T23:30:00.123456-05:30", "2024-01-06 05:00:00.123456"),
    ("2024-01-05 23:30 UTC", "2024-01-05 23:30:00"), ("2024-01-05 24:00", None), ("2024-01-05 10:60", None), ("1/5/2024 13:00 pm", None),
    ("2024-01-05 10:00:61", None), ("30 Feb 2024", None), ("5 Foo 2024", None), ("2024-01-05 trailing", None), ("", None), ("\x01", None)])
def test_common_date_layouts(spark, text, want):
    from hotspan.functions.parsing import to_timestamp_any
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(to_timestamp_any(F.col("t")).cast("string")).first()[0] == want


def test_incident_ids_are_reproducible(spark):
    rows = [("JA366925", 1.0, 2.0, "x", None), ("JA366926", 1.0, 2.0, None, "x"), ("JA366926", 1.0, 2.0, None, "x"), (None, 1.0, 2.0, "y", "z")]
    df = spark.createDataFrame(rows, "report_id string, latitude double, longitude double, incident_type string, note string")
    for data, key, distinct in ((df, "report_id", 3), (df.drop("report_id"), None, 3), (df.withColumn("m", F.create_map(F.lit("a"), F.lit(1))), None, 3)):
        ids = sorted(r[0] for r in normalize_incidents(data, id_col=key).select("incident_id").collect())
        again = sorted(r[0] for r in normalize_incidents(data.repartition(3), id_col=key).select("incident_id").collect())
        assert ids == again and len(ids) == 4 and len(set(ids)) == distinct


def test_integer_hours(spark):
    from hotspan.sources.normalize import ingest_report, normalize_incidents
    df = spark.createDataFrame([(1.0, 2.0, "x", 5), (1.0, 2.0, "x", 24), (1.0, 2.0, "x", None)], "latitude double, longitude double, incident_type string, hour int")
    assert [r.hour for r in normalize_incidents(df).orderBy("hour").collect()] == [None, None, 5]
    assert ingest_report(df).first().valid_hours == 1
