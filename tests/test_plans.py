"""What the physical plans must and must not contain."""

import pytest

from checks import QUERIES
from checks.tables import inc_events, table
from hotspan.functions.parsing import DATE_FAMILIES
from hotspan.operators import distributions as D
from hotspan.operators import forecast as FC
from hotspan.operators import recency
from hotspan.sources.normalize import normalize_incidents

SF_DIR = "/root/testdata/sf0.001"
LAZY = sorted(n for n in QUERIES if not any(w in n for w in ("cluster", "hotspot", "layers")))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_python_rows_and_no_nested_loops(spark, name):
    text = plan(QUERIES[name][0](spark, SF_DIR))
    for word in ("Python", "CartesianProduct", "NestedLoop"):
        assert word not in text


def test_only_needed_columns_are_read(spark):
    text = plan(D.type_distribution(inc_events(spark, SF_DIR)))
    assert "ReadSchema: struct<event_type:string>" in text


def test_filters_reach_the_scan(spark):
    events = table(spark, SF_DIR, "events").selectExpr("event_id incident_id", "event_type incident_type").where("incident_type = 'click'")
    assert "EqualTo(event_type,click)" in plan(D.type_counts(events))


def test_recency_needs_one_aggregate_only(spark):
    text = plan(recency.recency_weight(inc_events(spark, SF_DIR)).select("incident_id", "recency_weight"))
    assert "Join" not in text and "Exchange hashpartitioning" not in text


def test_each_text_is_parsed_once(spark):
    """The pattern of a family of date layouts stands once in the plan, though filter and six columns build on the date."""
    rows = table(spark, SF_DIR, "events").selectExpr("'1' lat", "'2' lon", "event_type type", "props occurred")
    text = normalize_incidents(rows)._jdf.queryExecution().optimizedPlan().toString()
    for _, pattern, _ in DATE_FAMILIES:
        assert text.count(pattern) == 1


def test_forecast_shuffles_twice(spark):
    """Once to count (series, day) and once by series; all factors share the second."""
    text = plan(FC.forecast(inc_events(spark, SF_DIR), ["incident_type"]))
    assert text.count("Exchange hashpartitioning") == 2


def test_top_k_is_cut_before_the_shuffle(spark):
    text = plan(D.top_k_per_group(inc_events(spark, SF_DIR), ["incident_type"], "hour", 2))
    assert "WindowGroupLimit" in text
