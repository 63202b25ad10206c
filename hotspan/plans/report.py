"""The analysis report as a tidy table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotspan.functions.tiers import bround
from hotspan.operators.distributions import summary, top_types
from hotspan.operators.predictions import prediction_table


def _rows(df: DataFrame, section: str, *pairs: tuple[Column, Column]) -> DataFrame:
    """Rows (section, ordinal, label, value) from label and value columns of a frame with an ``ordinal`` column."""
    entries = F.array(*[F.struct(label.alias("label"), value.cast("string").alias("value")) for label, value in pairs])
    return df.select(F.lit(section).alias("section"), F.col("ordinal").alias("_o"), F.posexplode(entries)).select(
        "section", (F.col("_o") * len(pairs) + F.col("pos")).cast("long").alias("ordinal"), "col.label", "col.value")


def analysis_report(incidents: DataFrame, predictions: DataFrame, k: int = 5, responses: DataFrame | None = None) -> DataFrame:
    """(section, ordinal, label, value): totals, the k top types, every prediction with its number, and every raw response.

    Predictions of a table of responses are numbered within their response, which the label then names.
    """
    totals = _rows(summary(incidents).withColumn("ordinal", F.lit(0)), "summary",
                   (F.lit("total_records"), F.col("total_records")), (F.lit("distinct_types"), F.col("distinct_types")))
    by_count = Window.partitionBy(F.lit("top")).orderBy(F.desc("count"), "incident_type")  # k rows only
    types = _rows(top_types(incidents, k).withColumn("ordinal", F.row_number().over(by_count) - 1), "top_types",
                  (F.col("incident_type"),
                   F.concat(F.col("count").cast("string"), F.lit(" ("), F.col("percentage").cast("string"), F.lit("%)"))))
    numbered = prediction_table(predictions).withColumn("ordinal", F.col("number") - 1)
    name = F.concat(F.lit("Prediction #"), F.concat_ws(".", F.col("response_id").cast("string"), F.col("number").cast("string")))

    def part(label: str) -> Column:
        return F.concat(name, F.lit(f" {label}"))

    place = F.concat(F.lit("("), bround(F.col("latitude"), 4).cast("string"), F.lit(", "),
                     bround(F.col("longitude"), 4).cast("string"), F.lit(")"))
    expected = _rows(numbered, "predictions", (part("location"), place), (part("type"), F.col("incident_type")),
                     (part("likelihood"), F.concat(F.col("likelihood").cast("string"), F.lit("%"))),
                     (part("analysis"), F.col("prediction")))
    report = totals.unionByName(types).unionByName(expected)
    if responses is None:
        return report
    raw = responses.select(F.lit("raw_output").alias("section"), F.lit(0).cast("long").alias("ordinal"),
                           F.concat(F.lit("Response #"), F.coalesce(F.col("response_id").cast("string"), F.lit("-"))).alias("label"),
                           F.col("raw").alias("value"))
    return report.unionByName(raw)


# The sections of the report in their order.
SECTIONS = ("summary", "top_types", "predictions", "raw_output")


def write_report(report: DataFrame, path: str, mode: str = "error") -> None:
    """Write a report as text, one line per entry, ordered by section, response and ordinal across the files."""
    section = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
    line = F.concat_ws("\t", "section", "label", F.regexp_replace(F.coalesce("value", F.lit("")), r"\R", " "))
    rows = report.select(section.alias("s"), "ordinal", "label", line.alias("line"))
    rows.orderBy("s", F.regexp_extract("label", r"#([^ ]*)", 1), "ordinal", "label").select("line").write.mode(mode).text(path)
