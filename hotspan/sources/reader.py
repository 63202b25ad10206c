"""Scans over incident files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc"}


def read_incidents(spark: SparkSession, path: str, format: str | None = None,
                   schema: T.StructType | str | None = None, multiline: bool = False, damaged: str | None = None) -> DataFrame:
    """Read an incident file or folder; the format comes from the extension unless given.

    CSV is Latin-1 with a header row and stays splittable unless ``multiline`` is set for quoted line breaks.
    Without a schema every CSV column is text, which saves a second pass over the file; ``normalize_incidents``
    does the typing. A missing path or an unknown format is an error.

    ``damaged`` names a further column that holds the text of CSV and JSON records that cannot be read, CSV lines with
    too few or too many fields included, and NULL for others; ``ingest_report`` counts them. The other columns of a
    damaged record hold what could be read.
    """
    fmt = format or FORMATS.get(os.path.splitext(path.rstrip("/"))[1].lower())
    if fmt not in FORMATS.values():
        raise ValueError(f"unsupported format for {path!r}: use one of {sorted(FORMATS.values())}")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.options(header=True, encoding="ISO-8859-1", escape='"', multiLine=multiline)
    if damaged is not None and fmt in ("csv", "json"):
        if schema is None:
            schema = T.StructType([f for f in reader.load(path).schema if f.name != damaged])
        elif isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        schema = T.StructType([*schema.fields, T.StructField(damaged, T.StringType())])
        # A pruned CSV scan would count the fields of the columns in use only.
        reader = reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=damaged, columnPruning=False)
    if schema is not None:
        reader = reader.schema(schema)
    found = reader.load(path)
    return found if damaged is None or damaged in found.columns else found.withColumn(damaged, F.lit(None).cast("string"))
