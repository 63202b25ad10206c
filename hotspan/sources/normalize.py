"""From a raw table with free column names to the normalised incident table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hotspan.functions.parsing import (MISSING_TOKENS, blank_to_null, chosen_hour, date_parts, hour_candidates, hour_counts, hour_parts,
                                       once, timestamp_of, to_double)
from hotspan.functions.temporal import calendar_columns
from hotspan.schema import INCIDENTS

# Name fragments that suggest a role, and fragments that rule it out.
ROLE_HINTS = {
    "latitude": (("lat",), ()),
    "longitude": (("lon",), ()),
    "incident_type": (("type", "crime", "offense", "category"), ()),
    "date": (("date", "occurred", "reported"), ()),
    "time": (("time", "hour"), ("datetime",)),
}
REQUIRED_ROLES = ("latitude", "longitude", "incident_type")

# Parsed rows that have a place.
GOOD = "_lat IS NOT NULL AND _lon IS NOT NULL"


def resolve_roles(columns: list[str]) -> dict[str, str]:
    """Guess which column plays which role from names alone; the first match wins and a column may fill several roles."""
    def fits(name: str, wanted: tuple, unwanted: tuple) -> bool:
        return any(w in name for w in wanted) and not any(u in name for u in unwanted)

    found = {role: next((c for c in columns if fits(c.lower(), *hints)), None) for role, hints in ROLE_HINTS.items()}
    return {role: column for role, column in found.items() if column is not None}


def _checked_roles(df: DataFrame, roles: dict[str, str] | None) -> dict[str, str]:
    roles = resolve_roles(df.columns) if roles is None else roles
    for role in REQUIRED_ROLES:
        if roles.get(role) not in df.columns:
            raise ValueError(f"no column for required role {role!r} (given: {roles.get(role)!r}); "
                             f"available columns: {df.columns}")
    return {role: column for role, column in roles.items() if column in df.columns}


def _field(df: DataFrame, roles: dict[str, str], role: str) -> tuple[Column | None, T.DataType | None]:
    name = roles.get(role)
    return (F.col(f"`{name}`"), df.schema[name].dataType) if name else (None, None)


def _parsed(df: DataFrame, roles: dict[str, str], *wanted: str) -> DataFrame:
    """The table with what its text columns hold, every text parsed once: _lat, _lon, _date (parts or timestamp) and
    _time (parts or hour)."""
    lat, lon = (to_double(_field(df, roles, role)[0]) for role in ("latitude", "longitude"))
    (date, date_kind), (time, time_kind) = _field(df, roles, "date"), _field(df, roles, "time")
    columns = {"_lat": lat, "_lon": lon}
    if date is not None and "date" in wanted:
        columns["_date"] = date_parts(date) if isinstance(date_kind, T.StringType) else date.try_cast("timestamp")
    if time is not None and "time" in wanted:
        if isinstance(time_kind, T.IntegralType):
            columns["_time"] = _whole_hour(time)
        elif isinstance(time_kind, (T.TimestampType, T.TimestampNTZType)):
            columns["_time"] = F.hour(time)
        else:
            columns["_time"] = hour_parts(time.cast("string"))
    return once(df, *[c.alias(name) for name, c in columns.items()])


def _timestamp(parsed: DataFrame) -> Column:
    if "_date" not in parsed.columns:
        return F.lit(None).cast("timestamp")
    return timestamp_of(F.col("_date")) if isinstance(parsed.schema["_date"].dataType, T.ArrayType) else F.col("_date")


def _hour_families(parsed: DataFrame) -> list[Column]:
    """Hour under each family of layouts; a typed column has one."""
    if "_time" not in parsed.columns:
        return [F.lit(None).cast("int")]
    return hour_candidates(F.col("_time")) if isinstance(parsed.schema["_time"].dataType, T.ArrayType) else [F.col("_time")]


def _hour(df: DataFrame, parsed: DataFrame, roles: dict[str, str], policy: str) -> Column:
    families = _hour_families(parsed)
    if policy not in ("row", "column"):
        raise ValueError(f"unknown policy {policy!r}: use 'column' or 'row'")
    if policy == "row" or len(families) == 1:
        return F.coalesce(*families)
    return chosen_hour(families, hour_counts(_parsed(df, roles, "time").where(GOOD), F.col("_time")))


def _whole_hour(column: Column) -> Column:
    """An integer from 0 to 23 as an hour, else NULL."""
    return F.when(column.between(0, 23), column.cast("int"))


def incident_key(df: DataFrame, id_col: str | None = None) -> Column:
    """A 64-bit id that is the same in every run and under every partitioning.

    Integer keys stay as they are. Other keys are hashed as text, and without a key the whole row is hashed, nulls
    told apart by their column. Rows with equal keys, or equal in all columns, share an id; such rows have one place, so
    no result depends on telling them apart. Two different keys among n share a hash by chance with probability n^2 / 2^65.
    """
    if id_col is None:
        nested = (T.ArrayType, T.MapType, T.StructType)
        columns = [F.col(f"`{f.name}`").cast("string") if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
                   for f in df.schema]
        return F.xxhash64(*[part for c in columns for part in (c, c.isNull())])
    key = F.col(f"`{id_col}`")
    return key.cast("long") if isinstance(df.schema[id_col].dataType, T.IntegralType) else F.xxhash64(key.cast("string"))


def normalize_incidents(df: DataFrame, roles: dict[str, str] | None = None, id_col: str | None = None,
                        time_policy: str = "column") -> DataFrame:
    """Typed incident table with the fixed schema; rows without usable coordinates are dropped.

    ``id_col`` is a unique key of any type; without one the row itself is the key, see ``incident_key``.
    """
    roles = _checked_roles(df, roles)
    kind = _field(df, roles, "incident_type")[0].cast("string")
    parsed = _parsed(df, roles, "date", "time")
    kept = once(parsed.where(GOOD), _timestamp(parsed).alias("_at")).select(
        incident_key(df, id_col).alias("incident_id"), F.col("_lat").alias("latitude"), F.col("_lon").alias("longitude"),
        F.when(~F.trim(kind).isin(*MISSING_TOKENS), kind).alias("incident_type"),
        F.col("_at").alias("occurred_at"), _hour(df, parsed, roles, time_policy).cast("int").alias("hour"))
    return calendar_columns(kept).select(*INCIDENTS.fieldNames())


def ingest_report(df: DataFrame, roles: dict[str, str] | None = None, damaged: str | None = None) -> DataFrame:
    """One row: rows read, dropped for bad coordinates, kept; of those with a valid date or hour, and with a text in the
    date or time column that is none; and records with a text in the column ``damaged`` that the reader made."""
    roles = _checked_roles(df if damaged is None else df.drop(damaged), roles)
    parsed, good = _parsed(df, roles, "date", "time"), F.expr(GOOD)
    families = _hour_families(parsed)
    hours = [F.count_if(good & h.isNotNull()).alias(f"_h{i}") for i, h in enumerate(families)]

    def filled(role: str) -> Column:
        column, _ = _field(df, roles, role)
        return F.count_if(good & blank_to_null(column).isNotNull()) if column is not None else F.lit(0)

    counted = parsed.agg(
        F.count(F.lit(1)).alias("rows_read"), F.count_if(~good).alias("rows_dropped"), F.count_if(good).alias("rows_kept"),
        F.count_if(good & _timestamp(parsed).isNotNull()).alias("valid_dates"), *hours,
        filled("date").alias("_dates"), filled("time").alias("_times"),
        F.count(F.lit(None) if damaged is None else F.col(f"`{damaged}`")).alias("damaged"))
    chosen = F.coalesce(*[F.when(F.col(f"_h{i}") > 0, F.col(f"_h{i}")) for i in range(len(families))], F.lit(0)).cast("long")
    return counted.select("rows_read", "rows_dropped", "rows_kept", "valid_dates", chosen.alias("valid_hours"),
                          (F.col("_dates") - F.col("valid_dates")).cast("long").alias("failed_dates"),
                          (F.col("_times") - chosen).cast("long").alias("failed_hours"), "damaged")


def require_rows(incidents: DataFrame) -> DataFrame:
    """The same table, or an error when no row survived cleaning. Runs one short job."""
    if incidents.isEmpty():
        raise ValueError("no valid rows remain after cleaning the coordinates")
    return incidents


def dataset_profile(df: DataFrame) -> DataFrame:
    """Record and column count."""
    return df.agg(F.count(F.lit(1)).alias("records")).withColumn("columns", F.lit(len(df.columns)))


def dated(incidents: DataFrame) -> DataFrame:
    """Rows with a date."""
    return incidents.where(F.col("occurred_at").isNotNull())
