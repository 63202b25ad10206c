"""Counts, shares, peaks and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotspan.functions.temporal import (SEASONS, TIME_PERIODS, month_name, quarter_label, season,
                                        time_period)
from hotspan.functions.tiers import bround


#: Column of a fact table: the incidents a row stands for.
STANDS_FOR = "_stands_for"


def fact_table(incidents: DataFrame) -> DataFrame:
    """Incidents counted by type, hour and day. Every operator that only counts takes it in place of the incidents.

    It has one row per type, hour and day, whatever the number of incidents, so many results are made from one scan.
    """
    return incidents.groupBy("incident_type", "hour", "day_of_week", "month", "quarter", "day_of_month", "year").agg(
        F.count(F.lit(1)).alias(STANDS_FOR))


def number_of(incidents: DataFrame, which: Column | None = None) -> Column:
    """Aggregate: rows of an incident table, or the incidents that the rows of a fact table stand for."""
    if STANDS_FOR not in incidents.columns:
        return F.count(F.lit(1)) if which is None else F.count_if(which)
    each = F.col(STANDS_FOR) if which is None else F.when(which, F.col(STANDS_FOR))
    return F.coalesce(F.sum(each), F.lit(0))


def summary(incidents: DataFrame) -> DataFrame:
    """Record count and number of distinct types."""
    return incidents.agg(number_of(incidents).alias("total_records"),
                         F.countDistinct("incident_type").alias("distinct_types"))


def geo_bounds(incidents: DataFrame) -> DataFrame:
    """Bounding box and mean centre."""
    return incidents.agg(
        F.min("latitude").alias("lat_min"), F.max("latitude").alias("lat_max"),
        F.min("longitude").alias("lon_min"), F.max("longitude").alias("lon_max"),
        F.avg("latitude").alias("center_lat"), F.avg("longitude").alias("center_lon"))


def percent_of(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent; an empty whole counts as 1."""
    return bround(part / F.greatest(whole, F.lit(1)) * 100, digits)


def with_share(counts: DataFrame, count: str = "count", out: str = "share", digits: int = 4) -> DataFrame:
    """Add each row's percentage of the column total."""
    total = counts.select(F.sum(count)).scalar()
    return counts.withColumn(out, percent_of(F.col(count), total, digits))


def type_counts(incidents: DataFrame) -> DataFrame:
    """Rows per known type."""
    return _counts(incidents, "incident_type")


def type_distribution(incidents: DataFrame) -> DataFrame:
    """Count and percentage per type; rows without a type stay in the denominator."""
    total = incidents.select(number_of(incidents)).scalar()
    return type_counts(incidents).withColumn("percentage", percent_of(F.col("count"), total))


def top_types(incidents: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent types; ties go to the smaller name."""
    return type_distribution(incidents).orderBy(F.desc("count"), "incident_type").limit(k)


def of_top_types(incidents: DataFrame, k: int = 5) -> DataFrame:
    """Only the incidents of the k most frequent types. The k-row list is what gets broadcast."""
    keep = type_counts(incidents).orderBy(F.desc("count"), "incident_type").limit(k).select("incident_type")
    return incidents.join(F.broadcast(keep), "incident_type", "left_semi")


def _counts(incidents: DataFrame, column: str) -> DataFrame:
    return incidents.where(F.col(column).isNotNull()).groupBy(column).agg(number_of(incidents).alias("count"))


def hourly_distribution(incidents: DataFrame) -> DataFrame:
    return _counts(incidents, "hour")


def daily_distribution(incidents: DataFrame) -> DataFrame:
    return _counts(incidents, "day_of_week")


def monthly_distribution(incidents: DataFrame) -> DataFrame:
    """Count per month number, with its short name."""
    return _counts(incidents, "month").withColumn("month_name", month_name(F.col("month")))


def _labelled(counts: DataFrame, label: str, labels: tuple[str, ...]) -> DataFrame:
    """Counts for every label of a fixed list, zero included, folded from at most len(labels) rows."""
    by_label = counts.agg(F.map_from_entries(F.collect_list(F.struct(label, "count"))).alias("m"))
    return by_label.select(F.posexplode(F.array(*[F.lit(x) for x in labels])).alias("ordinal", label), "m").select(
        label, "ordinal", F.coalesce(F.try_element_at("m", F.col(label)), F.lit(0)).alias("count"))


def time_periods(incidents: DataFrame) -> DataFrame:
    """Count and share for each part of the day, empty ones included."""
    counts = _counts(incidents.withColumn("time_period", time_period(F.col("hour"))), "time_period")
    return with_share(_labelled(counts, "time_period", TIME_PERIODS))


def season_comparison(incidents: DataFrame) -> DataFrame:
    """Count and share for each season, empty ones included."""
    counts = _counts(incidents.withColumn("season", season(F.col("month"))), "season")
    return with_share(_labelled(counts, "season", SEASONS))


def dominant(counts: DataFrame, label: str, order: str = "ordinal", count: str = "count") -> DataFrame:
    """One row: the label with the highest count, first in order on a tie; NULL when nothing was counted."""
    best = F.max_by(label, F.struct(F.col(count), -F.col(order)))
    return counts.agg(F.when(F.sum(count) > 0, best).alias(f"dominant_{label}"))


def dominant_time_period(incidents: DataFrame) -> DataFrame:
    return dominant(time_periods(incidents), "time_period")


def dominant_season(incidents: DataFrame) -> DataFrame:
    return dominant(season_comparison(incidents), "season")


def seasonal_distribution(incidents: DataFrame) -> DataFrame:
    """Monthly and quarterly counts from one scan: (section, key, ordinal, count)."""
    grouped = incidents.where(F.col("month").isNotNull()).groupingSets(
        [[F.col("month")], [F.col("quarter")]], F.col("month"), F.col("quarter")
    ).agg(F.grouping("month").alias("_by_quarter"), number_of(incidents).alias("count"))
    by_quarter = F.col("_by_quarter") == 1
    return grouped.select(
        F.when(by_quarter, "quarter").otherwise("month").alias("section"),
        F.when(by_quarter, quarter_label(F.col("quarter"))).otherwise(month_name(F.col("month"))).alias("key"),
        F.when(by_quarter, F.col("quarter")).otherwise(F.col("month")).alias("ordinal"), "count")


def peak_quarter(incidents: DataFrame) -> DataFrame:
    """Quarter with the most incidents, the earlier one on a tie."""
    return _counts(incidents, "quarter").agg(
        quarter_label(F.max_by("quarter", F.struct("count", -F.col("quarter")))).alias("peak_quarter"))


def peaks(incidents: DataFrame, column: str, k: int = 3) -> DataFrame:
    """The k most frequent values of a column, ranked."""
    best = _counts(incidents, column).orderBy(F.desc("count"), column).limit(k)
    ranked = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), F.col(column)))).alias("a"))
    return ranked.select(F.posexplode("a").alias("rank", "s")).select(
        (F.col("rank") + 1).alias("rank"), F.col(f"s.{column}").alias(column), (-F.col("s.c")).alias("count"))


def top_k_per_group(incidents: DataFrame, keys: list[str], column: str, k: int) -> DataFrame:
    """The k most frequent values of a column within each group.

    Rows are counted first, so a group reaches the window as one row per distinct value, and the rank filter
    is applied before that shuffle as well.
    """
    counts = incidents.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(number_of(incidents).alias("count"))
    return rank_within(counts, keys, column, k)


def rank_within(counts: DataFrame, keys: list[str], column: str, k: int, count: str = "count") -> DataFrame:
    """Keep the k best rows of each group of an already counted table."""
    order = Window.partitionBy(*keys).orderBy(F.desc(count), F.col(column))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_list(ranked: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """Collect at most k ranked rows per group into an array in rank order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("rank").alias("r"), value.alias("v"))))
    return ranked.groupBy(*keys).agg(F.transform(pairs, lambda p: p["v"]).alias(out))


# The marginals of the shared cube: name -> grouping columns.
CUBE_SETS = {
    "hour": ["hour"], "day_of_week": ["day_of_week"], "month": ["month"], "quarter": ["quarter"],
    "season": ["season"], "time_period": ["time_period"], "incident_type": ["incident_type"],
    "incident_type,hour": ["incident_type", "hour"], "incident_type,day_of_week": ["incident_type", "day_of_week"],
}


def incident_cube(incidents: DataFrame, sets: dict[str, list[str]] | None = None) -> DataFrame:
    """All requested marginals from one scan: (marginal, the grouping columns, count).

    The rows are first counted per full combination, which is small and independent of the row count, so the
    grouping-set expansion multiplies that table and not the incidents.
    """
    sets = CUBE_SETS if sets is None else sets
    columns = sorted({c for group in sets.values() for c in group})
    derived = incidents.withColumns({
        "season": season(F.col("month")), "time_period": time_period(F.col("hour"))})
    base = derived.groupBy(*columns).agg(number_of(incidents).alias("_n"))
    cube = base.groupingSets([[F.col(c) for c in group] for group in sets.values()], *[F.col(c) for c in columns]).agg(
        *[F.grouping(c).alias(f"_g_{c}") for c in columns], F.sum("_n").alias("count"))
    name, complete = F.lit(None).cast("string"), F.lit(False)
    for label, group in sets.items():
        here = F.lit(True)
        for c in columns:
            here = here & (F.col(f"_g_{c}") == (0 if c in group else 1))
        known = F.lit(True)
        for c in group:
            known = known & F.col(c).isNotNull()
        name, complete = F.when(here, label).otherwise(name), complete | (here & known)
    return cube.where(complete).select(name.alias("marginal"), *columns, "count")
