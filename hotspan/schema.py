"""The normalised incident table. Optional roles are always-present nullable columns."""

from pyspark.sql import types as T

INCIDENTS = T.StructType([
    T.StructField("incident_id", T.LongType(), False),
    T.StructField("latitude", T.DoubleType(), False),
    T.StructField("longitude", T.DoubleType(), False),
    T.StructField("incident_type", T.StringType()),
    T.StructField("occurred_at", T.TimestampType()),
    T.StructField("day_of_week", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("quarter", T.IntegerType()),
    T.StructField("day_of_month", T.IntegerType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("hour", T.IntegerType()),
])
