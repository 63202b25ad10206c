import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from hotspan.session import local_session
    session = local_session()
    yield session
    session.stop()


@pytest.fixture(scope="session")
def incidents_of(spark):
    """Build a normalised incident table from (id, lat, lon, type, timestamp text, hour) tuples."""
    from pyspark.sql import functions as F

    from hotspan.functions.temporal import calendar_columns
    from hotspan.schema import INCIDENTS

    def build(rows):
        raw = spark.createDataFrame(
            rows, "incident_id long, latitude double, longitude double, incident_type string, at string, hour int")
        typed = raw.withColumn("occurred_at", F.col("at").cast("timestamp"))
        return calendar_columns(typed).select(*INCIDENTS.fieldNames())
    return build
