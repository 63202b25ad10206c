"""Tables written once to the shared checkpoint folder, so that lineage stays short and a lost executor costs a re-read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Whether shuffle files go as soon as their query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir`` or set on the context. Only a local session may fall back to a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def write_once(df: DataFrame) -> DataFrame:
    """Run the plan now, keep the rows as Parquet in the shared folder and read them from there.

    The shuffle files of the run are of no further use once the table is there, so Spark is told to drop them at its end.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/hotspan-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def write_measured(df: DataFrame, measure: Column | None = None) -> tuple[DataFrame, int]:
    """``write_once`` plus one number observed on the way, by default the row count, without a second job.

    A retried stage may report more than the table holds, never less, so use it as an upper bound or to test for zero.
    """
    seen = Observation()
    value = F.count(F.lit(1)) if measure is None else measure
    table = write_once(df.observe(seen, F.coalesce(value, F.lit(0)).alias("value")))
    return table, seen.get.get("value", 0)


def spread_out(df: DataFrame) -> DataFrame:
    """Even partitions, at least one per core, ahead of a step that does much work per row on a compact table."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
