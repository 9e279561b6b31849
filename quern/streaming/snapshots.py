"""A stream of job-status snapshots (JSON Lines files in a folder): the polling loop's Spark counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import snapshots_schema

# Statuses after which a job does not change any more (in lower case), and those of them that are good.
GOOD = ("success", "succeeded")
TERMINAL = (*GOOD, "failed", "failed_validation", "cancelled", "canceled")


def read(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(snapshots_schema()).option("maxFilesPerTrigger", files_per_trigger).json(path)


def transitions(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each job's statuses, once each, with whether they are final; state is kept for ``late`` of event time."""
    named = stream.select(F.col("captured_at").try_cast("timestamp").alias("at"), "job_id", F.lower("status").alias("status")).where("at is not null")
    once = named.withWatermark("at", late).dropDuplicatesWithinWatermark(["job_id", "status"])
    return once.withColumn("final", F.col("status").isin(*TERMINAL))


def per_window(stream: DataFrame, length: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """How many snapshots of each status each window of event time has."""
    named = stream.select(F.col("captured_at").try_cast("timestamp").alias("at"), F.lower("status").alias("status")).where("at is not null")
    return named.withWatermark("at", late).groupBy(F.window("at", length), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "status", "n")


def write(df: DataFrame, path: str, checkpoint: str):
    """Append to Parquet, taking all that is there now and then stopping."""
    return df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
