"""Append-only logs as streams.

Rules of ours: event time is ``ts``; rows later than the watermark are dropped;
windows are tumbling.  ``available_now`` runs a stream over what is there and
returns its table, which equals the batch result as long as nothing is late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import USAGE_SCHEMA, shared_folder

STATUS_SCHEMA = "ts timestamp, slug string, pipeline string, model string, status string, f1 double"


def usage_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(USAGE_SCHEMA).option("maxFilesPerTrigger", 16).json(path).where("ts is not null")


def running_tokens(rows: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Token totals per key and window."""
    sums = rows.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "api_key").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.count("*").alias("calls"))
    return sums.select(F.col("w.start").alias("started"), "api_key", "prompt_tokens", "completion_tokens", "calls")


def attributed(rows: DataFrame, tasks: DataFrame, late: str = "10 minutes", bucket_s: int = 3600) -> DataFrame:
    """Log rows with the task in whose window [started, ended) of their key they fall; ``tasks`` is a static table.

    A window stands in each time bucket that it touches, so that rows of a hot
    key meet it by (key, bucket) and are spread over the key's buckets.
    """
    bucket = lambda c: F.floor(F.unix_timestamp(c) / bucket_s)
    spread = tasks.withColumn("bucket", F.explode(F.sequence(bucket("started"), bucket("ended"))))
    marked = rows.withWatermark("ts", late).withColumn("bucket", bucket("ts")).withColumnRenamed("api_key", "key")
    return marked.join(spread, ["key", "bucket"]).where("ts >= started and ts < ended").select("task_id", "ts", F.col("key").alias("api_key"), "prompt_tokens")


def available_now(stream: DataFrame, name: str) -> DataFrame:
    """What an append-mode stream yields over all files that are there, through a Parquet sink."""
    spark = stream.sparkSession
    path = shared_folder(spark, name)
    run = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
