"""Windowed aggregates over streams: watermark, checkpointed state, exactly-once Parquet output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir


def tumbling_counts(spark: SparkSession, path: str, time: str, key: str, size: str, late: str = "10 minutes") -> DataFrame:
    """(key, start, n) per window from the files of ``path`` read as a stream.

    State is bounded by the watermark in a continuous run; here the available files are processed and the stream
    ends, in complete mode, so that the last windows are emitted too.
    """
    run = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    folder, _, file = path.rstrip("/").rpartition("/")
    rows = spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder).withColumn(time, F.col(time).cast("timestamp"))
    counts = rows.withWatermark(time, late).groupBy(key, F.window(time, size).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")
    keep = lambda batch, _: batch.withColumn("start", F.col("start").cast(schema[time].dataType)).write.mode("overwrite").parquet(f"{run}/out")
    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{run}/out")


def deduplicated(stream: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
