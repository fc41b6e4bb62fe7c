"""Incremental feature computation: a fitted pipeline applied to a stream of rows.

Every block's transform is stateless once fitted, so a stream takes the batch plan. Spatial blocks must have a fixed
lat0 there, as the mean of a micro-batch would change the projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.plans.blocks import Pipeline


def rows_of(spark: SparkSession, folder: str, like: DataFrame, files_at_once: int = 64) -> DataFrame:
    """A stream of the Parquet files of a folder, with the schema of `like`."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def transformed_to(stream: DataFrame, fitted: Pipeline, to: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes the features of each micro-batch; a batch that is run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        fitted.transform(batch).write.mode("overwrite").parquet(f"{to}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window of event time and key; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
