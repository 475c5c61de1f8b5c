"""Results as they come: an idempotent log, and roll-ups over event time. An addition; batch operators do not need it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(stream: DataFrame, time: str, *by: str, window: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """(start, by..., n, mean): per window and group; rows later than ``late`` are left out of closed windows. None: the stream has a watermark already."""
    return (stream if late is None else stream.withWatermark(time, late)).groupBy(F.window(time, window).alias("w"), *by).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), *by, "n", "mean")


def once(stream: DataFrame, key: str, time: str, late: str = "2 hours") -> DataFrame:
    """Rows delivered again within ``late`` are dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch to a table; a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unfinished(tasks: DataFrame, results: DataFrame) -> DataFrame:
    return tasks.join(results.where("error_type is null").select("task_id"), "task_id", "left_anti")
