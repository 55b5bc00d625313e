"""Incremental work as structured streams: new files once, windows over events, edits into a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def new_files(spark: SparkSession, folder: str, schema: StructType, per_batch: int = 1000) -> DataFrame:
    """A stream of the rows of Parquet files, each file once; the checkpoint remembers them."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def drain(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs ``work`` over all that is new and stops; a second call does what has come since."""
    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed(events: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Counts and sums by window and type, for streams and tables alike; rows later than ``late`` are dropped in streams."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return own.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Sessions of users: events no farther apart than a gap."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return own.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def resumed(done: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks still to do: all that are not done; ones that failed come again."""
    return blocks.join(done.select("name"), "name", "left_anti")
