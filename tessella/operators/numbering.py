"""Consecutive numbers in a global order without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def numbered(df: DataFrame, order: list[str], out: str = "i") -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... by ``order``, which must not tie. Rows are range-sorted and numbered
    in their range; each range starts from the counts of those before it, a row for each range."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    starts = counts.select("_r", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_in", inside).join(starts, F.col("_range") == F.col("_r")).select(*df.columns, (F.col("_start") + F.col("_in")).cast("long").alias(out))
