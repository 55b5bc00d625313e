"""Helpers that the training-data operators share."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import components, cut, cut_counted, drop_cut, rooted

__all__ = ["components", "cut", "drop_cut", "rooted"]
#: Rows of ids that may be sent to every executor; larger sides are joined by a shuffle.
MOST_SENT = 2_000_000
#: ASCII white space, as the operators' contracts spell it.
SPACE = "\\x20\\x09-\\x0D"
#: One word.
WORD = f"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it differ from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mark(text: Column) -> Column:
    """Tells the texts of rows that share an id apart."""
    return F.xxhash64(text)


def without(docs: DataFrame, gone: DataFrame, twice: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but those in ``gone`` (id, mark), and one row of each (id, mark) in ``twice``."""
    own, other = unused(docs, "mark"), unused(docs, "mark_id")
    marked = docs.withColumn(own, mark(whole_text(text_col)))
    met = lambda side: (F.col(id_col) == F.col(other)) & (F.col(own) == F.col(f"{own}_2"))
    side = lambda df: sendable(df.toDF(other, f"{own}_2"))
    left = marked.join(side(gone), met(gone), "left_anti")
    twice = cut(twice)
    if not twice.isEmpty():
        once = left.join(side(twice), met(twice), "left_semi").dropDuplicates([id_col, own])
        left = left.join(side(twice), met(twice), "left_anti").union(once)
    return left.select(docs.columns)


def sendable(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """``df``, of a few fixed-width columns, cut from lineage; marked for broadcast if it has at most ``most`` rows.

    With more rows, the join that it is the side of shuffles both sides.
    """
    df, n, _ = cut_counted(df)
    return F.broadcast(df) if n <= most else df


def scratch(spark: SparkSession) -> str:
    """A new folder among the shared checkpoint files, for tables that an operator drops again."""
    cut(spark.range(0))  # makes sure that the folder is known
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tables-{uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_sums(df: DataFrame, keys: list[str], order: list[str], **sums: str) -> DataFrame:
    """Adds, for each ``out=value``, the sum of ``value`` over the rows before a row among those of its keys.

    No key is gathered in one task: rows are range-sorted by (keys, order), summed
    in each range, and each range starts from the sum of those before it. ``order``
    must not tie within keys where the split of a tie matters. The ranges are cut
    from lineage, so that every later read sees the same ones. Empty input: empty.
    """
    spark = df.sparkSession
    p = unused(df, "_r")  # before the names of all columns that are added and go again
    while any(c.lower().startswith(p) for c in df.columns):
        p = f"_{p}"
    by = [F.col(c) for c in (*keys, *order)]
    ranged = cut(df.repartitionByRange(partitions(spark), *by).withColumn(p, F.spark_partition_id()))
    inside = Window.partitionBy(p, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*[F.col(f"{p}_k{i}") for i in range(len(keys))] or [F.lit(0)]).orderBy(f"{p}_r").rowsBetween(Window.unboundedPreceding, -1)
    # At most a row for each range and key: ranges hold whole runs of keys.
    starts = ranged.groupBy(F.col(p).alias(f"{p}_r"), *[F.col(k).alias(f"{p}_k{i}") for i, k in enumerate(keys)]).agg(*[F.sum(v).alias(f"{p}_s_{out}") for out, v in sums.items()])
    starts = starts.select(f"{p}_r", *[f"{p}_k{i}" for i in range(len(keys))], *[F.coalesce(F.sum(f"{p}_s_{out}").over(before), F.lit(0)).alias(f"{p}_b_{out}") for out in sums])
    same = F.col(p) == F.col(f"{p}_r")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"{p}_k{i}"))
    summed = ranged.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"{p}_i_{out}") for out, v in sums.items()])
    return summed.join(starts, same, "left").select(*df.columns, *[(F.col(f"{p}_i_{out}") + F.col(f"{p}_b_{out}")).cast("long").alias(out) for out in sums])


def pieces(batches, limit: int = 1 << 21):
    """(first column's values, texts) of Arrow batches, as slices() deals them; null texts are empty."""
    for part in slices(batches, limit):
        yield part.column(0), [t or "" for t in part.column(1).to_pylist()]


def slices(batches, limit: int, rows: int = 4096):
    """Arrow batches with a bounded number of rows and of bytes in their second column; a single longer value comes alone."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            base = total[start - 1] if start else 0
            end = min(start + rows, max(start + 1, int(np.searchsorted(total, base + limit, "right"))))
            yield batch.slice(start, end - start)
            start = end
    tidy()


def tidy() -> None:
    """Gives the memory that a worker has freed back to the system: workers stay, and share their executor's limit."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass
