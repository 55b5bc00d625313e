"""Reliable cuts of lineage, and connected components of any graph."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for what has to outlive an executor: the session's ``spark.checkpoint.dir``.

    Where the session names none, a folder of our own is set on a local master; on a cluster, whose machines share no local folder, that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = os.path.join(tempfile.gettempdir(), "tessella-checkpoints")
        context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """``df`` stored reliably in the shared checkpoint folder, its lineage cut.

    The shuffle files of ``df`` are dropped as soon as it is stored.
    """
    conf = df.sparkSession.conf
    shared_folder(df.sparkSession)
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # a frame of its own: the setting is read when a frame is made
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def drop_cut(*frames: DataFrame) -> None:
    """Deletes the files of frames that cut() returned and that nothing will read again."""
    for df in frames:
        spark, file = df.sparkSession, df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int, int]:
    """cut(df), its number of rows, and a hash of all of them, both taken while it is stored."""
    seen = Observation()
    stored = cut(df.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("x")))
    return stored, seen.get["n"], seen.get["x"] or 0


def rooted(parents: DataFrame) -> DataFrame:
    """(id, component): the root that each id's parents lead to, of (id, parent) with one parent an id and no cycles.

    Every round doubles the steps that a pointer takes. Ids that are a parent only are not returned.
    """
    at, _, state = cut_counted(parents.select("id", F.col("parent").alias("component")))
    while True:
        further = at.select(F.col("id").alias("component"), F.col("component").alias("next"))
        past, before = at, state
        at, _, state = cut_counted(at.join(further, "component", "left").select("id", F.coalesce("next", "component").alias("component")))
        drop_cut(past)
        if state == before:
            return at


def components(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) of every vertex: the smallest id that links (a, b) reach.

    Alternates two contractions until nothing changes: every edge's larger end
    is hung under the smallest neighbour of the other, which halves the depth of
    chains each round; each round is cut from lineage. A vertex without links is
    its own component; null ids never link.
    """

    edges, *seen = cut_counted(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        # Larger neighbours of every vertex go under its smallest neighbour (or itself).
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        star = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = least.where("m < u").select("u", F.col("m").alias("v"))
        large = star.union(kept).where("u <> v").distinct()
        # Smaller neighbours go under the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        past, before = edges, seen
        edges, *seen = cut_counted(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        drop_cut(past)
        if seen == before:
            break
    roots = edges.groupBy("u").agg(F.min("v").alias("_root"))
    return vertices.select("id").join(roots, F.col("id") == F.col("u"), "left").select("id", F.coalesce("_root", "id").alias("component"))
