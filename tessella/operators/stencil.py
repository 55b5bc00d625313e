"""Neighbourhoods on rasters in long form.

Sparse masks (rows are the pixels that are set) are spread by small offset tables;
rectangular neighbourhoods of dense rasters are two passes of window frames, along
rows and along columns. Beyond the raster there is nothing: borders never erode.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

Offsets = list[tuple[int, int]]


def ellipse(k: int) -> Offsets:
    """Offsets of a k x k elliptic kernel: in each row, as far out as the ellipse through the borders reaches."""
    half = k // 2
    reach = {dy: round(half * math.sqrt(1 - dy * dy / (half * half))) if half else 0 for dy in range(-half, half + 1)}
    return [(dy, dx) for dy, wide in reach.items() for dx in range(-wide, wide + 1)]


def square(k: int) -> Offsets:
    half = k // 2
    return [(dy, dx) for dy in range(-half, half + 1) for dx in range(-half, half + 1)]


def _spread(mask: DataFrame, offsets: Offsets, height: int, width: int) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])
    moved = mask.withColumn("_s", F.explode(steps)).withColumn("r", F.col("r") + F.col("_s.dy")).withColumn("c", F.col("c") + F.col("_s.dx")).drop("_s")
    return moved.where(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1))


def dilate(mask: DataFrame, offsets: Offsets, height: int, width: int) -> DataFrame:
    return _spread(mask.select("r", "c"), offsets, height, width).distinct()


def erode(mask: DataFrame, offsets: Offsets, height: int, width: int) -> DataFrame:
    """Pixels whose kernel lies in the mask as far as it lies in the raster."""
    inside = F.lit(0)
    for dy, dx in offsets:
        inside = inside + ((F.col("r") + dy).between(0, height - 1) & (F.col("c") + dx).between(0, width - 1)).cast("int")
    hits = _spread(mask.select("r", "c"), [(-dy, -dx) for dy, dx in offsets], height, width).groupBy("r", "c").agg(F.count("*").alias("n"))
    return hits.where(F.col("n") == inside).select("r", "c")


def open_close(mask: DataFrame, opening: int, closing: int, height: int, width: int) -> DataFrame:
    """Opening, then closing, with elliptic kernels."""
    opened = dilate(erode(mask, ellipse(opening), height, width), ellipse(opening), height, width)
    return erode(dilate(opened, ellipse(closing), height, width), ellipse(closing), height, width)


def claimed_once(labels: DataFrame, offsets: Offsets, height: int, width: int) -> DataFrame:
    """(r, c, label): labelled regions grown by a kernel, without the pixels that two claim."""
    grown = _spread(labels.select("r", "c", "label"), offsets, height, width).distinct()
    return grown.groupBy("r", "c").agg(F.min("label").alias("label"), F.count("*").alias("n")).where("n = 1").select("r", "c", "label")


def box(pixels: DataFrame, k: int, out: str, combine, value: Column) -> DataFrame:
    """A separable aggregate over (2k+1) x (2k+1) boxes of a dense raster: ``combine`` is F.max, F.min or F.sum."""
    across = Window.partitionBy("r").orderBy("c").rangeBetween(-k, k)
    down = Window.partitionBy("c").orderBy("r").rangeBetween(-k, k)
    return pixels.withColumn("_row", combine(value).over(across)).withColumn(out, combine(F.col("_row")).over(down)).drop("_row")


def kernel_max(pixels: DataFrame, offsets: Offsets, out: str, value: Column) -> DataFrame:
    """Adds the largest value under a kernel that is one run in each of its rows, as ellipses are, on a dense raster.

    Runs of one length share a window along the row; the kernel's rows are then met down the columns, so nothing is exploded.
    """
    runs = {dy: max(dx for y, dx in offsets if y == dy) for dy, _ in offsets}
    across = Window.partitionBy("r").orderBy("c")
    wide = pixels.select("*", *[F.max(value).over(across.rangeBetween(-k, k)).alias(f"_run{k}") for k in sorted(set(runs.values()))])
    down = Window.partitionBy("c").orderBy("r")
    return wide.withColumn(out, F.greatest(*[F.max(f"_run{k}").over(down.rangeBetween(dy, dy)) for dy, k in runs.items()])).select(*pixels.columns, out)


def box_mean_std(pixels: DataFrame, value: str, k: int, least: int) -> DataFrame:
    """Adds mean and std over the known (not null) values of each box; null where there are fewer than ``least``."""
    v = F.col(value).cast("double")
    sums = pixels
    for name, x in (("_n", v.isNotNull().cast("int")), ("_s", F.coalesce(v, F.lit(0.0))), ("_q", F.coalesce(v * v, F.lit(0.0)))):
        sums = box(sums, k, name, F.sum, x)
    mean = F.col("_s") / F.col("_n")
    spread = F.sqrt(F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0)))
    enough = F.col("_n") >= least
    return sums.withColumn("mean", F.when(enough, mean)).withColumn("std", F.when(enough, spread)).drop("_n", "_s", "_q")


def reflected(pixels: DataFrame, k: int, height: int, width: int) -> DataFrame:
    """The raster with k mirrored rows and columns beyond each border (the border itself is not repeated)."""

    def mirrored(df: DataFrame, axis: str, size: int) -> DataFrame:
        v = F.col(axis)
        copies = F.array_distinct(F.array_compact(F.array(v, F.when(v.between(1, k), -v), F.when(v.between(size - 1 - k, size - 2), 2 * (size - 1) - v))))
        return df.withColumn(axis, F.explode(copies))

    return mirrored(mirrored(pixels, "r", height), "c", width)


def weighted(pixels: DataFrame, weights: dict[tuple[int, int], float], value: str, out: str) -> DataFrame:
    """Correlation of a dense raster with a small kernel; what lies beyond the raster counts as 0."""
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(float(w)).alias("w")) for (dy, dx), w in weights.items()])
    spread = pixels.withColumn("s", F.explode(steps))
    moved = spread.select((F.col("r") - F.col("s.dy")).alias("r"), (F.col("c") - F.col("s.dx")).alias("c"), (F.col(value) * F.col("s.w")).alias("v"))
    return pixels.join(moved.groupBy("r", "c").agg(F.sum("v").alias(out)), ["r", "c"], "left")


def distance_within(pixels: DataFrame, sources: DataFrame, radius: int) -> DataFrame:
    """(r, c, d2): squared distance of every pixel to the nearest source within ``radius``; null beyond.

    Exact: sources are spread over the disc, and the least distance of a pixel stays.
    """
    disc = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in disc])
    spread = sources.withColumn("s", F.explode(steps)).select((F.col("r") + F.col("s.dy")).alias("r"), (F.col("c") + F.col("s.dx")).alias("c"), (F.col("s.dy") * F.col("s.dy") + F.col("s.dx") * F.col("s.dx")).alias("d2"))
    return pixels.select("r", "c").join(spread.groupBy("r", "c").agg(F.min("d2").alias("d2")), ["r", "c"], "left")


def nearest_class(pixels: DataFrame, seeds: DataFrame, radius: int) -> DataFrame:
    """(r, c, d2, cls): the class of the nearest seed within ``radius``; the smallest class wins ties."""
    disc = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in disc])
    spread = seeds.withColumn("s", F.explode(steps)).select((F.col("r") + F.col("s.dy")).alias("r"), (F.col("c") + F.col("s.dx")).alias("c"), F.struct((F.col("s.dy") * F.col("s.dy") + F.col("s.dx") * F.col("s.dx")).alias("d2"), "cls").alias("near"))
    best = spread.groupBy("r", "c").agg(F.min("near").alias("near"))
    return pixels.select("r", "c").join(best, ["r", "c"], "left").select("r", "c", "near.d2", "near.cls")


def geodesic_growth(seeds: DataFrame, limit: DataFrame, most: int, height: int, width: int, step: Offsets | None = None) -> DataFrame:
    """Seeds grown by steps (3 x 3 by default) within ``limit``, ``most`` steps at most; stops when nothing is added.

    Each round only spreads what the last one added, and is cut from lineage.
    """
    grown = front = cut(seeds.select("r", "c").distinct())
    for _ in range(most):
        front = cut(dilate(front, step or square(3), height, width).join(limit.select("r", "c"), ["r", "c"], "left_semi").join(grown, ["r", "c"], "left_anti"))
        if front.isEmpty():
            break
        grown = grown.union(front)
    return grown


def best_window(mask: DataFrame, height: int, width: int, size_r: int, size_c: int) -> DataFrame:
    """(r, c, n): the placement of a window with the most set pixels; the first in reading order wins ties.

    Each set pixel votes for the placements that hold it along its row; votes then run down the columns.
    """
    across = mask.select("r", F.explode(F.sequence(F.greatest(F.lit(0), F.col("c") - size_c + 1).cast("int"), F.least(F.col("c"), F.lit(width - size_c)).cast("int"))).alias("c")).groupBy("r", "c").agg(F.count("*").alias("n"))
    down = across.select(F.explode(F.sequence(F.greatest(F.lit(0), F.col("r") - size_r + 1).cast("int"), F.least(F.col("r"), F.lit(height - size_r)).cast("int"))).alias("r"), "c", "n")
    votes = down.groupBy("r", "c").agg(F.sum("n").alias("n"))
    return votes.orderBy(F.desc("n"), "r", "c").limit(1)
