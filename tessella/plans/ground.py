"""Objects out, ground in: shadows grown and lifted, holes filled, tones matched; edits of masks and their log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import luma
from ..operators import records, regions, stencil


def lifted_shadows(pixels: DataFrame, known: DataFrame, k: int, ratio: float) -> DataFrame:
    """Bands of known, dark pixels scaled up to what is around: to the largest luma in an ellipse 2k+1 wide, known or not, 1 to 3 times."""
    y = pixels.withColumn("y", luma(F.col("red"), F.col("green"), F.col("blue"))).join(known.select("r", "c", F.lit(True).alias("known")), ["r", "c"], "left")
    near = stencil.kernel_max(y, stencil.ellipse(2 * k + 1), "top", F.col("y"))
    dark = F.col("known") & (F.col("y") < ratio * F.greatest("top", F.lit(1.0))) & (F.col("y") >= 3)
    scale = F.when(dark, F.least(F.greatest(F.col("top") / F.greatest("y", F.lit(1.0)), F.lit(1.0)), F.lit(3.0))).otherwise(1.0)
    fit = lambda c: F.least(F.col(c) * scale, F.lit(255.0)).cast("int").alias(c)
    return near.select("r", "c", *map(fit, ("red", "green", "blue")))


def filled(pixels: DataFrame, mask: DataFrame, radius: int, bands: tuple[str, ...] = ("red", "green", "blue")) -> DataFrame:
    """Masked pixels take the nearest unmasked ones' values within ``radius`` (first in reading order at equal distance), else the mean of all ground."""
    ground = pixels.join(mask.select("r", "c"), ["r", "c"], "left_anti")
    disc = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if 0 < dy * dy + dx * dx <= radius * radius]
    steps = F.array(*[F.struct(F.lit(dy * dy + dx * dx).alias("d2"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in disc])
    asked = mask.select("r", "c").withColumn("s", F.explode(steps)).select(F.col("r").alias("hr"), F.col("c").alias("hc"), (F.col("r") + F.col("s.dy")).alias("r"), (F.col("c") + F.col("s.dx")).alias("c"), F.col("s.d2").alias("d2"))
    best = asked.join(ground, ["r", "c"]).groupBy("hr", "hc").agg(F.min_by(F.struct(*bands), F.struct("d2", "r", "c")).alias("v"))
    mean = ground.agg(*[F.avg(b).cast("int").alias(f"_{b}") for b in bands])
    out = pixels.join(mask.select("r", "c", F.lit(True).alias("hole")), ["r", "c"], "left").join(best, (F.col("r") == F.col("hr")) & (F.col("c") == F.col("hc")), "left").crossJoin(F.broadcast(mean))
    return out.select("r", "c", *[F.when(F.col("hole"), F.coalesce(F.col(f"v.{b}"), F.col(f"_{b}"))).otherwise(F.col(b)).alias(b) for b in bands])


def relit(pixels: DataFrame, mask: DataFrame, k: int, least: float, enough: int = 8) -> DataFrame:
    """Masked pixels that came out too dark, scaled to 0.92 of the unmasked mean around them, 1 to 3.5 times; the median of all where too few are near."""
    y = pixels.withColumn("y", luma(F.col("red"), F.col("green"), F.col("blue"))).join(mask.select("r", "c", F.lit(True).alias("hole")), ["r", "c"], "left")
    free = F.when(F.col("hole").isNull(), F.col("y"))
    sums = stencil.box(stencil.box(y, k, "n", F.sum, free.isNotNull().cast("int")), k, "s", F.sum, F.coalesce(free, F.lit(0.0)))
    whole = y.where("hole is null").agg(F.median("y").alias("m"))
    local = F.when(F.col("n") > enough, F.col("s") / F.col("n")).otherwise(F.col("m"))
    dark = F.col("hole") & (F.col("y") < least * local) & (F.col("y") > 1)
    scale = F.when(dark, F.least(F.greatest(0.92 * local / F.greatest("y", F.lit(1.0)), F.lit(1.0)), F.lit(3.5))).otherwise(1.0)
    fit = lambda c: F.least(F.col(c) * scale, F.lit(255.0)).cast("int").alias(c)
    return sums.crossJoin(F.broadcast(whole)).select("r", "c", *map(fit, ("red", "green", "blue")))


def bare_ground(pixels: DataFrame, objects: DataFrame, height: int, width: int, dilate: int = 5, shadow: int = 8, ratio: float = 0.55, radius: int = 6) -> DataFrame:
    """Objects dilated, shadows at them grown in, holes filled from the nearest ground.

    A pixel is in shadow if its luma is less than ``ratio`` of the largest around it, in an ellipse
    that is as wide as shadows may grow, and 3 at least.
    """
    mask = stencil.dilate(objects, stencil.ellipse(dilate), height, width)
    y = pixels.withColumn("y", luma(F.col("red"), F.col("green"), F.col("blue")))
    around = stencil.kernel_max(y, stencil.ellipse(2 * min(shadow, 32) + 1), "top", F.col("y"))
    dark = around.where((F.col("y") < ratio * F.greatest("top", F.lit(1.0))) & (F.col("y") >= 3)).select("r", "c")
    mask = stencil.geodesic_growth(mask, dark.union(mask).distinct(), shadow, height, width, stencil.ellipse(3))
    return filled(pixels, mask, radius)


def brushed(mask: DataFrame, segment: tuple[float, float, float, float], radius: float, height: int, width: int, erase: bool = False) -> DataFrame:
    """The mask after a brush went along a segment (x0, y0, x1, y1)."""
    x0, y0, x1, y1 = segment
    rows = mask.sparkSession.range(max(0, int(min(y0, y1) - radius)), min(height, int(max(y0, y1) + radius) + 2)).withColumnRenamed("id", "r")
    box = rows.withColumn("c", F.explode(F.sequence(F.lit(max(0, int(min(x0, x1) - radius))).cast("long"), F.lit(min(width - 1, int(max(x0, x1) + radius) + 1)).cast("long"))))
    size = (x1 - x0) ** 2 + (y1 - y0) ** 2
    t = F.least(F.greatest(((F.col("c") - x0) * (x1 - x0) + (F.col("r") - y0) * (y1 - y0)) / size, F.lit(0.0)), F.lit(1.0)) if size else F.lit(0.0)
    hit = box.where(F.hypot(F.col("c") - x0 - t * (x1 - x0), F.col("r") - y0 - t * (y1 - y0)) <= radius)
    return mask.select("r", "c").join(hit, ["r", "c"], "left_anti") if erase else mask.select("r", "c").union(hit.select("r", "c")).distinct()


def hole_filled(mask: DataFrame, seeds: DataFrame, height: int, width: int) -> DataFrame:
    """The mask with the holes filled that a seed lies in."""
    hole = regions.with_seed(regions.holes(mask, height, width), seeds)
    return mask.select("r", "c").union(hole.select("r", "c"))


def replayed(base: DataFrame, log: DataFrame, version: int) -> DataFrame:
    """The mask after the edits (seq, r, c, value) up to a version."""
    last = records.state_at(log, ["r", "c"], "value", "seq", version)
    both = base.select("r", "c", F.lit(1).alias("b")).join(last, ["r", "c"], "full_outer")
    return both.where(F.coalesce("value", "b") == 1).select("r", "c")


def grained(pixels: DataFrame, mask: DataFrame, cell: int, strength: float, k: int = 1, band: str = "v") -> DataFrame:
    """Masked pixels with the grain of unmasked ones in their cell: what those differ by from the mean of their box.

    Donors are dealt in hash order, round and round; a cell without donors keeps its values.
    """
    from pyspark.sql import Window

    marked = pixels.join(mask.select("r", "c", F.lit(True).alias("hole")), ["r", "c"], "left").withColumn("_cell", F.struct(F.floor(F.col("r") / cell).alias("i"), F.floor(F.col("c") / cell).alias("j")))
    free = F.when(F.col("hole").isNull(), F.col(band).cast("double"))
    sums = stencil.box(stencil.box(marked, k, "_n", F.sum, free.isNotNull().cast("int")), k, "_s", F.sum, F.coalesce(free, F.lit(0.0)))
    order = Window.partitionBy("_cell").orderBy(F.xxhash64("r", "c"), "r", "c")
    donors = sums.where("hole is null").select("_cell", (F.row_number().over(order) - 1).alias("_k"), (F.col(band) - F.col("_s") / F.col("_n")).alias("_grain"))
    count = donors.groupBy("_cell").agg(F.count("*").alias("_of"))
    asked = sums.where("hole").select("r", "c", "_cell", (F.row_number().over(order) - 1).alias("_i")).join(count, "_cell").withColumn("_k", F.col("_i") % F.col("_of"))
    grain = asked.join(donors, ["_cell", "_k"]).select("r", "c", "_grain")
    return pixels.join(grain, ["r", "c"], "left").withColumn(band, F.col(band) + strength * F.coalesce("_grain", F.lit(0.0))).drop("_grain")
