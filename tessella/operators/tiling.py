"""Halo tiles over rasters: the grid, which tiles cover a pixel, and how overlapping results are merged.

A raster in long form has ``r``, ``c`` and values. Which tiles cover a pixel is
arithmetic on its place, so pixels are never joined with tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def step(tile: int, overlap: float) -> int:
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be in [0, 1)")
    return max(1, int(tile * (1 - overlap)))


def _last(size: int, tile: int, stride: int) -> int:
    return max(size - tile, 0) // stride


def _edge(size: int, tile: int, stride: int) -> int | None:
    """The extra offset that reaches the end, where the regular ones don't."""
    return max(0, size - tile) if _last(size, tile, stride) * stride + tile < size else None


def offsets(size: int, tile: int, stride: int) -> Column:
    """All tile offsets along an axis, as an array."""
    regular = F.transform(F.sequence(F.lit(0), F.lit(_last(size, tile, stride))), lambda k: k * stride)
    edge = _edge(size, tile, stride)
    return regular if edge is None else F.array_distinct(F.array_append(regular, F.lit(edge)))


def tile_grid(spark: SparkSession, height: int, width: int, tile: int, overlap: float = 0.0) -> DataFrame:
    """(tile_idx, row_off, col_off, height, width, pad_bottom, pad_right), numbered row by row."""
    stride = step(tile, overlap)
    columns = offsets(width, tile, stride)
    grid = spark.range(1).select(F.posexplode(offsets(height, tile, stride)).alias("i", "row_off"), columns.alias("cols"))
    grid = grid.select((F.col("i") * F.size("cols")).alias("base"), "row_off", F.posexplode("cols").alias("j", "col_off"))
    h, w = F.least(F.lit(tile), height - F.col("row_off")), F.least(F.lit(tile), width - F.col("col_off"))
    return grid.select((F.col("base") + F.col("j")).alias("tile_idx"), "row_off", "col_off", h.alias("height"), w.alias("width"), (tile - h).alias("pad_bottom"), (tile - w).alias("pad_right"))


def covering(place: Column, size: int, tile: int, stride: int) -> Column:
    """The offsets of the tiles along an axis that cover a place: at most tile / stride + 2."""
    low = F.greatest(F.lit(0), F.ceil((place - tile + 1) / stride)).cast("int")
    high = F.least(F.floor(place / stride), F.lit(_last(size, tile, stride))).cast("int")
    empty = F.array().cast("array<int>")
    regular = F.when(low <= high, F.transform(F.sequence(low, high), lambda k: k * stride)).otherwise(empty)
    edge = _edge(size, tile, stride)
    return regular if edge is None else F.array_distinct(F.concat(regular, F.when(place >= edge, F.array(F.lit(edge))).otherwise(empty)))


def to_tiles(pixels: DataFrame, height: int, width: int, tile: int, overlap: float = 0.0) -> DataFrame:
    """A row for each pixel and tile that covers it: adds row_off and col_off."""
    stride = step(tile, overlap)
    rows = pixels.withColumn("row_off", F.explode(covering(F.col("r"), height, tile, stride)))
    return rows.withColumn("col_off", F.explode(covering(F.col("c"), width, tile, stride)))


def overlap_mean(tiled: DataFrame, value: str, out: str) -> DataFrame:
    """Mean of the tiles' values at each pixel."""
    return tiled.groupBy("r", "c").agg(F.avg(value).alias(out))


def weighted_mean(tiled: DataFrame, value: Column, weight: Column, out: str) -> DataFrame:
    sums = tiled.groupBy("r", "c").agg(F.sum(value * weight).alias("_v"), F.sum(weight).alias("_w"))
    return sums.select("r", "c", F.when(F.col("_w") > 0, F.col("_v") / F.col("_w")).alias(out))


def majority(tiled: DataFrame, vote: Column, label: Column, order: list[str]) -> DataFrame:
    """(r, c, object, cls): objects where half the tiles or more vote so; the last tile's class stands."""
    votes = tiled.groupBy("r", "c").agg(F.sum(vote.cast("int")).alias("_v"), F.count("*").alias("_n"), F.max_by(label, F.struct(*order)).alias("cls"))
    return votes.select("r", "c", (2 * F.col("_v") >= F.col("_n")).cast("int").alias("object"), "cls")


def padded(tiled: DataFrame, tiles: DataFrame, tile: int, value: str) -> DataFrame:
    """Each tile as a dense tile x tile grid (row_off, col_off, i, j, value), 0 beyond the raster."""
    cells = tiles.select("row_off", "col_off", F.explode(F.sequence(F.lit(0), F.lit(tile - 1))).alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(tile - 1))))
    own = tiled.select("row_off", "col_off", (F.col("r") - F.col("row_off")).cast("int").alias("i"), (F.col("c") - F.col("col_off")).cast("int").alias("j"), value)
    return cells.join(own, ["row_off", "col_off", "i", "j"], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def mostly_empty(pixels: DataFrame, tile_keys: list[str], bands: list[str], nodata: float | None, least: float) -> DataFrame:
    """Share of pixels whose bands are all nodata (0 if there is none), by tile, and whether it reaches ``least``."""
    none = F.lit(True)
    for band in bands:
        none &= F.col(band) == (0 if nodata is None or nodata != nodata else nodata)
    share = pixels.groupBy(*tile_keys).agg(F.avg(none.cast("double")).alias("empty_share"))
    return share.withColumn("is_empty", F.col("empty_share") >= least)


def class_shares(pixels: DataFrame, keys: list[str], classes: dict[str, Column]) -> DataFrame:
    """Share of each chip's pixels in each class; a null condition is not in it."""
    return pixels.groupBy(*keys).agg(*[F.avg(F.coalesce(within, F.lit(False)).cast("double")).alias(name) for name, within in classes.items()])


def square_chips(pixels: DataFrame, keys: list[str], bands: list[str], least_side: int = 8, least_lit: float = 0.05, side: int = 16, fill: int = 114) -> DataFrame:
    """(keys, i, j, bands): the footprint of each chip, cropped to its bounds and padded to a square.

    ``pixels`` holds the pixels of the footprints (keys, r, c, bands), one row each. Within the bounds what is not
    in the footprint is 0, beyond them ``fill``. Chips whose bounds have a side below ``least_side``, or a
    smaller share of pixels above 0 in any band than ``least_lit``, are left out. The bounds are those of a
    footprint's own pixels: a square's size grows with them alone.
    """
    lit = F.greatest(*bands, F.lit(0)) > 0
    bounds = pixels.groupBy(*keys).agg(F.min("r").alias("_r"), F.min("c").alias("_c"), (F.max("r") - F.min("r") + 1).alias("_h"), (F.max("c") - F.min("c") + 1).alias("_w"), F.sum(lit.cast("int")).alias("_lit"))
    kept = bounds.where((F.least("_h", "_w") >= least_side) & (F.col("_lit") >= least_lit * F.col("_h") * F.col("_w"))).withColumn("_side", F.greatest("_h", "_w", F.lit(side)))
    steps = F.sequence(F.lit(0), (F.col("_side") - 1).cast("int"))
    cells = kept.select("*", F.explode(steps).alias("i")).select("*", F.explode(steps).alias("j"))
    y, x = (F.col(at) - F.floor((F.col("_side") - F.col(n)) / 2) for at, n in (("i", "_h"), ("j", "_w")))
    placed = cells.select(*keys, "i", "j", (F.col("_r") + y).alias("r"), (F.col("_c") + x).alias("c"), (y.between(0, F.col("_h") - 1) & x.between(0, F.col("_w") - 1)).alias("_inside"))
    around = F.when(F.col("_inside"), 0).otherwise(fill)
    return placed.join(pixels.select(*keys, "r", "c", *bands), [*keys, "r", "c"], "left").select(*keys, "i", "j", *[F.coalesce(F.col(b), around).alias(b) for b in bands])


def area_average(pixels: DataFrame, factor: int, value: str, out: str) -> DataFrame:
    """Reduction by a whole factor."""
    return pixels.groupBy(F.floor(F.col("r") / factor).alias("r"), F.floor(F.col("c") / factor).alias("c")).agg(F.avg(value).alias(out))


def nearest(pixels: DataFrame, height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """Nearest-neighbour resize: each source pixel is asked which target pixels it serves."""
    place = lambda v, old, new: F.sequence(F.ceil(v * new / old).cast("int"), F.ceil((v + 1) * new / old).cast("int") - 1)
    has = lambda v, old, new: F.ceil(v * new / old) <= F.ceil((v + 1) * new / old) - 1
    rows = pixels.where(has(F.col("r"), height, new_height)).withColumn("_r", F.explode(place(F.col("r"), height, new_height)))
    both = rows.where(has(F.col("c"), width, new_width)).withColumn("_c", F.explode(place(F.col("c"), width, new_width)))
    return both.drop("r", "c").withColumnsRenamed({"_r": "r", "_c": "c"})


def pyramid_level(tiles: DataFrame) -> DataFrame:
    """Parents (z-1, x div 2, y div 2) with their children's count, value average and covering share."""
    parents = tiles.groupBy((F.col("z") - 1).alias("z"), F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y"))
    return parents.agg(F.count("*").alias("children"), F.sum("value").alias("total")).withColumn("value", F.col("total") / 4).drop("total")


def warped(target: DataFrame, source: DataFrame, row: Column, col: Column, value: str) -> DataFrame:
    """(r, c, value): a target grid (r, c) filled bilinearly from a source raster at the places that ``row`` and ``col`` map it to.

    Each target pixel asks its four source pixels, which meet by equality; places next to
    missing pixels take what there is, weighted; places without any are null.
    """
    asked = target.select("r", "c", row.alias("_y"), col.alias("_x")).withColumn("_r", F.floor("_y")).withColumn("_c", F.floor("_x"))
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    asked = asked.withColumn("s", F.explode(corners))
    near = lambda place, base, step: 1 - F.abs(F.col(place) - F.col(base) - F.col(step))
    asked = asked.withColumn("_w", near("_y", "_r", "s.i") * near("_x", "_c", "s.j")).where("_w > 0")
    own = source.select(F.col("r").alias("_sr"), F.col("c").alias("_sc"), F.col(value).alias("_v"))
    met = asked.join(own, (F.col("_r") + F.col("s.i") == F.col("_sr")) & (F.col("_c") + F.col("s.j") == F.col("_sc")))
    sums = met.groupBy("r", "c").agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias(value))
    return target.select("r", "c").join(sums, ["r", "c"], "left")
