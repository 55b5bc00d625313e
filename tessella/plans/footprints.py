"""From scored tiles to numbered footprints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import regions, stencil, tiling
from ..operators.numbering import numbered

Scorer = Callable[[DataFrame], DataFrame]


def predicted(pixels: DataFrame, score: Scorer, height: int, width: int, tile: int, overlap: float) -> DataFrame:
    """(r, c, proba): a scorer's values over halo tiles, averaged where tiles overlap.

    ``score`` takes pixels with their tile's offsets and adds ``score``; a model goes
    there as a grouped Pandas function, an index as an expression.
    """
    return tiling.overlap_mean(score(tiling.to_tiles(pixels, height, width, tile, overlap)), "score", "proba")


def footprints(proba: DataFrame, height: int, width: int, threshold: float = 0.5, opening: int = 3, closing: int = 5, gsd: float = 0.3, least_m2: float = 5.0) -> DataFrame:
    """(id, comp, area_m2, area_px, box): cleaned regions of at least an area, numbered by place."""
    mask = proba.where(F.col("proba") >= threshold).select("r", "c")
    stats = regions.region_stats(regions.label_regions(stencil.open_close(mask, opening, closing, height, width), width, 8), gsd)
    return numbered(stats.where(F.col("area_m2") >= least_m2), ["comp"], "id").select((F.col("id") + 1).alias("id"), "comp", "area_px", "area_m2", "x", "y", "w", "h")


def merged(parts: dict[str, DataFrame]) -> DataFrame:
    """Footprints of many tiles in one table with tile_id, numbered anew; nothing to merge is an error."""
    if not parts:
        raise ValueError("no footprints to merge")
    out = None
    for name, df in parts.items():
        own = df.withColumn("tile_id", F.lit(name)).withColumnRenamed("id", "local_id")
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return numbered(out, ["tile_id", "local_id"], "id").withColumn("id", F.col("id") + 1)
