"""Centre lines of masks: thinning, and chains of pixels between nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut
from .regions import label_regions

#: The eight neighbours, clockwise from above.
AROUND = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def neighbours(mask: DataFrame) -> DataFrame:
    """(r, c, code): which neighbours of a pixel are set, a bit for each, in one shuffle: every pixel tells its neighbours."""
    told = F.array(*[F.struct(F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx"), F.lit(1 << k).alias("bit")) for k, (dy, dx) in enumerate(AROUND)], F.struct(F.lit(0).alias("dy"), F.lit(0).alias("dx"), F.lit(256).alias("bit")))
    moved = mask.select("r", "c", F.explode(told).alias("s")).select((F.col("r") + F.col("s.dy")).alias("r"), (F.col("c") + F.col("s.dx")).alias("c"), F.col("s.bit").alias("bit"))
    return moved.groupBy("r", "c").agg(F.sum("bit").alias("code")).where("code >= 256").withColumn("code", F.col("code") - 256)


def _bit(k: int) -> Column:
    return F.shiftright("code", k % 8).bitwiseAND(1)


def thinned(mask: DataFrame, most: int = 1000) -> DataFrame:
    """The mask thinned to lines one pixel wide, from both sides in turn until nothing goes.

    A pixel goes if it has two to six neighbours in one connected run and its removal
    from that side keeps the line. Every pass is cut from lineage.
    """
    now = cut(mask.select("r", "c").distinct())
    count = now.count()
    for _ in range(most):
        for side in ((0, 2, 4, 2, 4, 6), (0, 2, 6, 0, 4, 6)):
            number = sum((_bit(k) for k in range(1, 8)), _bit(0))
            runs = sum((((_bit(k) == 0) & (_bit(k + 1) == 1)).cast("int") for k in range(1, 8)), ((_bit(0) == 0) & (_bit(1) == 1)).cast("int"))
            a, b, c, d, e, f = map(_bit, side)
            goes = number.between(2, 6) & (runs == 1) & (a * b * c == 0) & (d * e * f == 0)
            now = neighbours(now).where(~goes).select("r", "c")
        now = cut(now)
        before, count = count, now.count()
        if count == before:
            return now
    return now


def chains(skeleton: DataFrame, width: int) -> DataFrame:
    """(r, c, comp): chains of a skeleton between its ends and forks; forks belong to none."""
    degree = neighbours(skeleton)
    number = sum((_bit(k) for k in range(1, 8)), _bit(0))
    return label_regions(degree.where(number <= 2).select("r", "c"), width, 8)
