"""Connected regions of masks: labels, statistics, holes, pruning, seeds.

Labels come in two steps. Pixels are dealt to square blocks, and each block is
labelled by itself; then only the regions that touch across block borders are
linked, so the iterated graph has as many vertices as blocks have regions.
A region's label is its smallest pixel key, row times width plus column.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components, cut

_HALF = {4: [(0, 1), (1, 0)], 8: [(0, 1), (1, 0), (1, 1), (1, -1)]}


def _label_block(pdf: pd.DataFrame, connectivity: int) -> pd.DataFrame:
    """Labels of one block by vectorised hooking and pointer jumping."""
    r, c, key = (pdf[x].to_numpy() for x in ("r", "c", "key"))
    order = np.argsort(key)
    r, c, key = r[order], c[order], key[order]
    r0, c0 = r.min() - 1, c.min() - 1
    place = np.full((r.max() - r0 + 2, c.max() - c0 + 2), -1)
    place[r - r0, c - c0] = np.arange(len(key))
    edges = []
    for dy, dx in _HALF[connectivity]:
        other = place[r - r0 + dy, c - c0 + dx]
        at = np.flatnonzero(other >= 0)
        edges.append((at, other[at]))
    u, v = (np.concatenate(x) for x in zip(*edges))
    label = np.arange(len(key))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    return pd.DataFrame({"r": r, "c": c, "key": key, "local": key[label]})


def label_regions(mask: DataFrame, width: int, connectivity: int = 8, block: int = 256) -> DataFrame:
    """(r, c, comp) of every set pixel. Repeated pixels count once; no pixels: no rows."""
    keyed = mask.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).distinct().withColumn("key", F.col("r") * width + F.col("c"))
    by_block = keyed.groupBy(F.floor(F.col("r") / block), F.floor(F.col("c") / block))
    local = cut(by_block.applyInPandas(lambda pdf: _label_block(pdf, connectivity), "r long, c long, key long, local long"))
    on_edge = (F.col("r") % block).isin(0, block - 1) | (F.col("c") % block).isin(0, block - 1)
    edge = local.where(on_edge).select("r", "c", "local")
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in _HALF[connectivity]])
    moved = edge.withColumn("s", F.explode(steps)).select((F.col("r") + F.col("s.dy")).alias("r"), (F.col("c") + F.col("s.dx")).alias("c"), F.col("local").alias("a"))
    links = moved.join(edge.withColumnRenamed("local", "b"), ["r", "c"]).where("a <> b").select("a", "b")
    comps = components(local.select(F.col("local").alias("id")).distinct(), links)
    return local.join(comps, F.col("local") == F.col("id")).select("r", "c", F.col("component").alias("comp"))


def region_stats(labels: DataFrame, gsd: float = 1.0) -> DataFrame:
    """(comp, area_px, area_m2, x, y, w, h, cx, cy) of each region."""
    stats = labels.groupBy("comp").agg(F.count("*").alias("area_px"), F.min("c").alias("x"), F.min("r").alias("y"), F.max("c").alias("x1"), F.max("r").alias("y1"), F.avg("c").alias("cx"), F.avg("r").alias("cy"))
    return stats.select("comp", "area_px", (F.col("area_px") * gsd * gsd).alias("area_m2"), "x", "y", (F.col("x1") - F.col("x") + 1).alias("w"), (F.col("y1") - F.col("y") + 1).alias("h"), "cx", "cy")


def inverse(mask: DataFrame, height: int, width: int) -> DataFrame:
    grid = mask.sparkSession.range(height).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("c"))
    return grid.join(mask.select("r", "c"), ["r", "c"], "left_anti")


def holes(mask: DataFrame, height: int, width: int) -> DataFrame:
    """(r, c, comp) of background regions (4-connected) that don't touch the border."""
    labels = label_regions(inverse(mask, height, width), width, 4)
    closed = labels.groupBy("comp").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1")).where((F.col("r0") > 0) & (F.col("c0") > 0) & (F.col("r1") < height - 1) & (F.col("c1") < width - 1))
    return labels.join(closed, "comp", "left_semi").select("r", "c", "comp")


def pruned(labels: DataFrame, least: int, protected: Column | None = None) -> DataFrame:
    """Pixels of regions of ``least`` pixels or more; regions with a protected pixel stay whatever their size."""
    kept = F.max(protected.cast("int")) if protected is not None else F.lit(0)
    keep = labels.groupBy("comp").agg(F.count("*").alias("n"), kept.alias("p")).where((F.col("n") >= least) | (F.col("p") > 0))
    return labels.join(keep, "comp", "left_semi")


def with_seed(labels: DataFrame, seeds: DataFrame, how: str = "left_semi") -> DataFrame:
    """Regions that a seed (r, c) lies in (``left_anti``: in which none does); seeds on background fall away."""
    hit = labels.join(seeds.select("r", "c"), ["r", "c"], "left_semi").select("comp").distinct()
    return labels.join(hit, "comp", how)


def split_instances(mask: DataFrame, kernel, height: int, width: int) -> DataFrame:
    """(r, c, label): regions of the eroded mask, grown back within the mask; the smallest label wins a pixel."""
    from .stencil import _spread, erode

    cores = label_regions(erode(mask, kernel, height, width), width, 8).withColumnRenamed("comp", "label")
    grown = _spread(cores, kernel, height, width).join(mask.select("r", "c"), ["r", "c"], "left_semi")
    return grown.groupBy("r", "c").agg(F.min("label").alias("label"))


def outlines(labels: DataFrame) -> DataFrame:
    """(comp, r, c, side): the pixel edges that bound each region, from which rings are traced; holes included."""
    sides = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(n).alias("side")) for dy, dx, n in ((-1, 0, "n"), (0, 1, "e"), (1, 0, "s"), (0, -1, "w"))])
    around = labels.select("comp", "r", "c", F.explode(sides).alias("s")).select("comp", "r", "c", "s.side", (F.col("r") + F.col("s.dy")).alias("nr"), (F.col("c") + F.col("s.dx")).alias("nc"))
    own = labels.select(F.col("r").alias("nr"), F.col("c").alias("nc"), "comp")
    return around.join(own, ["nr", "nc", "comp"], "left_anti").select("comp", "r", "c", "side")


def rings(labels: DataFrame) -> DataFrame:
    """(comp, part, outer, ring): closed rings of pixel corners around each region, its holes as inner rings."""

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = {"n": ((0, 0), (0, 1)), "e": ((0, 1), (1, 1)), "s": ((1, 1), (1, 0)), "w": ((1, 0), (0, 0))}
        after: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r, c, side in zip(pdf["r"], pdf["c"], pdf["side"]):
            (a, b), (x, y) = ends[side]
            after.setdefault((r + a, c + b), []).append((r + x, c + y))
        out = []
        for start in sorted(after):
            while after.get(start):
                ring, at, came = [start], start, None
                while True:
                    ways = after[at]
                    # Where two ways leave a corner, turn right: regions are 8-connected.
                    way = ways[0] if len(ways) == 1 or came is None else min(ways, key=lambda w: came[0] * (w[1] - at[1]) - came[1] * (w[0] - at[0]))
                    ways.remove(way)
                    came, at = (way[0] - at[0], way[1] - at[1]), way
                    if at == start:
                        break
                    ring.append(at)
                area = sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(ring, ring[1:] + ring[:1])) / 2
                out.append((int(pdf["comp"].iloc[0]), len(out), bool(area > 0), [{"x": float(c), "y": float(r)} for r, c in ring]))
        return pd.DataFrame(out, columns=["comp", "part", "outer", "ring"])

    return outlines(labels).groupBy("comp").applyInPandas(trace, "comp long, part int, outer boolean, ring array<struct<x:double,y:double>>")




def watershed(labels: DataFrame, apart: int = 3, radius: int = 16) -> DataFrame:
    """(r, c, comp, part): regions parted at their waists; pixels where two parts meet are left out as a gap.

    Seeds are the deepest pixels within ``apart``, the first in reading order of equally
    deep ones. Each region floods from its seeds, the deepest pixels first, in a task of its own.
    """
    from .stencil import dilate, distance_within, square

    inside = labels.select("r", "c")
    bounds = labels.agg(F.max("r"), F.max("c")).first()
    edge = dilate(inside.select((F.col("r") + 1).alias("r"), (F.col("c") + 1).alias("c")), square(3), (bounds[0] or 0) + 3, (bounds[1] or 0) + 3).select((F.col("r") - 1).alias("r"), (F.col("c") - 1).alias("c")).join(inside, ["r", "c"], "left_anti")
    deep = labels.join(distance_within(inside, edge, radius), ["r", "c"]).withColumn("d2", F.coalesce("d2", F.lit(radius * radius)))

    def flood(pdf: pd.DataFrame) -> pd.DataFrame:
        import heapq

        depth = {(r, c): d for r, c, d in zip(pdf["r"], pdf["c"], pdf["d2"])}
        seeds: list[tuple[int, int]] = []
        for place in sorted(depth, key=lambda p: (-depth[p], p)):
            if all(abs(place[0] - s[0]) > apart or abs(place[1] - s[1]) > apart for s in seeds) and all(depth.get((place[0] + i, place[1] + j), 0) <= depth[place] for i in range(-apart, apart + 1) for j in range(-apart, apart + 1)):
                seeds.append(place)
        part = {s: k for k, s in enumerate(seeds)}
        todo = [(-depth[s], s) for s in seeds]
        heapq.heapify(todo)
        while todo:
            _, (r, c) = heapq.heappop(todo)
            own = part[r, c]
            if own < 0:
                continue
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    n = (r + i, c + j)
                    if n in depth and n not in part:
                        around = {part[m] for a in (-1, 0, 1) for b in (-1, 0, 1) if part.get(m := (n[0] + a, n[1] + b), -1) >= 0}
                        part[n] = own if len(around) == 1 else -1
                        heapq.heappush(todo, (-depth[n], n))
        comp = int(pdf["comp"].iloc[0])
        return pd.DataFrame([(r, c, comp, k) for (r, c), k in part.items() if k >= 0], columns=["r", "c", "comp", "part"])

    return deep.select("r", "c", "comp", "d2").groupBy("comp").applyInPandas(flood, "r long, c long, comp long, part int")
