"""Ordered series along lines: smoothing, interpolation, runs, robust spread, width gates.

A series has a line id, a place and a nullable value; lines are partitions of
window functions, so every line is handled in one task and no two lines meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interpolated(series: DataFrame, line: str, place: str, value: str, out: str, at: str | None = None) -> DataFrame:
    """Adds ``out``: nulls filled linearly between their neighbours in ``at`` (the place by default); ends are held."""
    at = at or place
    w = Window.partitionBy(line).orderBy(place)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).cast("double").alias("t"), F.col(value).cast("double").alias("v")))
    filled = series.withColumn("_p", F.last(known, ignorenulls=True).over(before)).withColumn("_n", F.first(known, ignorenulls=True).over(after))
    t = F.col(at).cast("double")
    share = (t - F.col("_p.t")) / (F.col("_n.t") - F.col("_p.t"))
    between = F.col("_p.v") + share * (F.col("_n.v") - F.col("_p.v"))
    return filled.withColumn(out, F.coalesce(F.col(value).cast("double"), F.when(F.col("_n.t") > F.col("_p.t"), between), F.col("_p.v"), F.col("_n.v"))).drop("_p", "_n")


def runs(series: DataFrame, line: str, place: str, flag: Column, out: str = "run") -> DataFrame:
    """Adds ``out``: the number of the run of equal flags that a row is in, from 1."""
    w = Window.partitionBy(line).orderBy(place)
    flagged = series.withColumn("_flag", flag)
    before = F.lag("_flag").over(w)
    changed = flagged.withColumn("_change", F.when(before.isNull() | (before != F.col("_flag")), 1).otherwise(0))
    return changed.withColumn(out, F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change", "_flag")


def merged_runs(series: DataFrame, line: str, place: str, flag: Column, most_gap: int, least: int) -> DataFrame:
    """(line, run, first, last, n): runs of true, gaps of up to ``most_gap`` rows bridged, of ``least`` rows or more."""
    w = Window.partitionBy(line).orderBy(place)
    rows = series.select(line, place, flag.alias("_f"), F.row_number().over(w).alias("_i")).where("_f")
    gap = F.col("_i") - F.lag("_i").over(w)
    begun = rows.withColumn("_b", F.when(gap.isNull() | (gap > most_gap + 1), 1).otherwise(0))
    numbered = begun.withColumn("run", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = numbered.groupBy(line, "run").agg(F.min("_i").alias("first"), F.max("_i").alias("last"))
    return found.withColumn("n", F.col("last") - F.col("first") + 1).where(F.col("n") >= least)


def noise_sigma(series: DataFrame, line: str, place: str, value: str) -> DataFrame:
    """(line, sigma): 1.4826 times the median step over sqrt 2, within 0.15 and 3; 0.5 for lines of fewer than four values."""
    w = Window.partitionBy(line).orderBy(place)
    known = series.where(F.col(value).isNotNull())
    steps = known.withColumn("_d", F.abs(F.col(value) - F.lag(value).over(w)))
    sigma = F.least(F.greatest(1.4826 * F.median("_d") / F.sqrt(F.lit(2.0)), F.lit(0.15)), F.lit(3.0))
    return steps.groupBy(line).agg(F.when(F.count("*") < 4, 0.5).otherwise(sigma).alias("sigma"))


def local_median_without_self(series: DataFrame, line: str, place: str, value: str, radius: int, out: str) -> DataFrame:
    """Adds ``out``: the median of the known values within ``radius`` places but the own; of all others where fewer than two are near."""
    w = Window.partitionBy(line).orderBy(place)
    near, every = w.rowsBetween(-radius, radius), Window.partitionBy(line)
    seen = F.struct(F.col(place).alias("p"), F.col(value).alias("v"))

    def median(values: Column) -> Column:
        s = F.array_sort(values)
        n = F.size(s)
        return F.when(n > 0, (F.element_at(s, ((n + 1) / 2).cast("int")) + F.element_at(s, (n / 2).cast("int") + 1)) / 2)

    def others(frame) -> Column:
        return F.transform(F.filter(F.collect_list(F.when(F.col(value).isNotNull(), seen)).over(frame), lambda x: x["p"] != F.col(place)), lambda x: x["v"])

    both = series.withColumn("_near", others(near))
    return both.withColumn("_all", F.when(F.size("_near") < 2, others(every))).withColumn(out, median(F.coalesce("_all", "_near"))).drop("_near", "_all")


def inlier(width: Column, reference: Column, absolute: float = 2.5, relative: float = 0.55) -> Column:
    return F.abs(width - reference) <= F.greatest(F.lit(absolute), relative * F.greatest(reference, F.lit(1.0)))


def anchor(width: Column, reference: Column, absolute: float = 0.7, relative: float = 0.18) -> Column:
    return F.abs(width - reference) <= F.greatest(F.lit(absolute), relative * reference)


def fixed_width(series: DataFrame, line: str, value: str, least_inliers: int = 5, least_anchors: int = 3) -> DataFrame:
    """(line, w_ref, n_inliers, n_anchors, width): mean of the inliers round the median, then of the anchors round that mean."""
    ref = series.groupBy(line).agg(F.median(value).alias("w_ref"))
    near = series.join(ref, line).where(inlier(F.col(value), F.col("w_ref")))
    mean = near.groupBy(line, "w_ref").agg(F.count("*").alias("n_inliers"), F.avg(value).alias("w_in")).where(F.col("n_inliers") >= least_inliers)
    close = near.join(mean.select(line, "w_in"), line).where(anchor(F.col(value), F.col("w_in"))).groupBy(line).agg(F.count("*").alias("n_anchors"), F.avg(value).alias("w_an"))
    both = mean.join(close, line, "left").withColumn("n_anchors", F.coalesce("n_anchors", F.lit(0)))
    return both.select(line, "w_ref", "n_inliers", "n_anchors", F.when(F.col("n_anchors") >= least_anchors, F.col("w_an")).otherwise(F.col("w_in")).alias("width"))


def arc_length(vertices: DataFrame, line: str, seq: str) -> DataFrame:
    """Adds ``s``: the way along the line to each vertex."""
    w = Window.partitionBy(line).orderBy(seq)
    d = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return vertices.withColumn("_d", F.coalesce(d, F.lit(0.0))).withColumn("s", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def densified(vertices: DataFrame, line: str, seq: str, most: float) -> DataFrame:
    """(line, seq, k, x, y): every segment in equal parts no longer than ``most``; the last vertex closes its line."""
    w = Window.partitionBy(line).orderBy(seq)
    nxt = vertices.withColumn("_x", F.lead("x").over(w)).withColumn("_y", F.lead("y").over(w))
    parts = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("_x") - F.col("x"), F.col("_y") - F.col("y")) / most)).cast("int")
    cut = nxt.withColumn("_n", F.coalesce(parts, F.lit(1))).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    place = lambda a, b: F.coalesce(F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / F.col("_n"), F.col(a))
    return cut.select(line, seq, "k", place("x", "_x").alias("x"), place("y", "_y").alias("y"))


def stations(vertices: DataFrame, line: str, seq: str, step: float) -> DataFrame:
    """(line, i, s, x, y): at least three equally spaced places along each line of some length."""
    along = arc_length(vertices, line, seq)
    w = Window.partitionBy(line).orderBy(seq)
    seg = along.withColumn("s1", F.lead("s").over(w)).withColumn("x1", F.lead("x").over(w)).withColumn("y1", F.lead("y").over(w)).withColumn("total", F.max("s").over(Window.partitionBy(line))).withColumn("last", F.lead("s1").over(w).isNull())
    seg = seg.where("s1 > s").withColumn("n", F.greatest(F.lit(3), F.bround(F.col("total") / step).cast("int") + 1))
    gap = F.col("total") / (F.col("n") - 1)
    first = F.ceil(F.col("s") / gap - 1e-9).cast("int")
    final = F.when(F.col("last"), F.col("n") - 1).otherwise((F.ceil(F.col("s1") / gap - 1e-9) - 1).cast("int"))
    made = seg.withColumn("_a", first).withColumn("_b", final).where("_a <= _b").withColumn("i", F.explode(F.sequence("_a", "_b")))
    at = F.col("i") * gap
    share = (at - F.col("s")) / (F.col("s1") - F.col("s"))
    return made.select(line, "i", at.alias("s"), (F.col("x") + share * (F.col("x1") - F.col("x"))).alias("x"), (F.col("y") + share * (F.col("y1") - F.col("y"))).alias("y"))


def exception_runs(series: DataFrame, line: str, place: str, value: str, base: str, gate: str, most_gap: int = 2, least: int = 3, shrink: bool = True) -> DataFrame:
    """(line, side, run, first, last, n, level): stretches that hold a steady width of their own, wider or (``shrink``) narrower than the line's.

    A sample is strong if it is off the base by more than the gate, on the stretch's side; a gap
    of at most ``most_gap`` samples is bridged if all of it is off by more than half the gate. A
    stretch counts from ``least`` samples on, gaps included, if its median is off by more than the
    gate, and if 1.4826 times the median distance to that is 1 at most, or 0.6 of what it is off
    by. ``base`` and ``gate`` are the same all along a line; samples without a value are left out;
    ``first`` and ``last`` count the others from 1.
    """
    known = series.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(Window.partitionBy(line).orderBy(place)))
    off = known.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1)) if shrink else F.array(F.lit(1)))).withColumn("_off", F.col("side") * (F.col(value) - F.col(base)))
    w = Window.partitionBy(line, "side").orderBy("_i")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    off = off.withColumn("_strong", F.col("_off") > F.col(gate)).withColumn("_breaks", F.sum((F.col("_off") <= 0.5 * F.col(gate)).cast("int")).over(up_to))
    # The last strong sample before, and whether what lies between is short and without a break.
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    for name, of in (("_last", "_i"), ("_had", "_breaks")):
        off = off.withColumn(name, F.last(F.when(F.col("_strong"), F.col(of)), True).over(before))
    begins = F.col("_strong") & (F.col("_last").isNull() | (F.col("_i") - F.col("_last") - 1 > most_gap) | (F.col("_breaks") > F.col("_had")))
    off = off.withColumn("run", F.sum(begins.cast("int")).over(up_to))
    ends = off.where("_strong").groupBy(line, "side", "run").agg(F.min("_i").alias("first"), F.max("_i").alias("last"))
    inside = off.join(ends, [line, "side", "run"]).where("_i <= last")
    level = inside.groupBy(line, "side", "run", "first", "last").agg(F.median(value).alias("level"), F.first(base).alias("_base"), F.first(gate).alias("_gate"))
    level = level.withColumn("n", F.col("last") - F.col("first") + 1).withColumn("_far", F.abs(F.col("level") - F.col("_base"))).where((F.col("n") >= least) & (F.col("_far") > F.col("_gate")))
    spread = inside.join(level.select(line, "side", "run", "level"), [line, "side", "run"]).groupBy(line, "side", "run").agg((1.4826 * F.median(F.abs(F.col(value) - F.col("level")))).alias("_spread"))
    return level.join(spread, [line, "side", "run"]).where(F.col("_spread") <= F.greatest(F.lit(1.0), 0.6 * F.col("_far"))).select(line, "side", "run", "first", "last", "n", "level")
