"""Polylines and rings as arrays of struct(x, y): lengths, areas, smoothing, clipping, all by array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segments(points: Column) -> Column:
    """Array of struct(a, b) of neighbours; fewer than two points have none."""
    return F.when(F.size(points) > 1, F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.slice(F.transform(points, lambda p: F.struct(p.alias("a"), p.alias("b"))), 1, 0))


def _distance(s: Column) -> Column:
    return F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])


def length(points: Column) -> Column:
    return F.aggregate(segments(points), F.lit(0.0), lambda acc, s: acc + _distance(s))


def shoelace(ring: Column) -> Column:
    """The area within a ring; the last point joins the first."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    return F.abs(F.aggregate(segments(closed), F.lit(0.0), lambda acc, s: acc + s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])) / 2


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring: an odd number of edges crosses the ray to its right."""
    closed = F.concat(ring, F.slice(ring, 1, 1))

    def crosses(s: Column) -> Column:
        a, b = s["a"], s["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(segments(closed), crosses)) % 2 == 1


def smoothed_in_place(values: Column) -> Column:
    """1-2-1 smoothing where each value sees the smoothed one before it; both ends stay.

    An ordered fold: the recursion can't be had from lag and lead.
    """
    n = F.size(values)
    inner = F.sequence(F.lit(2), n - 1)
    folded = F.aggregate(inner, F.slice(values, 1, 1), lambda acc, i: F.array_append(acc, F.element_at(acc, -1) * 0.25 + F.element_at(values, i) * 0.5 + F.element_at(values, i + 1) * 0.25))
    return F.when(n < 3, values).otherwise(F.array_append(folded, F.element_at(values, -1)))


def clamped_window(values: Column, i: Column, k: int) -> Column:
    """The 2k+1 values around the i-th (from 0), ends repeated."""
    n = F.size(values)
    return F.transform(F.sequence(F.lit(-k), F.lit(k)), lambda j: F.element_at(values, F.least(F.greatest(i + j, F.lit(0)), n - 1) + 1))


def moving_mean(values: Column, k: int) -> Column:
    """Means over 2k+1 values with repeated ends."""
    each = F.sequence(F.lit(0), F.size(values) - 1)
    return F.when(F.size(values) > 0, F.transform(each, lambda i: F.aggregate(clamped_window(values, i, k), F.lit(0.0), lambda a, v: a + v) / (2 * k + 1))).otherwise(values)


def moving_median(values: Column, k: int) -> Column:
    each = F.sequence(F.lit(0), F.size(values) - 1)
    return F.when(F.size(values) > 0, F.transform(each, lambda i: F.element_at(F.array_sort(clamped_window(values, i, k)), k + 1))).otherwise(values)


def clip_segment(a: Column, b: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """struct(t0, t1): the part of a segment within a box as fractions of it; null if none."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    enter, leave = F.lit(0.0), F.lit(1.0)
    misses = F.lit(False)
    for p, q in ((-dx, a["x"] - west), (dx, east - a["x"]), (-dy, a["y"] - south), (dy, north - a["y"])):
        enter = F.when(p < 0, F.greatest(enter, q / p)).otherwise(enter)
        leave = F.when(p > 0, F.least(leave, q / p)).otherwise(leave)
        misses |= (p == 0) & (q < 0)
    return F.when(~misses & (enter <= leave), F.struct(enter.alias("t0"), leave.alias("t1")))


def distinct_headings(headings: Column, apart: float) -> Column:
    """Headings kept in order, each at least ``apart`` radians from all kept before."""
    from .geo import separation

    return F.aggregate(headings, F.slice(headings, 1, 0), lambda kept, h: F.when(F.exists(kept, lambda k: separation(k, h) < apart), kept).otherwise(F.array_append(kept, h)))


def insert_point(points: Column, x: Column, y: Column, reuse: float = 0.5) -> Column:
    """The polyline with the nearest place to (x, y) on it as a vertex; a vertex nearer than ``reuse`` to that place serves."""

    def foot(s: Column, i: Column) -> Column:
        a, b = s["a"], s["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        size = dx * dx + dy * dy
        t = F.when(size > 0, F.least(F.greatest(((x - a["x"]) * dx + (y - a["y"]) * dy) / size, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        px, py = a["x"] + t * dx, a["y"] + t * dy
        return F.struct(F.hypot(px - x, py - y).alias("d"), i.alias("i"), px.alias("x"), py.alias("y"))

    best = F.array_min(F.transform(segments(points), foot))
    place = F.struct(best["x"].alias("x"), best["y"].alias("y"))
    near = F.exists(points, lambda p: F.hypot(p["x"] - best["x"], p["y"] - best["y"]) < reuse)
    return F.when((F.size(points) < 2) | near, points).otherwise(F.concat(F.slice(points, F.lit(1), best["i"] + 1), F.array(place), F.slice(points, best["i"] + 2, F.size(points))))
