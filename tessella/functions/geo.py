"""Coordinate frames as expressions: affine, tile pyramids, Web Mercator, UTM, angles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Affine = tuple[float, float, float, float, float, float]


def pixel_to_world(col: Column, row: Column, t: Affine) -> tuple[Column, Column]:
    """x and y of a column and row under (a, b, c, d, e, f)."""
    a, b, c, d, e, f = t
    return a * col + b * row + c, d * col + e * row + f


def world_to_pixel(x: Column, y: Column, t: Affine) -> tuple[Column, Column]:
    a, b, c, d, e, f = t
    det = a * e - b * d
    return (e * (x - c) - b * (y - f)) / det, (a * (y - f) - d * (x - c)) / det


def ground_sample_distance(t: Affine) -> float:
    return max(abs(t[0]), abs(t[4]))


def tile_resolution(zoom: Column, tile: int = 256) -> Column:
    """Degrees a pixel of the global geodetic pyramid."""
    return F.lit(180.0) / tile / F.pow(F.lit(2.0), zoom)


def tile_bounds(x: Column, y: Column, zoom: Column, tile: int = 256) -> tuple[Column, Column, Column, Column]:
    """West, south, east, north; y grows to the north."""
    side = tile_resolution(zoom, tile) * tile
    return -180 + x * side, -90 + y * side, -180 + (x + 1) * side, -90 + (y + 1) * side


def tile_range(west: Column, south: Column, east: Column, north: Column, zoom: Column, tile: int = 256) -> tuple[Column, Column, Column, Column]:
    """First and last x and y of the tiles that a box meets."""
    side = tile_resolution(zoom, tile) * tile
    low = lambda v, o: F.floor((v - o) / side)
    high = lambda v, o: F.ceil((v - o) / side) - 1
    x0, y0 = low(west, -180), low(south, -90)
    return x0, y0, F.greatest(x0, high(east, -180)), F.greatest(y0, high(north, -90))


def native_zoom(metres: Column, latitude: Column, tile: int = 256) -> Column:
    """The zoom whose pixels are nearest to a ground distance, 0 to 22."""
    degrees = metres / (111320.0 * F.greatest(F.cos(F.radians(latitude)), F.lit(0.2)))
    return F.least(F.greatest(F.bround(F.log2(180.0 / tile / degrees)), F.lit(0.0)), F.lit(22.0)).cast("int")


def approximate_gsd(degrees: Column, latitude: Column) -> Column:
    return degrees * 111320.0 * F.abs(F.cos(F.radians(latitude)))


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    radius = 6378137.0
    return F.radians(lon) * radius, F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * radius


def utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing on WGS 84 by the series in the third flattening, to millimetres in the zone."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon) - math.radians(6 * zone - 183)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + 0.9996 * radius * east, (10_000_000 if south else 0) + 0.9996 * radius * north


def counter_clockwise(a: Column, b: Column) -> Column:
    """The turn from heading a to b in [0, 2 pi)."""
    return F.pmod(b - a, 2 * F.pi())


def separation(a: Column, b: Column) -> Column:
    """The angle between two headings in [0, pi]."""
    turn = counter_clockwise(a, b)
    return F.least(turn, 2 * F.pi() - turn)


def max_level(width: Column, height: Column) -> Column:
    return F.ceil(F.log2(F.greatest(width, height))).cast("int")
