"""Per-pixel expressions: colour indices, classes, blends, entropy. All are columns, none needs Python rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def excess_green(r: Column, g: Column, b: Column) -> Column:
    return 2 * g - r - b


def not_road(r: Column, g: Column, b: Column) -> Column:
    """Vegetation, water, strong red or magenta."""
    vegetation = (g >= r + 6) & (g >= b + 6) & (excess_green(r, g, b) >= 12)
    water = (b >= g + 16) & (b >= r + 30) & (b >= 48)
    red = (r >= g + 28) & (r >= b + 28) & (r >= 70)
    magenta = (r >= g + 22) & (b >= g + 22) & (F.greatest(r, b) >= 70)
    return vegetation | water | red | magenta


def pavement(r: Column, g: Column, b: Column) -> Column:
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    return ~not_road(r, g, b) & ~((g >= r + 3) & (g >= b + 3)) & ~((high >= 30) & (high - low >= 50))


def lab(r: Column, g: Column, b: Column) -> Column:
    """8-bit CIELAB (D65) of sRGB as struct(l, a, b): L scaled by 255/100, a and b moved by 128, rounded."""

    def linear(v: Column) -> Column:
        v = v / 255.0
        return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92)

    def curve(t: Column) -> Column:
        return F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0)

    lr, lg, lb = linear(r), linear(g), linear(b)
    x = curve((0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456)
    y0 = 0.212671 * lr + 0.715160 * lg + 0.072169 * lb
    y = curve(y0)
    z = curve((0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754)
    light = F.when(y0 > 0.008856, 116 * F.cbrt(y0) - 16).otherwise(903.3 * y0)
    eight = lambda v: F.least(F.greatest(F.round(v), F.lit(0)), F.lit(255)).cast("int")
    return F.struct(eight(light * 2.55).alias("l"), eight(500 * (x - y) + 128).alias("a"), eight(200 * (y - z) + 128).alias("b"))


def entropy(p: Column, clip: float = 1e-6) -> Column:
    """Binary entropy in nats, p clipped away from 0 and 1."""
    p = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return -(p * F.ln(p) + (1 - p) * F.ln(1 - p))


def glow(x: Column) -> Column:
    return F.least(F.greatest(1.25 * x + 40, F.lit(0.0)), F.lit(255.0))


def blend(x: Column, tint: int, alpha: Column) -> Column:
    """The brightened value mixed with a tint; truncated."""
    return (glow(x) * (1 - alpha) + F.lit(float(tint)) * alpha).cast("int")


def hann(i: Column, n: int) -> Column:
    """The i-th of n weights of a Hann window; a window of one is 1."""
    return F.lit(1.0) if n == 1 else 0.5 - 0.5 * F.cos(2 * F.pi() * i / (n - 1))


def stretched(v: Column, low: Column, high: Column) -> Column:
    """0..255 between two percentiles, clipped and truncated; equal percentiles span 1; null and NaN are 0."""
    span = F.when(high <= low, F.lit(1.0)).otherwise(high - low)
    unit = F.least(F.greatest((v - low) / span, F.lit(0.0)), F.lit(1.0))
    return F.coalesce(F.when(~F.isnan(v), (unit * 255).cast("int")), F.lit(0))


def preview_scale(top: Column) -> Column:
    """What 16-bit, 8-bit or unit values are divided by, from their maximum."""
    return F.when(top <= 1.5, 1.0).when(top <= 255, 255.0).otherwise(65535.0)


def normalized_mask(v: Column, top: Column) -> Column:
    """0/1 of a mask stored as 0/1 or 0/255."""
    return F.when(top > 1, (v > 127).cast("int")).otherwise((v > 0).cast("int"))
