"""Colour spaces as column expressions over red, green and blue in 0..255."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def grey(r: Column, g: Column, b: Column) -> Column:
    """Luma in fixed point with 14 bits (weights 0.299, 0.587, 0.114), rounded."""
    return F.shiftright((r * 4899 + g * 9617 + b * 1868 + 8192).cast("long"), 14)


def optical_density(x: Column) -> Column:
    return -F.ln((x + 1) / 255.0)


def hsi(r: Column, g: Column, b: Column, eps: float = 1e-6) -> tuple[Column, Column, Column]:
    """Hue in 0..1, saturation and intensity; the hue of greys is 0."""
    total = r + g + b + eps
    rn, gn, bn = r / total, g / total, b / total
    top = 0.5 * ((rn - gn) + (rn - bn))
    bottom = F.sqrt((rn - gn) * (rn - gn) + (rn - bn) * (gn - bn))
    angle = F.acos(F.least(F.greatest(top / (bottom + eps), F.lit(-1.0)), F.lit(1.0)))
    hue = F.when((r == g) & (g == b), F.lit(0.0)).otherwise(F.when(b > g, 2 * pi - angle).otherwise(angle) / (2 * pi))
    return hue, 1 - 3 * F.least(rn, gn, bn), (r + g + b) / 765.0


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees halved (0..179), saturation and value in 0..255."""
    v, low = F.greatest(r, g, b), F.least(r, g, b)
    d = (v - low).cast("double")
    degrees = F.when(d == 0, F.lit(0.0)).when(v == r, F.try_divide(60 * (g - b), d)).when(v == g, 120 + F.try_divide(60 * (b - r), d)).otherwise(240 + F.try_divide(60 * (r - g), d))
    degrees = F.when(degrees < 0, degrees + 360).otherwise(degrees)
    hue = F.floor(degrees / 2 + 0.5).cast("long") % 180
    return hue, F.when(v == 0, F.lit(0)).otherwise(F.floor(F.try_divide(255 * d, v.cast("double")) + 0.5)).cast("long"), v


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*a*b* of sRGB under D65."""
    linear = lambda c: F.when(c / 255.0 > 0.04045, F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 255.0 / 12.92)
    rl, gl, bl = linear(r), linear(g), linear(b)
    x = (0.412453 * rl + 0.357580 * gl + 0.180423 * bl) / 0.95047
    y = 0.212671 * rl + 0.715160 * gl + 0.072169 * bl
    z = (0.019334 * rl + 0.119193 * gl + 0.950227 * bl) / 1.08883
    f = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)
    return 116 * f(y) - 16, 500 * (f(x) - f(y)), 200 * (f(y) - f(z))
