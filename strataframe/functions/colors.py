"""Colour expressions: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def saturation(r: Column, g: Column, b: Column) -> Column:
    return F.greatest(r, g, b) - F.least(r, g, b)


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luma, 0 to 1."""
    return (r * 0.2125 + g * 0.7154 + b * 0.0721) / 255.0


def gray_mean(r: Column, g: Column, b: Column) -> Column:
    """The plain mean, 0 to 255."""
    return (r + g + b) / 3.0


def linear(c: Column) -> Column:
    v = c / 255.0
    return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92)


# The sRGB to XYZ matrix's rows, the D65 white point, and CIE's knee and slope.
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.95047, 1.0, 1.08883)
KNEE, SLOPE, SHIFT = 0.008856, 7.787, 16 / 116


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*, a*, b*."""
    rgb = [linear(c) for c in (r, g, b)]

    def f(row: int) -> Column:
        t = (rgb[0] * XYZ[row][0] + rgb[1] * XYZ[row][1] + rgb[2] * XYZ[row][2]) / WHITE[row]
        return F.when(t > KNEE, F.pow(t, F.lit(1 / 3))).otherwise(t * SLOPE + SHIFT)

    fx, fy, fz = f(0), f(1), f(2)
    return fy * 116.0 - 16.0, (fx - fy) * 500.0, (fy - fz) * 200.0


def hue(r: Column, g: Column, b: Column) -> Column:
    """0 to 1; grays have 0."""
    top, spread = F.greatest(r, g, b), saturation(r, g, b).cast("double")
    part = (
        F.when(spread == 0, F.lit(0.0))
        .when(top == r, F.pmod((g - b) / F.nullif(spread, F.lit(0.0)), F.lit(6.0)))
        .when(top == g, (b - r) / F.nullif(spread, F.lit(0.0)) + 2.0)
        .otherwise((r - g) / F.nullif(spread, F.lit(0.0)) + 4.0)
    )
    return part / 6.0


def distance(a: list[Column], b: list[Column]) -> Column:
    """Squared Euclidean distance."""
    out = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        out = out + (x - y) * (x - y)
    return out
