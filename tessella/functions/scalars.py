"""Scalar rules: half-even rounding, normalisation, affine maps, angles."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def fixed(x: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def normalized_pixel(x: Column, size: int) -> Column:
    """[0, 1] to a pixel index, half to even."""
    return F.bround(clamp(x, 0.0, 1.0) * (size - 1)).cast("int")


def clean_number(x: Column) -> Column:
    return F.when(F.abs(x) < 5e-10, F.lit(0.0)).otherwise(F.bround(x, 9))


def stretched(df: DataFrame, value: str, keys: Sequence[str], out: str, flat: float, finite_only: bool = False) -> DataFrame:
    """Clip to the 2nd and 98th percentile of each group and scale to [0, 1]; ``flat`` where they coincide.

    With ``finite_only`` values that aren't finite give 0 and don't count.
    """
    ok = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")) if finite_only else F.lit(True)
    bounds = df.where(ok).groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.02), F.lit(0.98))).alias("__p"))
    lo, hi = F.col("__p")[0], F.col("__p")[1]
    scaled = clamp((F.col(value) - lo) / (hi - lo), 0.0, 1.0)
    made = F.when(hi - lo < 1e-6, F.lit(flat)).otherwise(scaled)
    return df.join(F.broadcast(bounds) if not keys else bounds, list(keys), "left").withColumn(out, F.when(ok, made).otherwise(0.0)).drop("__p") if keys else df.crossJoin(F.broadcast(bounds)).withColumn(out, F.when(ok, made).otherwise(0.0)).drop("__p")


def affine(col: Column, row: Column, m: Sequence[float]) -> tuple[Column, Column]:
    """Pixel to world by (a, b, c, d, e, f)."""
    a, b, c, d, e, f = m
    return col * a + row * b + c, col * d + row * e + f


def compose(first: Sequence[float], second: Sequence[float]) -> tuple[float, ...]:
    """The map that applies ``first``, then ``second``."""
    a, b, c, d, e, f = first
    g, h, i, j, k, m = second
    return (g * a + h * d, g * b + h * e, g * c + h * f + i, j * a + k * d, j * b + k * e, j * c + k * f + m)


def rotation_scale(source: tuple[float, float], target: tuple[float, float], degrees: float, sx: float, sy: float, dx: float = 0.0, dy: float = 0.0) -> tuple[float, ...]:
    """Rotate and scale about the source centre, move to the target centre, shift."""
    import math

    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    a, b, d, e = c * sx, -s * sy, s * sx, c * sy
    return (a, b, target[0] + dx - a * source[0] - b * source[1], d, e, target[1] + dy - d * source[0] - e * source[1])


def unit_normal(sx: Column, sy: Column) -> tuple[Column, Column, Column]:
    """Of a plane with these slopes."""
    n = F.greatest(F.sqrt(sx * sx + sy * sy + 1.0), F.lit(1e-8))
    return -sx / n, -sy / n, F.lit(1.0) / n


def angle(dot: Column, signed: bool = True) -> Column:
    """Degrees between unit vectors with this product."""
    return F.degrees(F.acos(clamp(dot if signed else F.abs(dot), -1.0, 1.0)))


def line_difference(a: Column, b: Column) -> Column:
    """Degrees between undirected lines."""
    d = F.pmod(a - b, F.lit(180.0))
    return F.least(d, 180.0 - d)


def line_orientation(dx: Column, dy: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))


def pitch(sx: Column, sy: Column) -> Column:
    return F.degrees(F.atan(F.sqrt(sx * sx + sy * sy)))


def aspect(sx: Column, sy: Column) -> Column:
    """Azimuth of the steepest descent, clockwise from north (the direction of growing y)."""
    return F.pmod(F.degrees(F.atan2(-sx, -sy)), F.lit(360.0))


def parse_location(text: Column) -> Column:
    """``lat, lon`` as a struct; null if it does not parse or is out of range."""
    parts = F.split(text, ",")
    lat, lon = (F.trim(F.get(parts, F.lit(i))).try_cast("double") for i in (0, 1))
    ok = (F.size(parts) == 2) & lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(ok, F.struct(lat.alias("latitude"), lon.alias("longitude")))


def swap_up(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Z-up to Y-up coordinates."""
    return x, z, -y


def swap_back(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return x, -z, y
