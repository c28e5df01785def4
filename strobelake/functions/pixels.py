"""Column expressions over the pixels of a frame, all of them JVM-side."""

from __future__ import annotations

from math import tau

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")


def is_finite(x: Column) -> Column:
    """Spark's isnan is false for infinities, so those are compared by value."""
    return ~F.isnan(x) & (F.abs(x) != F.lit(_INF))


def _ends_finite(data: Column) -> Column:
    """True where the least and the greatest pixel are finite, and so all are: NaN counts as the greatest. Null for an empty frame."""
    return is_finite(F.array_min(data)) & is_finite(F.array_max(data))


def all_finite(data: Column) -> Column:
    """True for an empty frame; null pixels aside. Pixels are looked at one by one only where an end is not finite."""
    return F.when(_ends_finite(data), F.lit(True)).otherwise(F.forall(data, is_finite))


def finite_min(data: Column) -> Column:
    """The least finite pixel as double, or null."""
    return F.when(_ends_finite(data), F.array_min(data)).otherwise(F.array_min(F.filter(data, is_finite))).cast("double") + F.lit(0.0)


def finite_max(data: Column) -> Column:
    return F.when(_ends_finite(data), F.array_max(data)).otherwise(F.array_max(F.filter(data, is_finite))).cast("double") + F.lit(0.0)


def to_radians(data: Column, unit: Column, height_scale: Column) -> Column:
    """Pixels in radians: metres (and nanometres) over the height of one radian."""
    per_metre = F.transform(data, lambda v: (v / height_scale).cast("float"))
    per_nano = F.transform(data, lambda v: (v * F.lit(1e-9) / height_scale).cast("float"))
    return F.when(unit == "m", per_metre).when(unit == "nm", per_nano).otherwise(data)


def scale_between(data: Column, source_min: Column, source_max: Column, target: tuple[float, float], integer: bool) -> Column:
    """Min-max scaling with clamping; integer targets round half to even."""
    low, high = target

    def one(v: Column) -> Column:
        share = (v.cast("double") - source_min) / (source_max - source_min)
        out = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * F.lit(float(high - low)) + F.lit(float(low))
        return F.rint(out) if integer else out

    return F.transform(data, one)


def times(data: Column, factor: float) -> Column:
    return F.transform(data, lambda v: v * F.lit(factor))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def product(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def square(a: Column) -> Column:
    return F.transform(a, lambda x: x * x)


def total(data: Column) -> Column:
    return F.aggregate(data, F.lit(0.0), lambda s, x: s + x)


def mean(data: Column) -> Column:
    return F.when(F.size(data) > 0, total(data) / F.size(data))


def drymass_factor(pixel_size: float, wavelength: float, alpha: float) -> float:
    """Picograms a radian: path difference in micrometres, times area, over the refraction increment."""
    return wavelength / tau / 1000 * pixel_size**2 / alpha


def opd_factor(wavelength: float) -> float:
    """Nanometres of optical path a radian."""
    return wavelength / tau


def height_factor(wavelength: float, refractive_delta: float) -> float:
    """Micrometres of height a radian of phase change, with the factor of one half."""
    return 0.0005 * wavelength / (tau * refractive_delta)
