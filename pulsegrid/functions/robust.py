"""Robust statistics as column expressions: medians and deviations of arrays, padded with zeros, and sketches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body) -> Column:
    """body of a value that is computed once: Spark would compute it anew wherever a lambda names it."""
    return F.transform(F.array(value), body)[0]


def _middle(ordered: Column) -> Column:
    n = F.size(ordered)
    low = F.element_at(ordered, F.greatest(F.floor((n + 1) / 2).cast("int"), F.lit(1)))
    high = F.element_at(ordered, F.greatest(F.floor(n / 2).cast("int") + 1, F.lit(1)))
    return F.when(n > 0, (low + high) / 2.0)


def array_median(values: Column) -> Column:
    """Interpolated median of an array without nulls; null for an empty one."""
    return _let(F.sort_array(values), _middle)


def array_mad(values: Column) -> Column:
    """Median absolute deviation from the median."""
    return _let(array_median(values), lambda middle: array_median(F.transform(values, lambda x: F.abs(x - middle))))


def zero_padded(values: Column, n: Column) -> Column:
    """The values and as many zeros as make n of them: an absent observation counts as zero."""
    zeros = F.array_repeat(F.lit(0).cast("long"), F.greatest(n - F.size(values), F.lit(0)).cast("int"))
    return F.concat(values.cast("array<bigint>"), zeros)


def population_cv(total: Column, squares: Column, n: Column | float) -> Column:
    """Coefficient of variation over n slots from a sum and a sum of squares; absent slots are zero."""
    mean = total / n
    return F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0))) / mean


def quotient(a: Column, b: Column) -> Column:
    """a / b as doubles, by zero as well: infinite, or NaN of zero by zero."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def linear_count(bits: Column, size: int = 64) -> Column:
    """Distinct values from a bitmap of so many bits; a full one counts as size."""
    ones = F.bit_count(bits)
    return F.when(ones >= size, F.lit(float(size))).otherwise(-size * F.log(1 - ones / size))


def bitmap(key: Column, size: int = 64) -> Column:
    """Aggregate: a bitmap with one bit for each value's remainder."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(key, F.lit(size)).cast("int")))


def lower_rank(values: Column, q: float) -> Column:
    """The value at rank floor(q * n), counted from zero, of an array."""
    n = F.size(values)
    return F.element_at(F.sort_array(values), F.least(F.floor(n * q).cast("int") + 1, n))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def logit(p: Column, clip: float = 1e-6) -> Column:
    p = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.log(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_scale(x: Column, low: float = 8.0, high: float = 5000.0) -> Column:
    """ln(x / low) / ln(high / low), held between 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log(x / low) / F.log(F.lit(high / low))))


def hash_bucket(key: Column, buckets: int) -> Column:
    """A bucket from 0 on of a text, by the first 32 bits of its MD5: the same wherever it is computed."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % buckets
