"""Row functions over a vector column `array<double>`.

All are column expressions: they run inside the scan's task, never shuffle and never leave
the JVM.  sort_array, slice and concat are preferred where they do, since they take
part in code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10  # fixed value: the least denominator


def r6(c: Column) -> Column:
    """Six places, without a negative zero: sums in another order agree."""
    return F.round(c, 6) + F.lit(0.0)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return F.try_divide(total(x), F.size(x).cast("double"))


def variance(x: Column, ddof: int) -> Column:
    m = mean(x)
    squares = F.aggregate(F.transform(x, lambda v: (v - m) * (v - m)), F.lit(0.0), lambda a, v: a + v)
    return F.try_divide(squares, (F.size(x) - ddof).cast("double"))


def quantile(ordered: Column, p: float) -> Column:
    """Linear interpolation in a sorted array."""
    at = (F.size(ordered) - 1) * F.lit(float(p))
    low = F.floor(at).cast("int")
    a = F.get(ordered, low)
    b = F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return a + (b - a) * (at - low)


def median(x: Column) -> Column:
    return quantile(F.sort_array(x), 0.5)


def median_deviation(x: Column) -> Column:
    """Median of the distances to the median."""
    m = median(x)
    return median(F.transform(x, lambda v: F.abs(v - m)))


def count_below(x: Column, limit: float) -> Column:
    return F.size(F.filter(x, lambda v: v < limit)).cast("long")


def zeros(x: Column) -> Column:
    return F.size(F.filter(x, lambda v: v == 0)).cast("long")


def log1p(x: Column) -> Column:
    return F.transform(x, F.log1p)


def norm(x: Column, p: int) -> Column:
    return total(F.transform(x, F.abs)) if p == 1 else F.sqrt(total(F.transform(x, lambda v: v * v)))


def scaled(x: Column, by: Column) -> Column:
    """x / by; a zero divisor leaves zeros."""
    return F.transform(x, lambda v: F.coalesce(F.try_divide(v, by), F.lit(0.0)))


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def squared_distance(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def block_sort(x: Column, blocks: int) -> Column:
    """Each of the equal blocks sorted; an error if the length is not divisible."""
    width = (F.size(x) / blocks).cast("int")
    parts = F.concat(*[F.sort_array(F.slice(x, width * b + 1, width)) for b in range(blocks)])
    return F.when(F.size(x) % blocks == 0, parts).otherwise(F.raise_error(F.lit(f"the length is not divisible by {blocks}")))


def swap_halves(x: Column) -> Column:
    """The halves in the other order; an odd last entry stays last."""
    half = F.floor(F.size(x) / 2).cast("int")
    return F.concat(F.slice(x, half + 1, half), F.slice(x, F.lit(1), half), F.slice(x, half * 2 + 1, F.size(x) - half * 2))


def mask(x: Column) -> Column:
    """The zero pattern as text, 1 where a value is not zero."""
    return F.array_join(F.transform(x, lambda v: F.when(v == 0, "0").otherwise("1")), "")


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def softplus(c: Column) -> Column:
    """log(1 + exp(c)) without overflow."""
    return F.greatest(c, F.lit(0.0)) + F.log1p(F.exp(-F.abs(c)))
