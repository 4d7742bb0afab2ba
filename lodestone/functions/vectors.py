"""Vector functions over arrays, computed in double and without exploding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))


def mean(v: Column) -> Column:
    return F.try_divide(total(v), F.size(v))


def moment(v: Column, middle: Column, power: int) -> Column:
    """The mean of (x - middle) to a power."""

    def term(x: Column) -> Column:
        out = x - middle
        for _ in range(power - 1):
            out = out * (x - middle)
        return out

    return F.try_divide(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + term(x)), F.size(v))


def entropy(v: Column) -> Column:
    """Entropy of the absolute values as a distribution, with a small offset."""
    p = F.transform(v, lambda x: F.abs(x) + 1e-8)
    return F.log(total(p)) - F.try_divide(total(F.transform(p, lambda x: x * F.log(x))), total(p))


def share(v: Column, condition) -> Column:
    return F.try_divide(F.size(F.filter(v, condition)), F.size(v))


def quantile(ordered: Column, q: float) -> Column:
    """Linear interpolation at q of a sorted array."""
    at = (F.size(ordered) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    below, above = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return below + (above - below) * (at - low)


def differences(v: Column) -> Column:
    return F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: b - a)


def correlation(x: Column, y: Column) -> Column:
    mx, my = mean(x), mean(y)
    both = total(F.zip_with(x, y, lambda a, b: (a - mx) * (b - my))) / F.size(x)
    size = F.sqrt(moment(x, mx, 2)) * F.sqrt(moment(y, my, 2))
    return F.when(size == 0, 0.0).otherwise(both / size)
