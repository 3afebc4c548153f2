"""Arithmetic on array<double> Columns that stays in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqsift.model import Distance

#: Vectors up to this length are written out term by term, which compiles; longer ones fold.
UNROLL = 16


def _fold(x: Column, y: Column, term, n: int | None) -> Column:
    if n is not None and 0 < n <= UNROLL:
        total = term(F.get(x, F.lit(0)), F.get(y, F.lit(0)))
        for i in range(1, n):
            total = total + term(F.get(x, F.lit(i)), F.get(y, F.lit(i)))
        return total
    return F.aggregate(F.zip_with(x, y, term), F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column, n: int | None = None) -> Column:
    return _fold(x, y, lambda a, b: a * b, n)


def squared_norm(x: Column, n: int | None = None) -> Column:
    return dot(x, x, n)


def squared_euclidean(x: Column, y: Column, n: int | None = None) -> Column:
    """From the differences themselves: no cancellation of large norms."""
    return _fold(x, y, lambda a, b: (a - b) * (a - b), n)


def normed_euclidean(x: Column, y: Column, norm_x: Column, norm_y: Column, n: int | None = None) -> Column:
    """2 - 2 cos; null where a norm is 0."""
    return 2.0 - F.try_divide(2.0 * dot(x, y, n), norm_x * norm_y)


def _directed(a: Column, b: Column) -> Column:
    # a ln(a/b) where that is a number; 0 ln(0/b) is 0, and a ln(a/0) has no bound.
    ratio = F.try_divide(a, b)
    return F.when(b == 0, F.when(a > 0, F.lit(math.inf)).otherwise(0.0)).when(ratio > 0, a * F.log(ratio)).otherwise(0.0)


def kullback_leibler(x: Column, y: Column, n: int | None = None, symmetric: bool = True) -> Column:
    term = (lambda a, b: (_directed(a, b) + _directed(b, a)) / 2.0) if symmetric else _directed
    return _fold(x, y, term, n)


def distance(kind: Distance, x: Column, y: Column, norm_x: Column, norm_y: Column, n: int | None = None, asymmetric: bool = False) -> Column:
    if kind is Distance.DOT:
        return dot(x, y, n)
    if kind is Distance.NORMED:
        return normed_euclidean(x, y, norm_x, norm_y, n)
    if kind is Distance.EUCLIDEAN:
        return squared_euclidean(x, y, n)
    return kullback_leibler(x, y, n, not asymmetric)


def is_distance(d: Column) -> Column:
    """Neither null nor NaN; infinite ones count."""
    return d.isNotNull() & ~F.isnan(d)


def threshold_estimate(mean_n: float, d: float, variance: float) -> float:
    """A radius from the number of sampled distances, their fitted degrees of freedom and their variance:
    the first percentile of the least of ``mean_n`` draws from a gamma-like tail."""
    w = (-math.log(0.99)) ** (2 / d)
    return math.exp(math.log(variance) + math.log(w) - 2 / d * math.log(mean_n) - math.log(d / 2) - 2 / d * math.log(2 / d) + 2 / d * math.lgamma(d / 2))
