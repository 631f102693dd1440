"""Scalar column expressions with the numeric rules of the data model: missing is NULL, infinities stay."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def number(c: Column) -> Column:
    """As double, NaN as missing."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def log1p(c: Column) -> Column:
    """log(1 + x), with -inf at -1, where the built-in gives NULL."""
    return F.when(c == -1, F.lit(-INFINITY)).otherwise(F.log1p(c))


def power(x: Column, a: Column, b: Column) -> Column:
    """a * x ** b."""
    return a * F.pow(x, b)


def positive_finite(c: Column) -> Column:
    """Above zero, and neither missing, NaN (which sorts above all numbers) nor infinite."""
    return F.coalesce((c > 0) & (c < INFINITY) & ~F.isnan(c), F.lit(False))


def positive(c: Column) -> Column:
    """Above zero; infinity passes, NaN doesn't."""
    return F.coalesce((c > 0) & ~F.isnan(c), F.lit(False))


def is_infinite(c: Column) -> Column:
    return F.coalesce(F.abs(c) == INFINITY, F.lit(False))


def chebyshev(i: Column, n: Column, low: Column, high: Column) -> Column:
    """Node i (from 0, ascending) of n Chebyshev nodes on [low, high]."""
    k = n - 1 - i
    return 0.5 * (low + high) + 0.5 * (high - low) * F.cos((2 * k + 1) * math.pi / (2 * n))
