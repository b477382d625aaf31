"""Distances between array columns, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(a: Column, b: Column, term: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, t: s + t)


def l1(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y)))


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def norm2(a: Column) -> Column:
    """Squared length."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """One less the cosine; null if a vector is zero."""
    return 1 - dot(a, b) / F.nullif(F.sqrt(norm2(a) * norm2(b)), F.lit(0.0))


def unit(a: Column) -> Column:
    n = F.sqrt(norm2(a))
    return F.transform(a, lambda x: x.cast("double") / n)


#: Distances by name.
DISTANCES: dict[str, Callable[[Column, Column], Column]] = {"l1": l1, "euclidean": euclidean, "cosine": cosine}
