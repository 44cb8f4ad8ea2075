"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INFINITY = float("inf")


def is_infinite(value: Column) -> Column:
    return F.coalesce(F.abs(value) == F.lit(INFINITY), F.lit(False))


def is_finite(value: Column) -> Column:
    """False for NULL, NaN and both infinities."""
    return value.isNotNull() & ~F.isnan(value) & ~is_infinite(value)


def strip(value: Column) -> Column:
    """Strip every kind of surrounding whitespace, not spaces alone."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def clip(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where the denominator is 0."""
    return F.when(bottom == 0, 0.0).otherwise(
        top.cast("double") / F.when(bottom != 0, bottom).cast("double"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def shuffle_key(seed: int | str, *columns: str) -> Column:
    """A reproducible random order: md5 of the seed and the row's key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))
