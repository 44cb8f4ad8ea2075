"""Sample variance from exact integer sums, so results do not depend on order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WIDE = "decimal(38,0)"


def sample_variance(count: Column, total: Column, squares: Column) -> Column:
    """Variance of ``count`` integers given their sum and sum of squares; 0 below two.

    The squares are centred on the integer mean before leaving exact arithmetic.
    """
    n = count.cast("bigint")
    safe = F.greatest(n, F.lit(2).cast("bigint"))
    mean = F.floor(total / safe).cast("bigint")
    rest = total - safe * mean
    centred = (
        squares.cast(WIDE)
        - (F.lit(2) * mean).cast(WIDE) * total.cast(WIDE)
        + (safe.cast(WIDE) * mean.cast(WIDE)).cast(WIDE) * mean.cast(WIDE)
    )
    spread = centred.cast("double") - (rest.cast("double") * rest.cast("double")) / safe.cast("double")
    return F.when(n > 1, F.greatest(spread, F.lit(0.0)) / (safe - 1).cast("double")).otherwise(0.0)


def mean(count: Column, total: Column) -> Column:
    return F.when(count > 0, total.cast("double") / count.cast("double")).otherwise(0.0)
