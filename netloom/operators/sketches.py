"""Profiles that merge: per-day sketches of every column, stored once, answer for any range of days.

A row holds one day and column: exact counts of rows, NULLs and infinities, a HyperLogLog of the values as text,
and for numbers a KLL sketch of the finite ones. Merging rows of several days gives what one pass over all their
rows would give, within the sketches' error, without reading the rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from netloom.functions.exprs import is_finite, is_infinite

#: HyperLogLog of 2 ** HLL_BITS cells errs by about 1.04 / sqrt(2 ** HLL_BITS); KLL ranks by about 1.7 / KLL_K.
HLL_BITS, KLL_K = 14, 800
RANK_ERROR, DISTINCT_ERROR = 0.01, 0.05


def daily_profile(df: DataFrame, day: str, columns: list[str]) -> DataFrame:
    """day, column, rows, null_count, infinities, distinct (sketch) and ranks (sketch; NULL where nothing is a number).

    One pass and one shuffle of a row for each task, day and column: columns are aggregated side by side.
    """
    numeric = {f.name for f in df.schema if isinstance(f.dataType, NumericType)}
    items = []
    for c in columns:
        value = F.col(f"`{c}`")
        number = value.cast("double") if c in numeric else F.lit(None).cast("double")
        items.append((c, [
            F.count(F.lit(1)), F.count_if(value.isNull()), F.coalesce(F.count_if(is_infinite(number)), F.lit(0)),
            F.hll_sketch_agg(value.cast("string"), HLL_BITS), F.kll_sketch_agg_double(F.when(is_finite(number), number), KLL_K)]))
    names = ["rows", "null_count", "infinities", "distinct", "ranks"]
    wide = df.groupBy(F.col(day).alias("day")).agg(*[
        a.alias(f"{name}_{i}") for i, (_, aggregates) in enumerate(items) for name, a in zip(names, aggregates)])
    long = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{name}_{i}").alias(name) for name in names])
                     for i, (c, _) in enumerate(items)])
    return wide.select("day", F.inline(long))


def merged_profile(daily: DataFrame, fractions: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """column, rows, null_count, infinities, about_unique and quantiles of all given days together."""
    parts = daily.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("null_count").alias("null_count"), F.sum("infinities").alias("infinities"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("ranks").alias("ranks"))
    return parts.select("column", "rows", "null_count", "infinities", F.hll_sketch_estimate("distinct").alias("about_unique"),
                        quantiles(F.col("ranks"), fractions).alias("quantiles"))


def quantiles(ranks: Column, fractions: tuple[float, ...]) -> Column:
    """Values at ``fractions`` of the sketched numbers; NULL if there are none."""
    some = F.kll_sketch_get_n_double(ranks) > 0
    return F.when(some, F.array(*[F.kll_sketch_get_quantile_double(ranks, F.lit(f)) for f in fractions]))
