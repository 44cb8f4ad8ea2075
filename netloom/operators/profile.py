"""Dataset profiles: everything about all columns from one long aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, FloatType

from netloom.functions import constants as K
from netloom.functions.exprs import is_infinite

FULL_LISTING = 100
TOP = 20


def class_histogram(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count("*").alias("rows"))
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy(F.lit(1))))


def label_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if any(word in c.lower() for word in K.LABEL_COLUMN_WORDS)]


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, rows) over all columns, NULL counted as a value.

    Repeated values collapse before the shuffle, so a column of zeros costs one
    row per task.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells)).groupBy("column", "value").agg(F.count("*").alias("rows"))


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or df.columns
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    names = F.create_map(*[F.lit(x) for c in columns for x in (c, types[c])])
    return value_counts(df, columns).groupBy("column").agg(
        F.sum(F.when(F.col("value").isNull(), F.col("rows")).otherwise(0)).alias("null_count"),
        F.count("*").alias("unique_count")).withColumn("dtype", F.element_at(names, F.col("column")))


def approximate_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null counts and approximate distinct counts: a single row leaves each task."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{k}") for k, c in enumerate(columns)],
                 *[F.approx_count_distinct(c).alias(f"d_{k}") for k, c in enumerate(columns)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n_{k}").alias("null_count"), F.col(f"d_{k}").alias("about_unique"))
        for k, c in enumerate(columns)])))


def top_values(df: DataFrame, column: str) -> DataFrame:
    """All values when there are at most 100, else the top 20, with percentages."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("rows"))
    totals = counts.agg(F.count("*").alias("distinct"), F.sum("rows").alias("all_rows"))
    most = counts.orderBy(F.desc("rows"), F.asc("value")).limit(FULL_LISTING)
    # At most 100 rows and one row of totals meet here.
    placed = most.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rows"), F.asc("value"))))
    joined = placed.withColumn("one", F.lit(1)).join(F.broadcast(totals.withColumn("one", F.lit(1))), "one")
    return joined.filter((F.col("distinct") <= FULL_LISTING) | (F.col("place") <= TOP)).select(
        "value", "rows", (F.col("rows") / F.col("all_rows") * 100).alias("percent"))


def infinity_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    if columns is None:
        columns = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    row = df.agg(*[F.count_if(is_infinite(F.col(c))).alias(f"i_{k}") for k, c in enumerate(columns)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"i_{k}").alias("infinities")) for k, c in enumerate(columns)])))


def sample_rows(df: DataFrame, rows: int = 5, by: list[str] | None = None) -> DataFrame:
    """Any few rows, or the first ones in the order of ``by``."""
    return (df.orderBy(*by) if by else df).limit(rows)
