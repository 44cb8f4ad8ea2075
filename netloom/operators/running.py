"""Running aggregates over an ordered key, in one window or split over slices.

A plain window puts a whole key into one task. For keys too large for that, the
key is cut into slices; each slice is windowed on its own and receives the
combined totals of the slices before it, one row per slice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Running:
    """One running column: ``kind`` is last (non-null), sum, max, min or gather.

    ``gather`` joins arrays; use it only where their joint length is bounded.
    """

    kind: str
    value: Column
    inclusive: bool = True
    whole: bool = False   # the key's total instead of a running value

    def aggregate(self, value: Column) -> Column:
        if self.kind == "last":
            return F.last(value, ignorenulls=True)
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](value)

    def over(self, value: Column, frame) -> Column:
        if self.kind == "gather":
            return F.flatten(F.collect_list(value).over(frame))
        return self.aggregate(value).over(frame)

    def total(self, order: str) -> Column:
        if self.kind == "last":
            return F.max_by(self.value, F.when(self.value.isNotNull(), F.col(order)))
        if self.kind == "gather":
            row = F.struct(F.col(order).alias("at"), self.value.alias("value"))
            rows = F.array_sort(F.collect_list(F.when(self.value.isNotNull(), row)))
            return F.flatten(F.transform(rows, lambda row: row["value"]))
        return self.aggregate(self.value)

    def combine(self, here: Column, before: Column) -> Column:
        if self.kind == "last":
            return F.coalesce(here, before)
        if self.kind == "gather":
            return F.concat(F.coalesce(before, F.array().cast("array<binary>")), here)
        if self.kind == "sum":
            return F.when(here.isNull(), before).when(before.isNull(), here).otherwise(here + before)
        return (F.greatest if self.kind == "max" else F.least)(here, before)


def running(df: DataFrame, key: list[str], order: str, columns: dict[str, Running],
            slice_column: str | None = None) -> DataFrame:
    """Add running ``columns``; with ``slice_column`` no task sees a whole key."""
    part = key + ([slice_column] if slice_column else [])
    window = Window.partitionBy(*part).orderBy(order)
    frames = {
        True: window.rowsBetween(Window.unboundedPreceding, Window.currentRow),
        False: window.rowsBetween(Window.unboundedPreceding, -1),
    }
    if slice_column is None:
        everything = Window.partitionBy(*key)
        return df.select("*", *[
            run.over(run.value, everything if run.whole else frames[run.inclusive]).alias(name)
            for name, run in columns.items()
        ])
    local = df.select("*", *[
        run.over(run.value, frames[run.inclusive]).alias(name)
        for name, run in columns.items() if not run.whole
    ])
    totals = df.groupBy(*part).agg(*[run.total(order).alias(name) for name, run in columns.items()])
    earlier = Window.partitionBy(*key).orderBy(slice_column).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*key)
    carried = totals.select(*part, *[
        run.over(F.col(name), everything if run.whole else earlier).alias(f"_before_{name}")
        for name, run in columns.items()
    ])
    joined = local.join(carried, part, "inner")
    return joined.select(*df.columns, *[
        (F.col(f"_before_{name}") if run.whole
         else run.combine(F.col(name), F.col(f"_before_{name}"))).alias(name)
        for name, run in columns.items()
    ])
