"""Neighbour access on raw tick streams without one task per symbol.

A symbol that holds a third of all ticks cannot be one window group. Its stream
is cut into time slices; windows run inside a slice, and what crosses a slice
border is carried by a table with one row per (symbol, slice).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def minute_slice(ts: str = "ts") -> Column:
    return F.date_trunc("minute", F.col(ts))


def sliced_lag(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], slice_col: str = "slice"
) -> DataFrame:
    """Adds ``prev_<value>``: the value of the preceding row of the same key."""
    keys, order = list(keys), list(order)
    inside = Window.partitionBy(*keys, slice_col).orderBy(*order)
    packed = F.struct(*[F.col(v).alias(v) for v in values])
    tails = df.groupBy(*keys, slice_col).agg(F.max_by(packed, F.struct(*order)).alias("_tail"))
    carry = tails.select(
        *keys, slice_col, F.lag("_tail").over(Window.partitionBy(*keys).orderBy(slice_col)).alias("_carry")
    )
    local = df.withColumn("_prev", F.lag(packed).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    out = local.join(carry, [*keys, slice_col], "left")
    prev = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev"))
    return out.select(df["*"], *[prev.getField(v).alias(f"prev_{v}") for v in values])


def sliced_running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, str], slice_col: str = "slice"
) -> DataFrame:
    """Adds running totals (current row included) of ``sums``: {new column: value column}."""
    keys, order = list(keys), list(order)
    inside = Window.partitionBy(*keys, slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, slice_col).agg(*[F.sum(v).alias(f"_t_{o}") for o, v in sums.items()])
    carry = totals.select(
        *keys, slice_col, *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0.0)).alias(f"_c_{o}") for o in sums]
    )
    local = df.select("*", *[F.sum(v).over(inside).alias(f"_l_{o}") for o, v in sums.items()])
    out = local.join(carry, [*keys, slice_col], "left")
    return out.select(df["*"], *[(F.col(f"_l_{o}") + F.col(f"_c_{o}")).alias(o) for o in sums])
