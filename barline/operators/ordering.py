"""Ranks and exact quantiles over groups that may not fit one task.

A window ordered by the value would pull a whole group (say, every name of a
session) into one task. Here a group is cut into value ranges first:

1. equal values collapse into one counted row (map-side), so ties are harmless;
2. a quantile sketch per group, merged from partial sketches, gives cut points;
3. running counts are taken inside each (group, range), and ranges are offset by
   the totals of the ranges below - a table of ``buckets`` rows per group.

The cut points only balance the work. The table with every value's range is written
once and read for both the running counts and the offsets: two evaluations of a sketch
may differ, and counts would then belong to other ranges than their offsets. Ranks and
quantiles are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.cols import attach
from barline.session import durable


def value_ranks(df: DataFrame, group: Sequence[str], value: str, buckets: int = 32) -> DataFrame:
    """(group, value, cnt, below, total): counts of equal, smaller and all values."""
    group = list(group)
    if {value, *group} & {"cnt", "below", "total", "cuts", "bucket", "offset"}:
        raise ValueError("rename the columns: cnt, below, total, cuts, bucket and offset are used here")
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("cnt"))
    )
    probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = counts.groupBy(*group).agg(
        F.percentile_approx(value, probs, 1000).alias("cuts"), F.sum("cnt").alias("total")
    )
    placed = counts.join(cuts, group) if group else attach(counts, cuts)
    placed = placed.withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")
    placed = durable(placed, "value-ranges")
    inside = Window.partitionBy(*group, "bucket").orderBy(value)
    running = placed.withColumn(
        "in_bucket", F.sum("cnt").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cnt")
    )
    offsets = placed.groupBy(*group, "bucket").agg(F.sum("cnt").alias("bucket_n"))
    # at most `buckets` rows per group
    before = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(
        *group, "bucket", F.coalesce(F.sum("bucket_n").over(before), F.lit(0)).alias("offset")
    )
    return running.join(offsets, [*group, "bucket"]).select(
        *group, value, "cnt", (F.col("offset") + F.col("in_bucket")).alias("below"), "total"
    )


def average_rank(
    df: DataFrame, group: Sequence[str], value: str, out: str, least: int = 1, percent: bool = False
) -> DataFrame:
    """Average-tie rank of ``value`` inside ``group`` (NULL for NULL values).

    ``percent`` divides by the group's count; groups with fewer than ``least``
    values get NULL.
    """
    group = list(group)
    ranks = value_ranks(df, group, value)
    rank = F.col("below") + (F.col("cnt") + 1) / 2
    rank = rank / F.col("total") if percent else rank
    ranks = ranks.select(*group, value, F.when(F.col("total") >= least, rank).alias(out))
    return df.join(ranks, [*group, value], "left")


def window_rank(group: Sequence[str], value: Column | str, least: int = 1, percent: bool = False) -> Column:
    """The same rank as one window expression.

    Only for groups whose size is fixed by construction (a basket universe, one
    symbol's calendar).
    """
    c = F.col(value) if isinstance(value, str) else value
    g = list(group)
    whole = Window.partitionBy(*g)
    rank = F.rank().over(Window.partitionBy(*g).orderBy(c.asc_nulls_last()))
    ties = F.count(c).over(Window.partitionBy(*g, c))
    n = F.count(c).over(whole)
    r = rank + (ties - 1) / 2
    r = r / n if percent else r
    return F.when(c.isNotNull() & (n >= least), r)


def exact_quantiles(
    df: DataFrame, group: Sequence[str], value: str, probs: dict[str, float], buckets: int = 32
) -> DataFrame:
    """Linear-interpolated exact quantiles per group, one column per entry of ``probs``."""
    group = list(group)
    ranks = value_ranks(df, group, value, buckets)
    aggs = [F.max("total").alias("n")]
    for name, p in probs.items():
        where = F.lit(float(p)) * (F.col("total") - 1)
        for side, k in (("lo", F.floor(where)), ("hi", F.ceil(where))):
            hit = (F.col("below") <= k) & (k < F.col("below") + F.col("cnt"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{side}"))
    out = ranks.groupBy(*group).agg(*aggs) if group else ranks.agg(*aggs)
    cols = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return out.select(*group, "n", *cols)
