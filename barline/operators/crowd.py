"""Contributor accuracy and weighted crowd signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.cols import attach


def contributor_weights(rows: DataFrame, last: int = 90, least: int = 5, bonus: float = 1.5, order: str = "seq") -> DataFrame:
    """Accuracy plus a bonus for being right against the crowd, from each user's newest predictions.

    ``rows(user, seq, predicted, actual)``. The per-user cut is a rank filter, which
    Spark also applies before the shuffle, so a very active user stays small.
    """
    newest = Window.partitionBy("user").orderBy(F.desc(order))
    recent = rows.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= last)
    crowd = rows.orderBy(F.desc(order)).limit(last).agg(F.avg("predicted").alias("_c"))
    right = F.when(F.signum("predicted") == F.signum("actual"), 1.0).otherwise(0.0)
    against = F.signum("predicted") != F.signum("_c")
    out = attach(recent, crowd).groupBy("user").agg(
        F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"),
        F.coalesce(F.avg(F.when(against, right)), F.lit(0.0)).alias("contrarian"),
    )
    return out.where(F.col("n") >= least).withColumn("weight", F.col("accuracy") + bonus * F.col("contrarian"))


def crowd_signal(signals: DataFrame, weights: DataFrame, unknown: float = 0.5, gifted: float = 1.2) -> DataFrame:
    """Weighted mean of (user, signal); users without a record count half."""
    known = weights.select("user", "weight")
    both = signals.join(known, "user", "left").withColumn("_w", F.coalesce("weight", F.lit(unknown)))
    out = both.agg(
        F.sum(F.col("_w") * F.col("signal")).alias("_ws"), F.sum("_w").alias("_tw"), F.avg("signal").alias("raw"),
        F.count(F.lit(1)).alias("n_users"), F.sum(F.when(F.col("_w") > gifted, 1).otherwise(0)).alias("n_gifted"),
    )
    n = weights.agg(F.count(F.lit(1)).alias("_known"))
    ok = F.col("_tw") >= 1e-8
    out = attach(out, n).withColumn("sentiment", F.when(ok, F.col("_ws") / F.col("_tw")).otherwise(0.0))
    return out.select(
        "sentiment", "raw", (F.col("sentiment") - F.col("raw")).alias("boost"), "n_users", "n_gifted",
        F.least(F.col("_known") / F.greatest("n_users", F.lit(1)), F.lit(1.0)).alias("confidence"),
    )


def robust_mean(signals: DataFrame, value: str = "signal", *keys: str) -> DataFrame:
    """Mean weighted by closeness to the median, per key; medians come from exact distributed quantiles."""
    from barline.operators.ordering import exact_quantiles

    group = list(keys) or ["_g"]
    base = signals if keys else signals.withColumn("_g", F.lit(0))
    mid = exact_quantiles(base, group, value, {"_med": 0.5}).drop("n")
    sd = base.groupBy(*group).agg((F.stddev_pop(value) + 1e-8).alias("_sd"))
    w = F.exp(-0.5 * F.pow((F.col(value) - F.col("_med")) / F.col("_sd"), F.lit(2)))
    out = base.join(mid.join(sd, group), group).withColumn("_w", w).groupBy(*group).agg(
        (F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("robust_mean")
    )
    return out if keys else out.drop("_g")
