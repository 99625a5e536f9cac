"""Portfolio backtests of weight tables over walk-forward test sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.cols import attach


def test_sessions(cal: DataFrame, train: int, test: int) -> DataFrame:
    """(dt, w): every session that is a test bar of a rolling window, with its window.

    Test stretches are adjacent, so a bar's window follows from its index.
    """
    n = cal.agg(F.count(F.lit(1)).alias("_n"))
    at = F.floor((F.col("bar_idx") - train) / test).cast("int")
    last = F.floor((F.col("_n") - train - 2) / test)
    rows = attach(cal, n).where(F.col("_n") > train + 1).withColumn("w", at)
    return rows.where((F.col("w") >= 0) & (F.col("w") <= last)).select("dt", "bar_idx", "w")


def daily_results(weights: DataFrame, cost_bps: float, *keys: str) -> DataFrame:
    """Net return, turnover and changed positions per key and session.

    ``weights(keys, sym, dt, weight, ret)``: a weight known before the session's
    return. The first session trades in from nothing.
    """
    w = Window.partitionBy(*keys, "sym").orderBy("dt")
    step = F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(w), F.lit(0.0)))
    day = weights.withColumn("_t", step).groupBy(*keys, "dt").agg(
        F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("gross"),
        F.sum("_t").alias("turnover"),
        F.sum(F.when(F.col("_t") > 0, 1).otherwise(0)).alias("trades"),
    )
    return day.withColumn("ret", F.col("gross") - F.col("turnover") * cost_bps / 10_000)
