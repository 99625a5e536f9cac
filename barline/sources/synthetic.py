"""Synthetic panels for calibration, drawn from hashes so every retry gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.cols import attach, by_sym
from barline.session import dealt, durable

# Drift and volatility per session by regime
REGIMES = (("bull", 0.0006, 0.009), ("bear", -0.0008, 0.018), ("chop", 0.0, 0.012))


def uniform(seed: str, *parts: Column | str) -> Column:
    """A value in (0, 1) from the hash of its key."""
    cols = [F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(seed), *cols)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / 16.0**13


def normal(seed: str, *parts: Column | str) -> Column:
    """A standard normal value from two hashed uniforms."""
    return F.sqrt(-2 * F.ln(uniform(seed + "a", *parts))) * F.cos(2 * math.pi * uniform(seed + "b", *parts))


def regime_segments(cal: DataFrame, seed: str, low: int = 60, high: int = 250) -> DataFrame:
    """(bar_idx, regime): the calendar cut into stretches of ``low`` to ``high - 1`` bars."""
    n = cal.agg((F.max("bar_idx") + 1).alias("n"))
    ids = n.select("n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / low).cast("int"))).alias("k"))
    length = (low + F.floor(uniform(seed + "len", "k") * (high - low))).cast("int")
    # a handful of rows: one per stretch
    start = F.sum("len").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)) - F.col("len")
    cut = ids.withColumn("len", length).withColumn("s", start).where(F.col("s") < F.col("n"))
    kind = F.floor(uniform(seed + "kind", "k") * len(REGIMES)).cast("int")
    bars = F.sequence(F.col("s"), F.least(F.col("s") + F.col("len"), F.col("n").cast("bigint")) - 1)
    rows = cut.select(F.explode(bars).alias("bar_idx"), kind.alias("regime"))
    return rows.withColumn("bar_idx", F.col("bar_idx").cast("int"))


def regime_panel(symbols: DataFrame, cal: DataFrame, seed: str = "11") -> DataFrame:
    """Prices with bull, bear and flat stretches and a common factor, on a given calendar.

    Each symbol carries the session list; the grid grows by an explode and an equi-join. The
    symbols are dealt by the number of rows they become, for few bytes of them would meet in
    one task; the sessions are sent to the tasks, so the grid is not dealt again.
    """
    cal = durable(cal, "calendar")
    names = durable(symbols.select("sym").distinct(), "symbols")
    grown = names.count() * cal.count()
    days = cal.join(regime_segments(cal, seed), "bar_idx").withColumn("_f", normal(seed + "m", "bar_idx") * 0.01)
    drift = F.element_at(F.array(*[F.lit(d) for _, d, _ in REGIMES]), F.col("regime") + 1)
    vol = F.element_at(F.array(*[F.lit(v) for _, _, v in REGIMES]), F.col("regime") + 1)
    last = cal.agg(F.max("bar_idx").alias("_last"))
    grid = attach(dealt(names, grown, "sym"), last).select("sym", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("bar_idx"))
    rows = grid.join(F.broadcast(days), "bar_idx").withColumn("r", drift + vol * (0.6 * F.col("_f") + 0.4 * normal(seed + "e", "bar_idx", "sym")))
    past = by_sym().rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("sym", "dt", "bar_idx", "regime", (100 * F.exp(F.sum("r").over(past))).alias("close"))


def random_walk(symbols: DataFrame, cal: DataFrame, seed: str = "0", vol: float = 0.012) -> DataFrame:
    """Pure noise prices: nothing about them can be predicted."""
    grid = attach(symbols.select("sym").distinct(), cal.agg(F.max("bar_idx").alias("_last")))
    grid = grid.select("sym", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("bar_idx")).join(cal, "bar_idx")
    past = by_sym().rowsBetween(Window.unboundedPreceding, 0)
    rows = grid.withColumn("r", vol * normal(seed, "bar_idx", "sym"))
    return rows.select("sym", "dt", "bar_idx", (100 * F.exp(F.sum(F.log1p("r")).over(past))).alias("close"))


def synthetic_minutes(symbols: DataFrame, days: DataFrame, seed: str = "0", opens: int = 555, closes: int = 930) -> DataFrame:
    """Minute bars of a session between two minutes of the day, per symbol and day.

    ``days(sym, dt)`` states the sessions; every one is expanded to its minutes.
    """
    rows = days.join(symbols.select("sym").distinct(), "sym", "left_semi").select(
        "sym", "dt", F.explode(F.sequence(F.lit(opens), F.lit(closes - 1))).alias("minute")
    )
    key = ("sym", "dt", "minute")
    rows = rows.withColumn("_r", 0.0008 * normal(seed + "r", *key))
    w = Window.partitionBy("sym", "dt").orderBy("minute")
    rows = rows.withColumn("close", 100 * F.exp(F.sum(F.log1p("_r")).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    rows = rows.withColumn("open", F.coalesce(F.lag("close").over(w), "close"))
    edge = F.abs(0.0004 * normal(seed + "s", *key)) * F.col("close")
    return rows.select(
        "sym", "dt", "minute", "open", (F.greatest("open", "close") + edge).alias("high"),
        (F.least("open", "close") - edge).alias("low"), "close", F.exp(8 + 0.6 * normal(seed + "v", *key)).alias("volume"),
    )
