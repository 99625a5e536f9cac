"""Candle shapes, price channels, and volatility / liquidity measures of daily bars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.cols import by_sym, clip, finite, nonzero, ratio, roll_max, roll_mean, roll_min, roll_std

TINY = 1e-12

CANDLES = (
    "doji", "hammer", "shooting_star", "marubozu", "engulfing", "harami",
    "morning_star", "evening_star", "piercing", "dark_cloud", "three_soldiers", "three_crows",
)
CHANNELS = ("ichimoku_tk_cross", "ichimoku_cloud_pos", "keltner_pos", "donchian_pos", "pivot_dist")
MICRO = (
    "gk_vol", "parkinson_vol", "rogers_satchell", "vol_of_vol", "amihud_illiq",
    "roll_spread", "kyle_lambda", "close_loc_value", "gap_open", "range_expansion",
)


def _floor(c: Column, at: float = TINY) -> Column:
    return F.when(c.isNotNull(), F.greatest(c, F.lit(at)))


def with_open(panel: DataFrame) -> DataFrame:
    """An opening price from the previous close where none is recorded."""
    if "open" in panel.columns:
        return panel
    return panel.withColumn("open", F.coalesce(F.lag("close").over(by_sym()), F.col("close")))


def candles(panel: DataFrame) -> DataFrame:
    """Twelve candle strengths; patterns of several bars look back two rows at most."""
    w = by_sym()
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    base = panel.withColumns(
        {
            "_rng": _floor(h - l),
            "_body": c - o,
            "_up": h - F.greatest(o, c),
            "_dn": F.least(o, c) - l,
        }
    )
    base = base.withColumns(
        {
            "_body1": F.lag("_body").over(w),
            "_body2": F.lag("_body", 2).over(w),
            "_rng1": F.lag("_rng").over(w),
            "_mid1": (F.lag("open").over(w) + F.lag("close").over(w)) / 2,
        }
    )
    body, b1, b2, rng = (F.col(x) for x in ("_body", "_body1", "_body2", "_rng"))
    size, size1 = F.abs(body), F.abs(b1)
    fill = F.least(size / rng, F.lit(1.0))
    small = 1 - fill
    known1 = b1.isNotNull()
    against = (F.signum(body) != F.signum(b1)) & known1
    cover = size / F.greatest(size1, F.lit(TINY))
    star = (size1 / F.greatest("_rng1", F.lit(TINY)) < 0.3) & b2.isNotNull()
    beyond = (c - F.col("_mid1")) / F.greatest(size1, F.lit(TINY))
    run = F.least((size + size1 + F.abs(b2)) / (3 * rng), F.lit(1.0))
    def unit(x: Column) -> Column:
        return clip(x, 0.0, 1.0)
    def pick(cond: Column, x: Column) -> Column:
        return F.when(cond, x).otherwise(0.0)
    shapes = {
        "doji": small,
        "hammer": unit(F.col("_dn") / rng) * unit(1 - 2 * F.col("_up") / rng) * small,
        "shooting_star": -unit(F.col("_up") / rng) * unit(1 - 2 * F.col("_dn") / rng) * small,
        "marubozu": F.signum(body) * fill,
        # without a previous bar the two-bar shapes are undefined
        "engulfing": F.when(known1, pick(against, F.signum(body) * unit(cover - 1))),
        "harami": F.when(known1, pick(against, -F.signum(b1) * unit(1 - cover))),
        "morning_star": pick(star & (b2 < 0) & (body > 0), fill),
        "evening_star": pick(star & (b2 > 0) & (body < 0), -fill),
        "piercing": pick((b1 < 0) & (body > 0) & (c > F.col("_mid1")), unit(beyond)),
        "dark_cloud": pick((b1 > 0) & (body < 0) & (c < F.col("_mid1")), -unit(-beyond)),
        "three_soldiers": pick((body > 0) & (b1 > 0) & (b2 > 0), run),
        "three_crows": pick((body < 0) & (b1 < 0) & (b2 < 0), -run),
    }
    out = base.select(*panel.columns, *[shapes[n].alias(n) for n in CANDLES])
    return out


def _half(n: int) -> int:
    return max(2, n // 2)


def channels(panel: DataFrame) -> DataFrame:
    """Equilibrium lines, cloud position, range position and pivot distance (nothing shifted forward)."""
    def middle(n: int) -> Column:
        return (roll_max("high", n, _half(n)) + roll_min("low", n, _half(n))) / 2
    base = panel.withColumns(
        {
            "_t": middle(9),
            "_k": middle(26),
            "_b": middle(52),
            "_hi": roll_max("high", 20, 10),
            "_lo": roll_min("low", 20, 10),
        }
    )
    base = base.withColumn("_a", (F.col("_t") + F.col("_k")) / 2)
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    top = F.when(both, F.greatest("_a", "_b"))
    bottom = F.when(both, F.least("_a", "_b"))
    hi, lo = F.col("_hi"), F.col("_lo")
    pivot = (F.col("high") + F.col("low") + F.col("close")) / 3
    c = F.col("close")
    return base.withColumns(
        {
            "ichimoku_tk_cross": F.tanh((F.col("_t") - F.col("_k")) / _floor(F.abs("_k")) * 50),
            "ichimoku_cloud_pos": clip((c - bottom) / _floor(top - bottom), -2.0, 3.0),
            "donchian_pos": clip((c - lo) / _floor(hi - lo), 0.0, 1.0),
            "pivot_dist": F.tanh((c - pivot) / _floor(F.abs(pivot)) * 100),
        }
    ).drop("_t", "_k", "_a", "_b", "_hi", "_lo")


def range_vols(panel: DataFrame) -> DataFrame:
    """Volatility from the bar's range, annualised, and the spread of the first of them."""
    def lr(a: str, b: str) -> Column:
        return F.ln(_floor(F.col(a)) / _floor(F.col(b)))
    hl, co = lr("high", "low"), lr("close", "open")
    gk = 0.5 * hl * hl - (2 * math.log(2) - 1) * co * co
    rs = lr("high", "close") * lr("high", "open") + lr("low", "close") * lr("low", "open")
    def annual(x: Column) -> Column:
        return F.sqrt(_floor(x, 0.0) * 252)
    out = panel.withColumns(
        {"gk_vol": annual(gk), "parkinson_vol": annual(hl * hl / (4 * math.log(2))), "rogers_satchell": annual(rs)}
    )
    return out.withColumn("vol_of_vol", roll_std("gk_vol", 20, 10))


def liquidity(panel: DataFrame) -> DataFrame:
    """Price impact, implied spread, close location, opening gap, range growth."""
    w = by_sym()
    base = panel.withColumns({"_pc": F.lag("close").over(w), "_rg": F.col("high") - F.col("low")})
    base = base.withColumn("_r", F.col("close") / _floor(F.col("_pc")) - 1)
    base = base.withColumns(
        {
            "_cross": F.col("_r") * F.lag("_r").over(w),
            "_imp": F.abs("_r") / _floor(F.sqrt(_floor(F.col("volume")))),
        }
    )
    base = base.withColumns(
        {"_cov": roll_mean("_cross", 20, 10), "_avg_rg": roll_mean("_rg", 20, 10), "_avg_imp": roll_mean("_imp", 20, 10)}
    )
    cov = F.col("_cov")
    turnover = _floor(F.col("volume") * F.col("close"))
    return base.withColumns(
        {
            "amihud_illiq": F.log1p(F.abs("_r") / turnover * 1e9),
            "kyle_lambda": F.log1p(F.col("_avg_imp") * 1e6),
            "roll_spread": F.when(cov < 0, 2 * F.sqrt(-cov)),
            "close_loc_value": clip(
                (2 * F.col("close") - F.col("low") - F.col("high")) / _floor(F.col("_rg")), -1.0, 1.0
            ),
            "gap_open": F.tanh((F.col("open") - F.col("_pc")) / _floor(F.abs("_pc")) * 50),
            "range_expansion": F.log1p(_floor(F.col("_rg")) / _floor(F.col("_avg_rg"))),
        }
    ).drop("_pc", "_rg", "_r", "_cross", "_imp", "_cov", "_avg_rg", "_avg_imp")


def pattern_features(panel: DataFrame) -> DataFrame:
    """All candle, channel and micro-structure columns, non-finite values as NULL."""
    from barline.operators.recursive import keltner

    out = liquidity(range_vols(channels(candles(keltner(with_open(panel))))))
    names = CANDLES + CHANNELS + MICRO
    return out.select(*panel.columns, *[finite(F.col(n).cast("double")).alias(n) for n in names])
