"""Causal price features per symbol, as window expressions.

Every function takes a long panel ``(sym, dt, open, high, low, close, volume)``
and adds columns. All windows share the (sym, dt) ordering, so one exchange and
one sort serve a whole chain of calls.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.cols import (
    at_least,
    attach,
    by_sym,
    change,
    clip,
    expanding_z,
    finite,
    nonzero,
    ratio,
    roll_max,
    roll_mean,
    roll_min,
    roll_std,
    roll_sum,
    squash,
    trailing,
)
from barline.operators.rolling import Roll, rolled
from barline.session import spread

TINY = 1e-12


def returns(panel: DataFrame, k: int = 5) -> DataFrame:
    """Simple, log and k-bar relative changes of the close."""
    prev = F.lag("close").over(by_sym())
    return panel.select(
        "*",
        change("close").alias("ret"),
        F.when((prev > 0) & (F.col("close") > 0), F.ln(F.col("close") / prev)).alias("log_ret"),
        change("close", k).alias(f"ret_{k}"),
    )


def bollinger(panel: DataFrame, n: int = 20, slope: int = 5) -> DataFrame:
    """Moving average, band position, band width and slope of the average."""
    out = panel.withColumns({"sma": roll_mean("close", n), "sd": roll_std("close", n)})
    return out.withColumns(
        {
            "boll_pos": ratio(F.col("close") - F.col("sma"), 2 * F.col("sd")),
            "boll_width": ratio(4 * F.col("sd"), "sma"),
            "sma_slope": change("sma", slope),
        }
    )


def mean_rsi(panel: DataFrame, value: str = "close", n: int = 14, out: str = "rsi") -> DataFrame:
    """Strength index from plain rolling means of gains and losses."""
    delta = F.col(value) - F.lag(value).over(by_sym())
    step = panel.withColumn("_d", delta)
    gain = roll_mean(at_least("_d", 0.0), n)
    loss = roll_mean(F.when(F.col("_d").isNotNull(), -F.least(F.col("_d"), F.lit(0.0))), n)
    return step.withColumn(out, 100 - 100 / (1 + gain / (loss + 1e-8))).drop("_d")


def stochastic(panel: DataFrame, n: int = 14, smooth: int = 3) -> DataFrame:
    out = panel.withColumns({"_lo": roll_min("low", n), "_hi": roll_max("high", n)})
    out = out.withColumn("stoch_k", 100 * ratio(F.col("close") - F.col("_lo"), F.col("_hi") - F.col("_lo")))
    return out.withColumn("stoch_d", roll_mean("stoch_k", smooth)).drop("_lo", "_hi")


def volume_features(panel: DataFrame, n: int = 20) -> DataFrame:
    """Gap to the rolling volume-weighted price, volume ratio, return over its own spread."""
    out = panel.withColumns({"_v": nonzero("volume"), "ret": change("close")})
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    out = out.withColumn("_pv", typical * F.col("_v"))
    vwap = ratio(roll_sum("_pv", n), roll_sum("_v", n))
    return out.withColumns(
        {
            "vwap_gap": ratio(F.col("close") - vwap, "close"),
            "volume_ratio": ratio("_v", roll_mean("_v", n)),
            "ret_over_sd": ratio("ret", roll_std("ret", n)),
        }
    ).drop("_v", "_pv")


TECHNICAL_CHANNELS = (
    "rsi14", "rsi28", "macd_gap", "macd_side", "boll_pos", "boll_width", "ema_9_21", "ema_21_50",
    "ema_50_gap", "sma_slope", "adx", "di_spread", "stoch_k", "stoch_cross", "atr_share", "vwap_gap",
    "ret_5", "ret_21", "volume_ratio", "ret_over_sd",
)


def technical_channels(panel: DataFrame, least: int = 20) -> DataFrame:
    """The twenty channels, each standardised against its own past and squashed.

    Smoothed series (one grouped pass per symbol) are attached first; the rest are windows.
    Undefined values become 0 here, and only here.
    """
    from barline.operators.recursive import smoothed

    base = smoothed(panel)
    base = stochastic(volume_features(bollinger(base)))
    base = base.withColumns({"ret_5": change("close", 5), "ret_21": change("close", 21)})
    raw = {
        "rsi14": F.col("rsi14") - 50,
        "rsi28": F.col("rsi28") - 50,
        "macd_gap": ratio(F.col("macd") - F.col("macd_signal"), "close"),
        "macd_side": F.signum(F.col("macd") - F.col("macd_signal")),
        "boll_pos": F.col("boll_pos"),
        "boll_width": F.col("boll_width"),
        "ema_9_21": ratio(F.col("ema9") - F.col("ema21"), "close"),
        "ema_21_50": ratio(F.col("ema21") - F.col("ema50"), "close"),
        "ema_50_gap": ratio(F.col("close") - F.col("ema50"), "close"),
        "sma_slope": F.col("sma_slope"),
        "adx": F.col("adx") - 25,
        "di_spread": F.col("di_spread"),
        "stoch_k": F.col("stoch_k") - 50,
        "stoch_cross": F.col("stoch_k") - F.col("stoch_d"),
        "atr_share": ratio("atr", "close"),
        "vwap_gap": F.col("vwap_gap"),
        "ret_5": F.col("ret_5"),
        "ret_21": F.col("ret_21"),
        "volume_ratio": F.col("volume_ratio"),
        "ret_over_sd": F.col("ret_over_sd"),
    }
    keep = [c for c in panel.columns]
    base = base.select(*keep, *[raw[c].alias(f"x_{c}") for c in TECHNICAL_CHANNELS])
    return base.select(
        *keep,
        *[F.coalesce(finite(squash(expanding_z(f"x_{c}", least))), F.lit(0.0)).alias(c) for c in TECHNICAL_CHANNELS],
    )


def lagged_features(panel: DataFrame) -> DataFrame:
    """Momentum, volatility and price z-score from rows strictly before the current one.

    Zero before enough history exists.
    """
    seen = F.row_number().over(by_sym()) - 1
    base = panel.withColumns({"_r": F.coalesce(change("close"), F.lit(0.0)), "_n": seen})
    cols: dict[str, Column] = {}
    for h in (1, 2, 5, 10, 21):
        growth = F.exp(F.sum(F.log1p("_r")).over(trailing(h, skip=1))) - 1
        cols[f"mom_{h}"] = F.when(F.col("_n") >= h, growth).otherwise(0.0)
    for n in (5, 10, 21):
        cols[f"vol_{n}"] = F.when(F.col("_n") >= n, F.stddev_pop("_r").over(trailing(n, skip=1))).otherwise(0.0)
    cols["_last"] = F.lag("close").over(by_sym())
    for n in (10, 21):
        cols[f"_m{n}"] = F.avg("close").over(trailing(n, skip=1))
        cols[f"_s{n}"] = F.stddev_pop("close").over(trailing(n, skip=1))
    scores = {}
    for n in (10, 21):
        known = (F.col("_n") >= n) & (F.col(f"_s{n}") > 1e-12)
        scores[f"zscore_{n}"] = F.when(known, (F.col("_last") - F.col(f"_m{n}")) / F.col(f"_s{n}")).otherwise(0.0)
    out = base.withColumns(cols).withColumns(scores)
    return out.drop("_r", "_n", "_last", "_m10", "_m21", "_s10", "_s21")


def return_features(panel: DataFrame) -> DataFrame:
    """1/5/20-bar sums, volatility, long z-score, strength and momentum of returns.

    Undefined values take the last defined one, then 0.
    """
    # dealt before the lags, so that the rows are not dealt again after them
    base = spread(panel.select("sym", "dt", "close"), "sym").withColumn("ret1", F.coalesce(change("close"), F.lit(0.0)))
    base = base.withColumn("_d", F.col("ret1") - F.lag("ret1").over(by_sym()))
    base = base.select("sym", "dt", "ret1", at_least("_d", 0.0).alias("_up"), at_least(-F.col("_d"), 0.0).alias("_down"))
    return rolled(
        base,
        {
            "ret5": Roll("sum", "ret1", 5), "ret20": Roll("sum", "ret1", 20), "vol20": Roll("std", "ret1", 20), "mom20": Roll("mean", "ret1", 20),
            "_mean": Roll("mean", "ret1", 252), "_std": Roll("std", "ret1", 252), "_gain": Roll("mean", "_up", 14), "_loss": Roll("mean", "_down", 14),
        },
        then={
            "zscore": lambda c: (c["ret1"] - c["_mean"]) / (c["_std"] + 1e-8),
            "rsi14": lambda c: 100 - 100 / (1 + c["_gain"] / (c["_loss"] + 1e-8)),
        },
        filled=("ret1", "ret5", "ret20", "vol20", "zscore", "rsi14", "mom20"),
        kept=("sym", "dt"),
    )


def regime_variable(panel: DataFrame, short: int = 5, long: int = 20) -> DataFrame:
    """log(short-run / long-run spread of returns), NULL until both windows are full."""
    base = panel.withColumn("_r", change("close"))
    base = base.withColumns({"_s": roll_std("_r", short), "_l": roll_std("_r", long)})
    both = (F.col("_s") > 0) & (F.col("_l") > 0)
    return base.withColumn("regime", F.when(both, F.ln(F.col("_s") / F.col("_l")))).drop("_r", "_s", "_l")


def annual_vol(panel: DataFrame, n: int = 20, fallback: float = 0.15) -> DataFrame:
    """Trailing annualised volatility; the fallback stands in until it is known and positive."""
    base = panel.withColumn("_r", change("close"))
    base = base.withColumn("_v", roll_std("_r", n) * math.sqrt(252))
    return base.withColumn("ann_vol", F.when(F.col("_v") > 0, F.col("_v")).otherwise(fallback)).drop("_r", "_v")


def bars_since(panel: DataFrame, count: str, out: str) -> DataFrame:
    """Rows since ``count`` was last positive: 0 on such a row, NULL before the first."""
    pos = panel.withColumn("_i", F.row_number().over(by_sym()))
    past = by_sym().rowsBetween(Window.unboundedPreceding, 0)
    hit = F.last(F.when(F.col(count) > 0, F.col("_i")), ignorenulls=True).over(past)
    return pos.withColumn(out, (F.col("_i") - hit).cast("double")).drop("_i")


def flow_proxy(panel: DataFrame, n: int = 20, least: int = 5) -> DataFrame:
    """Order-flow proxy from the bar's body and wicks, and its recency-weighted mean.

    Weights run from exp(-2) to 1 over the bars at hand; zero below ``least`` bars.
    """
    body_hi, body_lo = F.greatest("open", "close"), F.least("open", "close")
    upper, lower = F.col("high") - body_hi, body_lo - F.col("low")
    wick = (lower - upper) / (upper + lower + 1e-8)
    base = panel.withColumn("flow", F.signum(F.col("close") - F.col("open")) * 0.6 + wick * 0.4)
    recent = base.withColumn("_l", F.collect_list("flow").over(trailing(n)))
    size = F.size("_l")
    step = F.lit(2.0) / F.greatest(size - 1, F.lit(1))
    weights = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.exp(i * step - 2.0))
    add = lambda a, x: a + x
    num = F.aggregate(F.zip_with("_l", weights, lambda x, w: x * w), F.lit(0.0), add)
    den = F.aggregate(weights, F.lit(0.0), add)
    return recent.withColumn("flow_cum", F.when(size >= least, num / den).otherwise(0.0)).drop("_l")


def normalise(panel: DataFrame, value: str, method: str) -> DataFrame:
    """Whole-history scaling of one symbol's series: ``zscore``, ``minmax`` or ``robust``."""
    c = F.col(value)
    if method == "zscore":
        stats = panel.groupBy("sym").agg(F.avg(value).alias("_a"), F.stddev_samp(value).alias("_b"))
    elif method == "minmax":
        stats = panel.groupBy("sym").agg(F.min(value).alias("_a"), (F.max(value) - F.min(value)).alias("_b"))
    elif method == "robust":
        # exact medians: one symbol's history is bounded by the calendar
        mid = panel.groupBy("sym").agg(F.percentile(value, 0.5).alias("_a"))
        spread = panel.join(mid, "sym").groupBy("sym").agg(F.percentile(F.abs(c - F.col("_a")), 0.5).alias("_b"))
        stats = mid.join(spread, "sym")
    else:
        raise ValueError(f"unknown method {method!r}")
    scaled = (c - F.col("_a")) / (F.col("_b") + 1e-8)
    return panel.join(stats, "sym").withColumn(f"{value}_{method}", scaled).drop("_a", "_b")


def standardise_on_train(panel: DataFrame, names: list[str], train: Column) -> DataFrame:
    """Scales columns by mean and population spread of the training rows only."""
    aggs = []
    for c in names:
        kept = F.when(train, F.col(c))
        aggs += [F.avg(kept).alias(f"_m_{c}"), F.stddev_pop(kept).alias(f"_s_{c}")]
    stats = panel.agg(*aggs)  # a single row
    out = attach(panel, stats)
    cols = {
        f"{c}_std": (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 1e-12, F.col(f"_s_{c}")).otherwise(1.0)
        for c in names
    }
    return out.withColumns(cols).drop(*[f"_{k}_{c}" for c in names for k in "ms"])


def dispersion(panel: DataFrame) -> DataFrame:
    """Per session: spread of the previous session's returns across names."""
    daily = panel.withColumn("_r", F.coalesce(change("close"), F.lit(0.0))).groupBy("dt").agg(
        F.stddev_pop("_r").alias("_d")
    )
    # one row per calendar day
    return daily.select("dt", F.coalesce(F.lag("_d").over(Window.orderBy("dt")), F.lit(0.0)).alias("dispersion"))


def delivery_features(panel: DataFrame) -> DataFrame:
    """Delivered share, log trade size and strictly trailing z-scores.

    Expects ``volume``, ``trades`` and ``delivered`` per symbol and session.
    """
    size = ratio("volume", "trades")
    base = panel.withColumns(
        {
            "deliv_pct": clip(ratio("delivered", "volume"), 0.0, 1.0),
            "avg_trade_size_log": F.when(size > 0, F.ln(size)),
            "_ld": F.when(F.col("delivered") > 0, F.ln("delivered")),
        }
    )
    z = {"deliv_pct_z": "deliv_pct", "avg_trade_size_z": "avg_trade_size_log", "deliv_qty_z": "_ld"}
    return rolled(base, {name: Roll("z", c, 60, 20, skip=1) for name, c in z.items()}, kept=[c for c in base.columns if c != "_ld"])


def pair_z(pairs: DataFrame, n: int = 60) -> DataFrame:
    """Rolling z of a log price ratio, current bar included, full windows only.

    Needs ``(pair, dt, ratio)``; starts at the pair's bar ``n``.
    """
    w = trailing(n, sym="pair")
    full = (F.count("ratio").over(w) == n) & (F.row_number().over(by_sym(sym="pair")) > n)
    base = pairs.withColumns(
        {"_full": full, "_m": F.avg("ratio").over(w), "_s": F.stddev_samp("ratio").over(w)}
    )
    known = F.col("_full") & (F.col("_s") > 1e-10)
    return base.withColumn("z", F.when(known, (F.col("ratio") - F.col("_m")) / F.col("_s"))).drop("_full", "_m", "_s")
