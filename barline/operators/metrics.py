"""Performance, risk and forecast statistics as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions import mathx
from barline.functions.cols import attach, by_sym, change, clip, ratio

DAYS = 252


def sharpe(mean: Column, sd: Column) -> Column:
    return F.when(sd > 1e-12, mean / sd * math.sqrt(DAYS)).otherwise(0.0)


def place(score: str) -> Column:
    """Rank of the largest score first; scores that differ by the order of their sums only share a place.

    One row per strategy is ranked.
    """
    return F.rank().over(Window.orderBy(F.desc(F.round(score, 10)))).cast("bigint")


def equity_curve(daily: DataFrame, *keys: str, ret: str = "ret") -> DataFrame:
    """Compounded equity, its running peak and drawdown along each key's sessions."""
    past = Window.partitionBy(*keys).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    out = daily.withColumn("equity", F.exp(F.sum(F.log1p(F.col(ret))).over(past)))
    out = out.withColumn("peak", F.max("equity").over(past))
    return out.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def performance(daily: DataFrame, *keys: str, ret: str = "ret", turnover: str | None = None) -> DataFrame:
    """Sharpe, drawdown, growth, volatility, hit rate and moments of daily net returns per key."""
    aggs = [
        F.count(ret).alias("n"),
        F.avg(ret).alias("_m"),
        F.stddev_pop(ret).alias("_sp"),
        F.stddev_samp(ret).alias("_ss"),
        F.exp(F.sum(F.log1p(F.col(ret)))).alias("_g"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg(F.when(F.col(ret) > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
        F.skewness(ret).alias("skew"),
        (F.kurtosis(ret) + 3).alias("kurt"),
    ]
    if turnover:
        aggs.append(F.avg(turnover).alias("avg_turnover"))
    out = equity_curve(daily, *keys, ret=ret).groupBy(*keys).agg(*aggs)
    return out.withColumns(
        {
            "sharpe": sharpe(F.col("_m"), F.col("_sp")),
            "total_return": F.col("_g") - 1,
            "cagr": F.pow("_g", DAYS / F.col("n")) - 1,
            "ann_vol": F.col("_ss") * math.sqrt(DAYS),
        }
    ).drop("_m", "_sp", "_ss", "_g")


def trading_stats(daily: DataFrame, *keys: str) -> DataFrame:
    """Win rate over days with turnover, profit factor, average turnover, trades.

    Expects ``ret`` (net), ``turnover`` and ``trades`` per key and session.
    """
    traded = F.col("turnover") > 0
    out = equity_curve(daily, *keys).groupBy(*keys).agg(
        F.avg("ret").alias("_m"), F.stddev_pop("ret").alias("_s"),
        (-F.min("drawdown")).alias("max_drawdown"),
        F.coalesce(F.avg(F.when(traded, F.when(F.col("ret") > 0, 1.0).otherwise(0.0))), F.lit(0.0)).alias("win_rate"),
        F.sum(F.when(F.col("ret") > 0, F.col("ret")).otherwise(0.0)).alias("_gain"),
        F.sum(F.when(F.col("ret") < 0, -F.col("ret")).otherwise(0.0)).alias("_loss"),
        F.avg("turnover").alias("avg_turnover"), F.sum("trades").alias("n_trades"),
    )
    factor = F.when(F.col("_loss") > 1e-12, ratio("_gain", "_loss")).when(F.col("_gain") > 0, F.lit(None)).otherwise(0.0)
    return out.withColumns({"sharpe": sharpe(F.col("_m"), F.col("_s")), "profit_factor": factor}).drop("_m", "_s", "_gain", "_loss")


# Constants of the selection score
ABSTENTION = -0.05
DRAWDOWN_LIMIT = 0.2
DRAWDOWN_PENALTY = 0.1
TRADE_SHRINKAGE = 20.0


def selection_score(stats: DataFrame, out: str = "fitness") -> DataFrame:
    """Sharpe discounted for drawdown and for few trades; no trade at all scores a small negative."""
    base = F.col("sharpe") * (1 - F.col("max_drawdown")) * F.col("n_trades") / (F.col("n_trades") + TRADE_SHRINKAGE)
    score = F.when(F.col("max_drawdown") > DRAWDOWN_LIMIT, base * DRAWDOWN_PENALTY).otherwise(base)
    return stats.withColumn(out, F.when(F.col("n_trades") == 0, ABSTENTION).otherwise(F.coalesce(score, F.lit(ABSTENTION))))


def required_bars(hold_days: Column, n_names: Column, min_trades: int = 20, duty: float = 0.25) -> Column:
    """Sessions needed before a validation period can hold enough trades."""
    return F.ceil(min_trades * hold_days / (n_names * duty)).cast("bigint")


def hit_rate(pred: str, actual: str) -> tuple[Column, Column]:
    """(calls, hits): zero predictions are no calls; a call hits when both signs are positive or both not."""
    call = F.col(pred) != 0
    hit = call & ((F.col(pred) > 0) == (F.col(actual) > 0))
    return F.count(F.when(call, 1)), F.count(F.when(hit, 1))


def signal_diagnostic(rows: DataFrame, *keys: str, pred: str = "pred", actual: str = "actual") -> DataFrame:
    """Hit rate, rate with the sign inverted, a two-sided p-value, and linear correlation."""
    calls, hits = hit_rate(pred, actual)
    flipped = F.count(F.when((F.col(pred) != 0) & ((F.col(pred) < 0) == (F.col(actual) > 0)), 1))
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), calls.alias("n_calls"), hits.alias("n_hits"), flipped.alias("_flip"),
        F.covar_pop(pred, actual).alias("_c"), F.var_pop(pred).alias("_vp"), F.var_pop(actual).alias("_va"),
    )
    z = F.greatest(F.abs(F.col("n_hits") - F.col("n_calls") / 2) - 0.5, F.lit(0.0)) / F.sqrt(F.col("n_calls") / 4)
    return out.withColumns(
        {
            "hit_rate": F.coalesce(ratio("n_hits", "n_calls"), F.lit(0.0)),
            "inverted_rate": F.coalesce(ratio("_flip", "n_calls"), F.lit(0.0)),
            "p_value": F.when(F.col("n_calls") > 0, 2 * (1 - mathx.norm_cdf(z))).otherwise(1.0),
            "pearson": F.when((F.col("_vp") > 0) & (F.col("_va") > 0), F.col("_c") / F.sqrt(F.col("_vp") * F.col("_va"))).otherwise(0.0),
        }
    ).drop("_flip", "_c", "_vp", "_va")


def size_scale(rows: DataFrame, *keys: str, pred: str = "pred", actual: str = "actual", least: int = 100, cap: float = 40.0) -> DataFrame:
    """Pooled least-squares slope of outcomes on predictions, clipped; 1 where it says nothing."""
    out = rows.groupBy(*keys).agg(
        F.count(pred).alias("n"), F.covar_pop(pred, actual).alias("_c"), F.var_pop(pred).alias("_v")
    )
    slope = clip(ratio("_c", "_v"), 0.0, cap)
    usable = (F.col("n") >= least) & (F.col("_v") >= 1e-12) & (slope > 0)
    return out.withColumn("scale", F.when(usable, slope).otherwise(1.0)).drop("_c", "_v")


def market_snapshot(panel: DataFrame, fear: int, bars: int = 20) -> DataFrame:
    """Last and mean level of a fear gauge (one symbol), last mean return, mean volatility of the others."""
    base = panel.withColumns({"_r": F.coalesce(change("close"), F.lit(0.0)), "_k": F.row_number().over(by_sym())})
    n = base.groupBy("sym").agg(F.max("_k").alias("_n"))
    recent = base.join(n, "sym").where(F.col("_k") > F.col("_n") - bars)
    gauge = recent.where(F.col("sym") == fear).agg(F.max_by("close", "dt").alias("vix_last"), F.avg("close").alias("vix_mean"))
    names = recent.where(F.col("sym") != fear).groupBy("sym").agg(F.max_by("_r", "dt").alias("_last"), F.stddev_samp("_r").alias("_sd"))
    market = names.agg(F.avg("_last").alias("market_return"), F.avg("_sd").alias("market_vol"))
    return attach(gauge, market)


def expected_vol(panel: DataFrame, windows: tuple[int, ...] = (5, 20)) -> DataFrame:
    """(window, vol): mean over names of the annualised spread of their last returns, in percent."""
    base = panel.withColumns({"_r": F.coalesce(change("close"), F.lit(0.0)), "_k": F.row_number().over(by_sym())})
    n = base.groupBy("sym").agg(F.max("_k").alias("_n"))
    # each row is expanded to the windows it falls in, so one pass serves all of them
    hit = F.array_compact(F.array(*[F.when(F.col("_k") > F.col("_n") - w, F.lit(w)) for w in windows]))
    rows = base.join(n, "sym").select("sym", "_r", F.explode(hit).alias("window"))
    per_name = rows.groupBy("window", "sym").agg(F.stddev_samp("_r").alias("_s"))
    return per_name.groupBy("window").agg((F.avg("_s") * math.sqrt(DAYS) * 100).alias("vol"))


def regime_label(panel: DataFrame, last: int = 3) -> DataFrame:
    """bull / bear / sideways from drift against volatility of the last sessions, over all names."""
    base = panel.withColumn("_r", F.coalesce(change("close"), F.lit(0.0)))
    days = base.select("dt").distinct().orderBy(F.desc("dt")).limit(last)
    stats = base.join(F.broadcast(days), "dt", "left_semi").agg(F.avg("_r").alias("drift"), F.stddev_pop("_r").alias("vol"))
    bar = 0.5 * F.col("vol") / math.sqrt(max(last, 1))
    label = F.when((F.col("drift") > bar) & (F.col("drift") > 0), "bull").when((F.col("drift") < -bar) & (F.col("drift") < 0), "bear")
    return stats.withColumn("regime", label.otherwise("sideways"))


def return_profile(rets: DataFrame) -> DataFrame:
    """Spread, skew and excess kurtosis per symbol, moments over the sample spread."""
    base = rets.groupBy("sym").agg(F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("vol"))
    centred = rets.join(base, "sym").withColumn("_d", F.col("ret") - F.col("_m"))
    return centred.groupBy("sym").agg(
        F.max("vol").alias("vol"),
        (F.avg(F.pow("_d", F.lit(3))) / (F.pow(F.max("vol"), F.lit(3)) + 1e-8)).alias("skew"),
        (F.avg(F.pow("_d", F.lit(4))) / (F.pow(F.max("vol"), F.lit(4)) + 1e-8) - 3).alias("kurt"),
    )


def kelly_sizes(
    history: DataFrame, latest: DataFrame, share: float = 0.5, max_position: float = 0.2, max_exposure: float = 1.0,
    lookback: int = 252, least: int = 30, multiplier: float = 1.0,
) -> DataFrame:
    """Stake per symbol from its record of (pred, actual), scaled to the portfolio limit.

    ``history(sym, dt, pred, actual)`` is cut to the newest rows per symbol, ``latest``
    holds today's (sym, pred, confidence).
    """
    newest = Window.partitionBy("sym").orderBy(F.desc("dt"))
    recent = history.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= lookback)
    right = F.signum("pred") == F.signum("actual")
    stats = recent.groupBy("sym").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(right, 1.0).otherwise(0.0)).alias("_p"),
        F.coalesce(F.avg(F.when(right & (F.col("actual") > 0), F.col("actual"))), F.lit(0.01)).alias("_w"),
        F.coalesce(F.abs(F.avg(F.when(~right & (F.col("actual") < 0), F.col("actual")))), F.lit(0.01)).alias("_l"),
    )
    out = latest.join(stats, "sym", "left")
    short = F.coalesce(F.col("n"), F.lit(0)) < least
    size = F.abs("pred")
    out = out.withColumns(
        {
            "_p": F.when(short, 0.5 + 0.1 * F.col("confidence")).otherwise(F.col("_p")),
            "_w": F.when(short, F.greatest(size * 1.2, F.lit(0.001))).otherwise(F.col("_w")),
            "_l": F.when(short, F.greatest(size * 0.8, F.lit(0.001))).otherwise(F.col("_l")),
        }
    )
    out = out.withColumns({"p_win": 0.5 + (F.col("_p") - 0.5) * F.col("confidence"), "win_loss": F.col("_w") / F.greatest("_l", F.lit(1e-8))})
    raw = F.when(F.col("_l") < 1e-8, 0.0).otherwise((F.col("win_loss") * F.col("p_win") - (1 - F.col("p_win"))) / F.col("win_loss"))
    bounded = F.abs(clip(raw * share * multiplier, -max_position, max_position))
    out = out.withColumn("_f", F.when(F.col("pred") < 0, -bounded).otherwise(bounded))
    total = out.agg(F.sum(F.abs("_f")).alias("_total"))
    scale = F.when(F.col("_total") > max_exposure, max_exposure / F.col("_total")).otherwise(1.0)
    return attach(out, total).withColumn("fraction", F.col("_f") * scale).drop("_p", "_w", "_l", "_f", "_total")


def correlated_cut(sizes: DataFrame, corr: DataFrame, limit: float = 0.8) -> DataFrame:
    """Scales down same-side positions whose correlation exceeds ``limit``.

    ``corr(a, b, corr)`` holds each pair once. Only strong pairs reach the join; the
    factors of one symbol multiply in a fold, since a factor may be zero or negative.
    """
    f = sizes.select("sym", "fraction")
    strong = corr.where(F.abs("corr") > limit)
    both = strong.join(f.withColumnsRenamed({"sym": "a", "fraction": "fa"}), "a").join(
        f.withColumnsRenamed({"sym": "b", "fraction": "fb"}), "b"
    ).where(F.col("fa") * F.col("fb") > 0)
    factor = 1 - (F.abs("corr") - limit) * 2
    parts = both.select(F.explode(F.array("a", "b")).alias("sym"), factor.alias("_f"))
    # sign and size fold separately, so the product is a plain partial aggregate
    prod = parts.groupBy("sym").agg(
        F.sum(F.when(F.col("_f") == 0, 1).otherwise(0)).alias("_zero"),
        F.sum(F.when(F.col("_f") < 0, 1).otherwise(0)).alias("_neg"),
        F.sum(F.when(F.col("_f") != 0, F.ln(F.abs("_f"))).otherwise(0.0)).alias("_log"),
    )
    mult = F.when(F.col("_zero") > 0, 0.0).otherwise(F.exp("_log") * F.when(F.col("_neg") % 2 == 1, -1.0).otherwise(1.0))
    return sizes.join(prod.select("sym", mult.alias("_m")), "sym", "left").withColumn(
        "adjusted", F.col("fraction") * F.coalesce("_m", F.lit(1.0))
    ).drop("_m")


def risk_budget(panel: DataFrame, last: int = 20) -> DataFrame:
    """Inverse-volatility weights from each symbol's last returns; a short record counts as 1 %."""
    newest = Window.partitionBy("sym").orderBy(F.desc("dt"))
    recent = panel.where(F.col("ret").isNotNull()).withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= last)
    vols = recent.groupBy("sym").agg(F.when(F.count("ret") >= last, F.stddev_pop("ret")).otherwise(0.01).alias("vol"))
    inv = vols.withColumn("_i", 1 / (F.col("vol") + 1e-8))
    return attach(inv, inv.agg(F.sum("_i").alias("_t"))).withColumn("budget", F.col("_i") / F.col("_t")).drop("_i", "_t")


def pooled_sharpe(panel: DataFrame, least: int = 10, last: int = 252, free: float = 0.05) -> DataFrame:
    newest = Window.partitionBy("sym").orderBy(F.desc("dt"))
    known = panel.where(F.col("ret").isNotNull())
    recent = known.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= last)
    long_enough = known.groupBy("sym").agg(F.count("ret").alias("_n")).where(F.col("_n") >= least).select("sym")
    out = recent.join(long_enough, "sym", "left_semi").agg(
        F.count("ret").alias("n_obs"), F.avg("ret").alias("mean_return"), F.stddev_pop("ret").alias("volatility")
    )
    return out.withColumn("sharpe", (F.col("mean_return") - free / DAYS) / (F.col("volatility") + 1e-8) * math.sqrt(DAYS))


def asymmetric_loss(
    pred: Column, target: Column, confidence: Column | None = None, alpha: float = 0.5, beta: float = 2.0, gamma: float = 3.0
) -> Column:
    """Loss of one prediction: mild when the direction is right, a power when it is wrong."""
    right = F.signum(pred) == F.signum(target)
    miss = F.abs(pred - target)
    short = F.when(F.abs(pred) < F.abs(target), alpha * miss).otherwise(0.0)
    loss = F.when(right, short + 0.01 * alpha * miss).otherwise(beta * F.least(F.pow(miss, F.lit(gamma)), F.lit(100.0)))
    if confidence is None:
        return loss
    return loss * F.when(right, 1.0).otherwise(1 + 2 * confidence)


def loss_breakdown(rows: DataFrame, *keys: str, pred: str = "pred", target: str = "target") -> DataFrame:
    right = F.signum(pred) == F.signum(target)
    miss = F.abs(F.col(pred) - F.col(target))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(right, 1.0).otherwise(0.0)).alias("directional_accuracy"),
        F.avg(F.when(right, 0.0).otherwise(miss)).alias("wrong_way_error"),
        F.avg(F.when(right, miss).otherwise(0.0)).alias("right_way_error"),
        F.count(F.when(~right, 1)).alias("n_wrong"),
    )


def weighted_squared_error(pred: Column, target: Column, power: float = 1.5) -> Column:
    return (F.pow(F.abs(target), F.lit(power)) + 1) * (pred - target) * (pred - target)


def weight_descriptors(weights: DataFrame, *keys: str) -> DataFrame:
    """Turnover, net exposure and concentration of a weight path ``(keys, sym, dt, weight)``."""
    w = Window.partitionBy(*keys, "sym").orderBy("dt")
    base = weights.withColumns({"_d": F.abs(F.col("weight") - F.lag("weight").over(w)), "_a": F.abs("weight")})
    day = base.groupBy(*keys, "dt").agg(
        F.sum("_d").alias("_turn"), F.sum("weight").alias("_net"), F.sum("_a").alias("_gross"), F.sum(F.col("_a") ** 2).alias("_sq")
    )
    share = F.when(F.col("_gross") > 1e-12, F.col("_sq") / F.col("_gross") ** 2)
    return day.groupBy(*keys).agg(
        F.coalesce(F.avg("_turn"), F.lit(0.0)).alias("turnover"), F.avg("_net").alias("net_exposure"),
        F.coalesce(F.avg(share), F.lit(0.0)).alias("concentration"),
    )


# Bounds of the behaviour descriptors
BEHAVIOUR_BOUNDS = {"turnover": (0.0, 2.0), "net_exposure": (-1.0, 1.0), "concentration": (0.0, 1.0)}


def behaviour_cells(strategies: DataFrame, bins: int = 6) -> DataFrame:
    """Best strategy per behaviour cell; the earlier strategy wins a tie, non-finite fitness is left out."""
    def cell(c: str) -> Column:
        lo, hi = BEHAVIOUR_BOUNDS[c]
        x = (F.col(c) - lo) / (hi - lo) * bins
        return F.least(F.greatest(F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)), F.lit(0)), F.lit(bins - 1)).cast("int")
    ok = strategies.where(~F.isnan("fitness") & (F.abs("fitness") < float("inf")))
    cells = ok.select("strategy", "fitness", *[cell(c).alias(f"cell_{c}") for c in BEHAVIOUR_BOUNDS])
    return cells.groupBy(*[f"cell_{c}" for c in BEHAVIOUR_BOUNDS]).agg(
        F.max_by("strategy", F.struct("fitness", -F.col("strategy"))).alias("strategy"), F.max("fitness").alias("fitness")
    )


def archive_summary(cells: DataFrame, bins: int = 6) -> DataFrame:
    return cells.agg(
        (F.count(F.lit(1)) / float(bins ** len(BEHAVIOUR_BOUNDS))).alias("coverage"),
        F.coalesce(F.sum(F.greatest("fitness", F.lit(0.0))), F.lit(0.0)).alias("score"),
    )


def false_discovery(tests: DataFrame, p: str = "p", alpha: float = 0.05, group: tuple[str, ...] = ()) -> DataFrame:
    """Step-up q-values over a table of tests (one row per hypothesis, a report-sized table)."""
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    order = whole.orderBy(F.col(p).asc())
    base = tests.withColumns({"_n": F.count(p).over(whole), "_k": F.row_number().over(order)})
    back = whole.orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.min(F.col(p) * F.col("_n") / F.col("_k")).over(back), F.lit(1.0))
    return base.withColumn("q", q).withColumn("significant", F.col("q") <= alpha).drop("_n", "_k")


def null_summary(draws: DataFrame, value: str = "score", n_ideas: int = 1, alpha: float = 0.05, *keys: str) -> DataFrame:
    """A real result (draw 0) against its permutation draws, per key.

    Mean, spread, 95 % band, percentile of the real value, permutation p-value, and
    whether so few draws can reach the corrected level at all.
    """
    real = draws.where(F.col("draw") == 0).select(*keys, F.col(value).alias("real"))
    # exact quantiles over draws: their number is a parameter of the study
    null = draws.where(F.col("draw") != 0).join(real, list(keys)) if keys else attach(draws.where(F.col("draw") != 0), real)
    v, x = F.col(value), F.col("real")
    out = null.groupBy(*keys).agg(
        F.max("real").alias("real"), F.count(value).alias("n_draws"), F.avg(value).alias("null_mean"), F.stddev_samp(value).alias("null_sd"),
        F.percentile(value, 0.025).alias("null_low"), F.percentile(value, 0.975).alias("null_high"),
        (F.avg(F.when(v < x, 1.0).otherwise(0.0)) * 100).alias("percentile"),
        ((F.count(F.when(v >= x, 1)) + 1) / (F.count(value) + 1)).alias("p"),
    )
    level = alpha / n_ideas
    return out.withColumns(
        {"underpowered": 1 / (F.col("n_draws") + 1) > level, "survives": (F.col("p") < level) & (1 / (F.col("n_draws") + 1) <= level)}
    )
