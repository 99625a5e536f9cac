"""Tick, quote, depth and minute-bar operators.

Raw tick streams are cut into time slices (see ``sliced``), so a symbol with a
third of all ticks is spread over many tasks; minute bars bound what a window
over one symbol's day can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.cols import by_sym, expanding_z, quotient, ratio, squash
from barline.operators.ordering import value_ranks
from barline.operators.sliced import sliced_lag, sliced_running_sum

DAY_SHAPE = (
    "overnight_gap", "open_range_pct", "first_hour_ret", "last_hour_ret", "intraday_rvol", "close_vs_vwap",
    "vwap_dispersion", "volume_concentration", "close_volume_share", "intraday_ret_skew", "signed_volume_frac",
    "path_efficiency",
)
ORDER_FLOW = ("depth_imbalance_mean", "depth_imbalance_close", "spread_mean_bps", "book_pressure_slope")


def day_shape(minutes: DataFrame, opens: int = 9 * 60 + 15, closes: int = 15 * 60 + 30) -> DataFrame:
    """Twelve features of the shape of a day from minute bars ``(sym, dt, minute, o, h, l, c, v)``.

    One window step (minute returns; at most 1,440 rows per symbol and day), then two
    aggregates that share the (sym, dt) partitioning.
    """
    w = Window.partitionBy("sym", "dt").orderBy("minute")
    prev = F.lag("close").over(w)
    m = F.col("minute")
    base = minutes.withColumns(
        {
            "_ret": ratio(F.col("close") - prev, prev),
            "_step": F.col("close") - prev,
            "_typ": (F.col("high") + F.col("low") + F.col("close")) / 3,
        }
    )
    day = base.groupBy("sym", "dt").agg(
        F.min_by("open", "minute").alias("_open"),
        F.max_by("close", "minute").alias("_close"),
        F.max(F.when(m < opens + 30, F.col("high"))).alias("_h30"),
        F.min(F.when(m < opens + 30, F.col("low"))).alias("_l30"),
        F.max_by(F.when(m < opens + 60, F.col("close")), F.when(m < opens + 60, m)).alias("_c60"),
        F.min_by(F.when(m >= closes - 60, F.col("open")), F.when(m >= closes - 60, m)).alias("_o60"),
        F.count("_ret").alias("_n"), F.avg("_ret").alias("_m"), F.stddev_samp("_ret").alias("_sd"),
        F.sum("volume").alias("_v"), F.sum(F.col("_typ") * F.col("volume")).alias("_pv"),
        F.sum(F.col("volume") ** 2).alias("_v2"),
        F.sum(F.when(m >= closes - 15, F.col("volume"))).alias("_v15"),
        F.sum(F.signum("_step") * F.col("volume")).alias("_sv"),
        F.count(F.lit(1)).alias("_bars"),
        F.sum(F.abs("_step")).alias("_path"),
    )
    day = day.withColumn("_vwap", F.when(F.col("_v") > 0, F.col("_pv") / F.col("_v")))
    # second pass for what needs the day's own mean or VWAP
    spread = base.join(day.select("sym", "dt", "_vwap", "_m", "_sd"), ["sym", "dt"]).groupBy("sym", "dt").agg(
        F.stddev_pop(ratio("_typ", "_vwap") - 1).alias("_disp"),
        F.avg(F.when(F.col("_sd") > 1e-12, F.pow((F.col("_ret") - F.col("_m")) / F.col("_sd"), F.lit(3)))).alias("_sk"),
    )
    before = F.lag("_close").over(by_sym())
    out = day.join(spread, ["sym", "dt"])
    traded = F.col("_v") > 0
    return out.select(
        "sym", "dt",
        (ratio("_open", before) - 1).alias("overnight_gap"),
        F.when(F.col("_close") > 0, (F.col("_h30") - F.col("_l30")) / F.col("_close")).alias("open_range_pct"),
        F.when(F.col("_open") > 0, F.col("_c60") / F.col("_open") - 1).alias("first_hour_ret"),
        F.when(F.col("_o60") > 0, F.col("_close") / F.col("_o60") - 1).alias("last_hour_ret"),
        F.when(F.col("_n") > 2, F.col("_sd")).alias("intraday_rvol"),
        F.when(F.col("_vwap") > 0, F.col("_close") / F.col("_vwap") - 1).alias("close_vs_vwap"),
        F.when(F.col("_vwap") > 0, F.col("_disp")).alias("vwap_dispersion"),
        F.when(traded, F.col("_v2") / (F.col("_v") * F.col("_v"))).alias("volume_concentration"),
        F.when(traded, F.col("_v15") / F.col("_v")).alias("close_volume_share"),
        F.when((F.col("_n") > 3) & (F.col("_sd") > 1e-12), F.col("_sk")).alias("intraday_ret_skew"),
        F.when((F.col("_bars") > 1) & traded, F.col("_sv") / F.col("_v")).alias("signed_volume_frac"),
        F.when(F.col("_path") > 1e-12, F.abs(F.col("_close") - F.col("_open")) / F.col("_path")).alias("path_efficiency"),
    )


def _levels(side: str, field: str, start: int = 1) -> Column:
    part = F.col(side) if start == 1 else F.slice(F.col(side), start, F.greatest(F.size(side) - start + 1, F.lit(0)))
    return F.aggregate(part, F.lit(0.0), lambda a, x: a + x[field].cast("double"))


def book_shape(depth: DataFrame, priced: bool = True) -> DataFrame:
    """Per snapshot: imbalance, best spread, its size in basis points, slope of book pressure.

    ``bids`` and ``asks`` are arrays of (quantity, price, orders), best level first.
    Snapshots without both sides, or without any quantity, are left out. With ``priced`` a
    spread in basis points needs a positive midpoint; without, it is the plain quotient.
    """
    base = depth.where((F.size("bids") > 0) & (F.size("asks") > 0))
    base = base.withColumns({"_b": _levels("bids", "quantity"), "_a": _levels("asks", "quantity")}).where(F.col("_b") + F.col("_a") > 0)
    bid, ask = F.col("bids")[0]["price"], F.col("asks")[0]["price"]
    near = F.col("bids")[0]["quantity"].cast("double") - F.col("asks")[0]["quantity"].cast("double")
    far = _levels("bids", "quantity", 2) - _levels("asks", "quantity", 2)
    mid = (bid + ask) / 2
    base = base.withColumns({"_near": near, "_far": far})
    return base.withColumns(
        {
            "imbalance": (F.col("_b") - F.col("_a")) / (F.col("_b") + F.col("_a")),
            "spread": ask - bid,
            "spread_bps": F.when(mid > 0, 10_000 * (ask - bid) / mid) if priced else quotient(10_000 * (ask - bid), mid),
            "slope": ratio(F.col("_near") - F.col("_far"), F.abs("_near") + F.abs("_far")),
        }
    ).drop("_b", "_a", "_near", "_far")


def order_flow_features(depth: DataFrame, pos: str = "pos", priced: bool = True) -> DataFrame:
    """Four daily features per symbol; the closing imbalance covers the last 2 % of snapshots.

    The cut for the last snapshots comes from exact ranks of the arrival order over
    value ranges, so a busy symbol's day is not sorted in one task.
    """
    shaped = book_shape(depth, priced)
    ranks = value_ranks(shaped, ["sym", "dt"], pos).withColumn(
        "_late", F.col("below") >= F.col("total") - F.greatest(F.lit(1), F.floor(F.col("total") / 50))
    )
    marked = shaped.join(ranks.select("sym", "dt", pos, "_late"), ["sym", "dt", pos])
    return marked.groupBy("sym", "dt").agg(
        F.avg("imbalance").alias("depth_imbalance_mean"),
        F.avg(F.when(F.col("_late"), F.col("imbalance"))).alias("depth_imbalance_close"),
        F.avg("spread_bps").alias("spread_mean_bps"),
        F.avg("slope").alias("book_pressure_slope"),
    )


def normalised(features: DataFrame, grid: DataFrame, names: tuple[str, ...], least: int = 60) -> DataFrame:
    """Features on the price grid, expanding z-score, squashed, undefined as 0."""
    out = grid.join(features, ["sym", "dt"], "left")
    return out.select("sym", "dt", *[F.coalesce(squash(expanding_z(c, least)), F.lit(0.0)).alias(c) for c in names])


def classify_trades(quotes: DataFrame, batch: list[str], order: list[str], slice_col: str = "slice") -> DataFrame:
    """Side of each trade: above or below the midpoint, else the midpoint's own move.

    The first trade of a batch compares its midpoint with itself.
    """
    base = quotes.withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    out = sliced_lag(base, batch, order, ["mid"], slice_col)
    before = F.coalesce("prev_mid", "mid")
    side = (
        F.when(F.col("px") > F.col("mid"), 1).when(F.col("px") < F.col("mid"), -1)
        .when(F.col("mid") > before, 1).when(F.col("mid") < before, -1).otherwise(0)
    )
    return out.withColumn("side", side)


def batch_imbalance(trades: DataFrame, batch: list[str]) -> DataFrame:
    """Order-flow imbalance per batch of classified trades."""
    signed = F.col("side") * F.col("qty")
    out = trades.groupBy(*batch).agg(
        F.sum(F.when(signed > 0, signed).otherwise(0.0)).alias("_b"),
        F.sum(F.when(signed < 0, -signed).otherwise(0.0)).alias("_s"),
        F.max_by("px", F.struct("ts", "event_id")).alias("last_px"),
    )
    return out.withColumn("ofi", (F.col("_b") - F.col("_s")) / (F.col("_b") + F.col("_s") + 1e-8)).drop("_b", "_s")


def decayed_imbalance(batches: DataFrame, order: str, n: int = 20, decay: float = 0.95) -> DataFrame:
    """Mean of the last ``n`` batch imbalances, newest weighted most."""
    w = by_sym(order=order).rowsBetween(-(n - 1), 0)
    recent = batches.withColumn("_l", F.reverse(F.collect_list("ofi").over(w)))
    weights = F.transform(F.sequence(F.lit(0), F.size("_l") - 1), lambda i: F.pow(F.lit(decay), i))
    add = lambda a, x: a + x
    num = F.aggregate(F.zip_with("_l", weights, lambda x, k: x * k), F.lit(0.0), add)
    return recent.withColumn("ofi_cum", num / F.aggregate(weights, F.lit(0.0), add)).drop("_l")


def flow_toxicity(batches: DataFrame, order: str, n: int = 20) -> DataFrame:
    """Impact, illiquidity and predictability of flow over the last ``n`` batches.

    Needs ``ofi`` and ``ret``; a constant window has no correlation. Until the window
    is full the estimate is 0.5 and the level unknown.
    """
    base = batches.withColumn("_po", F.lag("ofi").over(by_sym(order=order)))
    w = by_sym(order=order).rowsBetween(-(n - 1), 0)
    w1 = by_sym(order=order).rowsBetween(-(n - 2), 0)
    base = base.withColumns(
        {
            "_full": (F.count("ofi").over(w) == n) & (F.count("ret").over(w) == n),
            "_c": F.covar_pop("ofi", "ret").over(w), "_vo": F.var_pop("ofi").over(w), "_vr": F.var_pop("ret").over(w),
            "illiquidity": F.avg(F.abs("ret") / (F.abs("ofi") + 1e-4)).over(w),
            "_c1": F.covar_pop("_po", "ret").over(w1), "_vo1": F.var_pop("_po").over(w1), "_vr1": F.var_pop("ret").over(w1),
        }
    )
    def corr(c: str, a: str, b: str) -> Column:
        return F.when((F.col(a) > 1e-16) & (F.col(b) > 1e-16), F.col(c) / F.sqrt(F.col(a) * F.col(b)))
    base = base.withColumns(
        {
            "price_impact": F.when(F.col("_full"), F.coalesce(corr("_c", "_vo", "_vr"), F.lit(0.0))),
            "illiquidity": F.when(F.col("_full"), F.col("illiquidity")),
            "predictability": F.when(F.col("_full"), corr("_c1", "_vo1", "_vr1")),
        }
    )
    pin = F.abs("predictability")
    level = F.when(pin > 0.5, "HIGH").when(pin > 0.25, "MODERATE").when(pin.isNotNull(), "LOW")
    return base.withColumns(
        {
            "pin": F.when(F.col("_full"), pin).otherwise(0.5),
            "level": F.when(F.col("_full"), level).otherwise("UNKNOWN"),
            "follow": F.signum("predictability") * pin,
        }
    ).drop("_po", "_full", "_c", "_vo", "_vr", "_c1", "_vo1", "_vr1")


def session_vwap(tick_rows: DataFrame, alert_at: float = 0.65, slice_col: str = "slice") -> DataFrame:
    """Running session VWAP, deviation, signed volume imbalance and alert per tick.

    The volume yardstick is the session's mean volume per print so far.
    """
    base = tick_rows.withColumns({"_pv": F.col("px") * F.col("qty"), "_one": F.lit(1.0)})
    base = sliced_running_sum(base, ["sym", "dt"], ["ts", "event_id"], {"_cpv": "_pv", "_cv": "qty", "_cn": "_one"}, slice_col)
    base = sliced_lag(base, ["sym", "dt"], ["ts", "event_id"], ["px"], slice_col)
    vwap = F.col("_cpv") / (F.col("_cv") + 1e-9)
    move = F.when(F.col("prev_px") > 0, F.signum(F.col("px") - F.col("prev_px"))).otherwise(0.0)
    out = base.withColumns({"vwap": vwap, "imbalance": F.tanh(move * F.col("qty") / (F.col("_cv") / F.col("_cn") + 1e-9))})
    return out.withColumns(
        {
            "vwap_dev": (F.col("px") - F.col("vwap")) / (F.col("vwap") + 1e-9),
            "spread_bps": F.least(F.lit(50.0), 10_000 / (F.sqrt("qty") + 1)),
            "alert": F.abs("imbalance") > alert_at,
        }
    ).drop("_pv", "_one", "_cpv", "_cv", "_cn", "prev_px")


def live_return(tick_rows: DataFrame, pos: Column) -> DataFrame:
    """Return of the newest price since the day's first one; a single print gives zero."""
    day = tick_rows.groupBy("sym", "dt").agg(F.min_by("px", pos).alias("first_px"), F.max_by("px", pos).alias("last_px"))
    return day.withColumn("ret", F.when(F.col("first_px") != 0, F.col("last_px") / F.col("first_px") - 1).otherwise(0.0))


def with_live_row(history: DataFrame, live: DataFrame, bars: int) -> DataFrame:
    """The last ``bars - 1`` daily returns of each symbol followed by today's live return."""
    newest = Window.partitionBy("sym").orderBy(F.desc("dt"))
    recent = history.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= bars - 1)
    return recent.select("sym", "dt", "ret").unionByName(live.select("sym", "dt", "ret"))


def distinct_candles(candles: DataFrame) -> DataFrame:
    """Candles from overlapping fetches: one row per symbol and time, the earliest fetch wins."""
    values = [c for c in candles.columns if c not in ("sym", "ts", "chunk")]
    best = candles.groupBy("sym", "ts").agg(F.min_by(F.struct(*values), "chunk").alias("_c"))
    return best.select("sym", "ts", *[F.col(f"_c.{c}").alias(c) for c in values])


def changed_books(depth: DataFrame, order: list[str], signature: list[str], slice_col: str = "slice") -> DataFrame:
    """Snapshots that differ from the preceding one of the same symbol."""
    out = sliced_lag(depth.withColumn("_book", F.struct(*signature)), ["sym"], order, ["_book"], slice_col)
    return out.where(~F.col("_book").eqNullSafe(F.col("prev__book"))).drop("_book", "prev__book")
