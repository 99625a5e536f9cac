"""Trade ledgers: state replay, marking to market, risk checks, and the order fold."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.functions import costs
from barline.functions.cols import attach
from barline.session import spread

TRADE_COLUMNS = (
    "account string, seq bigint, day int, ticker string, side string, quantity double, signal_price double, "
    "fill_price double, slippage_pct double, notional double, position_after double, cash_after double"
)


def last_positions(trades: DataFrame, *keys: str) -> DataFrame:
    """Last position per ticker; closed ones are left out."""
    out = trades.groupBy(*keys, "ticker").agg(F.max_by("position_after", "id").alias("shares"))
    return out.where(F.col("shares") != 0)


def last_cash(trades: DataFrame, start: float) -> DataFrame:
    """Cash after the newest trade; a ledger without one starts fresh."""
    return trades.agg(F.coalesce(F.max_by("cash_after", "id"), F.lit(start)).alias("cash"))


def marked(positions: DataFrame, prices: DataFrame, cash: DataFrame) -> DataFrame:
    """(equity, largest position share): positions at current prices plus cash; an unknown price is zero."""
    value = positions.join(prices, "ticker", "left").withColumn("_v", F.col("shares") * F.coalesce("price", F.lit(0.0)))
    out = attach(value.agg(F.coalesce(F.sum("_v"), F.lit(0.0)).alias("_mark"), F.max(F.abs("_v")).alias("_top"), F.count(F.lit(1)).alias("n_positions")), cash)
    eq = F.col("cash") + F.col("_mark")
    return out.select(
        eq.alias("equity"), "n_positions", F.when(eq > 0, F.coalesce("_top", F.lit(0.0)) / eq).otherwise(0.0).alias("max_position_pct")
    )


def daily_pnl(equity: DataFrame, *keys: str) -> DataFrame:
    """PnL and return against the day before, per account."""
    w = Window.partitionBy(*keys).orderBy("dt")
    before = F.lag("equity").over(w)
    return equity.withColumns({"pnl": F.col("equity") - before, "ret": (F.col("equity") - before) / (before + 1e-9)})


def risk_breaches(equity: DataFrame, *keys: str, max_loss: float = 0.05, max_drawdown: float = 0.20) -> DataFrame:
    """Daily loss against the previous close and drawdown from the peak so far, with flags."""
    w = Window.partitionBy(*keys).orderBy("dt")
    start = F.lag("equity").over(w)
    peak = F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = equity.withColumns({"_s": start, "_p": peak})
    out = out.withColumns(
        {
            "loss": F.when(F.col("_s") > 0, (F.col("_s") - F.col("equity")) / F.col("_s")),
            "drawdown": F.when(F.col("_p") > 0, (F.col("_p") - F.col("equity")) / F.col("_p")),
        }
    )
    return out.withColumns(
        {
            "loss_breach": F.coalesce(F.col("loss") >= max_loss, F.lit(False)),
            "drawdown_breach": F.coalesce(F.col("drawdown") >= max_drawdown, F.lit(False)),
        }
    ).drop("_s", "_p")


def large_moves(daily: DataFrame, limit: float = 0.1) -> DataFrame:
    start = F.col("equity") - F.col("pnl")
    return daily.where((start > 0) & (F.abs("pnl") / start >= limit)).withColumn("move", F.abs("pnl") / start)


def replace_day(stored: DataFrame, new: DataFrame, key: str = "day") -> DataFrame:
    """Keyed overwrite: rows of the stored table whose key is written again leave."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


BANKRUPT = 0.001


def fold_orders(
    orders: pd.DataFrame, cash: float, shares: dict[str, float], last: dict[str, float],
    max_position: float = 0.25, commission: float = 0.0,
) -> tuple[list[tuple], float]:
    """One account's orders in sequence: cap, size, slip, pay, or write off.

    Fills feed the next order's equity, so this is the per-key state step of both
    the batch fold and the stream. Returns fills and the cash left.
    """
    fills: list[tuple] = []
    for o in orders.itertuples(index=False):
        held = shares.get(o.ticker, 0.0)
        if o.price <= BANKRUPT:
            if held:
                fills.append((o.seq, o.day, o.ticker, "writeoff", held, o.price, 0.0, 0.0, 0.0, 0.0, cash))
            shares.pop(o.ticker, None)
            last[o.ticker] = 0.0 if held else max(o.price, 0.0)
            continue
        last[o.ticker] = o.price
        room = max_position * min(1.0, o.cap) if o.weight > 0 else max_position
        goal = min(max(o.weight, -room), room)
        # plain sums in a fixed order: positions compound, so digits must not depend on who came first
        held_worth = 0.0
        for k in sorted(shares):
            held_worth += shares[k] * last.get(k, 0.0)
        worth = cash + held_worth
        change = goal * worth / max(o.price, 1e-9) - held
        if abs(change * o.price) < 1.0:
            continue
        buy = change > 0
        slip = _slip(o.volume, abs(change) * o.price, getattr(o, "daily_value", 0.0))
        paid = o.price * (1 + slip if buy else 1 - slip)
        if buy and change * paid + commission > cash:
            change = (cash - commission) / paid
            if change <= 0:
                continue
        cash -= change * paid + commission
        shares[o.ticker] = held + change
        fills.append(
            (o.seq, o.day, o.ticker, "buy" if buy else "sell", abs(change), o.price, paid, slip * 100, abs(change) * paid, shares[o.ticker], cash)
        )
    return fills, cash


def _slip(volume: float, value: float, daily_value: float | None) -> float:
    tiers = ((costs.HIGH_VOLUME, costs.HIGH_SLIPPAGE), (costs.MID_VOLUME, costs.MID_SLIPPAGE))
    base = next((s for v, s in tiers if volume >= v), costs.LOW_SLIPPAGE) / 100
    return min(costs.MAX_SLIPPAGE, base + value / daily_value * 0.01) if daily_value else base


def run_orders(orders: DataFrame, capital: float = 100_000.0, max_position: float = 0.25) -> DataFrame:
    """Ledger of every account, each replayed in order of ``seq``.

    Accounts are independent; the sequence inside one is inherent, since each fill
    changes the equity the next order is sized on.
    """
    names = [c.split()[0] for c in TRADE_COLUMNS.split(", ")]

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        fills, _ = fold_orders(pdf, capital, {}, {}, max_position)
        out = pd.DataFrame(fills, columns=names[1:])
        out.insert(0, "account", str(pdf["account"].iloc[0]))
        return out

    return spread(orders, "account").groupBy("account").applyInPandas(replay, TRADE_COLUMNS)
