"""Tables of rule strategies, and capital paths with whole shares."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.operators.xsection import CONVICTION, HOLD_DAYS, KELLY_SHARE, TRAILING_STOP, VOL_TARGET
from barline.session import spread
from barline.sources.synthetic import uniform


def random_strategies(spark, n: int, n_channels: int, seed: str = "g") -> DataFrame:
    """Strategy table of hashed parameter vectors: weights per channel, levels and six scalars."""
    base = spark.range(n).select(F.col("id").cast("int").alias("strategy"))
    u = lambda k: uniform(seed, "strategy", F.lit(k))
    raw = F.array(*[u(k) for k in range(n_channels)])
    span = lambda s, k: s[0] + (s[1] - s[0]) * u(k)
    base = base.withColumn("_w", raw).withColumn("_s", F.aggregate("_w", F.lit(0.0), lambda a, x: a + x))
    return base.select(
        "strategy", F.transform("_w", lambda x: x / F.col("_s")).alias("weights"),
        F.array(*[u(100 + k) * 0.5 for k in range(n_channels)]).alias("entry"), F.array(*[u(200 + k) * 0.5 for k in range(n_channels)]).alias("exit"),
        F.bround(span(HOLD_DAYS, 300)).cast("int").alias("hold_days"), span(TRAILING_STOP, 301).alias("trailing_stop"),
        span(KELLY_SHARE, 302).alias("kelly_share"), span(CONVICTION, 303).alias("conviction"), span(VOL_TARGET, 304).alias("vol_target"),
    )


CAPITAL = "account bigint, bar_idx int, equity double, pnl double, cost double, turnover double, quantisation double, untradeable int"


def capital_paths(weights: DataFrame, capital: float = 100_000.0, cap: float = 0.25) -> DataFrame:
    """Equity of each account with whole shares and itemised costs, session by session.

    ``weights(account, bar_idx, sym, weight, price, ret)``. Equity feeds the next
    session's sizes, so one account is a sequence; accounts run side by side.
    """
    from barline.functions import costs as c

    fees = (c.BROKERAGE + c.EXCHANGE_FEE + c.REGULATOR_FEE) * (1 + c.SERVICE_TAX)
    buy_rate, sell_rate = c.TRANSACTION_TAX_BUY + c.STAMP_DUTY_BUY + fees, c.TRANSACTION_TAX_SELL + fees

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        equity, held, out = capital, {}, []
        for bar, day in pdf.sort_values(["bar_idx", "sym"]).groupby("bar_idx"):
            w = day["weight"].clip(0.0, cap).to_numpy()
            px, r = day["price"].to_numpy(), day["ret"].fillna(0.0).to_numpy()
            want = np.trunc(np.where(px > 0, w * equity / np.maximum(px, 1e-12), 0.0))
            order = np.lexsort((-np.arange(len(w)), -np.abs(w), want == 0))
            fits = np.cumsum(np.abs(want * px)[order]) <= equity
            kept = np.zeros(len(w))
            kept[order[fits]] = want[order[fits]]
            trade = kept - np.array([held.get(s, 0.0) for s in day["sym"]])
            cost = float((np.abs(trade * px) * np.where(trade > 0, buy_rate, sell_rate)).sum())
            pnl = float((kept * px * r).sum())
            error = float(np.abs(w - kept * px / equity).sum()) if equity > 0 else 0.0
            equity += pnl - cost
            out.append((int(pdf["account"].iloc[0]), int(bar), equity, pnl, cost, float(np.abs(trade * px).sum() / max(equity, 1e-9)), error, int(((np.abs(w) > 1e-9) & (kept == 0)).sum())))
            held = dict(zip(day["sym"], kept))
        return pd.DataFrame(out, columns=[x.split()[0] for x in CAPITAL.split(", ")])

    return spread(weights, "account").groupBy("account").applyInPandas(run, CAPITAL)
