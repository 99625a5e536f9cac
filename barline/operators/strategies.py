"""Rule strategies from a table of any size, run over every symbol's bars.

Strategies are cut into blocks. A block meets the bars of one symbol after the other; the
state of all its strategies (position, best price, age) is an array that moves on bar by bar, and
daily results are summed over symbols before they leave the task. What is held is one
symbol's calendar and one block's days.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.functions.mathx import deflated_sharpe
from barline.operators import metrics as mx
from barline.operators.dependence import _histories
from barline.session import durable

MAX_SCALE = 3.0
#: Strategies that move together through a task.
BLOCK = 64
SCALARS = ("hold_days", "trailing_stop", "kelly_share", "conviction", "vol_target")


def votes(x: np.ndarray, weights: np.ndarray, entry: np.ndarray, exit_: np.ndarray) -> np.ndarray:
    """Scores (bars, strategies): weighted votes of channels ``x`` (bars, channels) against (strategies, channels) levels."""
    out = np.zeros((len(x), len(weights)))
    for k in range(x.shape[1]):
        c = x[:, k, None]
        out += weights[:, k] * ((c > entry[:, k]).astype(float) - (c < -exit_[:, k]))
    return out


def hold_paths(score: np.ndarray, price: np.ndarray, vol: np.ndarray, p: dict[str, np.ndarray], cap: float) -> np.ndarray:
    """Positions (bars, strategies): enter on conviction; leave on stop, age, or reversal.

    A name left on a bar may be entered again on the same bar. ``p`` holds the strategies' scalars.
    """
    n = score.shape[1]
    out = np.zeros(score.shape)
    pos, best, age = np.zeros(n), np.zeros(n), np.zeros(n)
    usable = np.isfinite(vol) & (vol > 1e-6)
    for i, px in enumerate(price):
        s = score[i]
        strong = np.abs(s) > p["conviction"]
        long, short = pos > 0, pos < 0
        age += long | short
        best = np.where(long, np.maximum(best, px), np.where(short, np.minimum(best, px), best))
        fallen = np.zeros(n)
        np.divide(best - px, best, out=fallen, where=long & (best > 0))
        if px > 0:
            fallen[short] = (px - best[short]) / max(px, 1e-12)
        leave = (long | short) & ((fallen > p["trailing_stop"]) | (age >= p["hold_days"]) | ((s * pos < 0) & strong))
        pos = np.where(leave, 0.0, pos)
        enter = (pos == 0) & strong
        if enter.any():
            v = np.full(n, vol[i]) if usable[i] else p["vol_target"]
            scale = np.ones(n)
            np.divide(p["vol_target"], v, out=scale, where=p["vol_target"] > 0)
            size = np.clip(np.abs(s) * p["kelly_share"] * np.clip(scale, 0.0, MAX_SCALE), 0.0, cap)
            pos = np.where(enter, np.sign(s) * size, pos)
            best, age = np.where(enter, px, best), np.where(enter, 0, age)
        out[i] = pos
    return out


class Days:
    """Sums over symbols of what the strategies of a block earn and trade, by bar."""

    def __init__(self, n: int):
        self.low, self.n = 0, n
        self.sums = np.zeros((3, 0, n))
        self.symbols = np.zeros(0, np.int64)

    def add(self, bars: np.ndarray, values: np.ndarray) -> None:
        """``values`` (3, bars, strategies) at distinct ``bars``."""
        low, high = int(bars.min()), int(bars.max())
        if not len(self.symbols):
            self.low = low
        before, after = max(self.low - low, 0), max(high + 1 - self.low - len(self.symbols), 0)
        self.sums = np.pad(self.sums, ((0, 0), (before, after), (0, 0)))
        self.symbols = np.pad(self.symbols, (before, after))
        self.low = min(self.low, low)
        self.sums[:, bars - self.low] += values
        self.symbols[bars - self.low] += 1


def _walk(batches: Iterator[pd.DataFrame], keys: list[str], cap: float, long_only: bool) -> Iterator[pd.DataFrame]:
    """Days of each (keys, block) whose rows arrive together, its strategies first, then its bars by symbol."""
    group = own = days = None

    def out() -> pd.DataFrame:
        there = np.flatnonzero(days.symbols)
        sums = days.sums[:, there]
        lists = {c: [sums[i, :, k].tolist() for k in range(days.n)] for i, c in enumerate(("gross", "turnover", "trades"))}
        head = {k: [v] * days.n for k, v in zip(keys, group[: len(keys)], strict=True)}
        return pd.DataFrame({**head, "strategy": own["strategy"].to_numpy(), "bars": [(there + days.low).tolist()] * days.n, **lists})

    for h in _histories(batches, [*keys, "block", "salt", "kind", "sym"]):
        first = h.iloc[0]
        at = tuple(first[c] for c in (*keys, "block", "salt"))
        if at != group:
            if days is not None and len(days.symbols):
                yield out()
            group, days = at, None
        if first["kind"] == 0:
            own = h.sort_values("strategy", ignore_index=True)
            p = {c: own[c].to_numpy(dtype="float64") for c in SCALARS}
            levels = [np.vstack(own[c].to_numpy()) for c in ("weights", "entry", "exit")]
            days = Days(len(own))
            continue
        h = h.sort_values("bar_idx")
        score = votes(np.vstack(h["x"].to_numpy()), *levels)
        score = np.maximum(score, 0.0) if long_only else score
        pos = hold_paths(score, h["close"].to_numpy(dtype="float64"), h["vol"].to_numpy(dtype="float64"), p, cap)
        before = np.vstack([np.zeros(days.n), pos[:-1]])
        ahead = np.nan_to_num(h["ahead"].to_numpy(dtype="float64"))[:, None]
        days.add(h["bar_idx"].to_numpy(dtype="int64"), np.stack([pos * ahead, np.abs(pos - before), ((pos != 0) & (pos != before)).astype(float)]))
    if days is not None and len(days.symbols):
        yield out()


def strategy_days(bars: DataFrame, strategies: DataFrame, *keys: str, cap: float = 0.1, long_only: bool = True, cost_bps: float = 22.0, salts: int = 1) -> DataFrame:
    """(keys, strategy, dt, ret, turnover, trades): net daily results of every strategy; half the round-trip cost is paid on each change.

    ``bars(keys, sym, bar_idx, close, vol, ahead, x)`` with channels ``x``; ``strategies(strategy, weights, entry, exit, ..)``
    with distinct numbers from 0. ``salts`` tasks share a block's symbols where these are many.
    """
    names = list(keys)
    blocks = strategies.withColumn("block", F.floor(F.col("strategy") / BLOCK).cast("int"))
    numbers = blocks.select("block").distinct()
    salt = F.pmod(F.xxhash64("sym"), F.lit(salts)).cast("int")
    # every block meets every bar: that is the work to be done
    cells = bars.select(*names, "sym", "bar_idx", "close", "vol", "ahead", "x").withColumn("salt", salt).withColumn("kind", F.lit(1)).join(
        F.broadcast(numbers), how="cross")
    groups = bars.select(*names).distinct() if names else bars.sparkSession.range(1).select()
    heads = blocks.join(groups, how="cross").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("kind", F.lit(0))
    heads = heads.withColumn("sym", F.lit(0).cast(bars.schema["sym"].dataType))
    both = cells.unionByName(heads.select(*names, "sym", "salt", "kind", "block", "strategy", "weights", "entry", "exit", *SCALARS), allowMissingColumns=True)
    n = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = both.repartition(n, *names, "block", "salt").sortWithinPartitions(*names, "block", "salt", "kind", "sym")
    kinds = ", ".join(f"`{k}` {bars.schema[k].dataType.simpleString()}" for k in names)
    schema = (kinds + ", " if kinds else "") + "strategy int, bars array<int>, gross array<double>, turnover array<double>, trades array<double>"
    parts = met.mapInPandas(partial(_walk, keys=names, cap=cap, long_only=long_only), schema)
    each = parts.select(*names, "strategy", F.explode(F.arrays_zip("bars", "gross", "turnover", "trades")).alias("d"))
    day = each.groupBy(*names, "strategy", F.col("d.bars").alias("dt")).agg(
        F.sum("d.gross").alias("_g"), F.sum("d.turnover").alias("turnover"), F.sum("d.trades").cast("long").alias("trades"))
    return day.select(*names, "strategy", "dt", (F.col("_g") - F.col("turnover") * cost_bps / 20_000).alias("ret"), "turnover", "trades")


def strategy_scores(days: DataFrame, *keys: str) -> DataFrame:
    """Trading statistics and fitness per (keys, strategy)."""
    return mx.selection_score(mx.trading_stats(days, *keys, "strategy"))


def sweep(bars: DataFrame, strategies: DataFrame, **kw) -> DataFrame:
    """Per window the strategy best on its training side, its test result, and what remains of the pooled test Sharpe after all trials.

    ``bars`` carry (w, side). (w, strategy, in_sample, out_sample, trades, gap, total_trials, deflated): the last
    two are the same in every row. The number of trials is that of all strategies in all windows.
    """
    days = durable(strategy_days(bars, strategies, "w", "side", **kw), "strategy-days")
    stats = durable(strategy_scores(days, "w", "side"), "sweep")
    pick = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    both = stats.groupBy("w", "strategy").agg(
        pick("train", "fitness").alias("_fit"), pick("train", "sharpe").alias("in_sample"), pick("test", "sharpe").alias("out_sample"),
        pick("test", "n_trades").alias("trades"))
    best = both.groupBy("w").agg(F.max_by(F.struct("strategy", "in_sample", "out_sample", "trades"), F.struct("_fit", -F.col("strategy"))).alias("b"))
    best = durable(best.select("w", "b.*").withColumn("gap", F.col("in_sample") - F.col("out_sample")), "picked")
    # one row: the picked strategies' test days, one after the other
    tested = days.where("side = 'test'").join(best.select("w", "strategy"), ["w", "strategy"])
    pooled = mx.performance(tested.select(F.lit(0).alias("_all"), (F.col("w") * 1_000_000 + F.col("dt")).alias("dt"), "ret", "turnover"), "_all")
    trials = stats.where("side = 'train'").agg(F.count(F.lit(1)).alias("total_trials"))
    row = pooled.join(trials, how="cross").select(
        "total_trials", deflated_sharpe("sharpe", "n", F.col("total_trials"), F.col("skew"), F.col("kurt")).alias("deflated"))
    return best.join(F.broadcast(row), how="cross")
