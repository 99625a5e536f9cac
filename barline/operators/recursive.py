"""Recursive smoothing and filtering.

An exponential average feeds on its own last value, which a window cannot
express. A symbol's history holds at most one row per calendar session; exponential
averages take some hundred histories at once, filters one after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barline.session import spread


def _grouped(panel: DataFrame, keys: list[str], names: list[str], fn) -> DataFrame:
    """Runs ``fn(history) -> {column: values}`` on each key's rows in session order."""
    schema = T.StructType(panel.schema.fields + [T.StructField(n, T.DoubleType()) for n in names])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt", ignore_index=True)
        return pdf.assign(**fn(pdf))

    return spread(panel, *keys).groupBy(*keys).applyInPandas(run, schema)


#: Rows that are worked on at once, whole symbols of a task
ROWS = 100_000


def _whole(
    panel: DataFrame, keys: Sequence[str], names: Sequence[str], work: Callable[[pa.Table, np.ndarray], dict], kept: Sequence[str] | None = None
) -> DataFrame:
    """Adds the columns ``names`` that ``work`` makes of many whole histories at once; ``kept`` are the columns of the panel that come along.

    ``work`` is given rows ordered by symbol and session, and a number that changes with the
    symbol: one call for some hundred symbols instead of one per symbol. A task holds ``ROWS``
    rows and the history that runs on.
    """
    fields = {f.name: f for f in panel.schema.fields}
    kept = list(panel.columns if kept is None else kept)
    schema = T.StructType([fields[c] for c in kept] + [T.StructField(n, T.DoubleType()) for n in names])

    def done(rows: pa.Table) -> pa.Table:
        ids = [rows.column(k).combine_chunks() for k in keys]
        at = np.zeros(len(rows), np.int64)
        for k in ids:
            code = k.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            at[1:] |= code[1:] != code[:-1]
        made = work(rows, np.cumsum(at))
        rows = rows.select(kept)
        for n in names:
            rows = rows.append_column(n, made[n])
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, goal = [], 0, ROWS
        for batch in batches:
            held, size = [*held, batch], size + batch.num_rows
            if size < goal:
                continue
            rows = pa.Table.from_batches(held)
            last = [rows.column(k)[-1] for k in keys]
            # the last history may go on in the next batch
            whole = size
            while whole and all(rows.column(k)[whole - 1] == v for k, v in zip(keys, last, strict=True)):
                whole -= 1
            if whole:
                yield from done(rows.slice(0, whole)).to_batches()
            rest = rows.slice(whole).combine_chunks()
            held, size = rest.to_batches(), rest.num_rows
            goal = max(ROWS, 2 * size)
        if size:
            yield from done(pa.Table.from_batches(held)).to_batches()

    return spread(panel, *keys).sortWithinPartitions(*keys, "dt").mapInArrow(run, schema)


def _many(
    panel: DataFrame, keys: Sequence[str], names: Sequence[str], fn: Callable[[pd.DataFrame, pd.Series], dict], kept: Sequence[str] | None = None
) -> DataFrame:
    """``_whole`` with closes, highs and lows as pandas columns; a missing value is NaN to the averages."""
    read = [c for c in ("close", "high", "low") if c in panel.columns]

    def work(rows: pa.Table, by: np.ndarray) -> dict:
        made = fn(pd.DataFrame({c: rows.column(c).cast(pa.float64()).to_numpy() for c in read}), pd.Series(by))
        return {n: pa.array(made[n].to_numpy(), pa.float64(), from_pandas=True) for n in names}

    return _whole(panel, keys, names, work, kept)


def _wilder(x: pd.Series | pd.DataFrame, n: int, by: pd.Series) -> pd.Series | pd.DataFrame:
    return _decayed(x, by, alpha=1 / n, min_periods=n)


def _span(x: pd.Series | pd.DataFrame, n: int, by: pd.Series) -> pd.Series | pd.DataFrame:
    return _decayed(x, by, span=n, min_periods=n)


def _decayed(x: pd.Series | pd.DataFrame, by: pd.Series, **how) -> pd.Series | pd.DataFrame:
    """Exponential average inside each symbol; the symbols' rows follow each other, so places stay."""
    return x.groupby(by, sort=False).ewm(adjust=False, **how).mean().set_axis(x.index)


def _no_zero(x: pd.Series) -> pd.Series:
    return x.mask(x == 0.0)


SMOOTHED = (
    "ema9", "ema12", "ema21", "ema26", "ema50", "macd", "macd_signal",
    "rsi14", "rsi28", "atr", "adx", "di_spread",
)


def _smooth_history(h: pd.DataFrame, by: pd.Series) -> dict[str, pd.Series]:
    close, high, low = (h[c].astype("float64") for c in ("close", "high", "low"))
    first = by != by.shift()
    out = {f"ema{n}": _span(close, n, by) for n in (9, 12, 21, 26, 50)}
    out["macd"] = out["ema12"] - out["ema26"]
    out["macd_signal"] = _span(out["macd"], 9, by)
    move = close.diff().mask(first)
    before = close.shift().mask(first)
    rise, fall = high.diff().mask(first), -low.diff().mask(first)
    parts = pd.DataFrame({
        "gain": move.clip(lower=0), "loss": (-move).clip(lower=0),
        "true_range": np.fmax(high - low, np.fmax((high - before).abs(), (low - before).abs())),
        "plus": rise.where((rise > fall) & (rise > 0), 0.0), "minus": fall.where((fall > rise) & (fall > 0), 0.0),
    })
    slow = _wilder(parts, 14, by)
    for n, w in ((14, slow), (28, _wilder(parts[["gain", "loss"]], 28, by))):
        out[f"rsi{n}"] = 100 - 100 / (1 + w["gain"] / _no_zero(w["loss"]))
    out["atr"] = slow["true_range"]
    scale = _no_zero(out["atr"])
    plus, minus = 100 * slow["plus"] / scale, 100 * slow["minus"] / scale
    out["adx"] = _wilder(100 * (plus - minus).abs() / _no_zero(plus + minus), 14, by)
    out["di_spread"] = plus - minus
    return out


def smoothed(panel: DataFrame, *keys: str, names: Sequence[str] = SMOOTHED, kept: Sequence[str] | None = None) -> DataFrame:
    """Adds exponential averages, their cross, strength indexes, true range, trend strength."""
    return _many(panel, [*keys, "sym"], names, _smooth_history, kept)


def _keltner_history(h: pd.DataFrame, by: pd.Series) -> dict[str, pd.Series]:
    close, high, low = (h[c].astype("float64") for c in ("close", "high", "low"))
    before = close.shift().mask(by != by.shift())
    wide = np.maximum(high - low, np.maximum((high - before).abs(), (low - before).abs()))
    middle = _decayed(pd.DataFrame({"close": close, "wide": wide}), by, span=20)
    return {"keltner_pos": ((close - middle["close"]) / (2 * middle["wide"]).clip(lower=1e-12)).clip(-3, 3)}


def keltner(panel: DataFrame) -> DataFrame:
    """Position inside an exponential band, no warm-up gate."""
    return _many(panel, ["sym"], ["keltner_pos"], _keltner_history)


def kalman_fill(panel: DataFrame, value: str, out: str, process: float = 1e-3, noise: float = 0.1) -> DataFrame:
    """Random-walk filter along one symbol: a gap takes the prediction, a print the update.

    Observed values are smoothed as well.
    """

    def run(h: pd.DataFrame) -> dict[str, np.ndarray]:
        seen = h[value].to_numpy(dtype="float64")
        known = seen[~np.isnan(seen)]
        level, spread = (known[0] if known.size else 0.0), 1.0
        path = np.empty(seen.size)
        for i, obs in enumerate(seen):
            spread += process
            if not np.isnan(obs):
                gain = spread / (spread + noise)
                level += gain * (obs - level)
                spread *= 1 - gain
            path[i] = level
        return {out: path}

    return _grouped(panel, ["sym"], [out], run)


def blended_path(panel: DataFrame, target: str, out: str, keep: float, keys: tuple[str, ...] = ("sym",)) -> DataFrame:
    """``w_t = keep * w_(t-1) + (1 - keep) * target_t``; the first row takes its target."""

    def run(h: pd.DataFrame) -> dict[str, pd.Series]:
        return {out: h[target].astype("float64").ewm(alpha=1 - keep, adjust=False).mean()}

    return _grouped(panel, list(keys), [out], run)


__all__ = ["SMOOTHED", "smoothed", "keltner", "kalman_fill", "blended_path"]
