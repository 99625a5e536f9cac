"""Sums, means, spreads and z-scores of trailing rows, many symbols a call.

A sliding window of SQL is evaluated anew for every row, once per aggregate. Here one step
per place of the window takes all rows of some hundred symbols at once. Values are taken
relative to the window's last one, so equal values have no spread and little is lost to
cancellation: the last value is itself one of the window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barline.operators.recursive import _whole


#: Rows whose arrays stay in the processor's cache
BLOCK = 1 << 13


class Roll(NamedTuple):
    """``kind`` (sum, mean, std, z) of the ``n`` rows that end ``skip`` rows before the current one.

    Missing until ``least`` values (all ``n`` if not given; a spread needs two) are present.
    A z-score is the current value's; it is missing where the spread is zero.
    """

    kind: str
    column: str
    n: int
    least: int | None = None
    skip: int = 0


def _last_known(known: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Place of the last known value up to each row of its history, -1 before the first."""
    at = np.maximum.accumulate(np.where(known, np.arange(len(known)), -1))
    return np.where(at >= start, at, -1)


def _moments(x: np.ndarray, known: np.ndarray, start: np.ndarray, n: int, skip: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(count, base, sum, sum of squares) of windows, the sums of values less ``base``."""
    rows = np.arange(len(x))
    end = rows - skip
    last = np.where(end >= start, _last_known(known, start)[np.maximum(end, 0)], -1)
    base = np.where(last >= 0, x[np.maximum(last, 0)], 0.0)
    count, total, squares = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    value = np.where(known, x, 0.0)
    for first in range(0, len(x), BLOCK):
        stop = min(first + BLOCK, len(x))
        for k in range(skip, min(skip + n, stop)):
            i = max(first, k)
            to, of = slice(i, stop), slice(i - k, stop - k)
            here = known[of] & (rows[of] >= start[to])
            d = np.where(here, value[of] - base[to], 0.0)
            count[to] += here
            total[to] += d
            d *= d
            squares[to] += d
    return count, base, total, squares


def _column(x: np.ndarray, known: np.ndarray) -> pa.Array:
    return pa.array(x, pa.float64(), mask=~known)


def rolled(
    panel: DataFrame, made: dict[str, Roll], then: dict[str, Callable[[dict], np.ndarray]] | None = None, filled: Sequence[str] = (), kept: Sequence[str] | None = None
) -> DataFrame:
    """Adds the columns ``made`` to a panel of one row per (sym, dt), and ``then`` functions of them.

    Functions of ``then`` are given all columns read or made, NaN where missing; their NaN is
    missing. Columns ``filled``, made or given, come out as doubles in which what is missing or
    not finite takes the symbol's last value before, or else 0. Names that begin with ``_`` are
    only for ``then``.
    """
    then = then or {}
    kept = [c for c in (panel.columns if kept is None else kept) if c not in filled]
    names = [n for n in dict.fromkeys([*made, *then, *filled]) if not n.startswith("_")]

    def work(rows: pa.Table, by: np.ndarray) -> dict[str, pa.Array]:
        start = np.searchsorted(by, by)

        def given(c: str) -> tuple[np.ndarray, np.ndarray]:
            values = rows.column(c).cast(pa.float64()).combine_chunks()
            return values.to_numpy(zero_copy_only=False), values.is_valid().to_numpy(zero_copy_only=False)

        columns = {c: given(c) for c in dict.fromkeys([*(m.column for m in made.values()), *(c for c in filled if c not in made and c not in then)])}
        moments, out = {}, dict(columns)
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            for name, m in made.items():
                key = (m.column, m.n, m.skip)
                if key not in moments:
                    moments[key] = _moments(*columns[m.column], start, m.n, m.skip)
                count, base, total, squares = moments[key]
                least = m.n if m.least is None else m.least
                known = count >= (max(2, least) if m.kind in ("std", "z") else max(1, least))
                mean = base + total / count
                if m.kind == "sum":
                    value = base * count + total
                elif m.kind == "mean":
                    value = mean
                else:
                    # NaN stays NaN
                    value = np.sqrt(np.maximum((squares - total * total / count) / (count - 1), 0.0))
                    if m.kind == "z":
                        x, there = columns[m.column]
                        known = known & there & (value != 0)
                        value = (x - mean) / value
                out[name] = (value, known)
            seen = {c: np.where(known, value, np.nan) for c, (value, known) in out.items()} if then else {}
            for name, fn in then.items():
                value = fn(seen)
                out[name] = (value, ~np.isnan(value))
            for name in filled:
                value, known = out[name]
                at = _last_known(known & np.isfinite(value), start)
                out[name] = (np.where(at >= 0, value[np.maximum(at, 0)], 0.0), np.ones(len(value), bool))
        return {n: _column(*out[n]) for n in names}

    return _whole(panel, ["sym"], names, work, kept)


__all__ = ["Roll", "rolled"]
