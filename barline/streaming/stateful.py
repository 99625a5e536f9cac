"""State steps of the live rules: what a key remembers between slices of its rows.

A step sees rows in event order (``eventtime.InOrder`` sees to that), updates a small dict
and returns its results. ``m["forget"]`` is a time after which the memory does not matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from barline.streaming.eventtime import DAY_US, Step, micros


def suppress_repeats(min_gap_us: int = 0) -> Step:
    """Keeps a record unless it comes too soon after, or equals, the last kept one (``sig``)."""

    def step(m: dict, rows: pd.DataFrame) -> pd.DataFrame:
        if not min_gap_us:
            sig = rows["sig"].to_numpy(object)
            changed = np.append(sig[0] != m.get("sig"), sig[1:] != sig[:-1])
            m["sig"] = sig[-1]
            return rows.loc[changed, ["sym", "event_id"]]
        kept = []
        for i, (at, sig) in enumerate(zip(micros(rows["ts"]).tolist(), rows["sig"].tolist())):
            if "at" in m and at - m["at"] < min_gap_us:
                continue
            if m.get("sig") == sig:
                continue
            m["sig"], m["at"] = sig, at
            kept.append(i)
        return rows.iloc[kept][["sym", "event_id"]]

    return step


REPEATS = "sym bigint, event_id bigint"


def volatility_gate(window: int = 20, sigma: float = 2.0, lockout_us: int = 30 * 60 * 1_000_000) -> Step:
    """Cap 0 for a while after a print more than ``sigma`` spreads above the prints before it."""

    def step(m: dict, rows: pd.DataFrame) -> pd.DataFrame:
        at, px = micros(rows["ts"]), rows["px"].to_numpy(float)
        past = np.array(m.get("past", []), float)
        known = np.concatenate([past, px])
        z = np.full(len(px), np.nan)
        # the first prints have fewer before them than the window holds
        short = min(max(window - len(past), 0), len(px))
        for i in range(short):
            if (n := len(past) + i) >= 2:
                z[i] = (px[i] - known[:n].mean()) / (known[:n].std() + 1e-9)
        if short < len(px):
            before = np.lib.stride_tricks.sliding_window_view(known, window)[len(past) + short - window: -1]
            z[short:] = (px[short:] - before.mean(axis=1)) / (before.std(axis=1) + 1e-9)
        until = np.where(z > sigma, at + lockout_us, np.iinfo(np.int64).min)
        if m.get("until") is not None:
            until[0] = max(until[0], m["until"])
        until = np.maximum.accumulate(until)
        m["past"] = known[-window:].tolist()
        m["until"] = int(until[-1]) if at[-1] < until[-1] else None
        return rows[["sym", "event_id"]].assign(z=z, cap=np.where(at < until, 0.0, 1.0))

    return step


GATE = "sym bigint, event_id bigint, z double, cap double"


def crash_lockout(drop: float = 0.2, bars: int = 30) -> Step:
    """Locks a name for ``bars`` prints when one falls by more than ``drop``; the falling print is the first."""

    def step(m: dict, rows: pd.DataFrame) -> pd.DataFrame:
        px = rows["px"].to_numpy(float)
        before = np.append(m.get("last", np.nan), px[:-1])
        with np.errstate(divide="ignore", invalid="ignore"):
            fell = np.where(before != 0, px / before - 1, np.nan) < -drop
        i = np.arange(len(px))
        # prints since the last fall; before the first one here, what was left of an earlier lock
        since = i - np.maximum.accumulate(np.where(fell, i, -1))
        left = np.where(np.maximum.accumulate(fell), bars - 1 - since, m.get("left", 0) - 1 - i)
        locked = left > 0
        m["last"], m["left"] = float(px[-1]), max(int(left[-1]), 0)
        return rows[["sym", "event_id"]].assign(locked=locked)

    return step


LOCKOUT = "sym bigint, event_id bigint, locked boolean"


def day_return() -> Step:
    """Return since the first print of the day."""

    def step(m: dict, rows: pd.DataFrame) -> pd.DataFrame:
        days = rows["dt"].astype(str)
        opens = rows["px"].groupby(days).transform("first")
        if m.get("day") == days.iloc[0]:
            opens = opens.mask(days == m["day"], m["open"])
        m["day"], m["open"] = days.iloc[-1], float(opens.iloc[-1])
        m["forget"] = int(micros(rows["ts"])[-1] // DAY_US + 1) * DAY_US
        return rows[["sym", "event_id"]].assign(ret=np.where(opens != 0, rows["px"] / opens.replace(0, np.nan) - 1, 0.0))

    return step


RETURN = "sym bigint, event_id bigint, ret double"


def quiet_alerts(window_us: int = 900 * 1_000_000) -> Step:
    """Sends an alert unless the same one was sent within the window; counts what it held back."""

    def step(m: dict, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for eid, text, at in zip(rows["event_id"].tolist(), rows["text"].tolist(), micros(rows["ts"]).tolist()):
            if "at" in m and at - m["at"] < window_us:
                m["held"] = m.get("held", 0) + 1
                continue
            out.append((text, eid, m.get("held", 0)))
            m["at"], m["held"] = at, 0
        if m.get("held"):
            m.pop("forget", None)
        else:
            m["forget"] = m["at"] + window_us
        return pd.DataFrame(out, columns=["text", "event_id", "held"])

    return step


ALERTS = "text string, event_id bigint, held bigint"


def account_risk(start: float, max_loss: float = 0.05, max_drawdown: float = 0.20) -> Step:
    """Loss since the day's start and drawdown from the peak, print by print."""

    def step(m: dict, rows: pd.DataFrame) -> pd.DataFrame:
        days, pnl = rows["dt"].astype(str), rows["pnl"].to_numpy(float)
        now = np.cumsum(np.append(m.get("equity", start), pnl))
        before, now = now[:-1], now[1:]
        peak = np.maximum.accumulate(np.append(m.get("peak", start), now))[1:]
        opens = pd.Series(before, index=rows.index).groupby(days).transform("first")
        if m.get("day") == days.iloc[0]:
            opens = opens.mask(days == m["day"], m["open"])
        opens = opens.to_numpy(float)
        m["day"], m["open"], m["equity"], m["peak"] = days.iloc[-1], float(opens[-1]), float(now[-1]), float(peak[-1])
        with np.errstate(divide="ignore", invalid="ignore"):
            loss, fall = np.where(opens > 0, (opens - now) / opens, np.nan), np.where(peak > 0, (peak - now) / peak, np.nan)
        return rows[["sym", "event_id"]].assign(equity=now, loss=loss, drawdown=fall, loss_breach=loss >= max_loss, drawdown_breach=fall >= max_drawdown)

    return step


RISK = "sym bigint, event_id bigint, equity double, loss double, drawdown double, loss_breach boolean, drawdown_breach boolean"


def order_ledger(capital: float = 100_000.0, max_position: float = 0.25) -> Step:
    """Fills of one account; cash, holdings and last prices are the state."""
    from barline.operators.ledger import TRADE_COLUMNS, fold_orders

    names = [c.split()[0] for c in TRADE_COLUMNS.split(", ")]

    def step(m: dict, rows: pd.DataFrame) -> pd.DataFrame:
        shares, last = m.setdefault("shares", {}), m.setdefault("last", {})
        fills, m["cash"] = fold_orders(rows, m.get("cash", capital), shares, last, max_position)
        out = pd.DataFrame(fills, columns=names[1:])
        out.insert(0, "account", str(rows["account"].iloc[0]))
        return out

    return step
