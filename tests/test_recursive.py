"""Smoothing of many histories at once against one pandas pass per symbol."""

import datetime as dt

import numpy as np
import pandas as pd

from barline.operators import recursive


def by_hand(h):
    """Some of the smoothed columns of one history, and its place in the band."""
    c, hi, lo = h["close"], h["high"], h["low"]
    e = {n: c.ewm(span=n, adjust=False, min_periods=n).mean() for n in (12, 26)}
    macd, before = e[12] - e[26], c.shift()
    tr = np.fmax(hi - lo, np.fmax((hi - before).abs(), (lo - before).abs()))
    gain, loss = (x.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for x in (c.diff(), -c.diff()))
    wide = np.maximum(hi - lo, np.maximum((hi - before).abs(), (lo - before).abs())).ewm(span=20, adjust=False).mean()
    place = (c - c.ewm(span=20, adjust=False).mean()) / (2 * wide).clip(lower=1e-12)
    return h.assign(
        macd_signal=macd.ewm(span=9, adjust=False, min_periods=9).mean(), atr=tr.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean(),
        rsi14=100 - 100 / (1 + gain / loss.mask(loss == 0)), keltner_pos=place.clip(-3, 3))


def test_histories_are_smoothed_together(spark, monkeypatch):
    """Few calls, and histories that are cut by batches, have gaps or one row keep their values."""
    rng = np.random.default_rng(2)
    rows = []
    for s in range(60):
        for d in range(int(rng.choice([1, 5, 30, 200]))):
            close = None if s % 7 == 3 and d % 11 == 4 else float(rng.uniform(5, 50))
            rows.append((s, dt.date(2020, 1, 1) + dt.timedelta(days=d), 55.0, 4.0, close))
    panel = spark.createDataFrame(rows, "sym bigint, dt date, high double, low double, close double").coalesce(1)
    monkeypatch.setattr(recursive, "ROWS", 300)
    monkeypatch.setattr(recursive, "spread", lambda df, *keys: df.repartition(1, *keys))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        both = recursive.keltner(recursive.smoothed(panel))
        got = both.toPandas().sort_values(["sym", "dt"], ignore_index=True)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert "FlatMapGroups" not in both._jdf.queryExecution().toString()
    want = pd.DataFrame(rows, columns=["sym", "dt", "high", "low", "close"]).sort_values(["sym", "dt"])
    want["close"] = want["close"].astype("float64")
    want = pd.concat([by_hand(h) for _, h in want.groupby("sym")], ignore_index=True)
    assert len(got) == len(want)
    for c in ("macd_signal", "atr", "rsi14", "keltner_pos"):
        assert np.allclose(got[c].astype("float64"), want[c], equal_nan=True, rtol=1e-9), c


def test_only_what_is_read_goes_through_python(spark):
    from conftest import SF

    import __spark_entry__ as entry

    plan = entry.queries()["w24_pattern_features"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "turnover" not in plan
