"""Trailing sums and spreads of many symbols a call, the gate's step, and how the synthetic panel is dealt."""

import math
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.functions.cols import roll_mean, roll_std, roll_sum, trailing_z
from barline.operators import technical
from barline.operators.rolling import Roll, rolled
from barline.sources import synthetic
from barline.streaming.stateful import volatility_gate


def _panel(spark):
    rng = random.Random(3)
    rows = []
    for sym, n in ((1, 90), (2, 1), (3, 400), (4, 25)):
        for i in range(n):
            # gaps, long runs of one value, one value far off
            x = None if rng.random() < 0.1 else 0.1 if 30 < i < 60 else rng.gauss(1e3, 1.0) if i != 70 else 1e9
            rows.append((sym, i, x))
    return spark.createDataFrame(rows, "sym bigint, at int, x double").select("sym", F.expr("date_add(DATE '2020-01-01', at)").alias("dt"), "x")


@pytest.mark.parametrize("rows", [None, 40])
def test_rolls_equal_windows(spark, monkeypatch, rows):
    if rows:
        monkeypatch.setattr("barline.operators.rolling.BLOCK", 7)
        monkeypatch.setattr("barline.operators.recursive.ROWS", rows)
    panel = _panel(spark)
    want = panel.withColumns({
        "s": roll_sum("x", 5), "m": roll_mean("x", 20, 3), "d": roll_std("x", 20, 2), "z": trailing_z("x", 60, 20), "full": roll_std("x", 252, 200)})
    got = rolled(panel, {
        "s": Roll("sum", "x", 5), "m": Roll("mean", "x", 20, 3), "d": Roll("std", "x", 20, 2), "z": Roll("z", "x", 60, 20, skip=1), "full": Roll("std", "x", 252, 200)})
    a, b = ({(r.sym, r.dt): r for r in df.collect()} for df in (want, got))
    assert a.keys() == b.keys() and len(a) == 516
    for key, r in a.items():
        for c in ("s", "m", "d", "z", "full"):
            x, y = r[c], b[key][c]
            assert (x is None) == (y is None), (key, c, x, y)
            assert x is None or math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-7), (key, c, x, y)
    # equal values have no spread at all
    assert any(r["d"] == 0.0 for r in b.values())


def test_features_slide_no_window_over_single_rows(spark):
    """a window of SQL was evaluated anew for every row."""
    panel = _panel(spark).select("sym", "dt", F.col("x").alias("close"), F.lit(5.0).alias("volume"), F.lit(2).alias("trades"), F.lit(1.0).alias("delivered"))
    for df in (technical.return_features(panel), technical.delivery_features(panel)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "stddev" not in plan and "avg(" not in plan


def _gate_by_loop(ts, px, window=20, sigma=2.0, lockout=1_800_000_000):
    past, last, out = [], None, []
    for at, x in zip(ts, px):
        z = (x - statistics.fmean(past)) / (statistics.pstdev(past) + 1e-9) if len(past) >= 2 else None
        if z is not None and z > sigma:
            last = at
        out.append((z, 0.0 if last is not None and at - last < lockout else 1.0))
        past = [*past, x][-window:]
    return out


@pytest.mark.parametrize("cuts", [[0, 500], [0, 1, 2, 3, 19, 20, 21, 22, 60, 500], [0, 15, 30, 500]])
def test_gate_takes_slices_not_prints(monkeypatch, cuts):
    """two numpy calls a print; a slice is one call, and where slices end changes nothing."""
    rng = random.Random(4)
    ts = np.cumsum([rng.randint(0, 400_000_000) for _ in range(500)])
    px = [rng.gauss(100, 5) for _ in ts]
    rows = pd.DataFrame({"sym": 1, "event_id": range(500), "ts": ts.astype("datetime64[us]"), "px": px})
    step, memory, parts = volatility_gate(), {}, []

    def none(*a, **k):
        raise AssertionError("one call a print")

    monkeypatch.setattr(np, "mean", none)
    monkeypatch.setattr(np, "std", none)
    for a, b in zip(cuts, cuts[1:]):
        parts.append(step(memory, rows[a:b].reset_index(drop=True)))
    got = pd.concat(parts, ignore_index=True)
    for (z, cap), g in zip(_gate_by_loop(ts.tolist(), px), got.itertuples(), strict=True):
        assert cap == g.cap
        assert (z is None) == math.isnan(g.z) and (z is None or math.isclose(z, g.z, rel_tol=1e-6, abs_tol=1e-6))
    assert 0 < (got.cap == 0).sum() < 500


def test_synthetic_panel_is_dealt_before_it_grows(spark, monkeypatch):
    """few bytes of symbols, which may meet in one task, grew to all rows there."""
    monkeypatch.setattr("barline.session.TASK_ROWS", 500)
    cal = spark.range(300).select(F.expr("date_add(DATE '2020-01-01', CAST(id AS INT))").alias("dt"), F.col("id").cast("int").alias("bar_idx"))
    out = synthetic.regime_panel(spark.range(40).select(F.col("id").alias("sym")), cal)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "SortMergeJoin" not in plan
    assert out.rdd.getNumPartitions() == 24
    assert out.count() == 12_000
