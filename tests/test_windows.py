"""Window features: known values, missing data, and no look-ahead."""

import random

import pandas as pd
import pytest
from conftest import panel
from pyspark.sql import functions as F

from barline.functions.cols import expanding_z, trailing_z
from barline.operators import patterns, recursive, targets, technical
from barline.operators.walkforward import prefix_unchanged


@pytest.fixture(scope="module")
def walk(spark):
    rng = random.Random(3)
    px, rows = 100.0, []
    for _ in range(120):
        px *= 1 + rng.gauss(0, 0.02)
        rows.append(px)
    hi = [p * (1 + rng.random() * 0.02) for p in rows]
    lo = [p * (1 - rng.random() * 0.02) for p in rows]
    op = [l + (h - l) * rng.random() for h, l in zip(hi, lo)]
    return panel(spark, rows, high=hi, low=lo, open=op, volume=[float(rng.randint(1, 90)) for _ in rows]).cache()


def test_exponential_average_matches_pandas(walk):
    got = recursive.smoothed(walk).toPandas().sort_values("dt", ignore_index=True)
    want = got["close"].ewm(span=12, adjust=False, min_periods=12).mean()
    pd.testing.assert_series_equal(got["ema12"], want, check_names=False)
    assert got["ema50"].isna().sum() == 49


def test_warm_up_is_null(spark):
    out = technical.bollinger(panel(spark, [float(i) for i in range(1, 25)])).orderBy("dt").collect()
    assert out[18]["boll_pos"] is None and out[19]["boll_pos"] is not None


def test_constant_series_has_no_z_score(spark):
    out = panel(spark, [5.0] * 80).select(expanding_z("close").alias("a"), trailing_z("close").alias("b")).collect()
    assert all(r["a"] is None and r["b"] is None for r in out)


def test_trailing_z_leaves_the_current_row_out(spark):
    closes = [1.0, 2.0] * 15 + [100.0]
    z = panel(spark, closes).select("dt", trailing_z("close").alias("z")).orderBy("dt").collect()[-1]["z"]
    past = pd.Series(closes[:-1])
    assert z == pytest.approx((100 - past.mean()) / past.std())


@pytest.mark.parametrize("build, names", [
    (technical.lagged_features, ["mom_5", "vol_10", "zscore_21"]),
    (technical.volume_features, ["vwap_gap", "volume_ratio", "ret_over_sd"]),
    (patterns.pattern_features, ["engulfing", "ichimoku_cloud_pos", "vol_of_vol", "roll_spread"]),
    (technical.technical_channels, ["rsi14", "adx", "boll_pos"]),
])
def test_later_bars_do_not_change_earlier_rows(walk, build, names):
    cut = walk.where(F.col("dt") <= F.lit("2020-03-10").cast("date"))
    assert prefix_unchanged(build(walk), build(cut), ["sym", "dt"], names).isEmpty()


def test_candle_known_values(spark):
    p = panel(spark, [10.0, 12.0], open=[11.0, 9.0], high=[11.5, 12.5], low=[9.5, 8.5])
    last = patterns.candles(p).orderBy("dt").collect()[1]
    assert last["marubozu"] == pytest.approx(3 / 4)
    assert last["engulfing"] == pytest.approx(1.0)
    assert last["doji"] == pytest.approx(0.25)


def test_targets_are_valid_per_cell(spark):
    closes = [10.0, 11.0, None, 12.0, 13.0, 14.0, 15.0, 16.0, 17.0, 18.0]
    rows = targets.targets(panel(spark, closes)).orderBy("dt").collect()
    assert rows[0]["direction_1d"] == pytest.approx(0.1)
    assert rows[1]["direction_1d"] is None and rows[2]["direction_1d"] is None
    assert rows[0]["vol_5d"] is None and rows[3]["vol_5d"] is not None
    # a single name has no relative strength, but stays valid
    assert rows[0]["rel_strength_1d"] == 0.0


def test_kalman_gap_takes_the_prediction(spark):
    rows = recursive.kalman_fill(panel(spark, [5.0, None, 7.0]), "close", "f").orderBy("dt").collect()
    assert rows[0]["f"] == pytest.approx(5.0) and rows[1]["f"] == pytest.approx(5.0)
    assert 5.0 < rows[2]["f"] < 7.0


