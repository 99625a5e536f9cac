"""Ranks, quantiles, audits, permutations: exactness and calibration."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barline.functions import mathx
from barline.operators import dependence as dp, distance, metrics as mx, ordering, permute, sliced


def test_bucketed_rank_equals_pandas_with_a_hot_tie(spark):
    rng = random.Random(1)
    # one value holds a third of all rows
    rows = [(i % 3, 7.0 if rng.random() < 0.34 else rng.random() * 100, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, v double, i int")
    got = ordering.average_rank(df, ["g"], "v", "r").toPandas().sort_values("i")
    want = got.groupby("g")["v"].rank()
    assert np.allclose(got["r"], want)


def test_ranks_of_a_wide_group_are_consistent(spark):
    """300,000 different values in one group: as many different counts of smaller values, 0 to n - 1."""
    n = 300_000
    df = spark.range(n, numPartitions=16).select(F.lit(1).alias("g"), (F.xxhash64("id") / 7.0).alias("v"))
    out = ordering.value_ranks(df, ["g"], "v")
    row = out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("below").alias("d"), F.min("below").alias("lo"), F.max("below").alias("hi"), F.max("total").alias("t")).first()
    kinds = df.select("v").distinct().count()
    assert (row["n"], row["d"], row["lo"], row["t"]) == (kinds, kinds, 0, n) and row["hi"] == n - out.orderBy(F.desc("v")).first()["cnt"]


def test_exact_quantiles_equal_numpy(spark):
    rng = random.Random(2)
    rows = [(i % 2, rng.gauss(0, 1)) for i in range(2001)]
    out = ordering.exact_quantiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", {"a": 0.05, "b": 0.5}).collect()
    for r in out:
        x = [v for g, v in rows if g == r["g"]]
        assert r["a"] == pytest.approx(np.percentile(x, 5)) and r["b"] == pytest.approx(np.median(x))


def test_sliced_lag_crosses_empty_slices(spark):
    rows = [(1, t, float(t)) for t in (1, 2, 3, 65, 66, 500, 501, 502)]
    df = spark.createDataFrame(rows, "k int, t int, v double").withColumn("slice", F.floor(F.col("t") / 10))
    got = {r["t"]: r["prev_v"] for r in sliced.sliced_lag(df, ["k"], ["t"], ["v"]).collect()}
    assert got == {1: None, 2: 1.0, 3: 2.0, 65: 3.0, 66: 65.0, 500: 66.0, 501: 500.0, 502: 501.0}


def test_running_sum_over_slices(spark):
    df = spark.createDataFrame([(1, t, 1.0) for t in range(50)], "k int, t int, v double").withColumn("slice", F.floor(F.col("t") / 7))
    got = sorted(r["s"] for r in sliced.sliced_running_sum(df, ["k"], ["t"], {"s": "v"}).collect())
    assert got == [float(i) for i in range(1, 51)]


def test_false_discovery_known_values(spark):
    p = [0.01, 0.04, 0.03, 0.2]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
    q = {r["i"]: r["q"] for r in mx.false_discovery(df).collect()}
    assert q[0] == pytest.approx(0.04) and q[1] == pytest.approx(4 / 75) and q[2] == pytest.approx(4 / 75) and q[3] == pytest.approx(0.2)


def _market(spark, planted):
    rng = np.random.default_rng(5)
    rows = []
    for s in range(4):
        y = rng.normal(size=300)
        for t in range(300):
            x = y[t] + rng.normal() if planted else rng.normal()
            rows.append((s, dt.date(2020, 1, 1) + dt.timedelta(days=t), float(x), float(rng.normal()), float(y[t]), float(rng.normal())))
    return spark.createDataFrame(rows, "sym bigint, dt date, sig double, noise double, ret double, base_ret double")


def test_planted_signal_is_found_and_noise_is_not(spark):
    out = {r["feature"]: r for r in dp.feature_audit(_market(spark, True), ["sig", "noise"], ["ret"], draws=199).collect()}
    assert out["sig"]["significant"] and out["sig"]["spearman"] > 0.4
    assert not out["noise"]["significant"]


def test_noise_has_no_survivor(spark):
    out = dp.feature_audit(_market(spark, False), ["sig", "noise"], ["ret"], draws=199).collect()
    assert not any(r["significant"] for r in out)


@pytest.mark.parametrize("n", [5, 21, 42, 43, 62, 200, 588])
def test_block_sums_equal_moved_rows(n):
    rng = np.random.default_rng(n)
    x, y = rng.normal(size=(n, 3)), rng.normal(size=n)
    got = dp.moved_sums(x, y, 21, dp.block_ranks(n, 21, 40, "p"))
    assert np.allclose(got, y[dp.block_draws(n, 21, 40, "p")] @ x, rtol=1e-12, atol=1e-9)


def _centred(x):
    d = np.abs(np.subtract.outer(x, x))
    m = d.mean(axis=0)
    return d - m[:, None] - m[None, :] + m.mean()


@pytest.mark.parametrize("n", [4, 5, 8, 33, 64, 301])
@pytest.mark.parametrize("shape", ["plain", "ties", "far from zero"])
def test_distances_without_matrices(n, shape):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n)
    y = rng.normal(size=n) + x**2
    if shape == "ties":
        x, y = np.round(x), np.sign(y)
    if shape == "far from zero":
        x, y = x * 1e-3 + 50, np.abs(y) + 1000
    orders = np.array([np.arange(n), *[rng.permutation(n) for _ in range(6)]])
    a, b = _centred(x), _centred(y)
    assert np.allclose(distance.cross_parts(x, y, orders), [(a * b[np.ix_(o, o)]).mean() for o in orders], rtol=1e-9, atol=1e-11)
    assert np.isclose(distance.variance_part(x), (a * a).mean(), rtol=1e-9, atol=1e-11)


def test_long_series_need_no_matrix():
    rng = np.random.default_rng(1)
    x = rng.normal(size=60_000)
    assert distance.distance_correlation(x, x**2) > 0.3 > 0.02 > distance.distance_correlation(x, rng.normal(size=60_000))


def test_nonlinear_audit_finds_what_ranks_miss(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in range(3):
        half = rng.normal(size=120)
        x = rng.permutation(np.concatenate([half, -half]))
        for f, v in (("v", x), ("none", rng.normal(size=240))):
            rows += [(f, "t", s, i, float(v[i]), float(abs(x[i]) + 0.01 * rng.normal())) for i in range(240)]
    df = spark.createDataFrame(rows, "feature string, target string, sym int, dt int, x double, y double")
    got = {r["feature"]: r for r in dp.nonlinear_audit(df, n_pairs=2, draws=199).collect()}
    assert got["v"]["significant"] and got["v"]["hidden_by_monotonic"] and abs(got["v"]["spearman"]) < 0.05
    assert not got["none"]["significant"] and not got["none"]["hidden_by_monotonic"]


def test_distance_correlation_sees_a_v_shape(spark):
    x = np.linspace(-1, 1, 200)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "x": x, "y": np.abs(x)}))
    d = dp.distance_correlation(df, ["k"]).first()["dcor"]
    assert d > 0.4 and abs(np.corrcoef(x, np.abs(x))[0, 1]) < 1e-9


def test_too_few_draws_are_refused(spark):
    with pytest.raises(ValueError):
        dp.nonlinear_audit(spark.range(1), n_pairs=10, draws=20)


def test_block_permutation_keeps_every_bar_once(spark):
    cal = spark.range(100).select(F.col("id").cast("int").alias("bar_idx"))
    rows = permute.block_order(cal, 3, 21).toPandas()
    for _, g in rows.groupby("draw"):
        assert sorted(g["old_idx"]) == list(range(100)) and sorted(g["new_idx"]) == list(range(100))


def test_normal_functions(spark):
    x = [-8.0, -3.0, -0.5, 0.0, 1.0, 4.0, 9.0]
    from statistics import NormalDist

    n = NormalDist()
    df = spark.createDataFrame([(v,) for v in x], "x double").select("x", mathx.norm_cdf("x").alias("c")).collect()
    assert all(r["c"] == pytest.approx(n.cdf(r["x"]), abs=1e-14) for r in df)
    p = [1e-9, 0.01, 0.5, 0.9, 0.9999]
    df = spark.createDataFrame([(v,) for v in p], "p double").select("p", mathx.norm_ppf("p").alias("q")).collect()
    assert all(r["q"] == pytest.approx(n.inv_cdf(r["p"]), abs=1e-9) for r in df)


def test_implied_vol_round_trip_and_parity(spark):
    rows = [(100.0, k, 0.25, v) for k in (90.0, 100.0, 110.0) for v in (0.15, 0.4, 0.9)]
    c = F.col
    df = spark.createDataFrame(rows, "s double, k double, t double, v double")
    df = df.withColumns({n: mathx.option_price(c("s"), c("k"), c("t"), c("v"), F.lit(n == "call")) for n in ("call", "put")})
    df = df.withColumn("iv", mathx.implied_vol(c("call"), c("s"), c("k"), c("t"), F.lit(True)))
    for r in df.collect():
        assert r["iv"] == pytest.approx(r["v"], abs=1e-4)
        assert r["call"] - r["put"] == pytest.approx(r["s"] - r["k"] * np.exp(-0.065 * r["t"]))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.floats(-0.5, 0.5), st.floats(-0.5, 0.5), st.floats(0, 1)), min_size=5, max_size=40))
def test_loss_is_never_negative_and_stakes_stay_bounded(spark, rows):
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "p double, t double, c double")
    c = F.col
    loss = mx.asymmetric_loss(c("p"), c("t"), c("c"))
    for r in df.select("p", "t", loss.alias("loss"), mathx.kelly("c", F.abs("t") + 0.01).alias("k")).collect():
        assert r["loss"] >= 0 and 0 <= r["k"] <= 0.25
        if r["p"] == r["t"]:
            assert r["loss"] == 0


def test_chi_square_tail(spark):
    # table values of the distribution
    known = [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (9.487729, 4, 0.05), (11.070498, 5, 0.05), (16.918978, 9, 0.05), (0.0, 4, 1.0)]
    row = spark.range(1).select(*[mathx.chi2_sf(F.lit(x), d).alias(f"c{i}") for i, (x, d, _) in enumerate(known)]).first()
    assert all(abs(row[i] - p) < 1e-6 for i, (_, _, p) in enumerate(known))


def test_pending_draws(spark, tmp_path):
    from barline.operators.walkforward import pending_draws

    wanted = spark.createDataFrame([(i,) for i in range(5)], "draw int")
    path = str(tmp_path / "draws")
    assert pending_draws(spark, path, wanted).count() == 5
    wanted.where("draw < 2").write.parquet(path)
    assert {r["draw"] for r in pending_draws(spark, path, wanted).collect()} == {2, 3, 4}
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("not a table")
    with pytest.raises(Exception):  # noqa: B017
        pending_draws(spark, str(tmp_path / "broken"), wanted).count()


def test_scores_equal_but_for_their_last_bits_share_a_place(spark):
    """Two strategies with the same weights differ by the order in which their sums were taken."""
    rows = [("equal", 7.703402469768488), ("momentum", 7.703402469768489), ("other", 7.7034), ("none", None)]
    got = spark.createDataFrame(rows, "strategy string, sharpe double").select("strategy", mx.place("sharpe").alias("place")).collect()
    assert {r["strategy"]: r["place"] for r in got} == {"equal": 1, "momentum": 1, "other": 3, "none": 4}
