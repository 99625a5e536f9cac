"""The strategy kernel against one strategy, one name and one bar at a time."""

import numpy as np
import pytest

from barline.operators import rules, strategies as st


def one(score, price, vol, p, cap):
    """Position of one name under one strategy, bar by bar."""
    out, pos, best, age = [], 0.0, 0.0, 0
    for s, px, v in zip(score, price, vol, strict=True):
        if pos:
            age += 1
            best = max(best, px) if pos > 0 else min(best, px)
            fallen = (best - px) / best if pos > 0 and best > 0 else (px - best) / max(px, 1e-12) if pos < 0 and px > 0 else 0.0
            if fallen > p["trailing_stop"] or age >= p["hold_days"] or (s * pos < 0 and abs(s) > p["conviction"]):
                pos = 0.0
        if not pos and abs(s) > p["conviction"]:
            v = v if np.isfinite(v) and v > 1e-6 else p["vol_target"]
            size = abs(s) * p["kelly_share"] * (min(max(p["vol_target"] / v, 0.0), 3.0) if p["vol_target"] > 0 else 1.0)
            pos, best, age = float(np.sign(s) * min(max(size, 0.0), cap)), px, 0
        out.append(pos)
    return out


def vote(x, w, e, o):
    return sum(w[k] * ((x[k] > e[k]) - (x[k] < -o[k])) for k in range(len(x)))


def parameters(rng, n):
    p = {"hold_days": rng.integers(2, 9, n), "trailing_stop": rng.uniform(0.01, 0.2, n), "kelly_share": rng.uniform(0, 1, n),
         "conviction": rng.uniform(0.05, 0.5, n), "vol_target": rng.uniform(0, 0.3, n) * (rng.random(n) > 0.2)}
    return {k: v.astype(float) for k, v in p.items()}


@pytest.mark.parametrize("seed", range(6))
def test_all_strategies_at_once(seed):
    rng = np.random.default_rng(seed)
    n, bars = 40, 120
    p = parameters(rng, n)
    price = np.exp(np.cumsum(rng.normal(0, 0.04, bars))) * 20
    price[50] = 0.0
    vol = np.where(rng.random(bars) < 0.1, np.nan, rng.uniform(0, 0.5, bars))
    score = rng.uniform(-1, 1, (bars, n)) * (rng.random((bars, n)) < 0.5)
    got = st.hold_paths(score, price, vol, p, 0.3)
    for k in range(n):
        assert np.allclose(got[:, k], one(score[:, k], price, vol, {c: v[k] for c, v in p.items()}, 0.3))


def test_stop_age_and_reversal():
    p = {"hold_days": 90.0, "trailing_stop": 0.1, "kelly_share": 1.0, "conviction": 0.1, "vol_target": 0.0}
    run = lambda score, price, **kw: st.hold_paths(np.array(score)[:, None], np.array(price), np.ones(len(price)), {k: np.array([v]) for k, v in {**p, **kw}.items()}, 0.3)[:, 0].tolist()
    assert run([0.5, 0.0, 0.0, 0.0], [10.0, 12.0, 10.0, 10.0]) == [0.3, 0.3, 0.0, 0.0]
    assert run([0.5, 0.0, 0.0], [10.0] * 3, hold_days=2.0, trailing_stop=0.5) == [0.3, 0.3, 0.0]


def panel(spark, seed=1, names=5, bars=60):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(names):
        price = np.exp(np.cumsum(rng.normal(0, 0.03, bars))) * 30
        first = int(rng.integers(0, 20))
        for i in range(first, bars):
            ahead = None if i + 1 == bars else float(price[i + 1] / price[i] - 1)
            rows.append(("a" if s % 2 else "b", s, i, float(price[i]), float(rng.uniform(0.05, 0.5)), ahead, [float(v) for v in rng.uniform(-1, 1, 4)]))
    return spark.createDataFrame(rows, "w string, sym long, bar_idx int, close double, vol double, ahead double, x array<double>").repartition(3), rows


def days_by_hand(rows, table, keyed):
    out = {}
    for p in table:
        for w, s in sorted({(r[0], r[1]) for r in rows}):
            own = sorted(r for r in rows if r[:2] == (w, s))
            score = [max(vote(r[6], p["weights"], p["entry"], p["exit"]), 0.0) for r in own]
            pos = one(score, [r[3] for r in own], [r[4] for r in own], p, 0.1)
            for r, now, was in zip(own, pos, [0.0, *pos[:-1]], strict=True):
                d = out.setdefault(((w,) if keyed else ()) + (p["strategy"], r[2]), [0.0, 0.0, 0])
                d[0] += now * (r[5] or 0.0) - abs(now - was) * 22 / 20_000
                d[1] += abs(now - was)
                d[2] += bool(now and now != was)
    return out


@pytest.mark.parametrize(("keyed", "salts"), [(False, 1), (True, 3)])
def test_days_equal_plain_loops(spark, keyed, salts):
    bars, rows = panel(spark)
    table = rules.random_strategies(spark, 70, 4)
    keys = ["w"] if keyed else []
    got = {(*[r[k] for k in keys], r["strategy"], r["dt"]): (r["ret"], r["turnover"], r["trades"]) for r in st.strategy_days(bars, table, *keys, salts=salts).collect()}
    want = days_by_hand(rows, [r.asDict() for r in table.collect()], keyed)
    assert got.keys() == want.keys() and len({k[-2] for k in got}) == 70
    assert all(np.allclose(got[k], want[k]) for k in got) and sum(v[2] for v in got.values()) > 100


def test_a_thousand_strategies_of_noise_leave_nothing(spark):
    bars, _ = panel(spark, seed=4, names=4, bars=200)
    both = bars.selectExpr("0 AS w", "CASE WHEN bar_idx < 140 THEN 'train' ELSE 'test' END AS side", "sym", "bar_idx", "close", "vol", "ahead", "x")
    got = st.sweep(both, rules.random_strategies(spark, 1000, 4)).collect()
    assert len(got) == 1 and got[0]["total_trials"] == 1000
    assert got[0]["in_sample"] > got[0]["out_sample"] and got[0]["deflated"] < 0.95
