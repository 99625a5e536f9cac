"""Forward-looking targets, baselines and pair spreads."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.functions.cols import rnd
from barline.operators import alignment as al, targets as tg, technical
from barline.plans.alignment import SECTOR10, sectors10
from barline.plans.ansi import BARS10, CAL, DENSE, lag, lead, over, r, with_
from barline.plans.registry import query
from barline.sources import tables as t

# targets and baselines of a dense panel named `dense`, keyed by `part`
def targets_sql(src="dense", part="sym", day="dt", keep=""):
    ahead = f"OVER (PARTITION BY {part} ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"
    past = f"OVER (PARTITION BY {part} ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    return (
        f"tr AS (SELECT *, close / {lag('close', part=part)} - 1 AS ret, {lead('close', part=part)} / close - 1 AS fwd FROM {src})",
        f"""tv AS (SELECT *, CASE WHEN count(ret) {ahead} = 5 THEN stddev_samp(ret) {ahead} END AS fv,
             CASE WHEN count(ret) {past} = 5 THEN stddev_samp(ret) {past} END AS pv FROM tr)""",
        f"""tgt AS (SELECT *, fwd AS direction_1d, fwd - avg(fwd) OVER (PARTITION BY {day}) AS rel_strength_1d, fv AS vol_5d,
             ln((fv + 1e-8) / (pv + 1e-8)) AS regime_shift_5d, coalesce(ret, 0.0) AS base_direction_1d, coalesce(ret, 0.0) AS base_rel_strength_1d,
             coalesce(pv, 0.0) AS base_vol_5d, coalesce(ln(pv + 1e-8), 0.0) AS base_regime_shift_5d FROM tv)""",
    )


BASE = (BARS10, CAL, DENSE)


def dense10(spark, sf):
    return t.dense_panel(t.saved_bars(spark, sf, 10))


@query("t01_direction", with_(*BASE, *targets_sql(), select=f"SELECT sym, dt, {r('direction_1d')} AS direction_1d, direction_1d IS NOT NULL AS valid FROM tgt"))
def t01(spark, sf):
    out = tg.targets(dense10(spark, sf))
    return out.select("sym", "dt", rnd("direction_1d").alias("direction_1d"), F.col("direction_1d").isNotNull().alias("valid"))


@query("t02_relative_strength", with_(*BASE, *targets_sql(), select=f"SELECT sym, dt, {r('rel_strength_1d')} AS rel_strength_1d FROM tgt"))
def t02(spark, sf):
    return tg.targets(dense10(spark, sf)).select("sym", "dt", rnd("rel_strength_1d").alias("rel_strength_1d"))


@query("t03_forward_vol", with_(*BASE, *targets_sql(), select=f"SELECT sym, dt, {r('vol_5d')} AS vol_5d FROM tgt"))
def t03(spark, sf):
    return tg.targets(dense10(spark, sf)).select("sym", "dt", rnd("vol_5d").alias("vol_5d"))


@query("t04_regime_shift", with_(*BASE, *targets_sql(), select=f"SELECT sym, dt, {r('regime_shift_5d')} AS regime_shift_5d FROM tgt"))
def t04(spark, sf):
    return tg.targets(dense10(spark, sf)).select("sym", "dt", rnd("regime_shift_5d").alias("regime_shift_5d"))


@query(
    "t05_target_table",
    with_(
        *BASE, *targets_sql(),
        select=" UNION ALL ".join(f"SELECT sym, dt, '{n}' AS target, {r(n)} AS y, {n} IS NOT NULL AS valid FROM tgt" for n in tg.TARGETS),
    ),
)
def t05(spark, sf):
    return tg.target_table(dense10(spark, sf)).withColumn("y", rnd("y"))


_B = [f"base_{n}" for n in tg.TARGETS]


@query("t06_baselines", with_(*BASE, *targets_sql(), select="SELECT sym, dt, " + ", ".join(f"{r(n)} AS {n}" for n in _B) + " FROM tgt"))
def t06(spark, sf):
    return tg.baselines(dense10(spark, sf)).select("sym", "dt", *[rnd(n).alias(n) for n in _B])


_H = (5, 10, 20)


@query(
    "t07_longer_horizons",
    with_(
        *BASE,
        "h AS (SELECT *, " + ", ".join(f"{lead('close', n)} / close - 1 AS f{n}, close / {lag('close', n)} - 1 AS b{n}" for n in _H) + " FROM dense)",
        select="SELECT sym, dt, " + ", ".join(f"{r(f'f{n}')} AS direction_{n}d, {r(f'b{n}')} AS trailing_{n}d, {r(f'f{n} - avg(f{n}) OVER (PARTITION BY dt)')} AS rel_strength_{n}d" for n in _H) + " FROM h",
    ),
)
def t07(spark, sf):
    df = dense10(spark, sf)
    for n in _H:
        df = tg.horizon_targets(df, n)
    names = [f"{k}_{n}d" for n in _H for k in ("direction", "trailing", "rel_strength")]
    return df.select("sym", "dt", *[rnd(c).alias(c) for c in names])


PAIR_SQL = (
    SECTOR10,
    "big AS (SELECT sector FROM sec GROUP BY sector HAVING count(*) >= 3)",
    "pr AS (SELECT x.sym AS a, y.sym AS b FROM sec x JOIN sec y ON x.sector = y.sector AND x.sym < y.sym WHERE x.sector IN (SELECT sector FROM big))",
    "ratios AS (SELECT pr.a || '/' || pr.b AS pair, x.dt, ln(x.close) - ln(y.close) AS ratio FROM pr JOIN dense x ON x.sym = pr.a JOIN dense y ON y.sym = pr.b AND y.dt = x.dt)",
    f"""pz AS (SELECT pair, dt, ratio, CASE WHEN count(ratio) {over(60, part='pair')} = 60 AND row_number() OVER (PARTITION BY pair ORDER BY dt) > 60
      AND stddev_samp(ratio) {over(60, part='pair')} > 1e-10 THEN (ratio - avg(ratio) {over(60, part='pair')}) / stddev_samp(ratio) {over(60, part='pair')} END AS z,
      {lead('ratio', 5, part='pair')} - ratio AS ahead, ratio - {lag('ratio', 5, part='pair')} AS behind FROM ratios)""",
)


def pair_panel(spark, sf, horizon=5):
    pairs = al.sector_pairs(sectors10(spark, sf))
    panel = al.forward_fill(dense10(spark, sf).select("sym", "dt", "close"), "close", "close")
    ratios = tg.pair_ratios(panel, pairs)
    return tg.pair_changes(technical.pair_z(ratios), horizon)


_DENSE_FF = DENSE.replace("b.close,", "last_value(b.close IGNORE NULLS) OVER (PARTITION BY s.sym ORDER BY c.dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close,")
PAIR_BASE = (BARS10, CAL, _DENSE_FF)


@query("w13_pair_z", with_(*PAIR_BASE, *PAIR_SQL, select=f"SELECT pair, dt, {r('z')} AS z FROM pz"))
def w13(spark, sf):
    return pair_panel(spark, sf).select("pair", "dt", rnd("z").alias("z"))


@query("t08_pair_changes", with_(*PAIR_BASE, *PAIR_SQL, select=f"SELECT pair, dt, {r('ratio')} AS ratio, {r('ahead')} AS ahead, {r('behind')} AS behind FROM pz"))
def t08(spark, sf):
    return pair_panel(spark, sf).select("pair", "dt", *[rnd(c).alias(c) for c in ("ratio", "ahead", "behind")])
