"""Performance, risk, selection and sizing queries."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Window
from pyspark.sql import functions as F

from barline.functions import mathx
from barline.functions.cols import by_sym, rnd
from barline.operators import alignment as al, backtest as bt, metrics as mx, quality as ql, technical, xsection as xs
from barline.operators.ordering import average_rank
from barline.plans.ansi import BARS, BARS10, CAL, DENSE, lag, over, r, with_
from barline.plans.registry import query
from barline.session import durable
from barline.sources import tables as t

# ---- walk-forward results of two weight rules on the dense ten-basket grid --------------------------

GRID10 = DENSE.replace("b.close,", "last_value(b.close IGNORE NULLS) OVER (PARTITION BY s.sym ORDER BY c.dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close,")
STRAT_DAYS = (
    BARS10, CAL, GRID10,
    f"g AS (SELECT sym, dt, bar_idx, close / {lag('close')} - 1 AS ret FROM dense)",
    f"m AS (SELECT *, coalesce(sign(avg(ret) {over(20, skip=1)}), 0) AS s FROM g)",
    "wt AS (SELECT 'momentum' AS strategy, sym, dt, ret, bar_idx, least(greatest(s / greatest(sum(abs(s)) OVER (PARTITION BY dt), 1), -0.25), 0.25) AS weight FROM m UNION ALL SELECT 'equal', sym, dt, ret, bar_idx, 1.0 / count(*) OVER (PARTITION BY dt) FROM m)",
    "ts AS (SELECT dt, CAST((bar_idx - 252) // 21 AS INTEGER) AS w FROM cal WHERE bar_idx >= 252 AND (bar_idx - 252) // 21 <= ((SELECT count(*) FROM cal) - 254) // 21)",
    "wtt AS (SELECT wt.*, ts.w FROM wt JOIN ts USING (dt))",
    f"st AS (SELECT *, abs(weight - coalesce({lag('weight', part='strategy, sym')}, 0)) AS step FROM wtt)",
    "days AS (SELECT strategy, dt, sum(weight * coalesce(ret, 0)) - sum(step) * 22.0 / 10000 AS ret, sum(step) AS turnover, sum(CASE WHEN step > 0 THEN 1 ELSE 0 END) AS trades FROM st GROUP BY 1, 2)",
    "eq AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY strategy ORDER BY dt ROWS UNBOUNDED PRECEDING)) AS equity FROM days)",
    "dd AS (SELECT *, equity / max(equity) OVER (PARTITION BY strategy ORDER BY dt ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM eq)",
    """perf AS (SELECT strategy, count(*) AS n, avg(ret) / stddev_pop(ret) * sqrt(252) AS sharpe, exp(sum(ln(1 + ret))) - 1 AS total_return, pow(exp(sum(ln(1 + ret))), 252.0 / count(*)) - 1 AS cagr,
      stddev_samp(ret) * sqrt(252) AS ann_vol, min(drawdown) AS max_drawdown, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, avg(turnover) AS avg_turnover,
      (avg(ret * ret * ret) - 3 * avg(ret) * avg(ret * ret) + 2 * avg(ret) ^ 3) / stddev_pop(ret) ^ 3 AS skew, kurtosis_pop(ret) + 3 AS kurt,
      avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE turnover > 0) AS win_rate, sum(CASE WHEN ret > 0 THEN ret END) / nullif(-sum(CASE WHEN ret < 0 THEN ret END), 0) AS profit_factor, sum(trades) AS n_trades FROM dd GROUP BY strategy)""",
    "fit AS (SELECT *, coalesce(sharpe * (1 + max_drawdown) * n_trades / (n_trades + 20.0) * CASE WHEN -max_drawdown > 0.2 THEN 0.1 ELSE 1 END, -0.05) AS fitness FROM perf)",
)


def strategy_weights(spark, sf):
    """Weights of two rules on the filled grid, cut to walk-forward test sessions."""
    panel = t.saved_bars(spark, sf, 10)
    cal = t.calendar(panel)
    grid = al.forward_fill(t.dense_panel(panel, cal).select("sym", "dt", "bar_idx", "close"), "close", "close")
    rets = technical.returns(grid).select("sym", "dt", "close", "ret")
    mom = xs.momentum_weights(rets).withColumn("strategy", F.lit("momentum"))
    eq = xs.equal_weights(rets).withColumn("strategy", F.lit("equal"))
    cols = ["strategy", "sym", "dt", "ret", "weight"]
    both = mom.select(*cols).unionByName(eq.select(*cols))
    return both.join(bt.test_sessions(cal, 252, 21).select("dt", "w"), "dt")


def strategy_days(spark, sf):
    return bt.daily_results(strategy_weights(spark, sf), 22.0, "strategy")


@query("d15_walkforward_days", with_(*STRAT_DAYS, select=f"SELECT strategy, dt, {r('ret')} AS ret, {r('turnover')} AS turnover, CAST(trades AS BIGINT) AS trades FROM days"))
def d15(spark, sf):
    return strategy_days(spark, sf).select("strategy", "dt", rnd("ret").alias("ret"), rnd("turnover").alias("turnover"), "trades")


_PERF = ["sharpe", "total_return", "cagr", "ann_vol", "max_drawdown", "hit_rate", "avg_turnover"]


@query("a10_performance", with_(*STRAT_DAYS, select="SELECT strategy, CAST(n AS BIGINT) AS n, " + ", ".join(f"{r(c)} AS {c}" for c in _PERF) + " FROM perf"))
def a10(spark, sf):
    out = mx.performance(strategy_days(spark, sf), "strategy", turnover="turnover")
    return out.select("strategy", "n", *[rnd(c).alias(c) for c in _PERF])


def cdf_sql(x):
    """Normal distribution function by its power series (an independent method)."""
    return f"(CASE WHEN abs({x}) > 7 THEN CASE WHEN {x} > 0 THEN 1.0 ELSE 0.0 END ELSE 0.5 + exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * sign({x}) * list_sum([exp((2 * i + 1) * ln(greatest(abs({x}), 1e-300)) + i * ln(2) + lgamma(i + 1) - lgamma(2 * i + 2)) FOR i IN range(0, 120)]) END)"


def best_z(n):
    q = NormalDist().inv_cdf
    return q(1 - 1 / n) * (1 - 0.5772156649) + q(1 - 1 / (n * math.e)) * 0.5772156649


@query(
    "a11_deflated_sharpe",
    with_(
        *STRAT_DAYS,
        f"x AS (SELECT strategy, (sharpe / sqrt(252) - {best_z(10)} / sqrt(n - 1)) / sqrt(greatest(1 - skew * sharpe / sqrt(252) + (kurt - 1) / 4 * (sharpe / sqrt(252)) ^ 2, 1e-12) / (n - 1)) AS z FROM perf)",
        select=f"SELECT strategy, {r(cdf_sql('z'))} AS probability FROM x",
    ),
)
def a11(spark, sf):
    p = mx.performance(strategy_days(spark, sf), "strategy")
    return p.select("strategy", rnd(mathx.deflated_sharpe("sharpe", "n", 10, F.col("skew"), F.col("kurt"))).alias("probability"))


@query(
    "a12_noise_sharpe",
    with_(
        BARS, "s AS (SELECT sym, count(*) AS n FROM bars GROUP BY sym)",
        select=f"SELECT sym, {r(f'{best_z(1000)} * sqrt(252.0 / n)')} AS best_of_1000 FROM s",
    ),
)
def a12(spark, sf):
    n = t.bars(spark, sf).groupBy("sym").agg(F.count(F.lit(1)).alias("n"))
    return n.select("sym", rnd(mathx.noise_sharpe(F.lit(1000.0), "n")).alias("best_of_1000"))


_CALLS = (
    BARS,
    f"p AS (SELECT sym, dt, sign(round(close / {lag('close', 5)} - 1, 1)) * abs(close / {lag('close', 5)} - 1) AS pred, lead(close) OVER (PARTITION BY sym ORDER BY dt) / close - 1 AS actual FROM bars)",
    "pa AS (SELECT * FROM p WHERE pred IS NOT NULL AND actual IS NOT NULL)",
)


def calls(spark, sf):
    """A past-return call and the next return; small past moves make no call."""
    base = technical.returns(t.bars(spark, sf))
    base = base.withColumn("pred", F.signum(F.round("ret_5", 1)) * F.abs("ret_5"))
    base = base.withColumn("actual", F.lead("close").over(by_sym()) / F.col("close") - 1)
    rows = base.where(F.col("pred").isNotNull() & F.col("actual").isNotNull()).select("sym", "dt", "pred", "actual")
    # several statistics read the calls more than once
    return durable(rows, "calls")


_DIAG = """SELECT {keys} CAST(count(*) AS BIGINT) AS n, count(*) FILTER (WHERE pred <> 0) AS c, count(*) FILTER (WHERE pred <> 0 AND (pred > 0) = (actual > 0)) AS h,
  count(*) FILTER (WHERE pred <> 0 AND (pred < 0) = (actual > 0)) AS f, covar_pop(pred, actual) / sqrt(var_pop(pred) * var_pop(actual)) AS pearson FROM pa {group}"""
_Z = "(greatest(abs(h - c / 2.0) - 0.5, 0) / sqrt(c / 4.0))"


@query(
    "a13_signal_diagnostic",
    with_(
        *_CALLS, f"d AS ({_DIAG.format(keys='sym,', group='GROUP BY sym')})",
        select=f"SELECT sym, n, CAST(c AS BIGINT) AS n_calls, CAST(h AS BIGINT) AS n_hits, {r('h / c')} AS hit_rate, {r('f / c')} AS inverted_rate, {r('2 * (1 - ' + cdf_sql(_Z) + ')')} AS p_value, {r('pearson')} AS pearson FROM d",
    ),
)
def a13(spark, sf):
    out = mx.signal_diagnostic(calls(spark, sf), "sym")
    return out.select("sym", "n", "n_calls", "n_hits", *[rnd(c).alias(c) for c in ("hit_rate", "inverted_rate", "p_value", "pearson")])


@query(
    "a13_rank_correlation",
    with_(
        *_CALLS,
        "k AS (SELECT rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0 AS kp, rank() OVER (ORDER BY actual) + (count(*) OVER (PARTITION BY actual) - 1) / 2.0 AS ka FROM pa)",
        select=f"SELECT CAST(count(*) AS BIGINT) AS n, {r('corr(kp, ka)')} AS spearman FROM k",
    ),
)
def a13_rank(spark, sf):
    """Pooled rank correlation: ranks over all rows come from value ranges, not from one sorted task."""
    rows = calls(spark, sf).withColumn("g", F.lit(0))
    ranked = average_rank(average_rank(rows, ["g"], "pred", "kp"), ["g"], "actual", "ka")
    out = ranked.agg(F.count(F.lit(1)).alias("n"), F.covar_pop("kp", "ka").alias("c"), F.var_pop("kp").alias("v"), F.var_pop("ka").alias("w"))
    return out.select("n", rnd(F.col("c") / F.sqrt(F.col("v") * F.col("w"))).alias("spearman"))


_TR = ["max_drawdown", "win_rate", "profit_factor", "avg_turnover", "sharpe"]


@query("a14_trading_stats", with_(*STRAT_DAYS, select=f"SELECT strategy, CAST(n_trades AS BIGINT) AS n_trades, {r('-max_drawdown')} AS max_drawdown, {r('win_rate')} AS win_rate, {r('profit_factor')} AS profit_factor, {r('avg_turnover')} AS avg_turnover, {r('sharpe')} AS sharpe FROM perf"))
def a14(spark, sf):
    return mx.trading_stats(strategy_days(spark, sf), "strategy").select("strategy", "n_trades", *[rnd(c).alias(c) for c in _TR])


@query("a15_selection_score", with_(*STRAT_DAYS, select=f"SELECT strategy, {r('fitness')} AS fitness FROM fit"))
def a15(spark, sf):
    return mx.selection_score(mx.trading_stats(strategy_days(spark, sf), "strategy")).select("strategy", rnd("fitness").alias("fitness"))


@query(
    "a16_required_bars",
    with_(BARS, "s AS (SELECT dt, count(*) AS names FROM bars GROUP BY dt)", select="SELECT dt, CAST(ceil(20 * 10 / (names * 0.25)) AS BIGINT) AS bars_needed FROM s"),
)
def a16(spark, sf):
    s = t.bars(spark, sf).groupBy("dt").agg(F.count(F.lit(1)).alias("names"))
    return s.select("dt", mx.required_bars(F.lit(10), F.col("names")).alias("bars_needed"))


@query("d16_compare_strategies", with_(*STRAT_DAYS, select=f"SELECT strategy, {r('sharpe')} AS sharpe, {r('max_drawdown')} AS max_drawdown, CAST(rank() OVER (ORDER BY sharpe DESC) AS BIGINT) AS place FROM perf"))
def d16(spark, sf):
    p = mx.performance(strategy_days(spark, sf), "strategy")
    return p.select("strategy", rnd("sharpe").alias("sharpe"), rnd("max_drawdown").alias("max_drawdown"), mx.place("sharpe").alias("place"))


# ---- market state ------------------------------------------------------------------------------------

_R10 = f"x AS (SELECT sym, dt, close, coalesce(close / {lag('close')} - 1, 0) AS ret, row_number() OVER (PARTITION BY sym ORDER BY dt DESC) AS k FROM bars)"


@query(
    "a08_market_snapshot",
    with_(
        BARS, _R10, "v AS (SELECT last(close ORDER BY dt) AS a, avg(close) AS b FROM x WHERE sym = 9 AND k <= 20)",
        "m AS (SELECT sym, last(ret ORDER BY dt) AS l, stddev_samp(ret) AS s FROM x WHERE sym <> 9 AND k <= 20 GROUP BY sym)",
        select=f"SELECT {r('max(a)')} AS vix_last, {r('max(b)')} AS vix_mean, {r('avg(l)')} AS market_return, {r('avg(s)')} AS market_vol FROM v, m",
    ),
)
def a08(spark, sf):
    out = mx.market_snapshot(t.saved_bars(spark, sf), fear=9)
    return out.select(*[rnd(c).alias(c) for c in ("vix_last", "vix_mean", "market_return", "market_vol")])


@query(
    "a09_expected_vol",
    with_(BARS, _R10, "v AS (SELECT w, sym, stddev_samp(ret) AS s FROM x, (VALUES (5), (20)) t(w) WHERE k <= w GROUP BY 1, 2)", select=f"SELECT w AS \"window\", {r('avg(s) * sqrt(252) * 100', 5)} AS vol FROM v GROUP BY w"),
)
def a09(spark, sf):
    return mx.expected_vol(t.saved_bars(spark, sf)).select("window", rnd("vol", 5).alias("vol"))


@query(
    "a35_regime_label",
    with_(
        BARS, _R10, "d AS (SELECT DISTINCT dt FROM x ORDER BY dt DESC LIMIT 3)", "s AS (SELECT avg(ret) AS drift, stddev_pop(ret) AS vol FROM x SEMI JOIN d USING (dt))",
        select=f"SELECT {r('drift')} AS drift, {r('vol')} AS vol, CASE WHEN drift > 0.5 * vol / sqrt(3) AND drift > 0 THEN 'bull' WHEN drift < -0.5 * vol / sqrt(3) AND drift < 0 THEN 'bear' ELSE 'sideways' END AS regime FROM s",
    ),
)
def a35(spark, sf):
    return mx.regime_label(t.saved_bars(spark, sf)).select(rnd("drift").alias("drift"), rnd("vol").alias("vol"), "regime")


@query(
    "a36_return_profile",
    with_(
        BARS, f"x AS (SELECT sym, close / {lag('close')} - 1 AS ret FROM bars)", "b AS (SELECT sym, avg(ret) AS m, stddev_samp(ret) AS s FROM x GROUP BY sym)",
        select=f"SELECT sym, {r('max(s)')} AS vol, {r('avg((ret - m) ^ 3) / (max(s) ^ 3 + 1e-8)')} AS skew, {r('avg((ret - m) ^ 4) / (max(s) ^ 4 + 1e-8) - 3')} AS kurt FROM x JOIN b USING (sym) GROUP BY sym",
    ),
)
def a36(spark, sf):
    rets = technical.returns(t.saved_bars(spark, sf)).where(F.col("ret").isNotNull())
    return mx.return_profile(rets).select("sym", *[rnd(c).alias(c) for c in ("vol", "skew", "kurt")])


def suppliers(spark, sf):
    """The universe: every supplier, as a table."""
    return t.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("bigint").alias("sym"))


_CORR = (
    f"cr AS (SELECT sym, dt, close / {lag('close')} - 1 AS ret FROM bars)",
    "co AS (SELECT a.sym AS a, b.sym AS b, count(*) AS n, covar_pop(a.ret, b.ret) / nullif(sqrt(var_pop(a.ret) * var_pop(b.ret)), 0) AS corr FROM cr a JOIN cr b ON a.dt = b.dt AND a.sym < b.sym WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY a.sym, b.sym)",
)


@query(
    "a36_pair_correlations",
    with_(
        BARS, *_CORR,
        select=f"SELECT x.s_suppkey::BIGINT AS a, y.s_suppkey::BIGINT AS b, CAST(coalesce(n, 0) AS BIGINT) AS n, {r('corr', 5)} AS corr FROM supplier x JOIN supplier y ON x.s_suppkey < y.s_suppkey LEFT JOIN co ON co.a = x.s_suppkey AND co.b = y.s_suppkey",
    ),
)
def a36_corr(spark, sf):
    """The profile's list of pair correlations, of all suppliers."""
    rets = technical.returns(t.bars(spark, sf)).select("sym", "dt", "ret")
    return ql.pair_correlations(rets, suppliers(spark, sf)).select("a", "b", F.col("n").cast("bigint").alias("n"), rnd("corr", 5).alias("corr"))


@query(
    "a37_size_scale",
    with_(
        *_CALLS, "s AS (SELECT sym, count(*) AS n, covar_pop(pred, actual) / nullif(var_pop(pred), 0) AS b FROM pa GROUP BY sym)",
        select=f"SELECT sym, {r('CASE WHEN n >= 100 AND least(greatest(b, 0), 40) > 0 THEN least(greatest(b, 0), 40) ELSE 1 END')} AS scale FROM s",
    ),
)
def a37(spark, sf):
    return mx.size_scale(calls(spark, sf), "sym").select("sym", rnd("scale").alias("scale"))


# ---- sizing ------------------------------------------------------------------------------------------

_KELLY = (
    *_CALLS,
    "h AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY dt DESC) AS k FROM pa)",
    """st AS (SELECT sym, count(*) AS n, avg(CASE WHEN sign(pred) = sign(actual) THEN 1.0 ELSE 0.0 END) AS p, coalesce(avg(actual) FILTER (WHERE sign(pred) = sign(actual) AND actual > 0), 0.01) AS w,
      coalesce(abs(avg(actual) FILTER (WHERE sign(pred) <> sign(actual) AND actual < 0)), 0.01) AS l FROM h WHERE k <= 252 GROUP BY sym)""",
    "la AS (SELECT sym, last(pred ORDER BY dt) AS pred, 0.5 + (sym % 5) / 10.0 AS conf FROM pa GROUP BY sym)",
    "k1 AS (SELECT sym, pred, 0.5 + (CASE WHEN n < 30 THEN 0.5 + 0.1 * conf ELSE p END - 0.5) * conf AS pw, CASE WHEN n < 30 THEN greatest(abs(pred) * 1.2, 0.001) ELSE w END / greatest(CASE WHEN n < 30 THEN greatest(abs(pred) * 0.8, 0.001) ELSE l END, 1e-8) AS b FROM la JOIN st USING (sym))",
    "k2 AS (SELECT *, CASE WHEN pred < 0 THEN -1 ELSE 1 END * abs(least(greatest((b * pw - (1 - pw)) / b * 0.5, -0.2), 0.2)) AS f FROM k1)",
    "kelly AS (SELECT sym, pred, pw, b, f * CASE WHEN sum(abs(f)) OVER () > 1 THEN 1 / sum(abs(f)) OVER () ELSE 1 END AS fraction FROM k2)",
)


def kelly10(spark, sf):
    hist = calls(spark, sf)
    latest = hist.groupBy("sym").agg(F.max_by("pred", "dt").alias("pred")).withColumn("confidence", 0.5 + (F.col("sym") % 5) / 10.0)
    return mx.kelly_sizes(hist, latest)


@query("a22_kelly_sizes", with_(*_KELLY, select=f"SELECT sym, {r('pw')} AS p_win, {r('b')} AS win_loss, {r('fraction', 8)} AS fraction FROM kelly"))
def a22(spark, sf):
    return kelly10(spark, sf).select("sym", rnd("p_win").alias("p_win"), rnd("win_loss").alias("win_loss"), rnd("fraction", 8).alias("fraction"))


@query(
    "a23_correlated_cut",
    with_(
        *_KELLY, *_CORR,
        "pr AS (SELECT co.a, co.b, 1 - (abs(corr) - 0.8) * 2 AS f FROM co JOIN kelly x ON x.sym = co.a JOIN kelly y ON y.sym = co.b WHERE abs(corr) > 0.8 AND n > 10 AND x.fraction * y.fraction > 0)",
        "mm AS (SELECT sym, product(f) AS m FROM (SELECT a AS sym, f FROM pr UNION ALL SELECT b, f FROM pr) GROUP BY sym)",
        select=f"SELECT sym, {r('fraction * coalesce(m, 1)', 8)} AS adjusted FROM kelly LEFT JOIN mm USING (sym)",
    ),
)
def a23(spark, sf):
    """Sizes of all suppliers, cut for each other that moves with them on more than ten common sessions."""
    rets = technical.returns(t.bars(spark, sf)).select("sym", "dt", "ret")
    corr = ql.pair_correlations(rets, suppliers(spark, sf), least=11, beyond=0.8)
    return mx.correlated_cut(kelly10(spark, sf).select("sym", "fraction"), corr, limit=0.8).select("sym", rnd("adjusted", 8).alias("adjusted"))


@query(
    "a24_risk_budget",
    with_(
        BARS, f"x AS (SELECT sym, dt, close / {lag('close')} - 1 AS ret FROM bars)", "k AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY dt DESC) AS n FROM x WHERE ret IS NOT NULL)",
        "v AS (SELECT sym, CASE WHEN count(*) >= 20 THEN stddev_pop(ret) ELSE 0.01 END AS vol FROM k WHERE n <= 20 GROUP BY sym)",
        select=f"SELECT sym, {r('vol')} AS vol, {r('(1 / (vol + 1e-8)) / sum(1 / (vol + 1e-8)) OVER ()', 8)} AS budget FROM v",
    ),
)
def a24(spark, sf):
    rets = technical.returns(t.bars(spark, sf)).select("sym", "dt", "ret")
    return mx.risk_budget(rets).select("sym", rnd("vol").alias("vol"), rnd("budget", 8).alias("budget"))


@query(
    "a24_pooled_sharpe",
    with_(
        BARS, f"x AS (SELECT sym, dt, close / {lag('close')} - 1 AS ret FROM bars)", "k AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY dt DESC) AS n, count(*) OVER (PARTITION BY sym) AS c FROM x WHERE ret IS NOT NULL)",
        select=f"SELECT CAST(count(*) AS BIGINT) AS n_obs, {r('(avg(ret) - 0.05 / 252) / (stddev_pop(ret) + 1e-8) * sqrt(252)')} AS sharpe FROM k WHERE n <= 252 AND c >= 10",
    ),
)
def a24b(spark, sf):
    rets = technical.returns(t.saved_bars(spark, sf)).select("sym", "dt", "ret")
    return mx.pooled_sharpe(rets).select("n_obs", rnd("sharpe").alias("sharpe"))


_LOSS = "CASE WHEN sign(pred) = sign(actual) THEN CASE WHEN abs(pred) < abs(actual) THEN 0.5 * abs(pred - actual) ELSE 0 END + 0.005 * abs(pred - actual) ELSE 2.0 * least(abs(pred - actual) ^ 3, 100) * (1 + 2 * 0.4) END"


@query(
    "a27_asymmetric_loss",
    with_(
        *_CALLS,
        select=f"""SELECT sym, {r(f'avg({_LOSS})')} AS loss, {r('avg(CASE WHEN sign(pred) = sign(actual) THEN 1.0 ELSE 0.0 END)')} AS directional_accuracy,
          {r('avg(CASE WHEN sign(pred) = sign(actual) THEN 0.0 ELSE abs(pred - actual) END)')} AS wrong_way_error, CAST(count(*) FILTER (WHERE sign(pred) <> sign(actual)) AS BIGINT) AS n_wrong FROM pa GROUP BY sym""",
    ),
)
def a27(spark, sf):
    rows = calls(spark, sf)
    loss = rows.groupBy("sym").agg(rnd(F.avg(mx.asymmetric_loss(F.col("pred"), F.col("actual"), F.lit(0.4)))).alias("loss"))
    parts = mx.loss_breakdown(rows, "sym", target="actual")
    return loss.join(parts, "sym").select("sym", "loss", rnd("directional_accuracy").alias("directional_accuracy"), rnd("wrong_way_error").alias("wrong_way_error"), "n_wrong")


@query("a28_weighted_mse", with_(*_CALLS, select=f"SELECT sym, {r('ln(avg((pow(abs(actual), 1.5) + 1) * (pred - actual) ^ 2))')} AS log_loss FROM pa GROUP BY sym"))
def a28(spark, sf):
    return calls(spark, sf).groupBy("sym").agg(
        rnd(F.ln(F.avg(mx.weighted_squared_error(F.col("pred"), F.col("actual"))))).alias("log_loss")
    )


@query(
    "a29_weight_descriptors",
    with_(
        *STRAT_DAYS,
        f"dl AS (SELECT strategy, sym, dt, weight, abs(weight - {lag('weight', part='strategy, sym')}) AS d FROM wtt)",
        "dv AS (SELECT strategy, dt, sum(d) AS tn, sum(weight) AS net, sum(abs(weight)) AS g, sum(weight * weight) AS q FROM dl GROUP BY 1, 2)",
        select=f"SELECT strategy, {r('coalesce(avg(tn), 0)')} AS turnover, {r('avg(net)')} AS net_exposure, {r('coalesce(avg(CASE WHEN g > 1e-12 THEN q / (g * g) END), 0)')} AS concentration FROM dv GROUP BY strategy",
    ),
)
def a29(spark, sf):
    out = mx.weight_descriptors(strategy_weights(spark, sf), "strategy")
    return out.select("strategy", *[rnd(c).alias(c) for c in ("turnover", "net_exposure", "concentration")])


_SUPP = """sp AS (SELECT CAST(s_suppkey AS BIGINT) AS strategy, CASE WHEN s_suppkey % 50 = 7 THEN CAST('NaN' AS DOUBLE) ELSE s_acctbal / 5000 END AS fitness, (s_suppkey % 21) / 10.0 AS turnover, s_acctbal / 5000 AS net_exposure, (s_nationkey % 11) / 10.0 AS concentration FROM supplier)"""
_CELL = "CAST(least(greatest(trunc(({c} - ({lo})) / ({hi} - ({lo})) * 6), 0), 5) AS INTEGER)"
_CELLS = f"""cl AS (SELECT strategy, fitness, {_CELL.format(c='turnover', lo='0.0', hi='2.0')} AS cell_turnover, {_CELL.format(c='net_exposure', lo='-1.0', hi='1.0')} AS cell_net_exposure, {_CELL.format(c='concentration', lo='0.0', hi='1.0')} AS cell_concentration FROM sp WHERE NOT isnan(fitness))"""
_BEST = "be AS (SELECT cell_turnover, cell_net_exposure, cell_concentration, strategy, fitness FROM cl QUALIFY row_number() OVER (PARTITION BY cell_turnover, cell_net_exposure, cell_concentration ORDER BY fitness DESC, strategy) = 1)"


def _archive(spark, sf):
    k = F.col("s_suppkey")
    rows = t.table(spark, sf, "supplier").select(
        k.alias("strategy"), F.when(k % 50 == 7, F.lit(float("nan"))).otherwise(F.col("s_acctbal") / 5000).alias("fitness"),
        ((k % 21) / 10.0).alias("turnover"), (F.col("s_acctbal") / 5000).alias("net_exposure"), ((F.col("s_nationkey") % 11) / 10.0).alias("concentration"),
    )
    return mx.behaviour_cells(rows)


@query("a30_behaviour_cells", with_(_SUPP, _CELLS, _BEST, select=f"SELECT cell_turnover, cell_net_exposure, cell_concentration, strategy, {r('fitness')} AS fitness FROM be"))
def a30(spark, sf):
    return _archive(spark, sf).withColumn("fitness", rnd("fitness"))


@query("a30_archive_summary", with_(_SUPP, _CELLS, _BEST, select=f"SELECT {r('count(*) / 216.0')} AS coverage, {r('sum(greatest(fitness, 0))')} AS score FROM be"))
def a30b(spark, sf):
    return mx.archive_summary(_archive(spark, sf)).select(rnd("coverage").alias("coverage"), rnd("score").alias("score"))


@query(
    "a39_false_discovery",
    with_(
        *_CALLS, f"d AS ({_DIAG.format(keys='sym,', group='GROUP BY sym')})", f"pv AS (SELECT sym, 2 * (1 - {cdf_sql(_Z)}) AS p FROM d)",
        "k AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS n FROM pv)",
        "q AS (SELECT sym, p, least(min(p * n / k) OVER (ORDER BY k DESC RANGE UNBOUNDED PRECEDING), 1) AS q FROM k)",
        select=f"SELECT sym, {r('p')} AS p, {r('q')} AS q, q <= 0.05 AS significant FROM q",
    ),
)
def a39(spark, sf):
    tests = mx.signal_diagnostic(calls(spark, sf), "sym").select("sym", F.col("p_value").alias("p"))
    return mx.false_discovery(tests).select("sym", rnd("p").alias("p"), rnd("q").alias("q"), "significant")


