"""Cross-sectional queries: ranks, weights, votes, sizing, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.functions import costs, mathx
from barline.functions.cols import change, rnd
from barline.operators import technical, xsection as xs
from barline.operators.ordering import exact_quantiles, window_rank
from barline.plans.ansi import BARS, BARS10, lag, over, pct_rank, r, with_
from barline.plans.registry import query
from barline.plans.windows import CHANNEL_CTES
from barline.session import dealt, durable
from barline.sources import tables as t

CH10 = (BARS10, *CHANNEL_CTES[1:])
_X = "x AS (SELECT sym, dt, close, volume, close / {l} - 1 AS ret, close / {l5} - 1 AS ret_5, trades FROM bars)".format(l=lag("close"), l5=lag("close", 5))


def _base(spark, sf):
    return technical.returns(t.bars(spark, sf)).select("sym", "dt", "close", "volume", "ret", "ret_5", "trades")


def _saved(spark, sf):
    """The same rows written once, for operators that read them several times."""
    return durable(_base(spark, sf), "returns")


@query("c01_cross_rank", with_(BARS, _X, select=f"SELECT sym, dt, {r(pct_rank('ret_5', 'dt', 5))} AS rank_ret, {r(pct_rank('trades', 'dt', 5))} AS rank_trades FROM x"))
def c01(spark, sf):
    out = xs.cross_rank(xs.cross_rank(_saved(spark, sf), "ret_5", "rank_ret"), "trades", "rank_trades")
    return out.select("sym", "dt", rnd("rank_ret").alias("rank_ret"), rnd("rank_trades").alias("rank_trades"))


_NAMES = ("close", "volume", "ret_5")
_PAIRS = [(a, b) for i, a in enumerate(_NAMES) for b in _NAMES[i + 1 :]]


@query(
    "c02_rank_products",
    with_(
        BARS, _X, "k AS (SELECT sym, dt, " + ", ".join(f"{pct_rank(c, 'dt', 5)} AS k_{c}" for c in _NAMES) + " FROM x)",
        select="SELECT sym, dt, " + ", ".join(f"{r(f'k_{a} * k_{b}')} AS {a}_x_{b}" for a, b in _PAIRS) + " FROM k",
    ),
)
def c02(spark, sf):
    # only what is ranked is written and dealt again
    out = xs.rank_products(durable(_base(spark, sf).select("sym", "dt", *_NAMES), "returns"), _NAMES)
    return out.select("sym", "dt", *[rnd(f"{a}_x_{b}").alias(f"{a}_x_{b}") for a, b in _PAIRS])


@query(
    "j10_feature_pairs",
    with_(
        BARS, _X, "k AS (SELECT sym, dt, close / 1000 AS close, volume / 50 AS volume, ret_5 FROM x)",
        "l AS (" + " UNION ALL ".join(f"SELECT sym, dt, '{c}' AS f, {c} AS v FROM k" for c in _NAMES) + ")",
        select=f"SELECT a.sym, a.f AS f1, b.f AS f2, CAST(count(a.v * b.v) AS BIGINT) AS n, {r('avg(a.v * b.v)')} AS mean_product FROM l a JOIN l b ON a.sym = b.sym AND a.dt = b.dt AND a.f < b.f GROUP BY ALL",
    ),
)
def j10(spark, sf):
    k = _base(spark, sf).select("sym", "dt", (F.col("close") / 1000).alias("close"), (F.col("volume") / 50).alias("volume"), "ret_5")
    # the pairs of one row are generated from its columns; no row meets another
    cells = F.array(*[F.struct(F.lit(min(a, b)).alias("f1"), F.lit(max(a, b)).alias("f2"), (F.col(a) * F.col(b)).alias("p")) for a, b in _PAIRS])
    rows = k.select("sym", F.explode(cells).alias("c")).select("sym", "c.*")
    return rows.groupBy("sym", "f1", "f2").agg(F.count("p").alias("n"), rnd(F.avg("p")).alias("mean_product"))


@query("c03_symbol_rank", with_(BARS, _X, select=f"SELECT sym, dt, {pct_rank('trades', 'sym', percent=False)} AS rank_trades, {pct_rank('ret', 'sym', percent=False)} AS rank_ret FROM x"))
def c03(spark, sf):
    # not more bars than fills, which the footers of the files count
    bars = dealt(t.bars(spark, sf).select("sym", "dt", "close", "trades"), t.table(spark, sf, "lineitem").count(), "sym")
    return bars.withColumn("ret", change("close")).select(
        "sym", "dt", window_rank(["sym"], "trades").alias("rank_trades"), window_rank(["sym"], "ret").alias("rank_ret")
    )


@query(
    "c04_unit_residual",
    with_(
        BARS, _X, "b AS (SELECT sym, dt, ret, volume FROM x WHERE ret IS NOT NULL)",
        "s AS (SELECT sym, avg(ret) AS my, avg(volume) AS mc, count(*) AS n, var_pop(ret) AS vy, var_pop(volume) AS vc, covar_pop(ret, volume) AS cv FROM b GROUP BY sym)",
        select=f"SELECT sym, dt, {r('(ret - my) / sqrt(vy * n)')} AS unit, {r('(ret - my) / sqrt(vy * n) - cv / sqrt(vy * vc) * (volume - mc) / sqrt(vc * n)')} AS residual FROM b JOIN s USING (sym)",
    ),
)
def c04(spark, sf):
    out = xs.unit_residual(_saved(spark, sf), "ret", "volume")
    return out.select("sym", "dt", rnd("unit").alias("unit"), rnd("residual").alias("residual"))


def _weights_sql(src, signal, gain, dead, share, bias, cap, group="dt"):
    s = f"tanh({signal} * {gain})"
    return (
        f"w1 AS (SELECT *, CASE WHEN abs({s}) < {dead} THEN 0 ELSE {s} END AS s FROM {src})",
        f"w2 AS (SELECT *, rank() OVER (PARTITION BY {group} ORDER BY abs(s) DESC) AS rk, count(*) OVER (PARTITION BY {group}) AS n FROM w1)",
        f"w3 AS (SELECT *, least(greatest(CASE WHEN {share} >= 1 OR rk <= greatest(round_even({share} * n, 0), 1) THEN s ELSE 0 END + {bias}, -{cap}), {cap}) AS weight FROM w2)",
    )


@query(
    "c05_signal_weights",
    with_(BARS, _X, "sg AS (SELECT sym, dt, ret AS signal FROM x WHERE ret IS NOT NULL)", *_weights_sql("sg", "signal", 2.0, 0.1, 0.4, 0.01, 0.25), select=f"SELECT sym, dt, {r('weight')} AS weight FROM w3"),
)
def c05(spark, sf):
    sg = _saved(spark, sf).where(F.col("ret").isNotNull()).select("sym", "dt", F.col("ret").alias("signal"))
    out = xs.signal_weights(sg, ["dt"], gain=2.0, deadband=0.1, top_share=0.4, bias=0.01, cap=0.25)
    return out.select("sym", "dt", rnd("weight").alias("weight"))


@query(
    "c06_smoothed_weights",
    with_(
        BARS, _X, "g AS (SELECT sym, dt, least(greatest(tanh(ret), -0.25), 0.25) AS goal, row_number() OVER (PARTITION BY sym ORDER BY dt) AS n FROM x WHERE ret IS NOT NULL)",
        "p AS (SELECT sym, dt, n, goal AS w FROM g WHERE n = 1 UNION ALL SELECT g.sym, g.dt, g.n, 0.6 * p.w + 0.4 * g.goal FROM p JOIN g ON g.sym = p.sym AND g.n = p.n + 1)",
        select=f"SELECT sym, dt, {r('w')} AS weight FROM p",
    ),
)
def c06(spark, sf):
    from barline.functions.cols import clip
    from barline.operators.recursive import blended_path

    goal = _base(spark, sf).where(F.col("ret").isNotNull()).select("sym", "dt", clip(F.tanh("ret"), -0.25, 0.25).alias("goal"))
    return blended_path(goal, "goal", "weight", 0.6).select("sym", "dt", rnd("weight").alias("weight"))


@query(
    "c07_strategy_blend",
    with_(
        BARS10, _X, "sg AS (SELECT sym, dt, ret AS signal FROM x WHERE ret IS NOT NULL)",
        "st AS (SELECT s_suppkey AS strategy, s_acctbal / 10000 AS fitness, 1.0 + s_suppkey % 3 AS gain, (s_suppkey % 4) / 20.0 AS dead, 0.3 + 0.1 * (s_suppkey % 7) AS share, (s_suppkey % 5 - 2) / 100.0 AS bias FROM supplier ORDER BY fitness DESC, strategy LIMIT 8)",
        "mx AS (SELECT *, exp(fitness - max(fitness) OVER ()) / sum(exp(fitness)) OVER () * exp(max(fitness) OVER ()) AS mix FROM st)",
        "cr AS (SELECT * FROM sg, mx)",
        *_weights_sql("cr", "signal", "gain", "dead", "share", "bias", 0.25, "strategy, dt"),
        select=f"SELECT sym, dt, {r('sum(mix * weight)')} AS weight FROM w3 GROUP BY sym, dt",
    ),
)
def c07(spark, sf):
    sg = technical.returns(t.bars(spark, sf, books=10)).where(F.col("ret").isNotNull()).select("sym", "dt", F.col("ret").alias("signal"))
    k = F.col("s_suppkey")
    st = t.table(spark, sf, "supplier").select(
        k.alias("strategy"), (F.col("s_acctbal") / 10000).alias("fitness"), (1.0 + k % 3).alias("gain"),
        ((k % 4) / 20.0).alias("deadband"), (0.3 + 0.1 * (k % 7)).alias("top_share"), ((k % 5 - 2) / 100.0).alias("bias"), F.lit(0.25).alias("cap"),
    )
    return xs.blended_strategies(sg, st).select("sym", "dt", rnd("weight").alias("weight"))


_MOM = (
    f"mo AS (SELECT sym, dt, ret, coalesce(sign(avg(ret) {over(20, skip=1)}), 0) AS s FROM x)",
    "mw AS (SELECT sym, dt, ret, least(greatest(s / greatest(sum(abs(s)) OVER (PARTITION BY dt), 1), -0.25), 0.25) AS weight FROM mo)",
)


@query("c08_momentum_weights", with_(BARS, _X, *_MOM, select=f"SELECT sym, dt, {r('weight')} AS weight, {r('1.0 / count(*) OVER (PARTITION BY dt)')} AS equal FROM mw"))
def c08(spark, sf):
    out = xs.momentum_weights(t.saved_bars(spark, sf))
    out = xs.equal_weights(out.withColumnRenamed("weight", "mom")).withColumnRenamed("weight", "equal")
    return out.select("sym", "dt", rnd("mom").alias("weight"), rnd("equal").alias("equal"))


@query(
    "c09_top_movers",
    with_(
        BARS, _X, "k AS (SELECT sym, coalesce(ret, 0) AS ret, row_number() OVER (PARTITION BY sym ORDER BY dt DESC) AS n FROM x)",
        "m AS (SELECT sym, avg(ret) AS signal FROM k WHERE n <= 5 GROUP BY sym ORDER BY abs(signal) DESC, sym LIMIT 3)",
        select=f"SELECT sym, {r('signal')} AS signal, CASE WHEN signal > 0 THEN 'LONG' ELSE 'SHORT' END AS direction FROM m",
    ),
)
def c09(spark, sf):
    return xs.top_movers(t.saved_bars(spark, sf)).select("sym", rnd("signal").alias("signal"), "direction")


FLOWS = """links AS (SELECT CAST(s_nationkey AS BIGINT) AS a, CAST(c_nationkey AS BIGINT) AS b, sum(l_extendedprice) / 1e6 AS strength
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"""


def trade_links(spark, sf):
    """Goods value from supplier nation to customer nation."""
    li = t.table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_extendedprice")
    s = t.table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("a"))
    o = t.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = t.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("b"))
    rows = li.join(s, li.l_suppkey == s.s_suppkey).join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return rows.groupBy("a", "b").agg((F.sum("l_extendedprice") / 1e6).alias("strength"))


_SPILL = (
    FLOWS,
    "st AS (SELECT sum(strength) / 625 AS m, sum(strength * strength) / 625 AS q FROM links)",
    "tw AS (SELECT least(a, b) AS a, greatest(a, b) AS b, sum(strength) / 2 AS strength FROM links WHERE a <> b GROUP BY 1, 2)",
    "sp AS (SELECT a, b, strength FROM tw, st WHERE strength > m + 0.5 * sqrt(q - m * m) ORDER BY strength DESC, a, b LIMIT 10)",
)


def _spill(spark, sf):
    n = t.table(spark, sf, "nation").agg(F.count(F.lit(1)).alias("n"))
    return xs.spillover_pairs(trade_links(spark, sf), n, 10, wide=0.5)


@query("c16_spillover_pairs", with_(*_SPILL, select=f"SELECT a, b, {r('strength', 5)} AS strength FROM sp"))
def c16(spark, sf):
    return _spill(spark, sf).select("a", "b", rnd("strength", 5).alias("strength"))


@query(
    "c25_trading_permission",
    with_(
        *_SPILL,
        "stab AS (SELECT 1 - stddev_pop(strength) / avg(strength) AS s FROM links)",
        "rk AS (SELECT a AS sym FROM sp UNION SELECT b FROM sp)",
        select="""SELECT CAST(n_nationkey AS BIGINT) AS sym, s >= 0.6 AS allowed, CASE WHEN s < 0.6 THEN 'halted' WHEN rk.sym IS NOT NULL THEN 'half_size' ELSE 'normal' END AS note,
          CASE WHEN s > 0.8 THEN 'LOW' WHEN s > 0.6 THEN 'MODERATE' WHEN s > 0.4 THEN 'ELEVATED' ELSE 'CRITICAL' END AS risk
          FROM nation CROSS JOIN stab LEFT JOIN rk ON rk.sym = n_nationkey""",
    ),
)
def c25(spark, sf):
    assets = t.table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("sym"))
    stab = trade_links(spark, sf).agg((1 - F.stddev_pop("strength") / F.avg("strength")).alias("stability"))
    return xs.trading_permission(assets, _spill(spark, sf), stab)


_ACCT = "ac AS (SELECT sym, dt, close AS price, least(greatest(ret, -1), 1) AS weight, CAST(trades % 3 AS BIGINT) AS held, 20000.0 AS equity, CAST(sym % 2 AS BIGINT) AS account, ret * 10000 AS edge FROM x WHERE ret IS NOT NULL)"


@query(
    "c17_share_sizes",
    with_(
        BARS10, _X, _ACCT,
        "a1 AS (SELECT *, CASE WHEN abs(edge) < 50 THEN 0.0 ELSE least(greatest(weight, 0), 0.25) END AS tw FROM ac)",
        "a2 AS (SELECT *, CAST(trunc(tw * equity / price) AS BIGINT) AS q FROM a1)",
        "a3 AS (SELECT *, sum(abs(q * price)) OVER (PARTITION BY account, dt ORDER BY (q <> 0) DESC, abs(tw) DESC, sym DESC ROWS UNBOUNDED PRECEDING) AS run FROM a2)",
        "a4 AS (SELECT *, CASE WHEN run <= equity THEN q ELSE 0 END AS shares FROM a3)",
        select=f"SELECT account, sym, dt, CAST(shares AS BIGINT) AS shares, CAST(shares - held AS BIGINT) AS trade, {r('abs((shares - held) * price) * CASE WHEN shares > held THEN 0.001 + 0.00015 + 3.07e-05 * 1.18 ELSE 0.001 + 3.07e-05 * 1.18 END', 5)} AS cost, {r('shares * price / equity', 12)} AS realised_weight, abs(tw) > 1e-9 AND shares = 0 AS untradeable FROM a4",
    ),
)
def c17(spark, sf):
    base = technical.returns(t.bars(spark, sf, books=10)).where(F.col("ret").isNotNull())
    rows = base.select(
        "sym", "dt", F.col("close").alias("price"), F.least(F.greatest("ret", F.lit(-1.0)), F.lit(1.0)).alias("weight"),
        (F.col("trades") % 3).alias("held"), F.lit(20000.0).alias("equity"), (F.col("sym") % 2).alias("account"), (F.col("ret") * 10000).alias("edge"),
    )
    out = xs.share_sizes(rows, min_edge_bps=50.0, edge="edge", round_trip_bps=22.0)
    return out.select("account", "sym", "dt", "shares", "trade", rnd("cost", 5).alias("cost"), rnd("realised_weight", 12).alias("realised_weight"), "untradeable")


@query(
    "c18_trade_costs",
    f"""SELECT CAST(l_suppkey AS BIGINT) AS sym, l_linestatus = 'O' AS is_buy, {r('sum(l_extendedprice) * CASE WHEN l_linestatus = ' + "'O'" + ' THEN 0.00115 + 3.07e-05 * 1.18 ELSE 0.001 + 3.07e-05 * 1.18 END', 4)} AS cost,
    {r('(0.00215 + 2 * 3.07e-05 * 1.18) * 10000')} AS round_trip_bps FROM lineitem GROUP BY 1, l_linestatus""",
)
def c18(spark, sf):
    li = t.table(spark, sf, "lineitem")
    rows = li.groupBy(F.col("l_suppkey").cast("bigint").alias("sym"), (F.col("l_linestatus") == "O").alias("is_buy")).agg(F.sum("l_extendedprice").alias("v"))
    return rows.select("sym", "is_buy", rnd(costs.trade_cost("v", F.col("is_buy")), 4).alias("cost"), rnd(costs.round_trip_bps()).alias("round_trip_bps"))


@query(
    "c19_kelly_fraction",
    with_(
        BARS, _X, "s AS (SELECT sym, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS p, avg(ret) FILTER (WHERE ret > 0) / nullif(-avg(ret) FILTER (WHERE ret < 0), 0) AS b FROM x WHERE ret IS NOT NULL GROUP BY sym)",
        select=f"SELECT sym, {r('CASE WHEN b > 0 THEN greatest((b * p - (1 - p)) / b, 0) * 0.25 ELSE 0 END')} AS fraction FROM s",
    ),
)
def c19(spark, sf):
    s = _base(spark, sf).where(F.col("ret").isNotNull()).groupBy("sym").agg(
        F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("p"),
        F.try_divide(F.avg(F.when(F.col("ret") > 0, F.col("ret"))), -F.avg(F.when(F.col("ret") < 0, F.col("ret")))).alias("b"),
    )
    return s.select("sym", rnd(mathx.kelly("p", "b")).alias("fraction"))


N_CHAN = 19
_GENE = "[least(greatest(CAST(v AS DOUBLE) + 0.5, 0), 1) FOR v IN embedding]"
STRATEGIES = f"""strat AS (SELECT vec_id, g, list_sum(g[1:{N_CHAN}]) AS s FROM (SELECT vec_id, {_GENE} AS g FROM embeddings))"""


def strategies(spark, sf):
    """Embedding vectors read as parameter vectors (three levels per channel and six scalars)."""
    e = t.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") + 0.5).alias("genes"))
    return xs.decode_vectors(e, N_CHAN).drop("genes")


_SCAL = (("hold_days", 1, 5, 90), ("trailing_stop", 2, 0.02, 0.2), ("kelly_share", 3, 0, 1), ("regime_sensitivity", 4, 0, 1), ("conviction", 5, 0.05, 0.6), ("vol_target", 6, 0, 0.3))


@query(
    "c21_decode_vectors",
    with_(
        STRATEGIES,
        select=f"SELECT vec_id, {r('g[1] / s')} AS w_first, {r('g[19] / s')} AS w_last, {r('list_sum(g[20:38])')} AS entry_sum, {r('list_sum(g[39:57])')} AS exit_sum, "
        + ", ".join(f"CAST(round_even({a} + ({b} - {a}) * g[{57 + i}], 0) AS INTEGER) AS {n}" if n == "hold_days" else f"{r(f'{a} + ({b} - {a}) * g[{57 + i}]')} AS {n}" for n, i, a, b in _SCAL)
        + " FROM strat",
    ),
)
def c21(spark, sf):
    st = strategies(spark, sf)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return st.select(
        "vec_id", rnd(F.element_at("weights", 1)).alias("w_first"), rnd(F.element_at("weights", -1)).alias("w_last"),
        rnd(total("entry")).alias("entry_sum"), rnd(total("exit")).alias("exit_sum"), "hold_days",
        *[rnd(n).alias(n) for n, *_ in _SCAL[1:]],
    )


_CHN = technical.TECHNICAL_CHANNELS[:N_CHAN]
_LATEST = f"la AS (SELECT sym, [{', '.join(_CHN)}] AS x FROM chan QUALIFY row_number() OVER (PARTITION BY sym ORDER BY dt DESC) = 1)"


def latest_channels(spark, sf):
    """The newest channel vector of each of the ten baskets."""
    ch = technical.technical_channels(t.bars(spark, sf, books=10))
    return ch.groupBy("sym").agg(F.max_by(F.array(*_CHN), "dt").alias("x"))


@query(
    "c20_vote_scores",
    with_(
        *CH10, STRATEGIES, _LATEST,
        select=f"SELECT vec_id, sym, {r('list_sum([g[i] / s * (CASE WHEN x[i] > g[i + 19] THEN 1 ELSE 0 END - CASE WHEN x[i] < -g[i + 38] THEN 1 ELSE 0 END) FOR i IN range(1, 20)])')} AS score FROM strat, la",
    ),
)
def c20(spark, sf):
    # ten rows (one per basket) meet the strategy table
    out = strategies(spark, sf).join(F.broadcast(latest_channels(spark, sf)), how="cross")
    return out.select("vec_id", "sym", rnd(xs.vote_score("x", "weights", "entry", "exit")).alias("score"))


@query(
    "j12_strategy_panel",
    with_(
        *CH10,
        "v AS (SELECT sym, dt, k AS strategy, CASE WHEN rsi14 > 0.1 * k THEN 1 ELSE 0 END - CASE WHEN rsi14 < -0.1 * k THEN 1 ELSE 0 END AS vote FROM chan, range(1, 6) t(k))",
        select="SELECT CAST(strategy AS INTEGER) AS strategy, sym, CAST(sum(vote) AS BIGINT) AS net_votes, CAST(sum(abs(vote)) AS BIGINT) AS active FROM v GROUP BY 1, 2",
    ),
)
def j12(spark, sf):
    ch = technical.technical_channels(t.bars(spark, sf, books=10)).select("sym", "dt", "rsi14")
    # strategies are a short sequence generated beside each row: no join at all
    crossed = ch.withColumn("strategy", F.explode(F.sequence(F.lit(1), F.lit(5))))
    level = 0.1 * F.col("strategy")
    vote = F.when(F.col("rsi14") > level, 1).otherwise(0) - F.when(F.col("rsi14") < -level, 1).otherwise(0)
    return crossed.groupBy("strategy", "sym").agg(F.sum(vote).alias("net_votes"), F.sum(F.abs(vote)).alias("active"))


def _bin(c, n):
    return f"CAST(least(greatest(floor(({c} + 1) / 2 * {n}), 0), {n - 1}) AS INTEGER)"


@query("c22_state_counts", with_(*CHANNEL_CTES, select=f"SELECT {_bin('atr_share', 3)} AS regime, {_bin('rsi14', 5)} AS strength, {_bin('macd_gap', 5)} AS trend, CAST(count(*) AS BIGINT) AS n FROM chan GROUP BY 1, 2, 3"))
def c22(spark, sf):
    panel = t.bars(spark, sf).select("sym", "dt", "high", "low", "close", "volume")
    return xs.state_counts(technical.technical_channels(panel), "atr_share", "rsi14", "macd_gap")


@query(
    "c24_gated_targets",
    with_(
        BARS, _X,
        "g AS (SELECT sym, dt, tanh(ret) AS signal, CASE WHEN sym % 4 <> 0 THEN ret_5 END AS bias, CASE WHEN month(dt) = 10 THEN 0.0 ELSE 1.0 END AS mc, CASE WHEN trades > 2 THEN 0.0 ELSE 0.5 END AS nc FROM x WHERE ret_5 IS NOT NULL)",
        "h AS (SELECT *, CASE WHEN bias IS NULL THEN signal ELSE least(greatest(signal * CASE WHEN sign(signal) = sign(bias) THEN 1.15 ELSE 0.7 END, -1), 1) END AS s FROM g)",
        "k AS (SELECT *, CASE WHEN mc = 0 OR nc = 0 THEN least(s, 0) ELSE s END * 0.5 * 0.25 AS goal FROM h)",
        select=f"SELECT sym, dt, {r('CASE WHEN goal > 0 THEN least(goal, 0.25 * least(mc, nc)) ELSE greatest(goal, -0.25) END')} AS target FROM k",
    ),
)
def c24(spark, sf):
    rows = _base(spark, sf).where(F.col("ret_5").isNotNull()).select(
        "sym", "dt", F.tanh("ret").alias("signal"), F.when(F.col("sym") % 4 != 0, F.col("ret_5")).alias("bias"),
        F.when(F.month("dt") == 10, 0.0).otherwise(1.0).alias("market_cap"), F.when(F.col("trades") > 2, 0.0).otherwise(0.5).alias("name_cap"),
    )
    return xs.gated_targets(rows).select("sym", "dt", rnd("target").alias("target"))


@query(
    "m16_blend_signals",
    with_(BARS, _X, select=f"SELECT sym, dt, {r('CASE WHEN trades > 1 AND ret_5 IS NOT NULL THEN 0.7 * ret + 0.3 * ret_5 ELSE ret END')} AS blended FROM x WHERE ret IS NOT NULL"),
)
def m16(spark, sf):
    base = _base(spark, sf)
    first = base.where(F.col("ret").isNotNull()).select("sym", "dt", F.col("ret").alias("signal"))
    second = base.where(F.col("trades") > 1).select("sym", "dt", F.col("ret_5").alias("signal"))
    return xs.blend_signals(first, second, 0.3).select("sym", "dt", rnd("blended").alias("blended"))


@query(
    "session_quantiles",
    with_(BARS, _X, select="SELECT dt, CAST(count(ret) AS BIGINT) AS n, " + ", ".join(f"{r(f'quantile_cont(ret, {p})')} AS {n}" for n, p in (("low", 0.05), ("mid", 0.5), ("high", 0.95))) + " FROM x WHERE ret IS NOT NULL GROUP BY dt"),
)
def session_quantiles(spark, sf):
    """Exact quantiles of a whole session's returns without gathering the session in one task."""
    out = exact_quantiles(_saved(spark, sf), ["dt"], "ret", {"low": 0.05, "mid": 0.5, "high": 0.95})
    return out.select("dt", "n", *[rnd(c).alias(c) for c in ("low", "mid", "high")])


