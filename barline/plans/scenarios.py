"""Path, graph, network and strategy-sweep queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from barline.functions import costs
from barline.functions.cols import by_sym, rnd
from barline.operators import admission as ad, alignment as al, graph as gr, network as nw, paths as pt, permute as pm, quality as ql, rules, skeleton as sk, strategies as sg, technical, xsection as xs
from barline.operators.alignment import assign_windows
from barline.plans.ansi import BARS, BARS10, CAL, lag, lead, r, roll, with_
from barline.plans.landing import _nrm, _u
from barline.plans.metrics import _KELLY, GRID10, STRAT_DAYS, calls, kelly10
from barline.plans.registry import query
from barline.plans.studies import _GRID, AUDIT_SQL, FEATS, channels, grid10
from barline.plans.xsection import FLOWS, trade_links
from barline.session import dealt, durable
from barline.sources import tables as t

LEN = 20
PATHS = (
    *_GRID,
    f"gr AS (SELECT sym, bar_idx, close / {lag('close', order='bar_idx')} - 1 AS ret FROM g10)",
    f"paths AS (SELECT CAST(bar_idx // {LEN} AS INTEGER) AS path, CAST(bar_idx % {LEN} AS INTEGER) AS t, sym, coalesce(ret, 0.0) AS r FROM gr)",
)


def rets10(spark, sf):
    g = grid10(spark, sf)
    return durable(technical.returns(g).select("sym", "dt", "bar_idx", "close", "ret", "volume"), "grid-returns")


def paths10(spark, sf):
    """History cut into 20-bar stretches: one path each."""
    return pt.cut_paths(rets10(spark, sf), LEN)


_BANDS = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


@query("a17_path_surface", with_(*PATHS, select="SELECT t, sym, " + ", ".join(f"{r(f'quantile_cont(r, {p})')} AS {n}" for n, p in _BANDS.items()) + f", {r('avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END)')} AS p_positive FROM paths GROUP BY t, sym"))
def a17(spark, sf):
    return pt.surface(paths10(spark, sf), _BANDS).select("t", "sym", *[rnd(c).alias(c) for c in (*_BANDS, "p_positive")])


_TOT = "tot AS (SELECT path, sym, exp(sum(ln(1 + least(greatest(r, -0.5), 2)))) - 1 AS total FROM paths GROUP BY 1, 2), vr AS (SELECT sym, quantile_cont(total, 0.05) AS v FROM tot GROUP BY sym), tr AS (SELECT sym, v AS var_95, coalesce(avg(total) FILTER (WHERE total < v), v) AS cvar_95 FROM tot JOIN vr USING (sym) GROUP BY sym, v)"


@query("a17_tail_risk", with_(*PATHS, _TOT, select=f"SELECT sym, {r('var_95')} AS var_95, {r('cvar_95')} AS cvar_95 FROM tr"))
def a17b(spark, sf):
    return pt.tail_risk(pt.compounded(paths10(spark, sf))).select("sym", rnd("var_95").alias("var_95"), rnd("cvar_95").alias("cvar_95"))


_SUMM = (
    _TOT, f"la AS (SELECT sym, r FROM paths WHERE t = {LEN - 1})", "lm AS (SELECT sym, avg(r) AS m, stddev_pop(r) AS s FROM la GROUP BY sym)",
    """ps AS (SELECT sym, m AS expected_return, s AS std, quantile_cont(r, 0.5) AS median_return, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS p_positive, avg((r - m) ^ 3) / (s ^ 3 + 1e-8) AS skewness, quantile_cont(r, 0.01) AS worst_case_1, quantile_cont(r, 0.99) AS best_case_99
      FROM la JOIN lm USING (sym) GROUP BY sym, m, s)""",
    "pss AS (SELECT ps.*, tr.var_95, tr.cvar_95 FROM ps JOIN tr USING (sym))",
)
_A18 = ("expected_return", "median_return", "std", "skewness", "p_positive", "var_95", "cvar_95", "worst_case_1", "best_case_99")


@query("a18_path_summary", with_(*PATHS, *_SUMM, select="SELECT sym, " + ", ".join(f"{r(c)} AS {c}" for c in _A18) + " FROM pss"))
def a18(spark, sf):
    return pt.path_summary(paths10(spark, sf)).select("sym", *[rnd(c).alias(c) for c in _A18])


_SCEN = (
    "lc AS (SELECT path, t, exp(sum(ln(1 + least(greatest(r, -0.99), 10))) OVER (PARTITION BY path ORDER BY t)) AS c FROM paths WHERE sym = 0)",
    "ld AS (SELECT path, c, max(c) OVER (PARTITION BY path ORDER BY t) AS p FROM lc)",
    "dr AS (SELECT path, min((c - p) / (p + 1e-8)) AS max_drawdown FROM ld GROUP BY path)",
    "pk AS (SELECT path, max(abs(r)) AS peak_move FROM paths GROUP BY path)",
    "pf AS (SELECT * FROM paths QUALIFY count(*) OVER (PARTITION BY path, sym) = max(t) OVER (PARTITION BY path) + 1)",
    "cc AS (SELECT a.path, a.sym AS x, b.sym AS y, covar_pop(a.r, b.r) / sqrt(var_pop(a.r) * var_pop(b.r)) AS c FROM pf a JOIN pf b ON a.path = b.path AND a.t = b.t AND a.sym < b.sym GROUP BY 1, 2, 3)",
    "mc AS (SELECT path, avg(c) AS mean_corr FROM cc GROUP BY path)",
    "sce AS (SELECT path, max_drawdown, peak_move, mean_corr, 1.0 + path % 4 AS sigma_mult, (1.0 + path % 4) * peak_move AS severity FROM dr JOIN pk USING (path) LEFT JOIN mc USING (path))",
)


def records10(spark, sf):
    return durable(pt.scenario_records(paths10(spark, sf), 0, 1.0 + F.col("path") % 4), "records")


@query("a19_scenario_records", with_(*PATHS, *_SCEN, select="SELECT path, " + ", ".join(f"{r(c)} AS {c}" for c in ("max_drawdown", "peak_move", "mean_corr", "severity")) + " FROM sce"))
def a19(spark, sf):
    return records10(spark, sf).select("path", *[rnd(c).alias(c) for c in ("max_drawdown", "peak_move", "mean_corr", "severity")])


@query(
    "a20_library_summary",
    with_(
        *PATHS, *_SCEN,
        select=f"SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE path % 4 <> 3) AS BIGINT) AS templated, CAST(count(*) FILTER (WHERE path % 4 = 3) AS BIGINT) AS pure_extreme, {r('avg(severity)')} AS severity_mean, {r('quantile_cont(severity, 0.99)')} AS severity_p99, {r('max(severity)')} AS severity_max, {r('avg(max_drawdown)')} AS drawdown_mean, {r('quantile_cont(max_drawdown, 0.99)')} AS drawdown_p99, {r('min(max_drawdown)')} AS drawdown_worst FROM sce",
    ),
)
def a20(spark, sf):
    out = pt.library_summary(records10(spark, sf), F.col("path") % 4 == 3)
    return out.select("total", "templated", "pure_extreme", *[rnd(c).alias(c) for c in ("severity_mean", "severity_p99", "severity_max", "drawdown_mean", "drawdown_p99", "drawdown_worst")])


@query(
    "a21_tail_coverage",
    with_(
        *PATHS, "po AS (SELECT stddev_pop(r) + 1e-8 AS sd, kurtosis_pop(r) AS k, (avg(r * r * r) - 3 * avg(r) * avg(r * r) + 2 * avg(r) ^ 3) / stddev_pop(r) ^ 3 AS sk FROM paths)",
        "hi AS (SELECT path, bool_or(abs(r) > 3 * sd) AS x FROM paths, po GROUP BY path)", "cu AS (SELECT min(c) AS w FROM (SELECT sum(r) OVER (PARTITION BY path, sym ORDER BY t) AS c FROM paths))",
        select=f"SELECT {r('100 * avg(CASE WHEN x THEN 1.0 ELSE 0 END)')} AS coverage_pct, CAST(count(*) AS BIGINT) AS n_paths, {r('max(k)', 5)} AS kurtosis, {r('max(sk)', 5)} AS skewness, {r('max(w)')} AS worst_drawdown, max(k) > 0 AND 100 * avg(CASE WHEN x THEN 1.0 ELSE 0 END) >= 1 AS passed FROM hi, po, cu",
    ),
)
def a21(spark, sf):
    out = pt.tail_coverage(paths10(spark, sf))
    return out.select(rnd("coverage_pct").alias("coverage_pct"), "n_paths", rnd("kurtosis", 5).alias("kurtosis"), rnd("skewness", 5).alias("skewness"), rnd("worst_drawdown").alias("worst_drawdown"), "passed")


@query(
    "a40_price_paths",
    with_(*PATHS, "px AS (SELECT path, t, sym, greatest(100 * product(1 + CASE WHEN path % 10 = 3 THEN r * 4 ELSE r END) OVER (PARTITION BY path, sym ORDER BY t), 0.01) AS price FROM paths)", select=f"SELECT path, t, sym, {r('ln(price)')} AS log_price FROM px"),
)
def a40(spark, sf):
    wild = paths10(spark, sf).withColumn("r", F.when(F.col("path") % 10 == 3, F.col("r") * 4).otherwise(F.col("r")))
    return pt.price_paths(wild, F.lit(100.0)).select("path", "t", "sym", rnd(F.ln("price")).alias("log_price"))




@query(
    "c10_recommendations",
    with_(
        *PATHS, *_SUMM, "top AS (SELECT * FROM pss ORDER BY abs(expected_return) DESC, sym LIMIT 5)",
        select=f"""SELECT sym, CASE WHEN expected_return > 0 THEN 'LONG' ELSE 'SHORT' END AS direction, {r('expected_return')} AS expected_return, {r('CASE WHEN expected_return > 0 THEN p_positive ELSE 1 - p_positive END')} AS probability, {r('(sym + 1) / 100.0 * 100')} AS size_pct, {r('var_95')} AS var_95,
          CASE WHEN abs(expected_return) > 0.02 AND p_positive > 0.65 THEN 'HIGH' ELSE 'MODERATE' END AS conviction FROM top WHERE NOT (abs(expected_return) < 0.001 OR (p_positive < 0.45 AND expected_return > 0))""",
    ),
)
def c10(spark, sf):
    stats = pt.path_summary(paths10(spark, sf))
    sizes = stats.select("sym", ((F.col("sym") + 1) / 100.0).alias("fraction"))
    out = pt.trade_recommendations(stats, sizes)
    return out.select("sym", "direction", rnd("expected_return").alias("expected_return"), rnd("probability").alias("probability"), rnd("size_pct").alias("size_pct"), rnd("var_95").alias("var_95"), "conviction")


@query(
    "c11_risk_summary",
    with_(
        *_KELLY, select=f"SELECT {r('min(fraction)')} AS worst_var, {r('coalesce(sum(fraction) FILTER (WHERE fraction > 0), 0)')} AS long_exposure, {r('coalesce(-sum(fraction) FILTER (WHERE fraction < 0), 0)')} AS short_exposure, {r('sum(fraction)')} AS net_exposure, CAST(count(*) FILTER (WHERE fraction <> 0) AS BIGINT) AS n_active, CASE WHEN min(fraction) < -0.15 THEN 'HIGH' WHEN min(fraction) < -0.08 THEN 'MODERATE' ELSE 'LOW' END AS risk_level FROM kelly",
    ),
)
def c11(spark, sf):
    k = kelly10(spark, sf)
    out = pt.risk_summary(k.select(F.col("fraction").alias("var_95")), k)
    return out.select(*[rnd(c).alias(c) for c in ("worst_var", "long_exposure", "short_exposure", "net_exposure")], "n_active", "risk_level")


@query("c12_severity_top", with_(*PATHS, *_SCEN, "wp AS (SELECT path, sum(r * 0.1) AS pnl FROM paths GROUP BY path ORDER BY pnl, path LIMIT 10)", select=f"SELECT 'severe' AS kind, path, {r('severity')} AS v FROM (SELECT * FROM sce ORDER BY severity DESC, path LIMIT 10) UNION ALL SELECT 'worst', path, {r('pnl')} FROM wp"))
def c12(spark, sf):
    a = pt.severity_top(records10(spark, sf), 10).select(F.lit("severe").alias("kind"), "path", rnd("severity").alias("v"))
    b = pt.worst_paths(paths10(spark, sf), F.lit(0.1), 10).select(F.lit("worst").alias("kind"), "path", rnd("pnl").alias("v"))
    return a.unionByName(b)


@query("c13_curriculum", with_(*PATHS, *_SCEN, "q AS (SELECT quantile_cont(severity, 0.33) AS lo, quantile_cont(severity, 0.66) AS hi FROM sce)", select="SELECT path, CASE WHEN severity <= lo THEN 'easy' WHEN severity <= hi THEN 'medium' ELSE 'hard' END AS band FROM sce, q"))
def c13(spark, sf):
    return pt.curriculum(records10(spark, sf)).select("path", "band")


@query(
    "c14_stratified_sample",
    with_(
        *PATHS, *_SCEN, "q AS (SELECT quantile_cont(severity, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS b FROM sce)",
        "st AS (SELECT path, i AS stratum FROM sce, q, range(0, 5) u(i) WHERE severity >= b[i + 1] AND severity <= b[i + 2])",
        select="SELECT path, CAST(stratum AS INTEGER) AS stratum FROM st QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5('s-' || stratum || '-' || path), path) <= 6",
    ),
)
def c14(spark, sf):
    return pt.stratified_sample(records10(spark, sf), 30).select("path", "stratum")


@query(
    "c15_adversarial_mix",
    with_(
        *PATHS, "pn AS (SELECT path, sum(r * 0.1) AS pnl FROM paths GROUP BY path)", "bad AS (SELECT path, pnl FROM pn ORDER BY pnl, path LIMIT 28)",
        "rnd AS (SELECT path, pnl FROM pn ANTI JOIN bad USING (path) ORDER BY md5('a-' || path), path LIMIT 12)",
        select=f"SELECT path, {r('pnl')} AS pnl, 'worst' AS kind FROM bad UNION ALL SELECT path, {r('pnl')}, 'random' FROM rnd",
    ),
)
def c15(spark, sf):
    return pt.adversarial_mix(paths10(spark, sf), F.lit(0.1), 40).select("path", rnd("pnl").alias("pnl"), "kind")


@query(
    "d21_bootstrap_paths",
    with_(
        *_GRID, f"gx AS (SELECT sym, bar_idx, coalesce(close / {lag('close', order='bar_idx')} - 1, 0) AS ret FROM g10)",
        "st AS (SELECT max(bar_idx) + 1 AS n, stddev_pop(ret) AS sd FROM gx)",
        f"sp AS (SELECT p AS path, CAST(floor({_u('b', 'p')} * greatest(n - 10, 0)) AS BIGINT) AS s, sd FROM st, range(0, 200) x(p))",
        f"cb AS (SELECT sp.path, t, g.sym, g.ret + {_nrm('bj', 'sp.path', 't', 'g.sym')} * sd * 0.1 AS r FROM sp, range(0, 10) y(t) JOIN gx g ON g.bar_idx = sp.s + t)",
        select=f"SELECT CAST(path AS INTEGER) AS path, CAST(count(*) AS BIGINT) AS cells, {r('sum(r)', 5)} AS total FROM cb GROUP BY path",
    ),
)
def d21(spark, sf):
    out = pm.bootstrap_paths(rets10(spark, sf).na.fill(0.0, ["ret"]), 200, 10)
    return out.groupBy("path").agg(F.count(F.lit(1)).alias("cells"), rnd(F.sum("r"), 5).alias("total"))


@query(
    "d22_augmented_paths",
    with_(
        *PATHS, f"au AS (SELECT path, c AS copy, (t + CAST(floor({_u('ur', 'path', 'c')} * 5) AS INTEGER)) % {LEN} AS t, r * (0.8 + 0.4 * {_u('us', 'path', 'c')}) AS r FROM paths, range(0, 3) x(c))",
        select=f"SELECT path, CAST(copy AS INTEGER) AS copy, CAST(count(*) AS BIGINT) AS cells, {r('sum(r * (t + 1))', 5)} AS total FROM au GROUP BY path, copy",
    ),
)
def d22(spark, sf):
    out = pt.augmented(paths10(spark, sf), 3, LEN)
    return out.groupBy("path", "copy").agg(F.count(F.lit(1)).alias("cells"), rnd(F.sum(F.col("r") * (F.col("t") + 1)), 5).alias("total"))


@query("d23_no_arbitrage")
def d23(spark, sf):
    x = rets10(spark, sf)
    cut = F.lit("1999-01-01").cast("date")
    pred = x.where(F.col("dt") >= cut).select("dt", "sym", F.coalesce("ret", F.lit(0.0)).alias("pred"))
    return pt.no_arbitrage_score(x.where(F.col("dt") < cut).select("dt", "sym", "ret"), pred, list(range(10))).withColumn("score", rnd("score"))


# ---- graph ---------------------------------------------------------------------------------------------------

EDGES = (
    FLOWS, "lk AS (SELECT a AS source, b AS target, strength, strength / sum(strength) OVER (PARTITION BY a) AS share FROM links WHERE a < b)",
    "edges AS (SELECT source, target, share * CASE WHEN (source + target) % 3 = 0 THEN -1 ELSE 1 END AS weight, 0.5 + share / 2 AS confidence FROM lk QUALIFY strength > avg(strength) OVER (PARTITION BY source))",
)


def edges(spark, sf):
    """Flows to higher-numbered nations that exceed the mean of their nation's: an acyclic graph."""
    from pyspark.sql import Window

    links = trade_links(spark, sf).where(F.col("a") < F.col("b"))
    out = Window.partitionBy("a")
    share = F.col("strength") / F.sum("strength").over(out)
    rows = links.withColumns({"share": share, "mean": F.avg("strength").over(out)}).where(F.col("strength") > F.col("mean"))
    sign = F.when((F.col("a") + F.col("b")) % 3 == 0, -1).otherwise(1)
    out = rows.select(F.col("a").alias("source"), F.col("b").alias("target"), (F.col("share") * sign).alias("weight"), (0.5 + F.col("share") / 2).alias("confidence"))
    return durable(out, "edges")


_WALK = "walk AS (SELECT source AS root, target AS node, weight AS w, confidence AS c, 1 AS len, [source, target] AS p FROM edges UNION ALL SELECT walk.root, e.target, walk.w * e.weight, walk.c * e.confidence, walk.len + 1, list_append(walk.p, e.target) FROM walk JOIN edges e ON e.source = walk.node WHERE walk.len < 5)"


@query("g02_intervention", with_(*EDGES, _WALK, select=f"SELECT node, {r('sum(w) * 2', 9)} AS effect, {r('avg(c)', 9)} AS confidence, CAST(count(*) AS BIGINT) AS n_paths FROM walk WHERE root = 0 GROUP BY node"))
def g02(spark, sf):
    return gr.intervention(edges(spark, sf), 0, 2.0).select("node", rnd("effect", 9).alias("effect"), rnd("confidence", 9).alias("confidence"), "n_paths")


@query("g03_counterfactual", with_(*EDGES, _WALK, select=f"SELECT node, {r('sum(w) * 2', 9)} AS factual, {r('sum(w) * -1.5', 9)} AS counterfactual, {r('sum(w) * -3.5', 9)} AS delta FROM walk WHERE root = 1 GROUP BY node"))
def g03(spark, sf):
    out = gr.counterfactual(edges(spark, sf), 1, 2.0, -1.5)
    return out.select("node", *[rnd(c, 9).alias(c) for c in ("factual", "counterfactual", "delta")])


@query(
    "g04_attribution",
    with_(
        *EDGES, _WALK, "at4 AS (SELECT root AS node, sum(w) * 10 AS effect, max(c) AS path_confidence, first(p ORDER BY c DESC) AS path FROM walk WHERE node = 24 AND len <= 4 GROUP BY root)",
        select=f"SELECT node, {r('effect', 9)} AS effect, {r('abs(effect) / sum(abs(effect)) OVER () * 100', 5)} AS share_pct, {r('path_confidence', 9)} AS path_confidence, array_to_string(path, '>') AS path FROM at4 ORDER BY abs(effect) DESC, node LIMIT 10",
    ),
)
def g04(spark, sf):
    out = gr.attribution(edges(spark, sf), F.lit(24).cast("bigint"), 10.0)
    return out.select("node", rnd("effect", 9).alias("effect"), rnd("share_pct", 5).alias("share_pct"), rnd("path_confidence", 9).alias("path_confidence"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


_REACH = "reach AS (SELECT source AS root, target AS node FROM edges UNION SELECT reach.root, e.target FROM reach JOIN edges e ON e.source = reach.node)"


_RANKED = "ranked AS (SELECT a, b, row_number() OVER (ORDER BY strength DESC, a, b) AS seq FROM links)"


@query(
    "g01_admit_edges",
    with_(
        # what a node reaches as bits, kept up to date proposal by proposal
        *EDGES, _REACH, _RANKED, "nodes AS (SELECT CAST(n_nationkey AS BIGINT) AS node FROM nation)",
        "mask AS (SELECT n.node, (1::BIGINT << n.node::INT) + coalesce(sum(1::BIGINT << r.node::INT), 0)::BIGINT AS m FROM nodes n LEFT JOIN reach r ON r.root = n.node GROUP BY n.node)",
        """turn AS (
          SELECT 0::BIGINT AS seq, -1::BIGINT AS a, -1::BIGINT AS b, (SELECT list(m ORDER BY node) FROM mask) AS m, false AS bad UNION ALL
          SELECT p.seq, p.a, p.b, CASE WHEN p.a = p.b OR t.m[p.b + 1] & (1::BIGINT << p.a::INT) <> 0 THEN t.m
            ELSE list_transform(t.m, lambda x: CASE WHEN x & (1::BIGINT << p.a::INT) <> 0 THEN x | t.m[p.b + 1] ELSE x END) END,
            p.a = p.b OR t.m[p.b + 1] & (1::BIGINT << p.a::INT) <> 0 FROM turn t JOIN ranked p ON p.seq = t.seq + 1)""",
        select="SELECT a AS source, b AS target, seq, CASE WHEN bad THEN 'cycle' ELSE 'accepted' END AS verdict FROM turn WHERE seq > 0",
    ),
)
def g01(spark, sf):
    """All flows, strongest first, proposed to the graph of the strong upward ones."""
    from pyspark.sql import Window

    nodes = t.table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("node"))
    # one row per pair of nations
    place = F.row_number().over(Window.orderBy(F.desc("strength"), "a", "b")).cast("bigint")
    proposed = trade_links(spark, sf).select(F.col("a").alias("source"), F.col("b").alias("target"), place.alias("seq"))
    return ad.admit_edges(nodes, edges(spark, sf), proposed).select("source", "target", "seq", "verdict")


@query(
    "g05_confounders",
    with_(*EDGES, _REACH, select="SELECT a.root AS node FROM reach a JOIN reach b ON a.root = b.root WHERE a.node = 20 AND b.node = 24 AND a.root NOT IN (SELECT source FROM edges WHERE target = 20)"),
)
def g05(spark, sf):
    return gr.confounders(edges(spark, sf), 20, 24)


_X3 = (*_GRID, f"gr AS (SELECT sym, bar_idx, close / {lag('close', order='bar_idx')} - 1 AS ret FROM g10)", "w3 AS (SELECT a.ret AS y, b.ret AS x, c.ret AS z FROM gr a JOIN gr b ON b.bar_idx = a.bar_idx AND b.sym = 1 JOIN gr c ON c.bar_idx = a.bar_idx AND c.sym = 2 WHERE a.sym = 0 AND a.ret IS NOT NULL AND b.ret IS NOT NULL AND c.ret IS NOT NULL)")


def _wide3(spark, sf):
    return rets10(spark, sf).groupBy("dt").pivot("sym", list(range(6))).agg(F.first("ret")).toDF("dt", *[f"v{i}" for i in range(6)])


@query(
    "g06_ridge_effect",
    with_(
        *_X3, "s AS (SELECT count(*) AS n, covar_pop(x, x) * count(*) + 1 AS xx, covar_pop(z, z) * count(*) + 1 AS zz, covar_pop(x, z) * count(*) AS xz, covar_pop(x, y) * count(*) AS xy, covar_pop(z, y) * count(*) AS zy FROM w3)",
        select=f"SELECT {r('(xy * zz - zy * xz) / (xx * zz - xz * xz) * 3', 8)} AS effect, CAST(n AS BIGINT) AS n FROM s",
    ),
)
def g06(spark, sf):
    return gr.ridge_effect(_wide3(spark, sf), "v0", "v1", ["v2"], 3.0).select(rnd("effect", 8).alias("effect"), F.col("n").cast("bigint").alias("n"))


_LP = "lev AS (SELECT DISTINCT source AS node, 1 AS l FROM edges UNION SELECT e.target, lev.l + 1 FROM lev JOIN edges e ON e.source = lev.node)"


@query(
    "g07_graph_summary",
    with_(
        *EDGES, _LP,
        select="""SELECT 'category' AS kind, r_name AS name, CAST(count(*) AS BIGINT) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name UNION ALL SELECT 'nodes', '', count(*) FROM nation UNION ALL SELECT 'edges', '', count(*) FROM edges
          UNION ALL SELECT 'longest_path', '', max(l) FROM lev UNION ALL SELECT * FROM (SELECT 'out_degree', CAST(source AS VARCHAR), count(*) AS n FROM edges GROUP BY source ORDER BY n DESC, source LIMIT 5)""",
    ),
)
def g07(spark, sf):
    n = t.table(spark, sf, "nation").join(t.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return gr.graph_summary(n.select("n_nationkey", F.col("r_name").alias("category")), edges(spark, sf))


_VARS = (*FEATS, "close", "volume")
_Z99 = 2.5758293035489004  # a two-sided p-value of 0.01


@query(
    "g08_skeleton_two_levels",
    with_(
        *AUDIT_SQL[:7], "vr AS (" + " UNION ALL ".join(f"SELECT {i} AS i, sym, bar_idx, {c} AS v FROM feats" for i, c in enumerate(_VARS)) + ")",
        "ok AS (SELECT sym, bar_idx FROM vr GROUP BY ALL HAVING count(v) = 6)", "vo AS (SELECT vr.* FROM vr SEMI JOIN ok USING (sym, bar_idx))",
        "co AS (SELECT a.i, b.i AS j, greatest(least(corr(a.v, b.v), 0.9999999), -0.9999999) AS c, count(*) AS n FROM vo a JOIN vo b USING (sym, bar_idx) WHERE a.i <> b.i GROUP BY a.i, b.i)",
        f"l0 AS (SELECT * FROM co WHERE abs(atanh(c)) * sqrt(n - 3) >= {_Z99})",
        f"""l1 AS (SELECT DISTINCT p.i, p.j FROM l0 p JOIN l0 s ON s.i = p.i AND s.j <> p.j JOIN co t ON t.i = p.j AND t.j = s.j
          WHERE p.i < p.j AND abs(atanh((p.c - s.c * t.c) / sqrt((1 - s.c * s.c) * (1 - t.c * t.c)))) * sqrt(p.n - 4) < {_Z99})""",
        f"nm AS (SELECT unnest(range(0, 6)) AS i, unnest({list(_VARS)}) AS name)",
        select=f"SELECT x.name AS a, y.name AS b, {r('c')} AS corr FROM l0 ANTI JOIN l1 USING (i, j) JOIN nm x ON x.i = l0.i JOIN nm y ON y.i = l0.j WHERE l0.i < l0.j",
    ),
)
def g08_two(spark, sf):
    p = channels(grid10(spark, sf))
    return sk.skeleton(p.select(*_VARS), list(_VARS), max_set=1).select("a", "b", rnd("corr").alias("corr"))


@query("g08_skeleton")
def g08(spark, sf):
    p = channels(grid10(spark, sf))
    return sk.skeleton(p.select(*_VARS), list(_VARS)).withColumn("corr", rnd("corr"))


@query(
    "g09_chi_square",
    with_(
        BARS, "b AS (SELECT close AS x, turnover AS y FROM bars)", "q AS (SELECT quantile_cont(x, 1 / 3.0) AS x1, quantile_cont(x, 2 / 3.0) AS x2, quantile_cont(y, 1 / 3.0) AS y1, quantile_cont(y, 2 / 3.0) AS y2 FROM b)",
        "c AS (SELECT (x >= x1)::INT + (x >= x2)::INT AS i, (y >= y1)::INT + (y >= y2)::INT AS j, count(*) AS o FROM b, q GROUP BY 1, 2)",
        "g AS (SELECT a.i, d.j, a.r * d.c / (SELECT sum(o) FROM c) AS e FROM (SELECT i, sum(o) AS r FROM c GROUP BY i) a, (SELECT j, sum(o) AS c FROM c GROUP BY j) d)",
        "s AS (SELECT sum((coalesce(o, 0) - e) ^ 2 / e) AS v FROM g LEFT JOIN c USING (i, j))",
        select=f"SELECT {r('v', 5)} AS statistic, CAST((SELECT sum(o) FROM c) AS BIGINT) AS n, {r('exp(-v / 2) * (1 + v / 2)')} AS p_value FROM s",
    ),
)
def g09(spark, sf):
    out = gr.chi_square(t.bars(spark, sf), "close", "turnover")
    return out.select(rnd("statistic", 5).alias("statistic"), "n", rnd("p_value").alias("p_value"))


# ---- networks --------------------------------------------------------------------------------------------------


def _network(spark, sf):
    return nw.rolling_network(rets10(spark, sf).select("sym", "bar_idx", "ret"), list(range(10)))


@query("w37_rolling_network")
def w37(spark, sf):
    return _network(spark, sf).select("bar_idx", "sym", *[rnd(c).alias(c) for c in (*nw.NODE_STATS, *nw.GLOBAL_STATS)])


# three names have closed forms: cofactors for the inverse, roots of a cubic and a quadratic for the spectra
_NET3 = (
    BARS10.replace("% 10", "% 3"), CAL, GRID10,
    f"rt AS (SELECT sym, bar_idx, close / {lag('close', order='bar_idx')} - 1 AS ret FROM dense)",
    "rr AS (SELECT bar_idx, " + ", ".join(f"coalesce(sum(ret) FILTER (WHERE sym = {i}), 0) AS {c}" for i, c in enumerate("xyz")) + " FROM rt GROUP BY bar_idx)",
    "wn AS (SELECT a.bar_idx AS k, " + ", ".join(f"b.{c} - avg(b.{c}) OVER (PARTITION BY a.bar_idx) AS {c}" for c in "xyz")
    + " FROM rr a JOIN rr b ON b.bar_idx BETWEEN a.bar_idx - 60 AND a.bar_idx - 1 WHERE a.bar_idx >= 60)",
    "sm AS (SELECT k, " + ", ".join(f"sum({c[0]} * {c[1]}) / 59 AS {c}" for c in ("xx", "yy", "zz", "xy", "xz", "yz")) + ", sum((x * x + y * y + z * z) ^ 2) AS q FROM wn GROUP BY k)",
    "mu AS (SELECT *, (xx + yy + zz) / 3 AS mu, xx * xx + yy * yy + zz * zz + 2 * (xy * xy + xz * xz + yz * yz) AS ss FROM sm)",
    "gp AS (SELECT *, (xx - mu) ^ 2 + (yy - mu) ^ 2 + (zz - mu) ^ 2 + 2 * (xy * xy + xz * xz + yz * yz) AS gap FROM mu)",
    "sr AS (SELECT *, CASE WHEN gap <= 1e-18 THEN 0 ELSE greatest(least((q - 58 * ss) / 3600 / gap, 1), 0) END AS s FROM gp)",
    "cv AS (SELECT k, " + ", ".join(f"(1 - s) * {c} + s * mu + 1e-10 * mu AS {c}" for c in ("xx", "yy", "zz")) + ", " + ", ".join(f"(1 - s) * {c} AS {c}" for c in ("xy", "xz", "yz")) + " FROM sr)",
    """pc AS (SELECT k, abs(xy * zz - xz * yz) / sqrt((yy * zz - yz * yz) * (xx * zz - xz * xz)) AS p, abs(xz * yy - xy * yz) / sqrt((yy * zz - yz * yz) * (xx * yy - xy * xy)) AS q,
      abs(yz * xx - xy * xz) / sqrt((xx * zz - xz * xz) * (xx * yy - xy * xy)) AS r FROM cv)""",
    "ed AS (SELECT k, " + ", ".join(f"CASE WHEN {u} < 0.05 THEN 0.0 ELSE {u} END AS {c}" for u, c in zip("pqr", "abc", strict=True)) + ", (p + q + r) / 3 AS m FROM pc)",
    "sp AS (SELECT *, a + b + c AS s, sqrt(greatest(a * a + b * b + c * c - a * b - a * c - b * c, 0)) AS d, a * a + b * b + c * c AS e FROM ed)",
    """gl AS (SELECT *, s - d AS fiedler, CASE WHEN e = 0 THEN 0.0 ELSE 2 * sqrt(e / 3) * cos(acos(least(3 * a * b * c / e * sqrt(3 / e), 1)) / 3) END AS radius,
      CASE WHEN s - d > 2e-12 * s THEN -(s - d) / (2 * s) * ln((s - d) / (2 * s)) ELSE 0.0 END + CASE WHEN s > 0 THEN -(s + d) / (2 * s) * ln((s + d) / (2 * s)) ELSE 0.0 END AS entropy,
      ((a > 0)::INT + (b > 0)::INT + (c > 0)::INT) / 3 AS density FROM sp)""",
    "nd AS (" + " UNION ALL ".join(
        f"SELECT k, {i}::BIGINT AS sym, {u} + {v} AS strength, CASE WHEN {u} > 0 AND {v} > 0 THEN cbrt(a * b * c) / greatest(a, b, c) ELSE 0.0 END AS clustering, "
        f"CASE WHEN {u} + {v} > 0 THEN 1 - ({u} * {u} + {v} * {v}) / ({u} + {v}) ^ 2 ELSE 0.0 END AS participation, fiedler, radius, m, entropy, density FROM gl"
        for i, (u, v) in enumerate((("a", "b"), ("a", "c"), ("b", "c")))) + ")",
)


@query(
    "w37_network_of_three",
    with_(
        *_NET3,
        select="SELECT CAST(k AS INTEGER) AS bar_idx, sym, " + ", ".join(f"{r(e, 5)} AS {c}" for c, e in (
            ("strength", "strength"), ("clustering", "clustering"), ("participation", "participation"), ("fiedler", "fiedler"), ("spectral_radius", "radius"),
            ("mean_abs_pcorr", "m"), ("entropy", "entropy"), ("density", "density"))) + " FROM nd",
    ),
)
def w37_three(spark, sf):
    """The rolling network over three baskets of all suppliers, where every statistic has a closed form."""
    panel = t.saved_bars(spark, sf, 3)
    grid = al.forward_fill(t.dense_panel(panel, t.calendar(panel)), "close", "close")
    rets = technical.returns(grid.select("sym", "dt", "bar_idx", "close")).select("sym", "bar_idx", "ret")
    out = nw.rolling_network(rets, [0, 1, 2])
    return out.select("bar_idx", "sym", *[rnd(c, 5).alias(c) for c in (*nw.NODE_STATS, *nw.GLOBAL_STATS) if c != "centrality"])


@query("w38_heart_stability")
def w38(spark, sf):
    return nw.heart_stability(_network(spark, sf)).withColumn("consistency", rnd("consistency"))


@query(
    "w39_node_features",
    with_(
        BARS, f"x AS (SELECT sym, dt, close / {lag('close')} - 1 AS ret FROM bars)", "k AS (SELECT sym, ret, row_number() OVER (PARTITION BY sym ORDER BY dt DESC) AS k FROM x WHERE ret IS NOT NULL)",
        "l AS (SELECT *, max(k) OVER (PARTITION BY sym) AS n FROM k WHERE k <= 20)",
        select=f"SELECT sym, {r('stddev_pop(ret)')} AS vol, {r('avg(ret) FILTER (WHERE k <= 5) - avg(ret) FILTER (WHERE k > n - 5)')} AS momentum FROM l GROUP BY sym",
    ),
)
def w39(spark, sf):
    x = technical.returns(t.bars(spark, sf)).where(F.col("ret").isNotNull())
    return nw.node_features(x).select("sym", rnd("vol").alias("vol"), rnd("momentum").alias("momentum"))


_ADJ = f"x AS (SELECT sym, dt, close / {lag('close')} - 1 AS ret FROM bars)"


@query("w39_adjacency", with_(BARS10, _ADJ, select=f"SELECT a.sym AS a, b.sym AS b, {r('abs(corr(a.ret, b.ret))')} AS strength FROM x a JOIN x b ON a.dt = b.dt AND a.sym < b.sym WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2 HAVING abs(corr(a.ret, b.ret)) > 0.01"))
def w39b(spark, sf):
    x = technical.returns(t.bars(spark, sf, books=10)).select("sym", "dt", "ret")
    c = ql.pair_correlations(x, list(range(10))).where(F.abs("corr") > 0.01)
    return c.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), rnd(F.abs("corr")).alias("strength"))


# ---- rule strategies ----------------------------------------------------------------------------------------------


def strategy_bars(spark, sf):
    """Bars with channels, price, volatility and next return, numbered from 0 after the warm-up."""
    p = channels(grid10(spark, sf))
    w = by_sym(order="bar_idx")
    r_ = F.col("close") / F.lag("close").over(w) - 1
    p = p.withColumns({"_r": r_, "ahead": F.lead("close").over(w) / F.col("close") - 1})
    w20 = w.rowsBetween(-19, 0)
    p = p.withColumn("vol", F.when(F.count("_r").over(w20) == 20, F.stddev_samp("_r").over(w20)) * math.sqrt(252))
    p = p.where(F.col("bar_idx") >= 60).withColumn("bar_idx", (F.col("bar_idx") - 60).cast("int"))
    # read for its bars and for its keys
    return durable(p.select("sym", "bar_idx", "close", "vol", "ahead", F.array(*FEATS).alias("x")), "strategy-bars")


def _span_sql(span, k):
    return f"{span[0]} + {span[1] - span[0]} * {_u('g', 's', str(k))}"


_N17 = 200
_STRATEGIES = f"""sw AS (SELECT s AS strategy, [{', '.join(_u('g', 's', str(k)) for k in range(len(FEATS)))}] AS u,
  [{', '.join(_u('g', 's', str(100 + k)) + ' * 0.5' for k in range(len(FEATS)))}] AS e, [{', '.join(_u('g', 's', str(200 + k)) + ' * 0.5' for k in range(len(FEATS)))}] AS o,
  round_even({_span_sql(xs.HOLD_DAYS, 300)}, 0) AS hold, {_span_sql(xs.TRAILING_STOP, 301)} AS stop, {_span_sql(xs.KELLY_SHARE, 302)} AS share,
  {_span_sql(xs.CONVICTION, 303)} AS conviction, {_span_sql(xs.VOL_TARGET, 304)} AS target FROM (SELECT CAST(unnest(range(0, {_N17})) AS INTEGER) AS s)),
sg AS (SELECT * EXCLUDE (u), list_transform(u, lambda x: x / list_sum(u)) AS k FROM sw)"""
# all strategies walk bar by bar; the state is one row per strategy and symbol
_WALK17 = (
    *AUDIT_SQL[:7],
    f"""cb AS (SELECT sym, bar_idx - 60 AS b, close AS px, ahead, vol, [mom_z, vol_z, range_z, volume_z] AS x, row_number() OVER (PARTITION BY sym ORDER BY bar_idx) AS n FROM (
      SELECT *, {lead('close', order='bar_idx')} / close - 1 AS ahead, {roll('stddev_samp', 'r0', 20, order='bar_idx')} * sqrt(252) AS vol FROM feats) WHERE bar_idx >= 60)""",
    _STRATEGIES,
    """walk AS (
      SELECT strategy, sym, 0::BIGINT AS n, 0.0::DOUBLE AS pos, 0.0::DOUBLE AS best, 0 AS age, 0.0::DOUBLE AS was, -1::BIGINT AS b, 0.0::DOUBLE AS ahead FROM sg CROSS JOIN (SELECT DISTINCT sym FROM cb)
      UNION ALL
      SELECT strategy, sym, n, CASE WHEN enter THEN size ELSE kept END, CASE WHEN enter THEN px ELSE best END, CASE WHEN enter THEN 0 ELSE age END, pos, b, ahead
      FROM (SELECT *, kept = 0 AND score > conviction AS enter, least(score * share * CASE WHEN target > 0 THEN least(target / CASE WHEN vol > 1e-6 THEN vol ELSE target END, 3) ELSE 1 END, 0.1) AS size
        FROM (SELECT *, CASE WHEN pos > 0 AND ((best > 0 AND (best - px) / best > stop) OR age >= hold) THEN 0 ELSE pos END AS kept
          FROM (SELECT g.* EXCLUDE (k, e, o), c.sym, c.n, c.b, c.px, c.ahead, c.vol, w.pos, CASE WHEN w.pos > 0 THEN greatest(w.best, c.px) ELSE w.best END AS best, w.age + (w.pos > 0)::INT AS age,
              greatest(list_sum([g.k[i] * ((c.x[i] > g.e[i])::INT - (c.x[i] < -g.o[i])::INT) FOR i IN [1, 2, 3, 4]]), 0) AS score
            FROM walk w JOIN cb c ON c.sym = w.sym AND c.n = w.n + 1 JOIN sg g ON g.strategy = w.strategy))))""",
    """days AS (SELECT strategy, b AS dt, sum(pos * coalesce(ahead, 0)) - sum(abs(pos - was)) * 22.0 / 20000 AS ret, sum(abs(pos - was)) AS turnover,
      sum(CASE WHEN pos <> 0 AND pos <> was THEN 1 ELSE 0 END) AS trades FROM walk WHERE b >= 0 GROUP BY 1, 2)""",
    *STRAT_DAYS[-4:],
)
_STATS17 = {"sharpe": "sharpe", "max_drawdown": "-max_drawdown", "win_rate": "win_rate", "profit_factor": "profit_factor", "avg_turnover": "avg_turnover"}


@query(
    "d17_rule_backtest",
    with_(
        *_WALK17,
        select="SELECT strategy, CAST(n_trades AS BIGINT) AS n_trades, " + ", ".join(f"CASE WHEN n_trades = 0 THEN 0.0 ELSE {r(e)} END AS {c}" for c, e in _STATS17.items())
        + f", CASE WHEN n_trades = 0 THEN -0.05 ELSE {r('fitness')} END AS fitness FROM fit",
    ),
)
def d17(spark, sf):
    """Two hundred hashed strategies over all bars."""
    days = sg.strategy_days(strategy_bars(spark, sf), rules.random_strategies(spark, _N17, len(FEATS)))
    stats = sg.strategy_scores(days)
    return stats.select("strategy", "n_trades", *[rnd(c).alias(c) for c in (*_STATS17, "fitness")])


@query("d18_strategy_sweep")
def d18(spark, sf):
    """A thousand strategies in every walk-forward window, and what remains after as many trials."""
    bars = strategy_bars(spark, sf)
    n = bars.agg((F.max("bar_idx") + 1).alias("n_bars"))
    placed = assign_windows(bars.join(F.broadcast(n), how="cross"), F.col("n_bars"), 504, 252).drop("n_bars")
    out = sg.sweep(placed, rules.random_strategies(spark, 1000, len(FEATS)))
    return out.select("w", "strategy", *[rnd(c).alias(c) for c in ("in_sample", "out_sample", "gap")], "trades", "total_trials", rnd("deflated").alias("deflated"))


_FEES = (costs.BROKERAGE + costs.EXCHANGE_FEE + costs.REGULATOR_FEE) * (1 + costs.SERVICE_TAX)
# four accounts walk session by session; a session's names are a list, largest weights bought first
_CAPITAL = (
    *STRAT_DAYS[:6],
    f"ah AS (SELECT sym, bar_idx, close, coalesce(({lead('close', order='bar_idx')} / close - 1) / 2000, 0) AS r FROM dense)",
    "dy AS MATERIALIZED (SELECT bar_idx, row_number() OVER (ORDER BY bar_idx) AS n, list({'s': sym, 'w': weight, 'px': close, 'r': r} ORDER BY sym) AS d FROM wt JOIN ah USING (sym, bar_idx) WHERE strategy = 'momentum' GROUP BY bar_idx)",
    f"""acc AS (
      SELECT unnest([1, 2, 3, 4])::BIGINT AS account, 0::BIGINT AS n, 100000.0::DOUBLE AS equity, list_transform(range(0, 10), lambda x: 0.0::DOUBLE) AS held, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS error, 0.0::DOUBLE AS untradeable
      UNION ALL
      SELECT account, n, equity + pnl - cost, list_transform(range(0, 10), lambda s: list_sum(list_transform(d, lambda x, i: CASE WHEN x.s = s THEN kept[i] ELSE 0.0 END))), cost, error, untradeable
      FROM (SELECT *, list_sum(list_transform(d, lambda x, i: abs((kept[i] - held[x.s + 1]) * x.px) * CASE WHEN kept[i] > held[x.s + 1] THEN {costs.TRANSACTION_TAX_BUY + costs.STAMP_DUTY_BUY + _FEES}::DOUBLE ELSE {costs.TRANSACTION_TAX_SELL + _FEES}::DOUBLE END)) AS cost,
          list_sum(list_transform(d, lambda x, i: kept[i] * x.px * x.r)) AS pnl,
          CASE WHEN equity > 0 THEN list_sum(list_transform(d, lambda x, i: abs(x.w - kept[i] * x.px / equity))) ELSE 0.0 END AS error,
          list_sum(list_transform(d, lambda x, i: CASE WHEN abs(x.w) > 1e-9 AND kept[i] = 0 THEN 1.0 ELSE 0.0 END)) AS untradeable
        FROM (SELECT *, list_transform(d, lambda x, i: CASE WHEN list_contains(fits, i) THEN x.want ELSE 0.0 END) AS kept
          FROM (SELECT *, list_transform(list_filter(list_transform(o, lambda y, p: {{'j': y.j, 'run': list_sum(list_transform(o[1:p], lambda t: t.v))}}), lambda y: y.run <= equity), lambda y: y.j) AS fits
            FROM (SELECT *, list_sort(list_transform(d, lambda x, i: {{'z': (x.want = 0)::INT, 'k': -abs(x.w), 'm': -i, 'v': abs(x.want * x.px), 'j': i}})) AS o
              FROM (SELECT * REPLACE (list_transform(d, lambda x: {{'s': x.s, 'w': x.w, 'px': x.px, 'r': x.r, 'want': trunc(CASE WHEN x.px > 0 THEN x.w * equity / greatest(x.px, 1e-12) ELSE 0 END)}}) AS d)
                FROM (SELECT a.account, y.n, a.equity, a.held, list_transform(y.d, lambda x: {{'s': x.s, 'w': least(greatest(x.w * a.account / 4, 0.0), 0.25), 'px': x.px, 'r': x.r}}) AS d FROM acc a JOIN dy y ON y.n = a.n + 1)))))))""",
)


@query(
    "d24_capital_paths",
    with_(
        *_CAPITAL,
        select=f"SELECT account, {r('ln(greatest(max_by(equity, n), 1e-9))', 4)} AS log_equity, {r('sum(cost)', 2)} AS total_cost, {r('avg(error)')} AS quantisation, {r('avg(untradeable)')} AS untradeable, CAST(count(*) AS BIGINT) AS sessions FROM acc WHERE n > 0 GROUP BY account",
    ),
)
def d24(spark, sf):
    """Four accounts over all sessions. Baskets of unrelated fills jump; a two-thousandth of their moves keeps equity of one size."""
    x = xs.momentum_weights(rets10(spark, sf).select("sym", "dt", "bar_idx", "close"), 20)
    ahead = (F.lead("close").over(by_sym()) / F.col("close") - 1) / 2000
    rows = x.select("bar_idx", "sym", "weight", F.col("close").alias("price"), ahead.alias("ret"))
    rows = rows.withColumn("account", F.explode(F.array(*[F.lit(a).cast("bigint") for a in (1, 2, 3, 4)])))
    rows = rows.withColumn("weight", F.col("weight") * F.col("account") / 4)
    out = rules.capital_paths(rows)
    return out.groupBy("account").agg(
        rnd(F.ln(F.greatest(F.max_by("equity", "bar_idx"), F.lit(1e-9))), 4).alias("log_equity"), rnd(F.sum("cost"), 2).alias("total_cost"),
        rnd(F.avg("quantisation")).alias("quantisation"), rnd(F.avg("untradeable")).alias("untradeable"), F.count(F.lit(1)).alias("sessions"),
    )


# ---- user-supplied pieces ------------------------------------------------------------------------------------


@query(
    "x01_user_strategy",
    with_(
        *_GRID, f"gx AS (SELECT sym, bar_idx, coalesce(close / {lag('close', order='bar_idx')} - 1, 0) AS ret FROM g10)",
        "al AS (SELECT s.sym, c.bar_idx, coalesce(g.ret, 0) AS ret FROM (SELECT DISTINCT sym FROM g10) s CROSS JOIN cal c LEFT JOIN gx g ON g.sym = s.sym AND g.bar_idx = c.bar_idx)",
        "sg AS (SELECT sym, bar_idx, sign(avg(ret) OVER (PARTITION BY sym ORDER BY bar_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) AS s FROM al)",
        "ww AS (SELECT sym, bar_idx, least(greatest(s / greatest(sum(abs(s)) OVER (PARTITION BY bar_idx), 1), -0.25), 0.25) AS weight FROM sg)",
        select=f"SELECT CAST((bar_idx - 252) // 63 AS INTEGER) AS w, bar_idx, sym, {r('weight')} AS weight FROM ww WHERE bar_idx >= 252 AND (bar_idx - 252) // 63 <= ((SELECT count(*) FROM cal) - 254) // 63",
    ),
)
def x01(spark, sf):
    from barline.operators.plugins import run_strategy

    out = run_strategy(rets10(spark, sf).select("sym", "bar_idx", "ret"), "trend", list(range(10)), 252, 63)
    return out.withColumn("weight", rnd("weight"))


@query(
    "x05_name_pairs",
    "SELECT a.n_regionkey AS region, a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name",
)
def x05(spark, sf):
    from barline.operators.plugins import NamePairs

    # a region's nations are a short stated list
    lists = t.table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.collect_list("n_name").alias("names"))
    spark.udtf.register("name_pairs", NamePairs)
    return spark.sql("SELECT l.region, p.a, p.b FROM {lists} l, LATERAL name_pairs(l.names) p", lists=lists)


@query(
    "x02_source_registry",
    """WITH s AS (SELECT CAST(l_suppkey AS BIGINT) AS sym, CAST(l_shipdate AS DATE) AS dt, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS priority, max(l_extendedprice / l_quantity) AS close FROM lineitem GROUP BY 1, 2, 3)
    SELECT sym, dt, priority, round(close, 8) AS close FROM s QUALIFY row_number() OVER (PARTITION BY sym, dt ORDER BY priority) = 1""",
)
def x02(spark, sf):
    from barline.operators import plugins

    many = t.table(spark, sf, "lineitem").count()

    def reader(status):
        def read(session, symbols):
            rows = t.fills(session, sf, extra=("l_linestatus",)).where(F.col("l_linestatus") == status)
            rows = rows.where(F.col("sym").isin(symbols)) if symbols else rows
            # cells hold few fills: they are dealt as they are, in shares that do not grow with the table
            return dealt(rows.select("sym", "dt", "px"), many, "sym", "dt").groupBy("sym", "dt").agg(F.max("px").alias("close"))

        return read

    for name, status in (("final", "F"), ("open", "O")):
        plugins.source(name, reader(status))
    both = plugins.read_sources(spark, ["final", "open"], [])
    return ql.first_source(both, "priority", ["close"]).withColumn("close", rnd("close", 8))


@query(
    "x03_feature_builders",
    with_(
        BARS, "b AS (SELECT sym, dt, close, avg(close) OVER w AS a, stddev_samp(close) OVER w AS s, count(close) OVER w AS n FROM bars WINDOW w AS (PARTITION BY sym ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))",
        select=f"SELECT sym, dt, {r('close / ' + lag('close') + ' - 1')} AS ret, {r('CASE WHEN n >= 20 THEN (close - a) / nullif(2 * s, 0) END')} AS boll_pos FROM b",
    ),
)
def x03(spark, sf):
    from barline.operators import plugins

    plugins.builder("returns", technical.returns)
    plugins.builder("bollinger", technical.bollinger)
    out = plugins.build_features(t.bars(spark, sf), ["returns", "bollinger"])
    return out.select("sym", "dt", rnd("ret").alias("ret"), rnd("boll_pos").alias("boll_pos"))


@query("x04_loss_argument", with_(*[x for x in _KELLY[:3]], select=f"SELECT sym, {r('ln(avg(pow(abs(pred - actual), 1.5)))')} AS log_loss FROM pa GROUP BY sym"))
def x04(spark, sf):
    from barline.operators import plugins

    out = plugins.mean_loss(calls(spark, sf), lambda p, y: F.pow(F.abs(p - y), F.lit(1.5)), "sym", target="actual")
    return out.select("sym", rnd(F.ln("loss")).alias("log_loss"))
