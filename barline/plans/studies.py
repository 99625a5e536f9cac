"""Dependence audits, permutation nulls and walk-forward studies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barline.functions.cols import by_sym, change, expanding_z, rnd, squash
from barline.operators import alignment as al, dependence as dp, metrics as mx, permute as pm, targets as tg, technical, walkforward as wf
from barline.operators.ordering import window_rank
from barline.plans.ansi import BARS, BARS10, CAL, lag, lead, over, pct_rank, r, roll, with_, z
from barline.plans.metrics import GRID10
from barline.plans.registry import query
from barline.session import durable
from barline.plans.targets import PAIR_BASE, PAIR_SQL, pair_panel, targets_sql
from barline.sources import tables as t

FEATS = ("mom_z", "vol_z", "range_z", "volume_z")


def grid10(spark, sf):
    """Ten baskets on their live grid, closes carried over gaps."""
    panel = t.saved_bars(spark, sf, 10)
    d = t.dense_panel(panel, t.calendar(panel))
    d = al.forward_fill(d, "close", "close")
    return d.select("sym", "dt", "bar_idx", "close", F.coalesce("volume", F.lit(0.0)).alias("volume"))


def channels(panel, *extra):
    """Four causal channels, squashed; undefined is 0."""
    key = dict(sym="sym", order="bar_idx")
    base = panel.withColumn("_r", change("close", 1, *extra, **key))
    w20 = by_sym(*extra, **key).rowsBetween(-19, 0)
    base = base.withColumns(
        {
            "_mom": change("close", 5, *extra, **key),
            "_vol": F.when(F.count("_r").over(w20) == 20, F.stddev_samp("_r").over(w20)),
            "_rng": F.max("close").over(w20) / F.min("close").over(w20) - 1,
            "_vlm": F.log1p("volume"),
        }
    )
    named = {"mom_z": "_mom", "vol_z": "_vol", "range_z": "_rng", "volume_z": "_vlm"}
    out = {}
    for n, c in named.items():
        w = by_sym(*extra, **key).rowsBetween(Window.unboundedPreceding, 0)
        z_ = F.when(F.count(c).over(w) >= 20, F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_samp(c).over(w)))
        out[n] = F.coalesce(F.tanh(z_ / 2), F.lit(0.0))
    return base.withColumns(out).drop("_r", "_mom", "_vol", "_rng", "_vlm")


def channels_sql(src, part):
    o = dict(part=part, order="bar_idx")
    raw = f"""f0 AS (SELECT *, close / {lag('close', **o)} - 1 AS r0 FROM {src}), f1 AS (SELECT *, close / {lag('close', 5, **o)} - 1 AS x_mom, {roll('stddev_samp', 'r0', 20, **o)} AS x_vol,
      max(close) {over(20, **o)} / min(close) {over(20, **o)} - 1 AS x_rng, ln(1 + volume) AS x_vlm FROM f0)"""
    named = {"mom_z": "x_mom", "vol_z": "x_vol", "range_z": "x_rng", "volume_z": "x_vlm"}
    return raw, "feats AS (SELECT *, " + ", ".join(f"coalesce(tanh({z(c, None, 20, **o)} / 2), 0.0) AS {n}" for n, c in named.items()) + " FROM f1)"


_GRID = (BARS10, CAL, GRID10, "g10 AS (SELECT sym, dt, bar_idx, close, coalesce(volume, 0.0) AS volume FROM dense)")
_T_SQL = tuple(x.replace("PARTITION BY sym ORDER BY dt", "PARTITION BY draw, sym ORDER BY bar_idx") for x in targets_sql("feats", "draw, sym", "draw, bar_idx"))
_T_SQL = tuple(x.replace("PARTITION BY draw, sym ORDER BY dt", "PARTITION BY draw, sym ORDER BY bar_idx") for x in _T_SQL)
# equal cells must stay equal when ranked, so study values are rounded
_ROUNDED = ", ".join(f"round({c}, 10) AS {c}" for c in (*FEATS, *tg.TARGETS, *(f"base_{n}" for n in tg.TARGETS)))
_T_SQL = (*(x.replace("tgt AS (", "tgu AS (", 1) for x in _T_SQL), f"tgt AS (SELECT * REPLACE ({_ROUNDED}) FROM tgu)")
AUDIT_SQL = (*_GRID, "gd AS (SELECT 0 AS draw, * FROM g10)", *channels_sql("gd", "draw, sym"), *_T_SQL)


def rounded(panel):
    return panel.withColumns({c: F.round(c, 10) for c in (*FEATS, *tg.TARGETS, *(f"base_{n}" for n in tg.TARGETS))})


def audit_panel(spark, sf):
    # the panel is read by several aggregates below; its windows run once
    p = durable(channels(grid10(spark, sf)), "channels")
    return durable(rounded(tg.baselines(tg.targets(p))), "audit-panel")


# ---- flagship: which causal channel ranks with which forward target ----------------------------------------

_RK = "rk AS (" + " UNION ALL ".join(
    f"SELECT sym, dt, '{f}' AS feature, '{n}' AS target, {f} AS x, {n} AS y, base_{n} AS b FROM (SELECT *, count({n}) OVER (PARTITION BY dt) AS k FROM tgt) WHERE k = 10" for f in FEATS for n in tg.TARGETS
) + ")"
_RK2 = "rk2 AS (SELECT feature, target, sym, dt, " + ", ".join(f"{pct_rank(c, 'feature, target, sym', percent=False)} AS {n}" for c, n in (("x", "rx"), ("y", "ry"), ("b", "rb"))) + " FROM rk)"
_OBS = "ob AS (SELECT feature, target, count(*) AS n, corr(rx, ry) AS raw, corr(rx, rb) AS fb, corr(ry, rb) AS tb FROM rk2 GROUP BY 1, 2)"


@query(
    "feature_relevance",
    with_(*AUDIT_SQL, _RK, _RK2, _OBS, select=f"SELECT feature, target, CAST(n AS BIGINT) AS n, {r('raw')} AS spearman, {r('(raw - tb * fb) / sqrt(1 - tb * tb)')} AS spearman_incremental FROM ob"),
)
def feature_relevance(spark, sf):
    rows = dp.audit_rows(audit_panel(spark, sf), FEATS, tg.TARGETS)
    out = dp.audit_correlations(dp.audit_sums(rows, FEATS, 0))
    return out.select("feature", "target", F.col("n").cast("bigint").alias("n"), rnd("spearman").alias("spearman"), rnd("incremental").alias("spearman_incremental"))


_DRAWS = 5
_ORD = """ord AS (SELECT draw, CAST(p0 + o AS INTEGER) AS new_idx, CAST(blk * 21 + o AS INTEGER) AS old_idx FROM (
  SELECT draw, blk, len, sum(len) OVER (PARTITION BY draw ORDER BY md5('{seed}-' || draw || '-' || blk), blk) - len AS p0
  FROM (SELECT d AS draw, b AS blk, least(21, n - b * 21) AS len FROM (SELECT {n} AS n), range(1, {draws} + 1) t(d), range(0, 1000) u(b) WHERE b * 21 < n)), range(0, 21) v(o) WHERE o < len)"""


@query(
    "d01_audit_null",
    with_(
        *AUDIT_SQL, _RK, _RK2, _OBS,
        "days AS (SELECT target, dt, row_number() OVER (PARTITION BY target ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY target) AS n FROM (SELECT DISTINCT target, dt FROM rk2))",
        "num AS (SELECT r.*, d.i, d.n AS nn FROM rk2 r JOIN days d USING (target, dt))",
        "ordt AS (SELECT draw, nn, CAST(p0 + o AS BIGINT) AS new_idx, blk * 21 + o AS old_idx FROM (SELECT draw, nn, blk, len, sum(len) OVER (PARTITION BY draw, nn ORDER BY md5('p-' || draw || '-' || blk), blk) - len AS p0 FROM (SELECT d AS draw, n AS nn, b AS blk, least(21, n - b * 21) AS len FROM (SELECT DISTINCT n FROM days), range(1, 6) t(d), range(0, 1000) u(b) WHERE b * 21 < n)), range(0, 21) v(o) WHERE o < len)",
        "mv0 AS MATERIALIZED (SELECT o.draw, o.old_idx, f.feature, f.target, f.sym, f.rx, f.rb FROM num f JOIN ordt o ON o.nn = f.nn AND o.new_idx = f.i)",
        "mv AS (SELECT f.draw, f.feature, f.target, f.rx, f.rb, y.ry FROM mv0 f JOIN num y ON y.feature = f.feature AND y.target = f.target AND y.sym = f.sym AND y.i = f.old_idx)",
        "nl AS (SELECT draw, feature, target, corr(rx, ry) AS raw, corr(rx, rb) AS fb, corr(ry, rb) AS tb FROM mv GROUP BY 1, 2, 3)",
        select=f"SELECT CAST(draw AS INTEGER) AS draw, feature, target, {r('raw')} AS spearman, {r('(raw - tb * fb) / sqrt(1 - tb * tb)')} AS incremental FROM nl",
    ),
)
def d01_null(spark, sf):
    rows = dp.audit_rows(audit_panel(spark, sf), FEATS, tg.TARGETS)
    out = dp.audit_correlations(dp.audit_sums(rows, FEATS, _DRAWS)).where(F.col("draw") > 0)
    return out.select("draw", "feature", "target", rnd("spearman").alias("spearman"), rnd("incremental").alias("incremental"))


@query("d01_feature_audit")
def d01(spark, sf):
    """The whole audit: 2,000 block permutations, false-discovery control, market-wide channels apart."""
    p = audit_panel(spark, sf)
    tone = p.groupBy("dt").agg(F.avg("mom_z").alias("market_tone"))
    out = dp.feature_audit(p.join(tone, "dt"), (*FEATS, "market_tone"), tg.TARGETS, draws=2000)
    return out.select("feature", "target", "market_level", rnd("spearman").alias("spearman"), rnd("spearman_incremental").alias("spearman_incremental"), "p_value", "p_incremental", rnd("q").alias("q"), "significant", "n_blocks")


def _pairs_long(p, feats, names):
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(n).alias("target"), F.col(f).alias("x"), F.col(n).alias("y")) for f in feats for n in names])
    rows = p.select("sym", "dt", F.explode(cells).alias("c")).select("sym", "dt", "c.*")
    return rows.where(F.col("x").isNotNull() & F.col("y").isNotNull())


# distance correlation of (key.., x, y) rows in `dc0`: row sums by order, products of distances by all pairs of rows
_DC = """rw AS (SELECT {key}, x, y, (x * (2 * row_number() OVER wx - 2 - count(*) OVER w) - 2 * (sum(x) OVER wx - x) + sum(x) OVER w) / count(*) OVER w AS mx,
  (y * (2 * row_number() OVER wy - 2 - count(*) OVER w) - 2 * (sum(y) OVER wy - y) + sum(y) OVER w) / count(*) OVER w AS my FROM dc0
  WINDOW w AS (PARTITION BY {key}), wx AS (PARTITION BY {key} ORDER BY x ROWS UNBOUNDED PRECEDING), wy AS (PARTITION BY {key} ORDER BY y ROWS UNBOUNDED PRECEDING)),
gm AS (SELECT {key}, count(*) AS n, avg(mx) AS gx, avg(my) AS gy, avg(mx * my) AS mxy, avg(mx * mx) AS mxx, avg(my * my) AS myy,
  2 * var_pop(x) AS sxx, 2 * var_pop(y) AS syy FROM rw GROUP BY {key}),
pr AS (SELECT {key}, sum(abs(a.x - b.x) * abs(a.y - b.y)) AS xy FROM dc0 a JOIN dc0 b USING ({key}) GROUP BY {key}),
dcor AS (SELECT *, sqrt(greatest(xy / n / n - 2 * mxy + gx * gy, 0) / sqrt((sxx - 2 * mxx + gx * gx) * (syy - 2 * myy + gy * gy))) AS dcor FROM gm JOIN pr USING ({key}))"""
_PAIRS = "pairs AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, '{n}' AS target, sym, dt, {f} AS x, {n} AS y FROM tgt WHERE {n} IS NOT NULL" for f in FEATS for n in tg.TARGETS) + ")"
_DC0 = "dc0 AS (SELECT feature, target, sym, x, y FROM pairs)"


@query(
    "d02_distance_correlation",
    with_(*AUDIT_SQL, _PAIRS, _DC0, _DC.format(key="feature, target, sym"), select=f"SELECT feature, target, sym, CAST(n AS BIGINT) AS n, {r('dcor')} AS dcor FROM dcor"),
)
def d02(spark, sf):
    rows = _pairs_long(audit_panel(spark, sf), FEATS, tg.TARGETS)
    return dp.distance_correlation(rows, ["feature", "target", "sym"]).select("feature", "target", "sym", "n", rnd("dcor").alias("dcor"))


@query(
    "d05_kruskal_bins",
    with_(
        *AUDIT_SQL,
        "k0 AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, sym, dt, {f} AS x, vol_5d AS y FROM tgt WHERE vol_5d IS NOT NULL" for f in FEATS) + ")",
        "kq AS (SELECT feature, sym, quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS c, count(*) AS n FROM k0 GROUP BY 1, 2)",
        "k1 AS (SELECT feature, sym, n, len([q FOR q IN c IF q <= x]) AS g, row_number() OVER (PARTITION BY feature, sym ORDER BY y, dt) AS rk FROM k0 JOIN kq USING (feature, sym))",
        "k2 AS (SELECT feature, sym, n, g, count(*) AS k, avg(rk) AS m FROM k1 GROUP BY ALL)",
        select=f"SELECT feature, sym, CAST(n AS BIGINT) AS n, {r('CASE WHEN count(*) = 5 THEN 12 / (n * (n + 1)) * sum(k * (m - (n + 1) / 2) ^ 2) ELSE 0 END')} AS kruskal FROM k2 GROUP BY feature, sym, n",
    ),
)
def d05(spark, sf):
    rows = _pairs_long(audit_panel(spark, sf), FEATS, ("vol_5d",))
    return dp.kruskal_bins(rows, ["feature", "sym"]).select("feature", "sym", "n", rnd("kruskal").alias("kruskal"))


@query(
    "d06_nonlinear_scores",
    with_(
        *AUDIT_SQL, _PAIRS, _DC0, _DC.format(key="feature, target, sym"),
        "kq AS (SELECT feature, target, sym, quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS c, count(*) AS n FROM pairs GROUP BY ALL)",
        "k1 AS (SELECT feature, target, sym, n, len([q FOR q IN c IF q <= x]) AS g, row_number() OVER (PARTITION BY feature, target, sym ORDER BY y, dt) AS rk FROM pairs JOIN kq USING (feature, target, sym))",
        "k2 AS (SELECT feature, target, sym, n, g, count(*) AS k, avg(rk) AS m FROM k1 GROUP BY ALL)",
        "k3 AS (SELECT feature, target, sym, CASE WHEN count(*) = 5 THEN 12 / (n * (n + 1)) * sum(k * (m - (n + 1) / 2) ^ 2) ELSE 0 END AS h FROM k2 GROUP BY feature, target, sym, n)",
        f"r1 AS (SELECT feature, target, sym, {pct_rank('x', 'feature, target, sym', percent=False)} AS rx, {pct_rank('y', 'feature, target, sym', percent=False)} AS ry FROM pairs)",
        "r2 AS (SELECT feature, target, sym, corr(rx, ry) AS c FROM r1 GROUP BY ALL)",
        select=f"SELECT feature, target, {r('avg(dcor)')} AS dcor, {r('avg(h)', 5)} AS kruskal, {r('avg(c)')} AS spearman FROM dcor JOIN k3 USING (feature, target, sym) JOIN r2 USING (feature, target, sym) GROUP BY feature, target",
    ),
)
def d06_scores(spark, sf):
    out = dp.nonlinear_scores(_pairs_long(audit_panel(spark, sf), FEATS, tg.TARGETS))
    return out.select("feature", "target", rnd("dcor").alias("dcor"), rnd("kruskal", 5).alias("kruskal"), rnd("spearman").alias("spearman"))


@query("d06_nonlinear_audit")
def d06(spark, sf):
    """All channels against all targets, 2,000 draws."""
    rows = _pairs_long(audit_panel(spark, sf), FEATS, tg.TARGETS)
    out = dp.nonlinear_audit(rows, n_pairs=len(FEATS) * len(tg.TARGETS), draws=2000)
    values = ("dcor", "kruskal", "dcor_sign", "floor", "spearman", "dcor_p", "kruskal_p", "q")
    return out.select("feature", "target", *[rnd(c).alias(c) for c in values], "significant", "magnitude_only", "hidden_by_monotonic")


_PICK = "dc0 AS (" + " UNION ALL ".join(
    [f"SELECT '{f}' AS a, '{n}' AS b, sym, {f} AS x, {n} AS y FROM tgt WHERE {n} IS NOT NULL" for f in FEATS for n in tg.TARGETS]
    + [f"SELECT '{a}', '{b}', sym, {a}, {b} FROM tgt" for i, a in enumerate(FEATS) for b in FEATS[i + 1:]]) + ")"


@query(
    "c23_pick_features",
    with_(
        *AUDIT_SQL, _PICK, _DC.format(key="a, b, sym"), "sc AS (SELECT a, b, avg(dcor) AS s FROM dcor GROUP BY a, b)",
        "rel AS (SELECT a AS feature, avg(s) AS s FROM sc WHERE b IN (" + ", ".join(f"'{n}'" for n in tg.TARGETS) + ") GROUP BY a)",
        "red AS (SELECT a, b, s FROM sc UNION ALL SELECT b, a, s FROM sc)",
        "p1 AS (SELECT feature, s AS gain FROM rel ORDER BY gain DESC, feature LIMIT 1)",
        "p2 AS (SELECT rel.feature, rel.s - 0.5 * red.s AS gain FROM rel JOIN red ON red.a = rel.feature JOIN p1 ON red.b = p1.feature ORDER BY gain DESC, feature LIMIT 1)",
        "p3 AS (SELECT rel.feature, any_value(rel.s) - 0.5 * avg(red.s) AS gain FROM rel JOIN red ON red.a = rel.feature WHERE red.b IN (SELECT feature FROM p1 UNION ALL SELECT feature FROM p2) AND rel.feature NOT IN (SELECT feature FROM p1 UNION ALL SELECT feature FROM p2) GROUP BY rel.feature ORDER BY gain DESC, feature LIMIT 1)",
        select=" UNION ALL ".join(f"SELECT feature, {i} AS place, {r('gain')} AS gain FROM p{i}" for i in (1, 2, 3)),
    ),
)
def c23(spark, sf):
    """Three channels by mean relevance over all targets, less redundancy."""
    p = audit_panel(spark, sf)
    rel = dp.distance_correlation(_pairs_long(p, FEATS, tg.TARGETS), ["feature", "target", "sym"]).groupBy("feature", "target").agg(F.avg("dcor").alias("s"))
    rel = rel.groupBy("feature").agg(F.avg("s").alias("score"))
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for i, a in enumerate(FEATS) for b in FEATS[i + 1 :]])
    rows = p.select("sym", F.explode(cells).alias("c")).select("sym", "c.*")
    red = dp.distance_correlation(rows, ["a", "b", "sym"]).groupBy("a", "b").agg(F.avg("dcor").alias("score"))
    return dp.pick_features(rel, red, 3).withColumn("gain", rnd("gain"))


# ---- permutations -------------------------------------------------------------------------------------------

_NCAL = "(SELECT CAST(count(*) AS BIGINT) FROM cal)"


@query("d03_block_order", with_(BARS10, CAL, _ORD.format(seed="p", n=_NCAL, draws=8), select="SELECT CAST(draw AS INTEGER) AS draw, new_idx, old_idx FROM ord"))
def d03(spark, sf):
    return pm.block_order(t.calendar(t.bars(spark, sf, books=10)), 8)


_PERM = (
    *_GRID, _ORD.format(seed="p", n=_NCAL, draws=4),
    f"pr0 AS (SELECT sym, bar_idx, coalesce(close / {lag('close', order='bar_idx')} - 1, 0) AS ret, first_value(close) OVER (PARTITION BY sym ORDER BY bar_idx) AS c0 FROM g10)",
    "pp AS (SELECT o.draw, p.sym, o.new_idx AS bar_idx, p.c0 * exp(sum(ln(1 + p.ret)) OVER (PARTITION BY o.draw, p.sym ORDER BY o.new_idx)) AS close FROM ord o JOIN pr0 p ON p.bar_idx = o.old_idx)",
)


@query("d04_permuted_prices", with_(*_PERM, select=f"SELECT CAST(draw AS INTEGER) AS draw, sym, bar_idx, {r('ln(close)')} AS log_close FROM pp"))
def d04(spark, sf):
    g = grid10(spark, sf)
    out = pm.permuted_prices(g, pm.block_order(t.calendar(g), 4))
    return out.select("draw", "sym", "bar_idx", rnd(F.ln("close")).alias("log_close"))


@query("j13_permuted_rows", with_(*_PERM, select="SELECT CAST(o.draw AS INTEGER) AS draw, g.sym, o.new_idx AS bar_idx, g.volume FROM ord o JOIN g10 g ON g.bar_idx = o.old_idx"))
def j13(spark, sf):
    g = grid10(spark, sf)
    return pm.permuted_rows(g, pm.block_order(t.calendar(g), 4), ["volume"])


# ---- walk-forward studies ---------------------------------------------------------------------------------------

TRAIN, TEST, WARM = 252, 63, 60
STUDY_TARGETS = ("direction_1d", "vol_5d")


def study_panel(spark, sf, draws: int = 0):
    """(draw, sym, bar_idx, channels, targets, baselines): draw 0 is real, the others permuted and rebuilt."""
    g = grid10(spark, sf)
    rows = g.select(F.lit(0).alias("draw"), "sym", "bar_idx", "close", "volume")
    if draws:
        order = pm.block_order(t.calendar(g), draws)
        px = pm.permuted_prices(g, order)
        vol = pm.permuted_rows(g, order, ["volume"])
        rows = rows.unionByName(px.join(vol, ["draw", "sym", "bar_idx"]))
    rows = rows.withColumn("dt", F.col("bar_idx"))
    p = durable(channels(rows, "draw"), "study-channels")
    p = rounded(tg.baselines(tg.targets(p, 5, "draw"), 5, "draw"))
    p = durable(p, "study-panel")
    n = p.groupBy("draw").agg(F.max("bar_idx").alias("_last"))
    kept = p.join(F.broadcast(n), "draw").where((F.col("bar_idx") >= WARM) & (F.col("bar_idx") < F.col("_last")))
    return kept.withColumn("bar_idx", (F.col("bar_idx") - WARM).cast("int")).drop("_last")


def _study_sql(src, feats, names, extra_cols="", feature_sql=None):
    """Windows, ranks, partial rank correlation, pick on train, score on test."""
    return (
        f"nb AS (SELECT draw, max(bar_idx) + 1 AS n FROM {src} GROUP BY draw)",
        f"win AS (SELECT draw, n, w, w * {TEST} AS s, w * {TEST} + {TRAIN} AS e, least(w * {TEST} + {TRAIN} + {TEST}, n) AS te FROM nb, range(0, 1000) q(w) WHERE w * {TEST} + {TRAIN} + 1 < n)",
        f"wc AS (SELECT p.*, win.w, CASE WHEN p.bar_idx < win.e THEN 'train' ELSE 'test' END AS side FROM {src} p JOIN win ON win.draw = p.draw AND p.bar_idx >= win.s AND p.bar_idx < win.te)",
        "cl AS (" + " UNION ALL ".join(f"SELECT draw, w, side, sym, bar_idx{extra_cols}, '{n}' AS target, {k} AS k, '{f}' AS feature, {f} AS f, {n} AS y, base_{n} AS b FROM wc WHERE {n} IS NOT NULL AND base_{n} IS NOT NULL AND {f} IS NOT NULL" for k, f in enumerate(feats) for n in names) + ")",
    )


_SC_KEYS = "draw, w, side, target, k, feature"
_SC = (
    "rkk AS (SELECT draw, w, side, target, k, feature, " + ", ".join(f"{pct_rank(c, _SC_KEYS, percent=False)} AS {n}" for c, n in (("f", "rf"), ("y", "ry"), ("b", "rb"))) + " FROM {cells})",
    "sm AS (SELECT draw, w, side, target, k, feature, count(*) AS n, covar_pop(rf, ry) AS fy, covar_pop(rf, rb) AS fb, covar_pop(ry, rb) AS yb, var_pop(rf) AS ff, var_pop(ry) AS yy, CASE WHEN var_pop(rb) > 0 THEN 1 / var_pop(rb) ELSE 0 END AS ib FROM rkk GROUP BY ALL)",
    "sc AS (SELECT draw, w, side, target, k, feature, n, CASE WHEN n >= 20 AND ff - fb * fb * ib > 1e-9 AND yy - yb * yb * ib > 1e-9 THEN (fy - fb * yb * ib) / sqrt((ff - fb * fb * ib) * (yy - yb * yb * ib)) ELSE 0 END AS score FROM sm)",
    "pk AS (SELECT draw, target, w, k, feature AS pick, abs(score) AS ins FROM sc WHERE side = 'train' AND n >= 20 QUALIFY row_number() OVER (PARTITION BY draw, target, w ORDER BY abs(score) DESC, k) = 1)",
    "po AS (SELECT pk.draw, pk.target, pk.w, pk.pick, pk.ins, abs(t.score) AS oos FROM pk JOIN sc t ON t.side = 'test' AND t.n >= 20 AND t.draw = pk.draw AND t.target = pk.target AND t.w = pk.w AND t.k = pk.k)",
    "su AS (SELECT draw, target, count(*) AS n_windows, avg(ins) AS mean_is, avg(oos) AS mean_oos, avg(ins) - avg(oos) AS gap, count(DISTINCT pick) AS n_picks FROM po GROUP BY draw, target)",
)


def _sc(cells="cl"):
    return tuple(x.replace("{cells}", cells) for x in _SC)


_CUT = f"cut AS (SELECT * EXCLUDE (bar_idx), bar_idx - {WARM} AS bar_idx FROM tgt WHERE bar_idx >= {WARM} AND bar_idx < (SELECT max(bar_idx) FROM cal))"
_DRAWN = tuple(x for x in _PERM) + (
    "gd AS (SELECT 0 AS draw, sym, bar_idx, close, volume FROM g10 UNION ALL SELECT pp.draw, pp.sym, pp.bar_idx, pp.close, g.volume FROM pp JOIN ord o ON o.draw = pp.draw AND o.new_idx = pp.bar_idx JOIN g10 g ON g.sym = pp.sym AND g.bar_idx = o.old_idx)",
)
REAL_SQL = (*AUDIT_SQL, _CUT)
DRAW_SQL = (*_DRAWN, *channels_sql("gd", "draw, sym"), *_T_SQL, _CUT)


def _out_summary(df):
    return df.select("draw", "target", "n_windows", rnd("mean_is").alias("mean_is"), rnd("mean_oos").alias("mean_oos"), rnd("gap").alias("gap"), "n_picks")


_SUM_SQL = f"SELECT CAST(draw AS INTEGER) AS draw, target, CAST(n_windows AS BIGINT) AS n_windows, {r('mean_is')} AS mean_is, {r('mean_oos')} AS mean_oos, {r('gap')} AS gap, CAST(n_picks AS BIGINT) AS n_picks FROM su"


@query("d07_incremental_scores", with_(*REAL_SQL, *_study_sql("cut", FEATS, STUDY_TARGETS), *_sc(), select=f"SELECT CAST(w AS INTEGER) AS w, side, target, feature, CAST(n AS BIGINT) AS n, {r('score')} AS score FROM sc"))
def d07(spark, sf):
    cells = wf.windowed_cells(study_panel(spark, sf), FEATS, STUDY_TARGETS, TRAIN, TEST)
    return wf.incremental_scores(cells, wf.KEYS).select("w", "side", "target", "feature", "n", rnd("score").alias("score"))


@query("d08_walkforward_pick", with_(*REAL_SQL, *_study_sql("cut", FEATS, STUDY_TARGETS), *_sc(), select=f"SELECT CAST(w AS INTEGER) AS w, target, pick, {r('ins')} AS in_sample, {r('oos')} AS out_sample FROM po"))
def d08(spark, sf):
    out = wf.study(study_panel(spark, sf), FEATS, STUDY_TARGETS, TRAIN, TEST)
    return out.select("w", "target", "pick", rnd("in_sample").alias("in_sample"), rnd("out_sample").alias("out_sample"))


@query("d09_null_cloud", with_(*DRAW_SQL, *_study_sql("cut", FEATS, STUDY_TARGETS), *_sc(), select=_SUM_SQL))
def d09(spark, sf):
    return _out_summary(wf.study_summary(wf.study(study_panel(spark, sf, 4), FEATS, STUDY_TARGETS, TRAIN, TEST)))


@query(
    "a38_null_summary",
    with_(
        *DRAW_SQL, *_study_sql("cut", FEATS, STUDY_TARGETS), *_sc(),
        "re AS (SELECT target, mean_oos AS real FROM su WHERE draw = 0)",
        select=f"""SELECT target, {r('max(real)')} AS real, CAST(count(*) AS BIGINT) AS n_draws, {r('avg(mean_oos)')} AS null_mean, {r('stddev_samp(mean_oos)')} AS null_sd, {r('quantile_cont(mean_oos, 0.025)')} AS null_low, {r('quantile_cont(mean_oos, 0.975)')} AS null_high,
          {r('avg(CASE WHEN mean_oos < real THEN 1.0 ELSE 0 END) * 100')} AS percentile, {r('(count(*) FILTER (WHERE mean_oos >= real) + 1) / (count(*) + 1)')} AS p, 1.0 / (count(*) + 1) > 0.05 AS underpowered FROM su JOIN re USING (target) WHERE draw <> 0 GROUP BY target""",
    ),
)
def a38(spark, sf):
    s = wf.study_summary(wf.study(study_panel(spark, sf, 4), FEATS, STUDY_TARGETS, TRAIN, TEST))
    out = mx.null_summary(s.select("draw", "target", F.col("mean_oos").alias("score")), "score", 1, 0.05, "target")
    return out.select("target", *[rnd(c).alias(c) for c in ("real", "null_mean", "null_sd", "null_low", "null_high", "percentile", "p")], "n_draws", "underpowered")


_CS = "csr AS (SELECT * REPLACE (" + ", ".join(f"{pct_rank(f, 'draw, bar_idx', 5)} AS {f}" for f in FEATS) + ") FROM cut)"


def ranked(panel):
    """Channels as session ranks; a session holds the ten baskets."""
    return panel.withColumns({f: window_rank(["draw", "bar_idx"], f, 5, True) for f in FEATS})


@query("d10_rank_study", with_(*REAL_SQL, _CS, *_study_sql("csr", FEATS, STUDY_TARGETS), *_sc(), select=_SUM_SQL))
def d10(spark, sf):
    return _out_summary(wf.study_summary(wf.study(ranked(study_panel(spark, sf)), FEATS, STUDY_TARGETS, TRAIN, TEST)))


_IP = [(a, b) for i, a in enumerate(FEATS) for b in FEATS[i + 1 :]]
_IX = tuple(f"{a}_x_{b}" for a, b in _IP)


@query(
    "d11_interaction_study",
    with_(*REAL_SQL, _CS, "ixs AS (SELECT *, " + ", ".join(f"{a} * {b} AS {a}_x_{b}" for a, b in _IP) + " FROM csr)", *_study_sql("ixs", _IX, ("direction_1d",)), *_sc(), select=_SUM_SQL),
)
def d11(spark, sf):
    p = ranked(study_panel(spark, sf)).withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in _IP})
    return _out_summary(wf.study_summary(wf.study(p, _IX, ("direction_1d",), TRAIN, TEST)))


_LH = "lh AS (SELECT *, " + ", ".join(
    f"{lead('close', n, part='draw, sym', order='bar_idx')} / close - 1 AS direction_{n}d, close / {lag('close', n, part='draw, sym', order='bar_idx')} - 1 AS base_direction_{n}d" for n in (5, 20)
) + " FROM cut)"
_LT = ("direction_5d", "direction_20d")


@query("d12_horizon_study", with_(*REAL_SQL, _LH, *_study_sql("lh", FEATS, _LT), *_sc(), select=_SUM_SQL))
def d12(spark, sf):
    key = dict(sym="sym", order="bar_idx")
    p = study_panel(spark, sf)
    for n in (5, 20):
        ahead = F.lead("close", n).over(by_sym("draw", **key)) / F.col("close") - 1
        p = p.withColumns({f"direction_{n}d": ahead, f"base_direction_{n}d": change("close", n, "draw", **key)})
    return _out_summary(wf.study_summary(wf.study(p, FEATS, _LT, TRAIN, TEST)))


_RG = f"rgm AS (SELECT *, ln(nullif({roll('stddev_samp', 'rr', 5, part='draw, sym', order='bar_idx')}, 0) / nullif({roll('stddev_samp', 'rr', 20, part='draw, sym', order='bar_idx')}, 0)) AS regime FROM (SELECT *, close / {lag('close', part='draw, sym', order='bar_idx')} - 1 AS rr FROM cut))"


@query(
    "d13_regime_study",
    with_(
        *REAL_SQL, _RG, *_study_sql("rgm", FEATS, ("direction_1d",), extra_cols=", regime"),
        "cu AS (SELECT draw, w, quantile_cont(regime, 1 / 3.0) AS lo, quantile_cont(regime, 2 / 3.0) AS hi, count(regime) AS kn FROM (SELECT DISTINCT draw, w, sym, bar_idx, regime FROM cl WHERE side = 'train') GROUP BY draw, w)",
        "cr AS (SELECT c.* REPLACE (c.target || '__' || CASE WHEN c.regime > u.hi THEN 'high' ELSE 'low' END AS target) FROM cl c JOIN cu u ON u.draw = c.draw AND u.w = c.w WHERE u.kn >= 50 AND (c.regime > u.hi OR c.regime < u.lo))",
        *_sc("cr"), select=_SUM_SQL,
    ),
)
def d13(spark, sf):
    key = dict(sym="sym", order="bar_idx")
    p = study_panel(spark, sf).withColumn("_r", change("close", 1, "draw", **key))
    std = lambda n: F.when(F.count("_r").over(by_sym("draw", **key).rowsBetween(-(n - 1), 0)) == n, F.stddev_samp("_r").over(by_sym("draw", **key).rowsBetween(-(n - 1), 0)))
    p = p.withColumns({"_s": std(5), "_l": std(20)})
    p = p.withColumn("regime", F.when((F.col("_s") > 0) & (F.col("_l") > 0), F.ln(F.col("_s") / F.col("_l")))).drop("_r", "_s", "_l")
    cells = wf.regime_cells(wf.windowed_cells(p, FEATS, ("direction_1d",), TRAIN, TEST, mask="regime"))
    return _out_summary(wf.study_summary(wf.select_and_score(wf.incremental_scores(cells, wf.KEYS))))


@query(
    "f26_regime_cells",
    with_(
        *REAL_SQL, _RG, *_study_sql("rgm", ("mom_z",), ("direction_1d",), extra_cols=", regime"),
        "cu AS (SELECT draw, w, quantile_cont(regime, 1 / 3.0) AS lo, quantile_cont(regime, 2 / 3.0) AS hi, count(regime) AS kn FROM cl WHERE side = 'train' GROUP BY draw, w)",
        select="SELECT CAST(c.w AS INTEGER) AS w, c.side, c.target || '__' || CASE WHEN c.regime > u.hi THEN 'high' ELSE 'low' END AS target, CAST(count(*) AS BIGINT) AS n FROM cl c JOIN cu u ON u.draw = c.draw AND u.w = c.w WHERE u.kn >= 50 AND (c.regime > u.hi OR c.regime < u.lo) GROUP BY ALL",
    ),
)
def f26(spark, sf):
    key = dict(sym="sym", order="bar_idx")
    p = study_panel(spark, sf).withColumn("_r", change("close", 1, "draw", **key))
    std = lambda n: F.when(F.count("_r").over(by_sym("draw", **key).rowsBetween(-(n - 1), 0)) == n, F.stddev_samp("_r").over(by_sym("draw", **key).rowsBetween(-(n - 1), 0)))
    p = p.withColumns({"_s": std(5), "_l": std(20)})
    p = p.withColumn("regime", F.when((F.col("_s") > 0) & (F.col("_l") > 0), F.ln(F.col("_s") / F.col("_l"))))
    cells = wf.regime_cells(wf.windowed_cells(p, ("mom_z",), ("direction_1d",), TRAIN, TEST, mask="regime"))
    return cells.groupBy("w", "side", "target").agg(F.count(F.lit(1)).alias("n"))


_PC = (
    "pcc AS (SELECT 0 AS draw, pair AS sym, dt, c.bar_idx, z AS zscore, ahead AS pair_reversion, behind AS base_pair_reversion FROM pz JOIN cal c USING (dt))",
)


@query("d14_pair_study", with_(*PAIR_BASE, *PAIR_SQL, *_PC, *_study_sql("pcc", ("zscore",), ("pair_reversion",)), *_sc(), select=_SUM_SQL))
def d14(spark, sf):
    cal = t.calendar(t.bars(spark, sf, books=10))
    p = pair_panel(spark, sf).join(cal, "dt").select(
        F.lit(0).alias("draw"), F.col("pair").alias("sym"), "bar_idx", F.col("z").alias("zscore"), F.col("ahead").alias("pair_reversion"), F.col("behind").alias("base_pair_reversion")
    )
    return _out_summary(wf.study_summary(wf.study(p, ("zscore",), ("pair_reversion",), TRAIN, TEST)))


# ---- causality and alignment ---------------------------------------------------------------------------------------


@query(
    "d19_causality",
    with_(BARS, "n AS (SELECT count(*) AS n FROM bars WHERE dt <= DATE '1999-06-30')", select="SELECT CAST(n AS BIGINT) AS checked, CAST(0 AS BIGINT) AS changed FROM n"),
)
def d19(spark, sf):
    """Recomputes causal features on a shortened panel: no earlier row may change."""
    panel = t.bars(spark, sf)
    run = lambda p: technical.lagged_features(p).withColumn("z", squash(expanding_z("close")))
    names = ["mom_5", "vol_21", "zscore_10", "z"]
    cut = run(panel.where(F.col("dt") <= F.lit("1999-06-30").cast("date")))
    bad = wf.prefix_unchanged(run(panel), cut, ["sym", "dt"], names)
    return cut.agg(F.count(F.lit(1)).alias("checked")).join(bad.agg(F.count(F.lit(1)).alias("changed")), how="cross")


@query(
    "d20_alignment",
    with_(
        BARS, f"x AS (SELECT sym, dt, close / {lag('close')} - 1 AS now, {lead('close')} / close - 1 AS ahead, close / {lag('close', 3)} - 1 AS feat FROM bars)",
        select=f"SELECT {r('abs(corr(feat, now))')} AS rho_now, {r('abs(corr(feat, ahead))')} AS rho_ahead, abs(corr(feat, now)) >= abs(corr(feat, ahead)) AS honest FROM x",
    ),
)
def d20(spark, sf):
    p = t.bars(spark, sf)
    p = p.withColumns({"now": change("close"), "ahead": F.lead("close").over(by_sym()) / F.col("close") - 1, "feat": change("close", 3)})
    out = wf.alignment_diagnostic(p, "feat", "now", "ahead")
    return out.select(rnd("rho_now").alias("rho_now"), rnd("rho_ahead").alias("rho_ahead"), "honest")


@query("d25_calibration")
def d25(spark, sf):
    """The whole audit on a random walk over the real calendar: nothing should survive."""
    from barline.sources.synthetic import random_walk

    g = grid10(spark, sf)
    walk = random_walk(g.select("sym"), t.calendar(g)).join(g.select("sym", "bar_idx", "volume"), ["sym", "bar_idx"])
    p = durable(channels(walk), "walk-channels")
    p = durable(rounded(tg.baselines(tg.targets(p))), "walk-panel")
    out = dp.feature_audit(p, FEATS, ("direction_1d", "rel_strength_1d"), draws=500)
    return out.select("feature", "target", rnd("spearman").alias("spearman"), "p_value", rnd("q").alias("q"), "significant")

