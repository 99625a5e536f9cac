"""Window-function queries: technical channels, patterns, adaptive scales, networks of returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.functions.cols import expanding_z, rnd, squash, trailing_z
from barline.operators import patterns, recursive, technical
from barline.plans import ansi as q
from barline.plans.ansi import BARS, lag, over, r, roll, with_, z
from barline.plans.registry import query
from barline.sources import tables as t


def _out(df, digits=6, **cols):
    keys = [c for c in ("sym", "pair", "dt") if c in df.columns]
    return df.select(*keys, *[rnd(v, digits).alias(k) for k, v in cols.items()])


def _keep(df, names, digits=6):
    return _out(df, digits, **{n: n for n in names})


RET = "rets AS (SELECT *, close / nullif({}, 0) - 1 AS ret FROM bars)".format(lag("close"))


@query(
    "w01_returns",
    with_(
        BARS,
        select=f"""SELECT sym, dt, {r('close / ' + lag('close') + ' - 1')} AS ret,
        {r('ln(close / ' + lag('close') + ')')} AS log_ret, {r('close / ' + lag('close', 5) + ' - 1')} AS ret_5 FROM bars""",
    ),
)
def w01(spark, sf):
    return _keep(technical.returns(t.bars(spark, sf)), ["ret", "log_ret", "ret_5"])


@query(
    "w02_bollinger",
    with_(
        BARS,
        f"b AS (SELECT *, {roll('avg', 'close', 20)} AS sma, {roll('stddev_samp', 'close', 20)} AS sd FROM bars)",
        select=f"""SELECT sym, dt, {r('(close - sma) / nullif(2 * sd, 0)')} AS boll_pos,
        {r('4 * sd / sma')} AS boll_width, {r('sma / ' + lag('sma', 5) + ' - 1')} AS sma_slope FROM b""",
    ),
)
def w02(spark, sf):
    return _keep(technical.bollinger(t.bars(spark, sf)), ["boll_pos", "boll_width", "sma_slope"])


# One recursion step per session: every exponential average feeds on its last value.
def _ema(prev: str, x: str, a: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN {prev} WHEN {prev} IS NULL THEN {x} ELSE {a} * {x} + (1 - {a}) * {prev} END"


_STEPS = f"""steps AS (
  SELECT sym, dt, close, n, close - pc AS move, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr,
         CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0.0 END AS up,
         CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0.0 END AS dn
  FROM (SELECT *, {lag('close')} AS pc, {lag('high')} AS ph, {lag('low')} AS pl,
               row_number() OVER (PARTITION BY sym ORDER BY dt) AS n FROM bars))"""
_NULLS = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in ("g14", "l14", "g28", "l28", "tr14", "up14", "dn14"))
_EMAS = (9, 12, 21, 26, 50)
_SMOOTH = f"""smooth AS (
  SELECT sym, n, {', '.join(f'CAST(NULL AS DOUBLE) AS e{s}' for s in _EMAS)}, CAST(NULL AS DOUBLE) AS sig, {_NULLS}, CAST(NULL AS DOUBLE) AS dx14
  FROM (SELECT DISTINCT sym, CAST(0 AS BIGINT) AS n FROM steps)
  UNION ALL
  SELECT sym, n, e9, e12, e21, e26, e50, {_ema('sig', 'CASE WHEN n >= 26 THEN e12 - e26 END', '(2.0 / 10)')} AS sig,
         g14, l14, g28, l28, tr14, up14, dn14,
         {_ema('dx14', 'CASE WHEN n >= 14 THEN 100 * abs(up14 - dn14) / nullif(up14 + dn14, 0) END', '(1.0 / 14)')} AS dx14
  FROM (
    SELECT s.sym, s.n, {', '.join(f"{_ema(f'p.e{x}', 's.close', f'(2.0 / {x + 1})')} AS e{x}" for x in _EMAS)}, p.sig, p.dx14,
      {', '.join(f"{_ema(f'p.g{x}', 'greatest(s.move, 0) + 0 * s.move', f'(1.0 / {x})')} AS g{x}, {_ema(f'p.l{x}', 'greatest(-s.move, 0) + 0 * s.move', f'(1.0 / {x})')} AS l{x}" for x in (14, 28))},
      {_ema('p.tr14', 's.tr', '(1.0 / 14)')} AS tr14, {_ema('p.up14', 's.up', '(1.0 / 14)')} AS up14, {_ema('p.dn14', 's.dn', '(1.0 / 14)')} AS dn14
    FROM smooth p JOIN steps s ON s.sym = p.sym AND s.n = p.n + 1))"""
_SMOOTHED = """smoothed AS (
  SELECT b.*, s.n,
    CASE WHEN s.n >= 9 THEN e9 END AS ema9, CASE WHEN s.n >= 12 THEN e12 END AS ema12, CASE WHEN s.n >= 21 THEN e21 END AS ema21,
    CASE WHEN s.n >= 26 THEN e26 END AS ema26, CASE WHEN s.n >= 50 THEN e50 END AS ema50,
    CASE WHEN s.n >= 26 THEN e12 - e26 END AS macd, CASE WHEN s.n >= 34 THEN sig END AS macd_signal,
    CASE WHEN s.n >= 15 THEN 100 - 100 / (1 + g14 / nullif(l14, 0)) END AS rsi14,
    CASE WHEN s.n >= 29 THEN 100 - 100 / (1 + g28 / nullif(l28, 0)) END AS rsi28,
    CASE WHEN s.n >= 14 THEN tr14 END AS atr,
    CASE WHEN s.n >= 27 THEN dx14 END AS adx,
    CASE WHEN s.n >= 14 THEN 100 * (up14 - dn14) / nullif(tr14, 0) END AS di_spread
  FROM (SELECT bars.*, st.n AS k FROM bars JOIN steps st USING (sym, dt)) b JOIN smooth s ON s.sym = b.sym AND s.n = b.k)"""
SMOOTH_CTES = (BARS, _STEPS, _SMOOTH, _SMOOTHED)


def _smooth_sql(names, digits=4):
    return with_(*SMOOTH_CTES, select="SELECT sym, dt, " + ", ".join(f"{r(n, digits)} AS {n}" for n in names) + " FROM smoothed")


def _prices(spark, sf, *more):
    """What the smoothing reads; Python work is handed every column it is given."""
    return t.bars(spark, sf).select("sym", "dt", "high", "low", "close", *more)


def _smooth(spark, sf, names):
    return _keep(recursive.smoothed(_prices(spark, sf), names=names, kept=("sym", "dt")), names, 4)


_W3 = ["ema9", "ema12", "ema21", "ema26", "ema50", "macd", "macd_signal"]


@query("w03_ema_macd", _smooth_sql(_W3))
def w03(spark, sf):
    return _smooth(spark, sf, _W3)


@query("w04_rsi_wilder", _smooth_sql(["rsi14", "rsi28"]))
def w04(spark, sf):
    return _smooth(spark, sf, ["rsi14", "rsi28"])


@query(
    "w05_rsi_simple",
    with_(
        BARS,
        f"d AS (SELECT *, close - {lag('close')} AS d FROM bars)",
        "g AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0.0) END AS up, CASE WHEN d IS NOT NULL THEN greatest(-d, 0.0) END AS dn FROM d)",
        select=f"SELECT sym, dt, {r('100 - 100 / (1 + ' + roll('avg', 'up', 14) + ' / (' + roll('avg', 'dn', 14) + ' + 1e-8))', 4)} AS rsi FROM g",
    ),
)
def w05(spark, sf):
    return _keep(technical.mean_rsi(t.bars(spark, sf)), ["rsi"], 4)


@query("w06_atr", _smooth_sql(["atr"]))
def w06(spark, sf):
    return _smooth(spark, sf, ["atr"])


@query("w07_adx_di", _smooth_sql(["adx", "di_spread"]))
def w07(spark, sf):
    return _smooth(spark, sf, ["adx", "di_spread"])


_STOCH = f"st AS (SELECT *, 100 * (close - {roll('min', 'low', 14)}) / nullif({roll('max', 'high', 14)} - {roll('min', 'low', 14)}, 0) AS stoch_k FROM {{}})"


@query(
    "w08_stochastic",
    with_(BARS, _STOCH.format("bars"), select=f"SELECT sym, dt, {r('stoch_k')} AS stoch_k, {r(roll('avg', 'stoch_k', 3))} AS stoch_d FROM st"),
)
def w08(spark, sf):
    return _keep(technical.stochastic(t.bars(spark, sf)), ["stoch_k", "stoch_d"])


_VOL = f"vv AS (SELECT *, nullif(volume, 0) AS v, (high + low + close) / 3 * nullif(volume, 0) AS pv, close / nullif({lag('close')}, 0) - 1 AS ret FROM {{}})"
_VWAP = f"(close - {roll('sum', 'pv', 20)} / {roll('sum', 'v', 20)}) / close"


@query(
    "w09_vwap_volume",
    with_(
        BARS,
        _VOL.format("bars"),
        select=f"""SELECT sym, dt, {r(_VWAP)} AS vwap_gap, {r('v / ' + roll('avg', 'v', 20))} AS volume_ratio,
        {r('ret / nullif(' + roll('stddev_samp', 'ret', 20) + ', 0)')} AS ret_over_sd FROM vv""",
    ),
)
def w09(spark, sf):
    return _keep(technical.volume_features(t.bars(spark, sf)), ["vwap_gap", "volume_ratio", "ret_over_sd"])


_CH = technical.TECHNICAL_CHANNELS
_RAW = f"""raw AS (SELECT sym, dt, rsi14 - 50 AS rsi14, rsi28 - 50 AS rsi28, (macd - macd_signal) / close AS macd_gap,
    sign(macd - macd_signal) AS macd_side, (close - sma) / nullif(2 * sd, 0) AS boll_pos, 4 * sd / sma AS boll_width,
    (ema9 - ema21) / close AS ema_9_21, (ema21 - ema50) / close AS ema_21_50, (close - ema50) / close AS ema_50_gap,
    sma / {lag('sma', 5)} - 1 AS sma_slope, adx - 25 AS adx, di_spread, stoch_k - 50 AS stoch_k,
    stoch_k - {roll('avg', 'stoch_k', 3)} AS stoch_cross, atr / close AS atr_share, {_VWAP} AS vwap_gap,
    close / {lag('close', 5)} - 1 AS ret_5, close / {lag('close', 21)} - 1 AS ret_21,
    v / {roll('avg', 'v', 20)} AS volume_ratio, ret / nullif({roll('stddev_samp', 'ret', 20)}, 0) AS ret_over_sd
  FROM (SELECT *, {roll('avg', 'close', 20)} AS sma, {roll('stddev_samp', 'close', 20)} AS sd FROM vv))"""
CHANNEL_CTES = (
    *SMOOTH_CTES,
    _STOCH.format("smoothed"),
    _VOL.format("st"),
    _RAW,
    "chan AS (SELECT sym, dt, " + ", ".join(f"coalesce(tanh({z(c, None, 20)} / 2), 0.0) AS {c}" for c in _CH) + " FROM raw)",
)


@query(
    "w10_technical_channels",
    with_(*CHANNEL_CTES, select="SELECT sym, dt, " + ", ".join(f"{r(c, 5)} AS {c}" for c in _CH) + " FROM chan"),
)
def w10(spark, sf):
    return _keep(technical.technical_channels(_prices(spark, sf, "volume")), _CH, 5)


@query(
    "w11_expanding_z",
    with_(
        BARS,
        RET,
        select=f"SELECT sym, dt, {r(z('ret', None, 20))} AS z20, {r(z('ret', None, 60))} AS z60, {r('tanh(' + z('ret', None, 20) + ' / 2)')} AS squashed FROM rets",
    ),
)
def w11(spark, sf):
    df = technical.returns(t.bars(spark, sf))
    return _out(df, z20=expanding_z("ret", 20), z60=expanding_z("ret", 60), squashed=squash(expanding_z("ret", 20)))


@query(
    "w12_trailing_z",
    with_(BARS, select=f"SELECT sym, dt, {r(z('close', 60, 20, skip=1))} AS close_z, {r(z('volume', 60, 20, skip=1))} AS volume_z FROM bars"),
)
def w12(spark, sf):
    return _out(t.bars(spark, sf), close_z=trailing_z("close"), volume_z=trailing_z("volume"))


_PRODUCTS = {h: f"(exp(sum(ln(1 + ret)) {over(h, skip=1)}) - 1)" for h in (1, 2, 5, 10, 21)}
_W14 = [f"mom_{h}" for h in (1, 2, 5, 10, 21)] + [f"vol_{n}" for n in (5, 10, 21)] + ["zscore_10", "zscore_21"]


@query(
    "w14_lagged_features",
    with_(
        BARS,
        f"base AS (SELECT sym, dt, close, row_number() OVER (PARTITION BY sym ORDER BY dt) - 1 AS n, coalesce(close / {lag('close')} - 1, 0.0) AS ret, {lag('close')} AS pc FROM bars)",
        select="SELECT sym, dt, "
        + ", ".join(f"{r(f'CASE WHEN n >= {h} THEN {e} ELSE 0.0 END')} AS mom_{h}" for h, e in _PRODUCTS.items())
        + ", "
        + ", ".join(f"{r(f'CASE WHEN n >= {n} THEN stddev_pop(ret) {over(n, skip=1)} ELSE 0.0 END')} AS vol_{n}" for n in (5, 10, 21))
        + ", "
        + ", ".join(
            f"{r(f'CASE WHEN n >= {n} AND stddev_pop(close) {over(n, skip=1)} > 1e-12 THEN (pc - avg(close) {over(n, skip=1)}) / stddev_pop(close) {over(n, skip=1)} ELSE 0.0 END')} AS zscore_{n}"
            for n in (10, 21)
        )
        + " FROM base",
    ),
)
def w14(spark, sf):
    return _keep(technical.lagged_features(t.bars(spark, sf)), _W14)


@query(
    "w15_dispersion",
    with_(
        BARS,
        f"x AS (SELECT dt, coalesce(close / {lag('close')} - 1, 0.0) AS ret FROM bars)",
        select=f"SELECT dt, {r('coalesce(lag(d) OVER (ORDER BY dt), 0.0)')} AS dispersion FROM (SELECT dt, stddev_pop(ret) AS d FROM x GROUP BY dt)",
    ),
)
def w15(spark, sf):
    return _keep(technical.dispersion(t.bars(spark, sf)), ["dispersion"])


@query(
    "w16_train_standardise",
    with_(
        BARS,
        RET,
        "o AS (SELECT *, CASE WHEN dt < DATE '1999-01-01' THEN ret END AS o_ret, CASE WHEN dt < DATE '1999-01-01' THEN volume END AS o_volume FROM rets)",
        select="SELECT sym, dt, " + ", ".join(f"{r(f'({c} - avg(o_{c}) OVER ()) / stddev_pop(o_{c}) OVER ()')} AS {c}_std" for c in ("ret", "volume")) + " FROM o",
    ),
)
def w16(spark, sf):
    df = technical.returns(t.saved_bars(spark, sf))
    out = technical.standardise_on_train(df, ["ret", "volume"], F.col("dt") < F.lit("1999-01-01").cast("date"))
    return _keep(out, ["ret_std", "volume_std"])


_W17 = ["ret1", "ret5", "ret20", "vol20", "zscore", "rsi14", "mom20"]
_FF = "coalesce(last_value({} IGNORE NULLS) " + over(None) + ", 0.0)"


@query(
    "w17_return_features",
    with_(
        BARS,
        f"a AS (SELECT sym, dt, coalesce(close / {lag('close')} - 1, 0.0) AS ret1 FROM bars)",
        f"b AS (SELECT *, ret1 - {lag('ret1')} AS d FROM a)",
        "c AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0.0) END AS up, CASE WHEN d IS NOT NULL THEN greatest(-d, 0.0) END AS dn FROM b)",
        f"""f AS (SELECT sym, dt, ret1, {roll('sum', 'ret1', 5)} AS ret5, {roll('sum', 'ret1', 20)} AS ret20,
            {roll('stddev_samp', 'ret1', 20)} AS vol20,
            (ret1 - {roll('avg', 'ret1', 252)}) / ({roll('stddev_samp', 'ret1', 252)} + 1e-8) AS zscore,
            100 - 100 / (1 + {roll('avg', 'up', 14)} / ({roll('avg', 'dn', 14)} + 1e-8)) AS rsi14,
            {roll('avg', 'ret1', 20)} AS mom20 FROM c)""",
        select="SELECT sym, dt, " + ", ".join(f"{r(_FF.format(c), 5)} AS {c}" for c in _W17) + " FROM f",
    ),
)
def w17(spark, sf):
    return _keep(technical.return_features(t.bars(spark, sf)), _W17, 5)


@query(
    "w18_normalise",
    with_(
        BARS,
        "m AS (SELECT sym, avg(close) AS a, stddev_samp(close) AS s, min(close) AS lo, max(close) AS hi, quantile_cont(close, 0.5) AS med FROM bars GROUP BY sym)",
        "d AS (SELECT sym, quantile_cont(abs(close - med), 0.5) AS mad FROM bars JOIN m USING (sym) GROUP BY sym)",
        select=f"""SELECT sym, dt, {r('(close - a) / (s + 1e-8)')} AS close_zscore, {r('(close - lo) / (hi - lo + 1e-8)')} AS close_minmax,
        {r('(close - med) / (mad + 1e-8)')} AS close_robust FROM bars JOIN m USING (sym) JOIN d USING (sym)""",
    ),
)
def w18(spark, sf):
    df = t.saved_bars(spark, sf)
    for method in ("zscore", "minmax", "robust"):
        df = technical.normalise(df, "close", method)
    return _keep(df, ["close_zscore", "close_minmax", "close_robust"])


_E = "1e-12"
_CANDLE_CTES = (
    f"""c1 AS (SELECT *, CAST(greatest(high - low, {_E}) AS DOUBLE) AS rng, close - open AS body, high - greatest(open, close) AS up,
        least(open, close) - low AS dn, {lag('open')} AS po, {lag('close')} AS pc FROM bars)""",
    f"c2 AS (SELECT *, {lag('body')} AS b1, {lag('body', 2)} AS b2, {lag('rng')} AS r1, (po + pc) / 2 AS mid FROM c1)",
    f"""candles AS (SELECT sym, dt,
    1 - least(abs(body) / rng, 1) AS doji,
    least(greatest(dn / rng, 0), 1) * least(greatest(1 - 2 * up / rng, 0), 1) * (1 - least(abs(body) / rng, 1)) AS hammer,
    -least(greatest(up / rng, 0), 1) * least(greatest(1 - 2 * dn / rng, 0), 1) * (1 - least(abs(body) / rng, 1)) AS shooting_star,
    sign(body) * least(abs(body) / rng, 1) AS marubozu,
    CASE WHEN b1 IS NULL THEN NULL WHEN sign(body) <> sign(b1) THEN sign(body) * least(greatest(abs(body) / greatest(abs(b1), {_E}) - 1, 0), 1) ELSE 0 END AS engulfing,
    CASE WHEN b1 IS NULL THEN NULL WHEN sign(body) <> sign(b1) THEN -sign(b1) * least(greatest(1 - abs(body) / greatest(abs(b1), {_E}), 0), 1) ELSE 0 END AS harami,
    CASE WHEN abs(b1) / greatest(r1, {_E}) < 0.3 AND b2 < 0 AND body > 0 THEN least(abs(body) / rng, 1) ELSE 0 END AS morning_star,
    CASE WHEN abs(b1) / greatest(r1, {_E}) < 0.3 AND b2 > 0 AND body < 0 THEN -least(abs(body) / rng, 1) ELSE 0 END AS evening_star,
    CASE WHEN b1 < 0 AND body > 0 AND close > mid THEN least(greatest((close - mid) / greatest(abs(b1), {_E}), 0), 1) ELSE 0 END AS piercing,
    CASE WHEN b1 > 0 AND body < 0 AND close < mid THEN -least(greatest((mid - close) / greatest(abs(b1), {_E}), 0), 1) ELSE 0 END AS dark_cloud,
    CASE WHEN body > 0 AND b1 > 0 AND b2 > 0 THEN least((abs(body) + abs(b1) + abs(b2)) / (3 * rng), 1) ELSE 0 END AS three_soldiers,
    CASE WHEN body < 0 AND b1 < 0 AND b2 < 0 THEN -least((abs(body) + abs(b1) + abs(b2)) / (3 * rng), 1) ELSE 0 END AS three_crows
    FROM c2)""",
)


@query(
    "w19_candles",
    with_(BARS, *_CANDLE_CTES, select="SELECT sym, dt, " + ", ".join(f"{r(c)} AS {c}" for c in patterns.CANDLES) + " FROM candles"),
)
def w19(spark, sf):
    return _keep(patterns.candles(t.bars(spark, sf)), patterns.CANDLES)


def _mid(n):
    return f"(({roll('max', 'high', n, max(2, n // 2))} + {roll('min', 'low', n, max(2, n // 2))}) / 2)"


_CHANNEL_CTES = (
    f"h1 AS (SELECT *, {_mid(9)} AS tk, {_mid(26)} AS kj, {_mid(52)} AS sb, {roll('max', 'high', 20, 10)} AS hi, {roll('min', 'low', 20, 10)} AS lo FROM bars)",
    f"""channels AS (SELECT sym, dt, tanh((tk - kj) / greatest(abs(kj), {_E}) * 50) AS ichimoku_tk_cross,
      CASE WHEN tk + kj + sb IS NOT NULL THEN least(greatest((close - least((tk + kj) / 2, sb)) / greatest(abs((tk + kj) / 2 - sb), {_E}), -2), 3) END AS ichimoku_cloud_pos,
      CASE WHEN hi IS NOT NULL THEN least(greatest((close - lo) / greatest(hi - lo, {_E}), 0), 1) END AS donchian_pos,
      tanh((close - (high + low + close) / 3) / ((high + low + close) / 3) * 100) AS pivot_dist FROM h1)""",
)
_W20 = ["ichimoku_tk_cross", "ichimoku_cloud_pos", "donchian_pos", "pivot_dist"]


@query("w20_channels", with_(BARS, *_CHANNEL_CTES, select="SELECT sym, dt, " + ", ".join(f"{r(c)} AS {c}" for c in _W20) + " FROM channels"))
def w20(spark, sf):
    return _keep(patterns.channels(t.bars(spark, sf)), _W20)


_KELT_CTES = (
    f"ks AS (SELECT sym, dt, close, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) + 0 * {lag('close')} AS tr, row_number() OVER (PARTITION BY sym ORDER BY dt) AS n FROM bars)",
    f"""ke AS (SELECT DISTINCT sym, CAST(0 AS BIGINT) AS n, CAST(NULL AS DATE) AS dt, CAST(NULL AS DOUBLE) AS close, CAST(NULL AS DOUBLE) AS e, CAST(NULL AS DOUBLE) AS a FROM ks
      UNION ALL SELECT s.sym, s.n, s.dt, s.close, {_ema('p.e', 's.close', '(2.0 / 21)')}, {_ema('p.a', 's.tr', '(2.0 / 21)')}
      FROM ke p JOIN ks s ON s.sym = p.sym AND s.n = p.n + 1)""",
    f"kelt AS (SELECT sym, dt, CASE WHEN a IS NOT NULL THEN least(greatest((close - e) / greatest(2 * a, {_E}), -3), 3) END AS keltner_pos FROM ke WHERE n > 0)",
)


@query("w21_keltner", with_(BARS, *_KELT_CTES, select=f"SELECT sym, dt, {r('keltner_pos')} AS keltner_pos FROM kelt"))
def w21(spark, sf):
    return _keep(recursive.keltner(_prices(spark, sf)), ["keltner_pos"])


_RANGE_CTES = (
    "g1 AS (SELECT *, 0.5 * ln(high / low) ^ 2 - (2 * ln(2) - 1) * ln(close / open) ^ 2 AS gk, ln(high / low) ^ 2 / (4 * ln(2)) AS pk, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs FROM bars)",
    "g2 AS (SELECT *, sqrt(greatest(gk, 0) * 252) AS gk_vol FROM g1)",
    f"ranges AS (SELECT sym, dt, gk_vol, sqrt(greatest(pk, 0) * 252) AS parkinson_vol, sqrt(greatest(rs, 0) * 252) AS rogers_satchell, {roll('stddev_samp', 'gk_vol', 20, 10)} AS vol_of_vol FROM g2)",
)
_W22 = ["gk_vol", "parkinson_vol", "rogers_satchell", "vol_of_vol"]


@query("w22_range_vols", with_(BARS, *_RANGE_CTES, select="SELECT sym, dt, " + ", ".join(f"{r(c)} AS {c}" for c in _W22) + " FROM ranges"))
def w22(spark, sf):
    return _keep(patterns.range_vols(t.bars(spark, sf)), _W22)


_LIQ_CTES = (
    f"q1 AS (SELECT *, {lag('close')} AS pc, close / {lag('close')} - 1 AS ret, high - low AS rg FROM bars)",
    f"q2 AS (SELECT *, ret * {lag('ret')} AS cross_ret, abs(ret) / sqrt(volume) AS imp FROM q1)",
    f"""liq AS (SELECT sym, dt, ln(1 + abs(ret) / (volume * close) * 1e9) AS amihud_illiq, ln(1 + {roll('avg', 'imp', 20, 10)} * 1e6) AS kyle_lambda,
      CASE WHEN {roll('avg', 'cross_ret', 20, 10)} < 0 THEN 2 * sqrt(-{roll('avg', 'cross_ret', 20, 10)}) END AS roll_spread,
      least(greatest((2 * close - low - high) / greatest(rg, {_E}), -1), 1) AS close_loc_value,
      tanh((open - pc) / pc * 50) AS gap_open,
      ln(1 + greatest(rg, {_E}) / CASE WHEN {roll('avg', 'rg', 20, 10)} IS NOT NULL THEN greatest({roll('avg', 'rg', 20, 10)}, {_E}) END) AS range_expansion FROM q2)""",
)
_W23 = ["amihud_illiq", "kyle_lambda", "roll_spread", "close_loc_value", "gap_open", "range_expansion"]


@query("w23_liquidity", with_(BARS, *_LIQ_CTES, select="SELECT sym, dt, " + ", ".join(f"{r(c)} AS {c}" for c in _W23) + " FROM liq"))
def w23(spark, sf):
    return _keep(patterns.liquidity(t.bars(spark, sf)), _W23)


_ALL = patterns.CANDLES + patterns.CHANNELS + patterns.MICRO


@query(
    "w24_pattern_features",
    with_(
        BARS, *_CANDLE_CTES, *_CHANNEL_CTES, *_KELT_CTES, *_RANGE_CTES, *_LIQ_CTES,
        select="SELECT sym, dt, " + ", ".join(f"{r(c)} AS {c}" for c in _ALL)
        + " FROM candles JOIN channels USING (sym, dt) JOIN kelt USING (sym, dt) JOIN ranges USING (sym, dt) JOIN liq USING (sym, dt)",
    ),
)
def w24(spark, sf):
    return _keep(patterns.pattern_features(_prices(spark, sf, "open", "volume")), _ALL)


@query(
    "w29_regime_variable",
    with_(BARS, RET, select=f"SELECT sym, dt, {r('ln(nullif(' + roll('stddev_samp', 'ret', 5) + ', 0) / nullif(' + roll('stddev_samp', 'ret', 20) + ', 0))')} AS regime FROM rets"),
)
def w29(spark, sf):
    return _keep(technical.regime_variable(t.bars(spark, sf)), ["regime"])


DELIV = """deliv AS (SELECT b.*, d.delivered FROM bars b JOIN (SELECT CAST(l_suppkey AS BIGINT) AS sym, CAST(l_shipdate AS DATE) AS dt,
  sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS delivered FROM lineitem GROUP BY 1, 2) d USING (sym, dt))"""


@query(
    "w30_delivery",
    with_(
        BARS,
        DELIV,
        "f AS (SELECT sym, dt, least(greatest(delivered / volume, 0), 1) AS deliv_pct, ln(volume / trades) AS avg_trade_size_log, ln(nullif(delivered, 0)) AS ld FROM deliv)",
        select=f"""SELECT sym, dt, {r('deliv_pct')} AS deliv_pct, {r(z('deliv_pct', 60, 20, skip=1))} AS deliv_pct_z, {r('avg_trade_size_log')} AS avg_trade_size_log,
        {r(z('avg_trade_size_log', 60, 20, skip=1))} AS avg_trade_size_z, {r(z('ld', 60, 20, skip=1))} AS deliv_qty_z FROM f""",
    ),
)
def w30(spark, sf):
    rows = t.fills(spark, sf, extra=("l_returnflag",))
    # one pass over the fills gives the bars and the delivered part
    panel = rows.groupBy("sym", "dt").agg(
        F.sum("qty").alias("volume"),
        F.count(F.lit(1)).alias("trades"),
        F.sum(F.when(F.col("l_returnflag") == "N", F.col("qty")).otherwise(0.0)).alias("delivered"),
    )
    names = ["deliv_pct", "deliv_pct_z", "avg_trade_size_log", "avg_trade_size_z", "deliv_qty_z"]
    return _keep(technical.delivery_features(panel), names)


@query(
    "w31_kalman_fill",
    with_(
        q.BARS10, q.CAL, q.DENSE,
        "k AS (SELECT sym, dt, close, row_number() OVER (PARTITION BY sym ORDER BY dt) AS n FROM dense)",
        """f AS (SELECT sym, CAST(0 AS BIGINT) AS n, CAST(NULL AS DATE) AS dt, close AS x, CAST(1 AS DOUBLE) AS p FROM k WHERE n = 1
          UNION ALL SELECT k.sym, k.n, k.dt, CASE WHEN k.close IS NULL THEN f.x ELSE f.x + (f.p + 1e-3) / (f.p + 1e-3 + 0.1) * (k.close - f.x) END,
          CASE WHEN k.close IS NULL THEN f.p + 1e-3 ELSE (1 - (f.p + 1e-3) / (f.p + 1e-3 + 0.1)) * (f.p + 1e-3) END
          FROM f JOIN k ON k.sym = f.sym AND k.n = f.n + 1)""",
        select=f"SELECT sym, dt, {r('x', 4)} AS filled FROM f WHERE n > 0",
    ),
)
def w31(spark, sf):
    grid = t.dense_panel(t.saved_bars(spark, sf, 10)).select("sym", "dt", "close")
    return _keep(recursive.kalman_fill(grid, "close", "filled"), ["filled"], 4)


@query(
    "w32_flow_proxy",
    with_(
        BARS,
        """p AS (SELECT sym, dt, sign(close - open) * 0.6 + ((least(open, close) - low) - (high - greatest(open, close)))
          / ((high - greatest(open, close)) + (least(open, close) - low) + 1e-8) * 0.4 AS flow FROM bars)""",
        f"l AS (SELECT *, list(flow) {over(20)} AS h FROM p)",
        f"w AS (SELECT *, [exp(-2 + i * 2.0 / greatest(len(h) - 1, 1)) FOR i IN range(len(h))] AS wt FROM l)",
        select=f"SELECT sym, dt, {r('flow')} AS flow, {r('CASE WHEN len(h) >= 5 THEN list_dot_product(h, wt) / list_sum(wt) ELSE 0 END')} AS flow_cum FROM w",
    ),
)
def w32(spark, sf):
    return _keep(technical.flow_proxy(t.bars(spark, sf)), ["flow", "flow_cum"])


@query(
    "w40_annual_vol",
    with_(BARS, RET, f"v AS (SELECT sym, dt, {roll('stddev_samp', 'ret', 20)} * sqrt(252) AS vol FROM rets)", select=f"SELECT sym, dt, {r('CASE WHEN vol > 0 THEN vol ELSE 0.15 END')} AS ann_vol FROM v"),
)
def w40(spark, sf):
    return _keep(technical.annual_vol(t.bars(spark, sf)), ["ann_vol"])
