"""Filter, validity and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.functions.cols import rnd
from barline.operators import quality as ql

from barline.plans.ansi import BARS, BARS10, CAL, DENSE, TICKS, lag, r, with_
from barline.plans.registry import query
from barline.sources import tables as t


LISTED = """listed AS (SELECT CAST(l_suppkey AS BIGINT) AS sym, CAST(l_shipdate AS DATE) AS dt, l_quantity AS qty,
  CASE WHEN l_linestatus = 'O' THEN ' EQ ' ELSE 'BE' END AS series, CASE WHEN l_returnflag = 'A' THEN 'FUT' ELSE 'STK' END AS instrument,
  CASE WHEN year(l_shipdate) < 1997 THEN '--' WHEN l_suppkey % 3 = 0 THEN 'INF' || CAST(l_partkey AS VARCHAR) ELSE 'INE' || CAST(l_partkey AS VARCHAR) END AS isin
  FROM lineitem)"""


def listed(spark, sf):
    """Listing columns as the venue files carry them; ISINs appear from 1997 on."""
    li = t.table(spark, sf, "lineitem")
    part = F.col("l_partkey").cast("string")
    return li.select(
        F.col("l_suppkey").cast("bigint").alias("sym"),
        F.col("l_shipdate").cast("date").alias("dt"),
        F.col("l_quantity").alias("qty"),
        F.when(F.col("l_linestatus") == "O", " EQ ").otherwise("BE").alias("series"),
        F.when(F.col("l_returnflag") == "A", "FUT").otherwise("STK").alias("instrument"),
        F.when(F.year("l_shipdate") < 1997, F.lit("--"))
        .when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("INF"), part))
        .otherwise(F.concat(F.lit("INE"), part))
        .alias("isin"),
    )


@query(
    "f01_equity_filter",
    with_(
        LISTED,
        "eq AS (SELECT * FROM listed WHERE trim(series) = 'EQ' AND trim(instrument) = 'STK')",
        "has AS (SELECT dt, bool_or(isin LIKE 'IN%') AS h FROM eq GROUP BY dt)",
        select="""SELECT dt, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT sym) AS BIGINT) AS names, round(sum(qty), 4) AS qty
          FROM eq JOIN has USING (dt) WHERE NOT h OR isin LIKE 'INE%' GROUP BY dt""",
    ),
)
def f01(spark, sf):
    return ql.equities_only(listed(spark, sf)).groupBy("dt").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("sym").alias("names"), F.round(F.sum("qty"), 4).alias("qty")
    )


_QUOTE = "CASE WHEN l_tax = 0 THEN 0.0 WHEN l_discount = 0 THEN CAST('NaN' AS DOUBLE) WHEN l_tax = 0.08 THEN -l_extendedprice ELSE l_extendedprice / l_quantity END"


def _quotes(spark, sf):
    """Prints with zero, negative and non-finite prices among them."""
    li = t.table(spark, sf, "lineitem")
    px = (
        F.when(F.col("l_tax") == 0, F.lit(0.0))
        .when(F.col("l_discount") == 0, F.lit(float("nan")))
        .when(F.col("l_tax") == 0.08, -F.col("l_extendedprice"))
        .otherwise(F.col("l_extendedprice") / F.col("l_quantity"))
    )
    return li.select(
        F.col("l_suppkey").cast("bigint").alias("sym"), F.col("l_shipdate").cast("date").alias("dt"), px.alias("px")
    )


@query(
    "f02_price_validity",
    with_(
        f"v AS (SELECT CAST(l_suppkey AS BIGINT) AS sym, CAST(l_shipdate AS DATE) AS dt, {_QUOTE} AS px FROM lineitem)",
        "w AS (SELECT sym, dt, CASE WHEN isnan(px) OR px <= 0 THEN NULL ELSE px END AS px FROM v)",
        select=f"SELECT sym, dt, CAST(count(*) AS BIGINT) AS prints, CAST(count(px) AS BIGINT) AS valid, {r('max(px)', 8)} AS high, {r('min(px)', 8)} AS low FROM w GROUP BY sym, dt",
    ),
)
def f02(spark, sf):
    rows = _quotes(spark, sf).withColumn("px", ql.valid_price("px"))
    return rows.groupBy("sym", "dt").agg(
        F.count(F.lit(1)).alias("prints"), F.count("px").alias("valid"), rnd(F.max("px"), 8).alias("high"), rnd(F.min("px"), 8).alias("low")
    )


_THIN = "CASE WHEN l_returnflag = 'A' AND l_discount > 0.07 AND l_tax > 0.06 THEN l_extendedprice / l_quantity END"


@query(
    "f03_live_sessions",
    with_(
        f"p AS (SELECT CAST(l_suppkey AS BIGINT) AS sym, CAST(l_shipdate AS DATE) AS dt, max({_THIN}) AS close FROM lineitem GROUP BY 1, 2)",
        select="""SELECT dt, CAST(count(*) AS BIGINT) AS cells, CAST(count(close) AS BIGINT) AS live FROM p
          WHERE sym IN (SELECT sym FROM p WHERE close IS NOT NULL) GROUP BY dt HAVING count(close) > 0""",
    ),
)
def f03(spark, sf):
    li = t.table(spark, sf, "lineitem")
    thin = (F.col("l_returnflag") == "A") & (F.col("l_discount") > 0.07) & (F.col("l_tax") > 0.06)
    panel = li.groupBy(F.col("l_suppkey").cast("bigint").alias("sym"), F.col("l_shipdate").cast("date").alias("dt")).agg(
        F.max(F.when(thin, F.col("l_extendedprice") / F.col("l_quantity"))).alias("close")
    )
    # symbols without any price are named by `require_live_symbols`; here they leave quietly
    named = panel.join(panel.where(F.col("close").isNotNull()).select("sym").distinct(), "sym", "left_semi")
    out = ql.live_sessions(ql.require_live_symbols(named))
    return out.groupBy("dt").agg(F.count(F.lit(1)).alias("cells"), F.count("close").alias("live"))


_SIGNED = "CASE l_returnflag WHEN 'R' THEN -l_quantity WHEN 'A' THEN 0.0 ELSE l_quantity END"


def _signed(spark, sf):
    li = t.table(spark, sf, "lineitem")
    v = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).when(F.col("l_returnflag") == "A", 0.0).otherwise(F.col("l_quantity"))
    return li.groupBy(F.col("l_suppkey").cast("bigint").alias("sym"), F.col("l_shipdate").cast("date").alias("dt")).agg(
        F.sum(v).alias("volume")
    )


_SIGNED_CTE = f"sv AS (SELECT CAST(l_suppkey AS BIGINT) AS sym, CAST(l_shipdate AS DATE) AS dt, sum({_SIGNED}) AS volume FROM lineitem GROUP BY 1, 2)"


@query("f04_volume_sign", with_(_SIGNED_CTE, select="SELECT sym, dt, CASE WHEN volume >= 0 THEN round(volume, 4) END AS volume FROM sv"))
def f04(spark, sf):
    return _signed(spark, sf).select("sym", "dt", F.round(ql.valid_volume("volume"), 4).alias("volume"))


@query(
    "f05_live_span",
    with_(
        BARS, CAL, DENSE,
        select="SELECT sym, min(dt) AS first_dt, max(dt) AS last_dt, CAST(count(*) AS BIGINT) AS sessions, CAST(count(close) AS BIGINT) AS prints FROM dense GROUP BY sym",
    ),
)
def f05(spark, sf):
    panel = t.saved_bars(spark, sf)
    grid = ql.live_span(t.dense_panel(panel))
    return grid.groupBy("sym").agg(
        F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"),
        F.count(F.lit(1)).alias("sessions"), F.count("close").alias("prints"),
    )


@query(
    "f06_coverage",
    with_(
        BARS,
        "n AS (SELECT count(DISTINCT dt) AS n FROM bars)",
        "g AS (SELECT sym FROM bars, n GROUP BY sym, n.n HAVING count(close) / n.n >= 0.2)",
        select=f"SELECT sym, CAST(count(*) AS BIGINT) AS prints, {r('avg(close)', 4)} AS mean_close FROM bars SEMI JOIN g USING (sym) GROUP BY sym",
    ),
)
def f06(spark, sf):
    return ql.keep_covered(t.saved_bars(spark, sf), 0.2).groupBy("sym").agg(
        F.count(F.lit(1)).alias("prints"), rnd(F.avg("close"), 4).alias("mean_close")
    )


@query(
    "f07_breadth",
    with_(
        BARS,
        select="""SELECT dt, CAST(count(close) AS BIGINT) AS n_live, round(sum(volume), 4) AS volume FROM bars GROUP BY dt
          HAVING count(close) >= greatest(2, ceil(0.22 * (SELECT count(DISTINCT sym) FROM bars)))""",
    ),
)
def f07(spark, sf):
    kept = ql.keep_broad(t.saved_bars(spark, sf), 0.22)
    return kept.groupBy("dt").agg(F.max("n_live").alias("n_live"), F.round(F.sum("volume"), 4).alias("volume"))


@query(
    "f08_clean_returns",
    with_(
        BARS10, CAL, DENSE,
        f"rr AS (SELECT sym, dt, ln(close / {lag('close')}) AS ret FROM dense)",
        "g AS (SELECT sym FROM rr GROUP BY sym HAVING 1 - count(ret) / (SELECT count(DISTINCT dt) FROM rr) <= 0.5)",
        "k AS (SELECT * FROM rr SEMI JOIN g USING (sym))",
        "d AS (SELECT dt FROM k GROUP BY dt HAVING count(ret) = (SELECT count(*) FROM g))",
        select=f"SELECT sym, dt, {r('ret')} AS ret FROM k SEMI JOIN d USING (dt)",
    ),
)
def f08(spark, sf):
    out = ql.clean_returns(t.dense_panel(t.saved_bars(spark, sf, 10)))
    return out.select("sym", "dt", rnd("ret").alias("ret"))


@query(
    "f09_warmup_trim",
    with_(
        BARS10, CAL, DENSE,
        select="SELECT sym, dt, bar_idx, round(close, 8) AS close FROM dense WHERE bar_idx >= 60 AND bar_idx < (SELECT max(bar_idx) FROM dense)",
    ),
)
def f09(spark, sf):
    out = ql.trim_warmup(t.dense_panel(t.saved_bars(spark, sf, 10)))
    return out.select("sym", "dt", "bar_idx", rnd("close", 8).alias("close"))


_VENUE = "SELECT CAST(l_suppkey % 10 AS BIGINT) AS sym, CAST(l_shipdate AS DATE) AS dt, avg(l_extendedprice / l_quantity) AS close FROM lineitem WHERE l_linestatus = '{}' GROUP BY 1, 2"


def _venue(spark, sf, status):
    rows = t.fills(spark, sf, 10, extra=("l_linestatus",)).where(F.col("l_linestatus") == status)
    return rows.groupBy("sym", "dt").agg(F.avg("px").alias("close"))


@query(
    "f10_source_disagreement",
    with_(
        f"a AS ({_VENUE.format('O')})", f"b AS ({_VENUE.format('F')})",
        "m AS (SELECT count(*) AS cells, max(abs(a.close - b.close) / (abs(a.close) + 1e-9)) AS d FROM a JOIN b USING (sym, dt))",
        select=f"SELECT CAST(cells AS BIGINT) AS cells, {r('d')} AS max_diff, d > 0.01 AS flagged FROM m",
    ),
)
def f10(spark, sf):
    out = ql.source_disagreement(_venue(spark, sf, "O"), _venue(spark, sf, "F"))
    return out.select("cells", rnd("max_diff").alias("max_diff"), "flagged")


@query(
    "f11_source_priority",
    with_(
        "s AS (SELECT CAST(l_suppkey AS BIGINT) AS sym, CAST(l_shipdate AS DATE) AS dt, CASE l_returnflag WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS priority, max(l_extendedprice / l_quantity) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2, 3)",
        select=f"SELECT sym, dt, priority, {r('close', 8)} AS close, round(volume, 4) AS volume FROM s QUALIFY row_number() OVER (PARTITION BY sym, dt ORDER BY priority) = 1",
    ),
)
def f11(spark, sf):
    rows = t.fills(spark, sf, extra=("l_returnflag",))
    prio = F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "R", 2).otherwise(3)
    src = rows.groupBy("sym", "dt", prio.alias("priority")).agg(F.max("px").alias("close"), F.sum("qty").alias("volume"))
    out = ql.first_source(src, "priority", ["close", "volume"])
    return out.select("sym", "dt", "priority", rnd("close", 8).alias("close"), F.round("volume", 4).alias("volume"))


_N_VOL = "CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0.0 END"
_NV = f"nv AS (SELECT CAST(l_suppkey AS BIGINT) AS sym, CAST(l_shipdate AS DATE) AS dt, sum({_N_VOL}) AS volume FROM lineitem GROUP BY 1, 2)"
_RUN = "nr AS (SELECT *, sum(CASE WHEN volume = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY sym ORDER BY dt ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS z FROM {})"
_ILL = "ill AS (SELECT sym, max(z) >= 3 AS is_illiquid, coalesce(quantile_cont(CASE WHEN volume > 0 THEN volume END, 0.5), 1.0) AS median_volume FROM nr GROUP BY sym)"


def _n_volume(spark, sf):
    rows = t.fills(spark, sf, extra=("l_returnflag",))
    v = F.when(F.col("l_returnflag") == "N", F.col("qty")).otherwise(0.0)
    return rows.groupBy("sym", "dt").agg(F.sum(v).alias("volume"))


@query(
    "f12_cleaning_flags",
    with_(
        BARS, CAL, DENSE,
        "c AS (SELECT sym, dt, close, coalesce(volume, 0.0) AS volume FROM dense)",
        _RUN.format("c"), _ILL,
        "s AS (SELECT sym, 1 - count(close) / count(*) AS missing, sum(volume) AS vol FROM c GROUP BY sym)",
        select=f"""SELECT sym, {r('missing')} AS missing, CASE WHEN missing > 0.79 THEN 'dropped' ELSE
          concat_ws(';', CASE WHEN missing > 0 THEN 'repaired' END, CASE WHEN vol = 0 THEN 'illiquid' WHEN is_illiquid THEN 'illiquid_periods' END) END AS flags
          FROM s JOIN ill USING (sym)""",
    ),
)
def f12(spark, sf):
    out = ql.cleaning_flags(t.dense_panel(t.saved_bars(spark, sf)), max_missing=0.79)
    return out.select("sym", rnd("missing").alias("missing"), F.concat_ws(";", "flags").alias("flags"))


@query("f13_illiquid_run", with_(_NV, _RUN.format("nv"), _ILL, select="SELECT sym, is_illiquid, round(median_volume, 4) AS median_volume FROM ill"))
def f13(spark, sf):
    return ql.illiquid_flags(_n_volume(spark, sf)).withColumn("median_volume", F.round("median_volume", 4))


@query(
    "f14_fill_volume",
    with_(_NV, _RUN.format("nv"), _ILL, select="SELECT sym, dt, round(CASE WHEN volume > 0 THEN volume ELSE median_volume END, 4) AS volume_filled, is_illiquid FROM nv JOIN ill USING (sym)"),
)
def f14(spark, sf):
    return ql.fill_volume(_n_volume(spark, sf)).select("sym", "dt", F.round("volume_filled", 4).alias("volume_filled"), "is_illiquid")


@query(
    "f15_flash_crash",
    with_(
        BARS,
        f"x AS (SELECT sym, close / {lag('close')} - 1 AS ret, row_number() OVER (PARTITION BY sym ORDER BY dt DESC) AS k FROM bars)",
        select=f"SELECT sym, {r('min(ret)')} AS worst, coalesce(bool_or(ret < -0.2), false) AS flash_crash FROM x WHERE k <= 5 GROUP BY sym",
    ),
)
def f15(spark, sf):
    return ql.flash_crash(t.bars(spark, sf)).select("sym", rnd("worst").alias("worst"), "flash_crash")


QUOTES = f"""quotes AS (SELECT *, px - (CAST(qty AS BIGINT) % 5) / 100.0 AS bid, px + (CAST(qty AS BIGINT) % 7 - 2) / 100.0 AS ask FROM ticks)"""


def quotes(spark, sf, books=10):
    """Ticks with a bid and an ask around the print; some cross."""
    k = F.col("qty").cast("bigint")
    return t.ticks(spark, sf, books).withColumns({"bid": F.col("px") - (k % 5) / 100.0, "ask": F.col("px") + (k % 7 - 2) / 100.0})


@query(
    "f16_spread_repair",
    with_(TICKS, QUOTES, select=f"SELECT event_id, {r('bid')} AS bid, {r('CASE WHEN ask < bid THEN bid * 1.001 ELSE ask END')} AS ask_fixed, ask < bid AS crossed FROM quotes"),
)
def f16(spark, sf):
    out = ql.repair_spread(quotes(spark, sf))
    return out.select("event_id", rnd("bid").alias("bid"), rnd("ask_fixed").alias("ask_fixed"), "crossed")


@query("f17_utc_time", "SELECT event_id, CAST(epoch_us(ts - INTERVAL 330 MINUTE) AS BIGINT) AS utc_us FROM events")
def f17(spark, sf):
    ev = t.table(spark, sf, "events")
    # the clock reading is taken as local exchange time (five and a half hours ahead)
    wall = F.unix_micros(ql.local_to_utc(F.col("ts").cast("timestamp"), "Asia/Kolkata"))
    return ev.select("event_id", wall.alias("utc_us"))


@query(
    "f18_split",
    with_(
        BARS,
        select="SELECT sym, CASE WHEN dt < DATE '1999-01-01' THEN 'train' ELSE 'test' END AS side, CAST(count(*) AS BIGINT) AS n, max(dt) AS last_dt FROM bars GROUP BY 1, 2",
    ),
)
def f18(spark, sf):
    train, test = ql.split_at(t.bars(spark, sf), "1999-01-01")
    both = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return both.groupBy("sym", "side").agg(F.count(F.lit(1)).alias("n"), F.max("dt").alias("last_dt"))


_EDGES = """{n} AS (SELECT x.sym AS a, y.sym AS b, covar_pop(x.ret, y.ret) / sqrt(var_pop(x.ret) * var_pop(y.ret)) AS corr
  FROM rr x JOIN rr y ON x.dt = y.dt AND x.sym < y.sym WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL AND x.dt {op} DATE '1999-01-01' GROUP BY 1, 2)"""


@query(
    "f19_edge_leakage",
    with_(
        BARS10, f"rr AS (SELECT sym, dt, close / {lag('close')} - 1 AS ret FROM bars)",
        _EDGES.format(n="tr", op="<"), _EDGES.format(n="te", op=">="),
        "m AS (SELECT count(*) AS test_edges, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.a = te.a AND tr.b = te.b AND abs(tr.corr) > 0.02)) AS novel FROM te WHERE abs(corr) > 0.02)",
        select=f"SELECT CAST(test_edges AS BIGINT) AS test_edges, CAST(novel AS BIGINT) AS novel, {r('coalesce(novel / nullif(test_edges, 0), 0)')} AS share, coalesce(novel / nullif(test_edges, 0), 0) <= 0.1 AS passed FROM m",
    ),
)
def f19(spark, sf):
    from barline.operators.technical import returns

    rets = returns(t.bars(spark, sf, books=10)).select("sym", "dt", "ret")
    train, test = ql.split_at(rets, "1999-01-01")
    names = list(range(10))
    out = ql.novel_edge_share(ql.pair_correlations(train, names), ql.pair_correlations(test, names), limit=0.02)
    return out.withColumn("share", rnd("share"))


@query(
    "f20_order_sanity",
    with_(
        BARS,
        f"o AS (SELECT sym, dt, close, {lag('close')} AS last, volume / 100 - 0.25 AS weight FROM bars)",
        select=f"SELECT sym, dt, CASE WHEN last > 0 AND close > 0 AND abs(close - last) / last > 0.2 THEN 'price' WHEN abs(weight) > 0.25 THEN 'weight' END AS reason FROM o",
    ),
)
def f20(spark, sf):
    from barline.functions.cols import by_sym

    orders = t.bars(spark, sf).withColumns({"last": F.lag("close").over(by_sym()), "weight": F.col("volume") / 100 - 0.25})
    return orders.select("sym", "dt", ql.order_reason("close", "last", "weight").alias("reason"))


@query(
    "f21_stale_feeds",
    """WITH f AS (SELECT event_type || '-' || CAST(user_id AS VARCHAR) AS feed, max(ts) AS newest, count(*) AS items FROM events GROUP BY 1)
    SELECT feed, CAST(items AS BIGINT) AS items, round(date_diff('microsecond', newest, TIMESTAMP '2024-02-01 00:00:00') / 86400000000.0, 6) AS age_days,
    date_diff('microsecond', newest, TIMESTAMP '2024-02-01 00:00:00') / 86400000000.0 > 3.0 AS stale FROM f""",
)
def f21(spark, sf):
    ev = t.table(spark, sf, "events").select(
        F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("feed"), F.col("ts").cast("timestamp").alias("published")
    )
    out = ql.stale_feeds(ev, F.lit("2024-02-01 00:00:00").cast("timestamp"), 3.0)
    return out.select("feed", "items", rnd("age_days").alias("age_days"), "stale")


@query(
    "f22_outcome_gate",
    """WITH g AS (SELECT CAST(ts AS DATE) AS grp, count(*) AS attempts, sum(CASE WHEN event_type IN ('error') THEN 1 ELSE 0 END) AS unresolved FROM events GROUP BY 1)
    SELECT grp, CAST(attempts AS BIGINT) AS attempts, CAST(unresolved AS BIGINT) AS unresolved, round(unresolved / attempts, 6) AS share, unresolved / attempts <= 0.2 AS passed FROM g""",
)
def f22(spark, sf):
    log = t.table(spark, sf, "events").select(F.col("ts").cast("date").alias("grp"), F.col("event_type").alias("reason"))
    return ql.outcome_gate(log, ("error",), 0.2).withColumn("share", rnd("share"))


_U = "(CAST(('0x' || substr(md5('991{sep}' || sym || '{sep}' || dt), 1, 13)) AS BIGINT) + 0.5) / pow(16.0, 13)"


@query(
    "f23_control_channels",
    with_(
        BARS,
        "days AS (SELECT dt, row_number() OVER (ORDER BY dt) AS at, row_number() OVER (ORDER BY md5('991-' || dt), dt) AS src FROM (SELECT DISTINCT dt FROM bars))",
        "mv AS (SELECT a.dt, b.dt AS src_dt FROM days a JOIN days b ON a.at = b.src)",
        select=f"""SELECT b.sym, b.dt, {r('s.close', 8)} AS control_shuffled, {r("sqrt(-2 * ln(" + _U.format(sep='-').replace('sym', 'b.sym').replace('dt', 'b.dt') + ")) * cos(2 * pi() * " + _U.format(sep='+').replace('sym', 'b.sym').replace('dt', 'b.dt') + ")")} AS control_noise
          FROM bars b JOIN mv USING (dt) LEFT JOIN bars s ON s.sym = b.sym AND s.dt = mv.src_dt""",
    ),
)
def f23(spark, sf):
    out = ql.control_channels(t.saved_bars(spark, sf), "close")
    return out.select("sym", "dt", rnd("control_shuffled", 8).alias("control_shuffled"), rnd("control_noise").alias("control_noise"))


@query(
    "f23_channel_coverage",
    with_(
        BARS,
        f"x AS (SELECT close / {lag('close')} - 1 AS ret, CASE WHEN trades > 2 THEN close END AS busy, CASE WHEN trades > 9 THEN close END AS crowded FROM bars)",
        "c AS (SELECT 'ret' AS channel, count(ret) / count(*) AS coverage FROM x UNION ALL SELECT 'busy', count(busy) / count(*) FROM x UNION ALL SELECT 'crowded', count(crowded) / count(*) FROM x)",
        select=f"SELECT channel, {r('coverage')} AS coverage, coverage >= 0.05 AS kept FROM c",
    ),
)
def f23c(spark, sf):
    from barline.operators.technical import returns

    panel = returns(t.bars(spark, sf)).withColumns(
        {"busy": F.when(F.col("trades") > 2, F.col("close")), "crowded": F.when(F.col("trades") > 9, F.col("close"))}
    )
    return ql.channel_coverage(panel, ["ret", "busy", "crowded"]).withColumn("coverage", rnd("coverage"))


@query(
    "f24_market_open",
    """SELECT CAST(ts AS DATE) AS dt, isodow(ts) < 6 AND strftime(ts, '%H:%M') BETWEEN '09:15' AND '15:30' AS is_open, CAST(count(*) AS BIGINT) AS n
    FROM events GROUP BY 1, 2""",
)
def f24(spark, sf):
    ev = t.table(spark, sf, "events")
    return ev.groupBy(F.col("ts").cast("date").alias("dt"), ql.market_open("ts").alias("is_open")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "f25_plain_symbols",
    "SELECT CAST(s_suppkey AS BIGINT) AS sym, upper(s_name) AS plain FROM supplier",
)
def f25(spark, sf):
    tail = F.element_at(F.array(*[F.lit(x) for x in (".NS", ".bo", ".NSE", ".bse", "")]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    raw = F.concat(F.lit(" "), F.lower("s_name"), tail, F.lit(" "))
    return t.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("bigint").alias("sym"), ql.plain_symbol(raw).alias("plain"))


