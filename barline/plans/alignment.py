"""Joins, alignment, corporate actions and event features."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.functions.cols import by_sym, rnd
from barline.operators import adjust, alignment as al, technical
from barline.plans.ansi import BARS, BARS10, CAL, DENSE, lag, over, r, with_, z
from barline.plans.registry import query
from barline.plans.windows import DELIV
from barline.sources import tables as t

# ---- corporate actions ---------------------------------------------------------------------------

_SUBJECT_SQL = """CASE o_orderkey % 7 WHEN 0 THEN 'Bonus issue ' || CAST(o_orderkey % 3 + 1 AS VARCHAR) || ':' || '2'
  WHEN 1 THEN 'Face Value Split (Sub-Division) - From Rs 10/- Per Share To Rs 2/- Per Share'
  WHEN 2 THEN 'Interim Dividend - Rs ' || CAST(o_orderkey % 9 + 1 AS VARCHAR) || '.50 Per Share'
  WHEN 3 THEN 'Scheme Of Arrangement' WHEN 4 THEN 'Annual General Meeting' WHEN 5 THEN 'Dividend Re 0.75' ELSE 'Demerger / Dividend Rs 2' END"""
ACTIONS = f"""actions AS (
  SELECT sym, dt, seq, subject, kind,
    CASE kind WHEN 'bonus' THEN b2 / (b1 + b2) WHEN 'split' THEN s2 / s1 ELSE 1.0 END AS price_ratio,
    CASE WHEN kind = 'dividend' THEN d ELSE 0.0 END AS dividend
  FROM (SELECT *, CASE WHEN regexp_matches(subject, '(?i)demerger|de-merger|arrangement|spin\\s*-?\\s*off') THEN 'demerger'
      WHEN b1 > 0 AND b2 > 0 THEN 'bonus' WHEN s1 > 0 AND s2 > 0 THEN 'split' WHEN d IS NOT NULL THEN 'dividend' ELSE 'other' END AS kind
    FROM (SELECT sym, dt, seq, subject,
        TRY_CAST(regexp_extract(subject, '(?i)bonus\\D*(\\d+)\\s*:\\s*(\\d+)', 1) AS DOUBLE) AS b1,
        TRY_CAST(regexp_extract(subject, '(?i)bonus\\D*(\\d+)\\s*:\\s*(\\d+)', 2) AS DOUBLE) AS b2,
        TRY_CAST(regexp_extract(subject, '(?is)split.*?\\bfrom\\b\\D*?([\\d.]+)\\D*?\\bto\\b\\D*?([\\d.]+)', 1) AS DOUBLE) AS s1,
        TRY_CAST(regexp_extract(subject, '(?is)split.*?\\bfrom\\b\\D*?([\\d.]+)\\D*?\\bto\\b\\D*?([\\d.]+)', 2) AS DOUBLE) AS s2,
        TRY_CAST(regexp_extract(subject, '(?i)dividend\\D*(?:rs\\.?|re\\.?)\\s*([\\d.]+)', 1) AS DOUBLE) AS d
      FROM (SELECT CAST(o_custkey % 10 AS BIGINT) AS sym, CAST(o_orderdate AS DATE) AS dt, o_orderkey AS seq, {_SUBJECT_SQL} AS subject FROM orders))))"""


def actions(spark, sf):
    """Every order as an announced action of its basket."""
    o = t.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    pick = k % 7
    subject = (
        F.when(pick == 0, F.concat(F.lit("Bonus issue "), (k % 3 + 1).cast("string"), F.lit(":2")))
        .when(pick == 1, F.lit("Face Value Split (Sub-Division) - From Rs 10/- Per Share To Rs 2/- Per Share"))
        .when(pick == 2, F.concat(F.lit("Interim Dividend - Rs "), (k % 9 + 1).cast("string"), F.lit(".50 Per Share")))
        .when(pick == 3, F.lit("Scheme Of Arrangement"))
        .when(pick == 4, F.lit("Annual General Meeting"))
        .when(pick == 5, F.lit("Dividend Re 0.75"))
        .otherwise(F.lit("Demerger / Dividend Rs 2"))
    )
    rows = o.select(
        (F.col("o_custkey") % 10).cast("bigint").alias("sym"),
        F.col("o_orderdate").cast("date").alias("dt"),
        k.alias("seq"),
        subject.alias("subject"),
    )
    return adjust.classify_actions(rows)


@query("m01_classify_actions", with_(ACTIONS, select=f"SELECT seq, sym, dt, kind, {r('price_ratio')} AS price_ratio, {r('dividend')} AS dividend FROM actions"))
def m01(spark, sf):
    return actions(spark, sf).select("seq", "sym", "dt", "kind", rnd("price_ratio").alias("price_ratio"), rnd("dividend").alias("dividend"))


_EFFECT = """eff AS (SELECT sym, dt, last(kind ORDER BY seq) FILTER (WHERE kind <> 'demerger') AS kind, last(price_ratio ORDER BY seq) FILTER (WHERE kind <> 'demerger') AS pr,
  last(dividend ORDER BY seq) FILTER (WHERE kind <> 'demerger') AS dv, bool_or(kind = 'demerger') AS dm, count(*) AS n FROM actions GROUP BY sym, dt)"""
_RAWRET = f"""rr AS (SELECT b.sym, b.dt, b.open, b.high, b.low, b.close, b.prev_close, e.kind AS action, coalesce(e.dm, false) AS dm,
  CASE WHEN e.kind IS NOT NULL AND b.prev_close > 0 THEN (b.close + e.dv) / (b.prev_close * e.pr) - 1 ELSE b.close / b.prev_close - 1 END AS ret0
  FROM (SELECT *, {lag('close')} AS prev_close FROM bars) b LEFT JOIN eff e ON e.sym = b.sym AND e.dt = b.dt)"""
_ADJ = "adj AS (SELECT *, dm OR coalesce(abs(ret0) > 0.25, false) AS masked, CASE WHEN NOT (dm OR coalesce(abs(ret0) > 0.25, false)) THEN ret0 END AS ret FROM rr)"


def _adjusted(spark, sf):
    panel = t.saved_bars(spark, sf, 10).withColumn("prev_close", F.lag("close").over(by_sym()))
    return adjust.adjust_returns(panel, actions(spark, sf))


@query(
    "j05_action_join",
    with_(ACTIONS, _EFFECT, BARS10, select="SELECT b.sym, b.dt, e.kind, CAST(coalesce(e.n, 0) AS BIGINT) AS n_actions FROM bars b LEFT JOIN eff e USING (sym, dt)"),
)
def j05(spark, sf):
    eff = adjust.effective_actions(actions(spark, sf)).select("sym", "dt", F.col("_last.kind").alias("kind"), "n_actions")
    out = al.align_features(t.bars(spark, sf, books=10), eff)
    return out.select("sym", "dt", "kind", F.coalesce("n_actions", F.lit(0)).cast("bigint").alias("n_actions"))


@query("w26_adjusted_returns", with_(ACTIONS, _EFFECT, BARS10, _RAWRET, _ADJ, select=f"SELECT sym, dt, action, masked, {r('ret')} AS ret FROM adj"))
def w26(spark, sf):
    return _adjusted(spark, sf).select("sym", "dt", "action", "masked", rnd("ret").alias("ret"))


_INDEX = (
    CAL,
    """gridded AS (SELECT s.sym, c.dt, a.high, a.low, a.close, a.ret FROM (SELECT sym, min(dt) AS a, max(dt) AS z FROM bars GROUP BY sym) s
      JOIN cal c ON c.dt BETWEEN s.a AND s.z LEFT JOIN adj a ON a.sym = s.sym AND a.dt = c.dt)""",
    f"ix AS (SELECT *, 100 * exp(sum(ln(1 + coalesce(ret, 0))) {over(None)}) AS adj_close FROM gridded)",
    f"fx AS (SELECT *, coalesce(last_value(adj_close / close IGNORE NULLS) {over(None)}, first_value(adj_close / close IGNORE NULLS) OVER (PARTITION BY sym ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS f FROM ix)",
)


def _indexed(spark, sf):
    ret = _adjusted(spark, sf)
    cal = t.calendar(ret)
    grid = t.live_grid(ret, cal).select("sym", "dt")
    return ret, adjust.adjusted_index(al.align_features(grid, ret))


@query(
    "w27_adjusted_index",
    with_(ACTIONS, _EFFECT, BARS10, _RAWRET, _ADJ, *_INDEX, select=f"SELECT sym, dt, {r('ln(adj_close)')} AS log_close, {r('ln(high * f)')} AS log_high, {r('ln(low * f)')} AS log_low FROM fx"),
)
def w27(spark, sf):
    _, ix = _indexed(spark, sf)
    return ix.select("sym", "dt", *[rnd(F.ln(f"adj_{c}")).alias(f"log_{c}") for c in ("close", "high", "low")])


@query(
    "w28_rescaled_bars",
    with_(ACTIONS, _EFFECT, BARS10, _RAWRET, _ADJ, *_INDEX, select=f"SELECT a.sym, a.dt, {r('ln(x.adj_close / a.close)')} AS log_factor, {r('ln(a.open * x.adj_close / a.close)')} AS log_open, {r('ln(a.high * x.adj_close / a.close)')} AS log_high, {r('ln(a.low * x.adj_close / a.close)')} AS log_low FROM adj a JOIN ix x USING (sym, dt)"),
)
def w28(spark, sf):
    ret, ix = _indexed(spark, sf)
    out = adjust.rescale_bars(ret.select("sym", "dt", "open", "high", "low", "close"), ix)
    return out.select(
        "sym", "dt", rnd(F.ln("factor")).alias("log_factor"), *[rnd(F.ln(f"adj_{c}")).alias(f"log_{c}") for c in ("open", "high", "low")]
    )


# ---- calendars, events, as-of ----------------------------------------------------------------------

EVENTS_GRID = """ann AS (SELECT CAST(o_custkey % 10 AS BIGINT) AS sym, CAST(o_orderdate AS DATE) AS dt, count(*) AS ann_count FROM orders GROUP BY 1, 2)"""
_ANN_GRID = "ag AS (SELECT d.sym, d.dt, CAST(coalesce(a.ann_count, 0) AS DOUBLE) AS ann_count, row_number() OVER (PARTITION BY d.sym ORDER BY d.dt) AS i FROM dense d LEFT JOIN ann a ON a.sym = d.sym AND a.dt = d.dt)"


def announcements(spark, sf):
    o = t.table(spark, sf, "orders")
    return o.groupBy((F.col("o_custkey") % 10).cast("bigint").alias("sym"), F.col("o_orderdate").cast("date").alias("dt")).agg(
        F.count(F.lit(1)).alias("ann_count")
    )


def _grid(spark, sf, books=10):
    panel = t.saved_bars(spark, sf, books)
    return t.live_grid(panel, t.calendar(panel)).select("sym", "dt")


@query(
    "j01_align_features",
    with_(
        BARS, DELIV, "bb AS (SELECT CAST(l_suppkey AS BIGINT) AS sym, CAST(l_shipdate AS DATE) AS dt, max(l_extendedprice / l_quantity) AS close FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2)",
        select="SELECT b.sym, b.dt, round(b.close, 8) AS close, round(d.delivered, 4) AS delivered FROM bb b LEFT JOIN deliv d USING (sym, dt)",
    ),
)
def j01(spark, sf):
    rows = t.fills(spark, sf, extra=("l_returnflag",))
    panel = rows.where(F.col("l_returnflag") != "N").groupBy("sym", "dt").agg(F.max("px").alias("close"))
    feats = rows.groupBy("sym", "dt").agg(F.sum(F.when(F.col("l_returnflag") == "N", F.col("qty")).otherwise(0.0)).alias("delivered"))
    return al.align_features(panel, feats).select("sym", "dt", rnd("close", 8).alias("close"), F.round("delivered", 4).alias("delivered"))


@query("j02_calendar_zero_fill", with_(BARS10, CAL, DENSE, EVENTS_GRID, _ANN_GRID, select="SELECT sym, dt, ann_count FROM ag"))
def j02(spark, sf):
    return al.zero_filled_counts(_grid(spark, sf), announcements(spark, sf), "ann_count")


@query(
    "w25_event_features",
    with_(
        BARS10, CAL, DENSE, EVENTS_GRID, _ANN_GRID,
        select=f"SELECT sym, dt, ann_count, {r(z('ann_count', 60, 20, skip=1))} AS ann_count_z, CAST(i - last_value(CASE WHEN ann_count > 0 THEN i END IGNORE NULLS) {over(None)} AS DOUBLE) AS days_since FROM ag",
    ),
)
def w25(spark, sf):
    out = al.event_features(al.zero_filled_counts(_grid(spark, sf), announcements(spark, sf), "ann_count"))
    return out.select("sym", "dt", "ann_count", rnd("ann_count_z").alias("ann_count_z"), "days_since")


_WEEKLY = """slow AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS dt,
  (sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE 0 END) - sum(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice ELSE 0 END))
  / nullif(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN o_totalprice ELSE 0 END), 0) AS net FROM orders GROUP BY 1)"""


def weekly_net(spark, sf):
    o = t.table(spark, sf, "orders")
    part = lambda p: F.sum(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice")).otherwise(0.0))
    return o.groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("dt")).agg(
        F.try_divide(part("1-URGENT") - part("5-LOW"), part("1-URGENT") + part("5-LOW")).alias("net")
    )


@query(
    "j03_as_of_lagged",
    with_(
        BARS10, CAL, _WEEKLY,
        "u AS (SELECT dt FROM cal UNION SELECT dt FROM slow)",
        "f AS (SELECT u.dt, last_value(s.net IGNORE NULLS) OVER (ORDER BY u.dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS net FROM u LEFT JOIN slow s ON s.dt = u.dt)",
        "p AS (SELECT 0 AS sym, dt, lag(net) OVER (ORDER BY dt) AS net FROM f SEMI JOIN cal USING (dt))",
        select=f"SELECT dt, {r('net')} AS net, {r('coalesce(tanh(' + z('net', None, 20) + ' / 2), 0)')} AS channel FROM p",
    ),
)
def j03(spark, sf):
    cal = t.calendar(t.bars(spark, sf, books=10))
    late = al.as_of_lagged(weekly_net(spark, sf), cal, ["net"], 1)
    chan = al.market_channels(late, ["net"]).withColumnRenamed("net", "channel")
    return late.join(chan, "dt").select("dt", rnd("net").alias("net"), rnd("channel").alias("channel"))


@query(
    "j04_forward_fill",
    with_(
        BARS10, CAL, DENSE,
        select=f"""SELECT sym, dt, round(last_value(close IGNORE NULLS) OVER (PARTITION BY sym ORDER BY dt ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 8) AS one,
          round(last_value(close IGNORE NULLS) {over(None)}, 8) AS span FROM dense""",
    ),
)
def j04(spark, sf):
    d = t.dense_panel(t.saved_bars(spark, sf, 10))
    d = al.forward_fill(al.forward_fill(d, "close", "one", 1), "close", "span")
    return d.select("sym", "dt", rnd("one", 8).alias("one"), rnd("span", 8).alias("span"))


@query(
    "j06_spot_lookup",
    with_(
        BARS,
        "c AS (SELECT CAST(l_suppkey AS BIGINT) AS sym, CAST(l_shipdate AS DATE) AS dt, l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN l_extendedprice / l_quantity END AS underlying FROM lineitem)",
        select="SELECT sym, dt, l_orderkey, l_linenumber, round(coalesce(underlying, close), 8) AS spot FROM c LEFT JOIN bars USING (sym, dt)",
    ),
)
def j06(spark, sf):
    c = t.fills(spark, sf, extra=("l_orderkey", "l_linenumber", "l_linestatus")).select(
        "sym", "dt", "l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "O", F.col("px")).alias("underlying")
    )
    out = al.underlying_price(c, t.bars(spark, sf))
    return out.select("sym", "dt", "l_orderkey", "l_linenumber", rnd("spot", 8).alias("spot"))


@query(
    "j07_nearest_strike",
    """SELECT p_brand, p_type, p_retailprice AS strike, p_partkey FROM part
    QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY abs(p_retailprice - 950.0), p_partkey) = 1""",
)
def j07(spark, sf):
    rows = t.table(spark, sf, "part")
    out = al.nearest(rows, ["p_brand", "p_type"], "p_retailprice", F.lit(950.0), "p_partkey", ["p_partkey"])
    return out.select("p_brand", "p_type", F.col("p_retailprice").alias("strike"), "p_partkey")


_V2 = "{n} AS (SELECT CAST(l_suppkey % 10 AS BIGINT) AS sym, CAST(l_shipdate AS DATE) AS dt, max(l_extendedprice / l_quantity) AS close, sum(l_quantity) AS volume FROM lineitem WHERE l_linestatus = '{s}' GROUP BY 1, 2)"


def _venue(spark, sf, status):
    rows = t.fills(spark, sf, 10, extra=("l_linestatus",)).where(F.col("l_linestatus") == status)
    return rows.groupBy("sym", "dt").agg(F.max("px").alias("close"), F.sum("qty").alias("volume"))


@query(
    "j08_cross_venue",
    with_(
        _V2.format(n="a", s="O"), _V2.format(n="b", s="F"),
        "j AS (SELECT a.sym, a.dt, a.close, a.volume, b.close AS cb, b.volume AS vb FROM a LEFT JOIN b USING (sym, dt))",
        "k AS (SELECT *, last_value(cb IGNORE NULLS) OVER (PARTITION BY sym ORDER BY dt ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS fb FROM j)",
        f"s AS (SELECT *, ((close / {lag('close')} - 1) - (fb / {lag('fb')} - 1)) * 10000 AS sp FROM k)",
        select=f"SELECT sym, dt, {r('CASE WHEN abs(sp) <= 500 THEN sp END', 5)} AS spread_bps, {r('CASE WHEN abs(sp) <= 500 THEN abs(sp) END', 5)} AS spread_abs_bps, {r('vb / nullif(volume + vb, 0)')} AS second_share FROM s",
    ),
)
def j08(spark, sf):
    out = al.cross_venue(_venue(spark, sf, "O"), _venue(spark, sf, "F"))
    return out.select("sym", "dt", rnd("spread_bps", 5).alias("spread_bps"), rnd("spread_abs_bps", 5).alias("spread_abs_bps"), rnd("second_share").alias("second_share"))


SECTOR10 = "sec AS (SELECT CAST(s_suppkey % 10 AS BIGINT) AS sym, CASE WHEN s_suppkey % 10 < 4 THEN 'alpha' WHEN s_suppkey % 10 < 8 THEN 'beta' ELSE 'gamma' END AS sector FROM supplier GROUP BY 1, 2)"


def sectors10(spark, sf):
    """Baskets with a sector each; the last sector is too small for pairs."""
    b = (F.col("s_suppkey") % 10).cast("bigint")
    s = F.when(b < 4, "alpha").when(b < 8, "beta").otherwise("gamma")
    return t.table(spark, sf, "supplier").select(b.alias("sym"), s.alias("sector")).distinct()


@query(
    "j09_sector_pairs",
    with_(
        SECTOR10, "big AS (SELECT sector FROM sec GROUP BY sector HAVING count(*) >= 3)",
        select="SELECT x.sector, x.sym AS a, y.sym AS b FROM sec x JOIN sec y ON x.sector = y.sector AND x.sym < y.sym WHERE x.sector IN (SELECT sector FROM big)",
    ),
)
def j09(spark, sf):
    return al.sector_pairs(sectors10(spark, sf))


@query(
    "j11_walk_windows",
    with_(
        BARS10, CAL, "n AS (SELECT count(*) AS n FROM cal)",
        "win AS (SELECT CAST(w AS INTEGER) AS w, CAST(w * 21 AS INTEGER) AS s, CAST(w * 21 + 252 AS INTEGER) AS e, CAST(least(w * 21 + 273, n) AS INTEGER) AS te FROM n, range(0, 1000) t(w) WHERE w * 21 + 253 < n)",
        select="""SELECT win.w, win.s, win.e, win.te, CAST(count(*) FILTER (WHERE bar_idx < e) AS BIGINT) AS train_bars, CAST(count(*) FILTER (WHERE bar_idx >= e) AS BIGINT) AS test_bars
          FROM win JOIN cal ON bar_idx >= s AND bar_idx < te GROUP BY ALL""",
    ),
)
def j11(spark, sf):
    from barline.functions.cols import attach

    cal = t.calendar(t.bars(spark, sf, books=10))
    n = cal.agg(F.count(F.lit(1)).alias("n_bars"))
    placed = al.assign_windows(attach(cal, n), F.col("n_bars"), 252, 21)
    counts = placed.groupBy("w").agg(
        F.count(F.when(F.col("side") == "train", 1)).alias("train_bars"), F.count(F.when(F.col("side") == "test", 1)).alias("test_bars")
    )
    return al.walk_windows(n, 252, 21).join(counts, "w").select("w", "s", "e", "te", "train_bars", "test_bars")


@query(
    "j14_prediction_actual",
    with_(
        BARS,
        f"p AS (SELECT sym, dt, close / {lag('close', 5)} - 1 AS pred, lead(close) OVER (PARTITION BY sym ORDER BY dt) / close - 1 AS actual FROM bars)",
        select=f"SELECT sym, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE (pred > 0) = (actual > 0)) AS BIGINT) AS hits, {r('avg(pred * actual)')} AS product FROM p WHERE pred IS NOT NULL AND actual IS NOT NULL GROUP BY sym",
    ),
)
def j14(spark, sf):
    panel = technical.returns(t.bars(spark, sf))
    preds = panel.select("sym", "dt", F.col("ret_5").alias("pred"))
    actual = panel.select("sym", "dt", (F.lead("close").over(by_sym()) / F.col("close") - 1).alias("actual"))
    both = preds.join(actual, ["sym", "dt"]).where(F.col("pred").isNotNull() & F.col("actual").isNotNull())
    hit = (F.col("pred") > 0) == (F.col("actual") > 0)
    return both.groupBy("sym").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(hit, 1)).alias("hits"), rnd(F.avg(F.col("pred") * F.col("actual"))).alias("product")
    )


@query(
    "j15_unmatched",
    """SELECT 'customer_without_order' AS what, CAST(count(*) AS BIGINT) AS n FROM customer ANTI JOIN orders ON o_custkey = c_custkey
    UNION ALL SELECT 'customer_with_order', count(*) FROM customer SEMI JOIN orders ON o_custkey = c_custkey
    UNION ALL SELECT 'document_without_label', count(*) FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL""",
)
def j15(spark, sf):
    cust = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("name"))
    have = t.table(spark, sf, "orders").select(F.col("o_custkey").alias("name"))
    docs = t.table(spark, sf, "documents").select("doc_id").join(t.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    one = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return (
        one(al.missing_names(cust, have), "customer_without_order")
        .unionByName(one(cust.join(have, "name", "left_semi"), "customer_with_order"))
        # an unlabelled document keeps NULL, it gets no default class
        .unionByName(one(docs.where(F.col("quality").isNull()), "document_without_label"))
    )
