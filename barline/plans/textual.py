"""Text, calendar, crowd, ledger and set-operation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barline.functions import costs, dates, text as tx
from barline.functions.cols import clip, finite, ratio, rnd
from barline.operators import crowd, ledger as lg
from barline.operators.universe import top_liquid
from barline.plans.ansi import BARS, lag, r, with_
from barline.plans.registry import query
from barline.sources import tables as t

_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_STRIP = "html"
for _p in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"<[^>]+>", r"&[a-zA-Z#0-9]+;"):
    _STRIP = f"regexp_replace({_STRIP}, '{_p}', ' ', 'g')"
_STRIP = f"trim(regexp_replace({_STRIP}, '{_WS}+', ' ', 'g'))"


@query("m02_strip_markup", f"SELECT page_id, {_STRIP} AS plain FROM pages")
def m02(spark, sf):
    return t.table(spark, sf, "pages").select("page_id", tx.strip_markup("html").alias("plain"))


def _count(words):
    return "(" + " + ".join(f"(length(lo) - length(replace(lo, '{w}', ''))) // {len(w)}" for w in words) + ")"


_SENT = (
    f"w AS (SELECT doc_id, text, lower(text) AS lo, greatest(len(regexp_extract_all(text, '[^\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+')), 1) AS n FROM documents)",
    f"d AS (SELECT doc_id, text, {_count(tx.NEGATIVE)} / n * 1000 AS neg, {_count(tx.POSITIVE)} / n * 1000 AS pos, {_count(tx.HEDGES)} / n * 1000 AS hed, contains(lo, 'going concern') AS going_concern, contains(lo, 'regulatory investigation') OR contains(lo, 'whistleblower') AS litigation FROM w)",
    "s AS (SELECT *, (pos - neg) / (pos + neg + 1e-8) AS score, least(hed / 10, 1.0) AS unc FROM d)",
)


@query(
    "m03_filing_sentiment",
    with_(
        *_SENT,
        select=f"""SELECT doc_id, {r('neg')} AS negative_density, {r('pos')} AS positive_density, {r('score')} AS score, {r('unc')} AS uncertainty, going_concern, litigation,
          CASE WHEN score > 0.3 AND unc < 0.3 THEN 'BULLISH' WHEN score < -0.3 THEN 'BEARISH' WHEN unc > 0.6 THEN 'CAUTIOUS' ELSE 'NEUTRAL' END AS label FROM s""",
    ),
)
def m03(spark, sf):
    out = tx.filing_sentiment(t.table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[rnd(c).alias(c) for c in ("negative_density", "positive_density", "score", "uncertainty")], "going_concern", "litigation", "label")


@query("m04_filing_scores", with_(*_SENT, "l AS (SELECT source, avg(CASE WHEN length(text) < 10 THEN 0.0 ELSE score END) AS score, count(*) AS n FROM documents JOIN s USING (doc_id, text) GROUP BY source)", select=f"SELECT source, CAST(n AS BIGINT) AS n, {r('score')} AS score FROM l"))
def m04(spark, sf):
    docs = tx.filing_sentiment(t.table(spark, sf, "documents").select("doc_id", "source", "text"))
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg(tx.usable_score("text", "score"))).alias("score"))


@query(
    "m05_combined_index",
    with_(
        *_SENT, "c AS (SELECT doc_id, 0.6 * score + 0.4 * (CASE quality WHEN 1 THEN 1.0 WHEN 0 THEN -1.0 ELSE 0 END) AS v FROM s LEFT JOIN labels USING (doc_id))",
        select=f"SELECT doc_id, {r('v')} AS combined, CASE WHEN v > 0.15 THEN 'BUY' WHEN v < -0.15 THEN 'SELL' ELSE 'NEUTRAL' END AS signal, {r('abs(v)')} AS strength FROM c",
    ),
)
def m05(spark, sf):
    docs = tx.filing_sentiment(t.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "score")
    both = docs.join(t.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    social = F.when(F.col("quality") == 1, 1.0).when(F.col("quality") == 0, -1.0).otherwise(0.0)
    return both.select("doc_id", tx.combined_index("score", social).alias("c")).select("doc_id", rnd("c.combined").alias("combined"), "c.signal", rnd("c.strength").alias("strength"))


_MENTION = "text || ' $' || upper(substr(role, 1, 4)) || ' and $USER  or $ASSISTANT, $A'"


@query(
    "m06_known_mentions",
    f"""SELECT conv_id, turn, trim(regexp_replace(replace(regexp_replace(regexp_replace({_MENTION}, '\\$(USER|ABC)\\b', chr(1) || '\\1', 'g'), '\\$[A-Z]{{1,5}}\\b', '', 'g'), chr(1), '$'), '{_WS}{{2,}}', ' ', 'g')) AS clean FROM conversations""",
)
def m06(spark, sf):
    c = t.table(spark, sf, "conversations")
    raw = F.concat("text", F.lit(" $"), F.upper(F.substring("role", 1, 4)), F.lit(" and $USER  or $ASSISTANT, $A"))
    return c.select("conv_id", "turn", tx.keep_known_mentions(raw, ["USER", "ABC"]).alias("clean"))


# ---- calendars ----------------------------------------------------------------------------------------------

_YEARS = "ys AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders UNION SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) FROM lineitem)"
# Easter by the Meeus/Jones/Butcher steps, another method than the Spark side uses
_EASTER = (
    "e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM ys)",
    "e2 AS (SELECT *, (19 * a + b - b // 4 - ((b - (b + 8) // 25 + 1) // 3) + 15) % 30 AS h, c // 4 AS i, c % 4 AS k FROM e1)",
    "e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * i - h - k) % 7 AS l FROM e2)",
    "e4 AS (SELECT y, h, l, (a + 11 * h + 22 * l) // 451 AS m FROM e3)",
    "ea AS (SELECT y, make_date(CAST(y AS BIGINT), CAST((h + l - 7 * m + 114) // 31 AS BIGINT), CAST((h + l - 7 * m + 114) % 31 + 1 AS BIGINT)) AS d FROM e4)",
)


def _nth(m, dow, n):
    first = f"make_date(y, {m}, 1)"
    return f"CAST({first} + CAST(({dow} - isodow({first}) + 7) % 7 + {7 * (n - 1)} AS INTEGER) AS DATE)"


def _obs(m, d):
    x = f"make_date(y, {m}, {d})"
    return f"CAST(CASE isodow({x}) WHEN 6 THEN {x} - 1 WHEN 7 THEN {x} + 1 ELSE {x} END AS DATE)"


_MEM = "CAST(make_date(y, 5, 31) - CAST((isodow(make_date(y, 5, 31)) + 6) % 7 AS INTEGER) AS DATE)"
_HOL = "hol AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS name, {e} AS dt, y AS year FROM {src}"
    for n, e, src in (
        ("new_year", _obs(1, 1), "ys"), ("king", _nth(1, 1, 3), "ys"), ("presidents", _nth(2, 1, 3), "ys"), ("good_friday", "CAST(d - 2 AS DATE)", "ea"), ("memorial", _MEM, "ys"),
        ("juneteenth", _obs(6, 19), "ys"), ("independence", _obs(7, 4), "ys"), ("labor", _nth(9, 1, 1), "ys"), ("thanksgiving", _nth(11, 4, 4), "ys"), ("christmas", _obs(12, 25), "ys"),
    )
) + ")"


def _years(spark, sf):
    a = t.table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return a.union(t.table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year")).distinct()).distinct()


@query("m07_holidays", with_(_YEARS, *_EASTER, _HOL, select="SELECT name, dt, year FROM hol"))
def m07(spark, sf):
    return dates.us_holidays(_years(spark, sf)).select("name", "dt", "year")


@query(
    "m08_trading_days",
    with_(
        _YEARS, *_EASTER, _HOL,
        "days AS (SELECT CAST(d AS DATE) AS dt FROM (SELECT min(y) AS a, max(y) AS z FROM ys), unnest(generate_series(make_date(a, 1, 1), make_date(z, 12, 31), INTERVAL 1 DAY)) u(d))",
        "tr AS (SELECT dt, isodow(dt) < 6 AND dt NOT IN (SELECT dt FROM hol) AS is_trading FROM days)",
        select="SELECT dt, is_trading, first_value(CASE WHEN is_trading THEN dt END IGNORE NULLS) OVER (ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_trading FROM tr",
    ),
)
def m08(spark, sf):
    years = _years(spark, sf)
    span = years.agg(F.min("year").alias("a"), F.max("year").alias("z"))
    days = span.select(F.explode(F.sequence(F.make_date("a", F.lit(1), F.lit(1)), F.make_date("z", F.lit(12), F.lit(31)))).alias("dt"))
    return dates.trading_days(days, dates.us_holidays(years))


@query("m08_uncovered_years", "SELECT CAST(count(DISTINCT CAST(ts AS DATE)) AS BIGINT) AS days, 2024 AS first_missing FROM events")
def m08b(spark, sf):
    days = t.table(spark, sf, "events").select(F.col("ts").cast("date").alias("dt")).distinct()
    return dates.uncovered_years(days).agg(F.count(F.lit(1)).alias("days"), F.min(F.col("missing_years")[0]).alias("first_missing"))


@query(
    "m09_safe_math",
    f"""SELECT event_id, {r('tanh(value / 50)')} AS squashed, {r('ln(1 + value)')} AS logged, sign(value - 50) AS side, {r('least(greatest(value, 10), 90)')} AS bounded,
    {r('value / nullif(CAST(event_id % 5 AS DOUBLE), 0)')} AS divided FROM events""",
)
def m09(spark, sf):
    return t.table(spark, sf, "events").select(
        "event_id", rnd(F.tanh(F.col("value") / 50)).alias("squashed"), rnd(F.log1p("value")).alias("logged"),
        F.signum(F.col("value") - 50).cast("tinyint").alias("side"), rnd(clip("value", 10, 90)).alias("bounded"), rnd(finite(ratio("value", (F.col("event_id") % 5).cast("double")))).alias("divided"),
    )


_TIER = "CASE WHEN volume >= 60 THEN 0.0005 WHEN volume >= 30 THEN 0.0015 ELSE 0.005 END"


@query("m15_slippage", with_(BARS, select=f"SELECT sym, dt, {r(_TIER, 8)} AS base, {r(f'least({_TIER} + (volume * 10) / turnover * 0.01, 0.05)', 8)} AS with_impact FROM bars"))
def m15(spark, sf):
    b = t.bars(spark, sf)
    tier = {"high": 60, "mid": 30}
    return b.select(
        "sym", "dt", rnd(costs.slippage("volume", **tier), 8).alias("base"),
        rnd(costs.slippage("volume", F.col("volume") * 10, F.col("turnover"), **tier), 8).alias("with_impact"),
    )


# ---- crowd ----------------------------------------------------------------------------------------------------

_CROWD = (
    "pr AS (SELECT user_id AS u, epoch_us(ts) * 4096 + event_id % 4096 AS seq, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 = 0 THEN -1.0 ELSE 1.0 END AS p, CASE WHEN value > 40 THEN 1.0 ELSE -1.0 END AS a FROM events)",
    "cs AS (SELECT avg(p) AS c FROM (SELECT p FROM pr ORDER BY seq DESC LIMIT 90))",
    "rc AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY u ORDER BY seq DESC) <= 90)",
    "uw AS (SELECT u, count(*) AS n, avg(CASE WHEN p = a THEN 1.0 ELSE 0 END) AS acc, coalesce(avg(CASE WHEN p = a THEN 1.0 ELSE 0 END) FILTER (WHERE sign(p) <> sign(c)), 0) AS con FROM rc, cs GROUP BY u HAVING count(*) >= 5)",
)


def predictions(spark, sf):
    e = t.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("user_id").alias("user"), (F.unix_micros(F.col("ts").cast("timestamp")) * 4096 + F.pmod("event_id", F.lit(4096))).alias("seq"),
        F.when(k % 3 == 0, -1.0).otherwise(1.0).alias("predicted"), F.when(F.col("value") > 40, 1.0).otherwise(-1.0).alias("actual"),
    )


@query("a25_contributor_weights", with_(*_CROWD, select=f"SELECT u AS user, CAST(n AS BIGINT) AS n, {r('acc')} AS accuracy, {r('con')} AS contrarian, {r('acc + 1.5 * con')} AS weight FROM uw"))
def a25(spark, sf):
    out = crowd.contributor_weights(predictions(spark, sf))
    return out.select("user", "n", *[rnd(c).alias(c) for c in ("accuracy", "contrarian", "weight")])


_SIG = "sg AS (SELECT user_id AS u, avg(value) / 50 - 1 AS s FROM events GROUP BY 1 UNION ALL SELECT 1000000 + c_custkey, c_acctbal / 10000 FROM customer)"


def _signals(spark, sf):
    a = t.table(spark, sf, "events").groupBy(F.col("user_id").alias("user")).agg((F.avg("value") / 50 - 1).alias("signal"))
    b = t.table(spark, sf, "customer").select((1000000 + F.col("c_custkey")).alias("user"), (F.col("c_acctbal") / 10000).alias("signal"))
    return a.unionByName(b)


@query(
    "a26_crowd_signal",
    with_(
        *_CROWD, _SIG, "j AS (SELECT s, coalesce(acc + 1.5 * con, 0.5) AS w FROM sg LEFT JOIN uw USING (u))",
        select=f"SELECT {r('sum(w * s) / sum(w)')} AS sentiment, {r('avg(s)')} AS raw, {r('sum(w * s) / sum(w) - avg(s)')} AS boost, CAST(count(*) AS BIGINT) AS n_users, CAST(sum(CASE WHEN w > 1.2 THEN 1 ELSE 0 END) AS BIGINT) AS n_gifted, {r('least((SELECT count(*) FROM uw) / count(*), 1.0)')} AS confidence FROM j",
    ),
)
def a26(spark, sf):
    out = crowd.crowd_signal(_signals(spark, sf), crowd.contributor_weights(predictions(spark, sf)))
    return out.select(*[rnd(c).alias(c) for c in ("sentiment", "raw", "boost")], "n_users", "n_gifted", rnd("confidence").alias("confidence"))


@query(
    "a26_robust_mean",
    """WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS med, stddev_pop(value) + 1e-8 AS sd FROM events GROUP BY 1)
    SELECT event_type, round(sum(exp(-0.5 * ((value - med) / sd) ^ 2) * value) / sum(exp(-0.5 * ((value - med) / sd) ^ 2)), 6) AS robust_mean FROM events JOIN m USING (event_type) GROUP BY 1""",
)
def a26b(spark, sf):
    out = crowd.robust_mean(t.table(spark, sf, "events").select("event_type", "value"), "value", "event_type")
    return out.withColumn("robust_mean", rnd("robust_mean"))


# ---- ledger ----------------------------------------------------------------------------------------------------

_TRADES = """trades AS (SELECT (l_orderkey * 8 + l_linenumber) * 262144 + CAST(round(l_extendedprice * 100) AS BIGINT) % 262144 AS id, 'S' || CAST(l_suppkey AS VARCHAR) AS ticker,
  l_quantity - 25 AS position_after, l_extendedprice - 20000 AS cash_after FROM lineitem)"""


def trades(spark, sf):
    li = t.table(spark, sf, "lineitem")
    return li.select(
        t.session_pos().alias("id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"),
        (F.col("l_quantity") - 25).alias("position_after"), (F.col("l_extendedprice") - 20000).alias("cash_after"),
    )


_POSN = "posn AS (SELECT ticker, position_after AS shares FROM trades t1 WHERE id = (SELECT max(id) FROM trades t2 WHERE t2.ticker = t1.ticker) AND position_after <> 0)"


@query("a31_ledger_replay", with_(_TRADES, _POSN, select="SELECT ticker, shares FROM posn UNION ALL SELECT 'CASH', round(cash_after, 2) FROM trades WHERE id = (SELECT max(id) FROM trades)"))
def a31(spark, sf):
    tr = trades(spark, sf)
    cash = lg.last_cash(tr, 100000.0).select(F.lit("CASH").alias("ticker"), F.round("cash", 2).alias("shares"))
    return lg.last_positions(tr).unionByName(cash)


@query(
    "a32_mark_to_market",
    with_(
        BARS, _TRADES, _POSN, "px AS (SELECT 'S' || sym AS ticker, last(close ORDER BY dt) AS price FROM bars GROUP BY sym)",
        "c AS (SELECT cash_after AS cash FROM trades WHERE id = (SELECT max(id) FROM trades))",
        "v AS (SELECT sum(shares * price) AS m, max(abs(shares * price)) AS top, count(*) AS n FROM posn LEFT JOIN px USING (ticker))",
        select=f"SELECT {r('cash + m', 4)} AS equity, CAST(n AS BIGINT) AS n_positions, {r('CASE WHEN cash + m > 0 THEN top / (cash + m) ELSE 0 END')} AS max_position_pct FROM v, c",
    ),
)
def a32(spark, sf):
    tr = trades(spark, sf)
    px = t.bars(spark, sf).groupBy(F.concat(F.lit("S"), F.col("sym").cast("string")).alias("ticker")).agg(F.max_by("close", "dt").alias("price"))
    out = lg.marked(lg.last_positions(tr), px, lg.last_cash(tr, 100000.0))
    return out.select(rnd("equity", 4).alias("equity"), "n_positions", rnd("max_position_pct").alias("max_position_pct"))


_EQ = """dayv AS (SELECT CAST(c_nationkey AS BIGINT) AS account, CAST(o_orderdate AS DATE) AS dt, sum(o_totalprice * (CASE WHEN o_orderstatus = 'F' THEN -0.05 ELSE 0.05 END)) AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
eqd AS (SELECT account, dt, 100000 + sum(v) OVER (PARTITION BY account ORDER BY dt ROWS UNBOUNDED PRECEDING) AS equity FROM dayv)"""


def account_equity(spark, sf):
    """Daily equity per account (customer nation) from signed order value."""
    o = t.table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    c = t.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("account"))
    v = F.col("o_totalprice") * F.when(F.col("o_orderstatus") == "F", -0.05).otherwise(0.05)
    day = o.join(c, o.o_custkey == c.c_custkey).groupBy("account", F.col("o_orderdate").cast("date").alias("dt")).agg(F.sum(v).alias("v"))
    # one row per account and day
    w = Window.partitionBy("account").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return day.select("account", "dt", (100000 + F.sum("v").over(w)).alias("equity"))


_P = f"pn AS (SELECT *, equity - {lag('equity', part='account')} AS pnl, (equity - {lag('equity', part='account')}) / ({lag('equity', part='account')} + 1e-9) AS ret FROM eqd)"


@query("a32_daily_pnl", with_(_EQ, _P, select=f"SELECT account, dt, {r('equity', 5)} AS equity, {r('pnl', 5)} AS pnl, {r('ret')} AS ret FROM pn"))
def a32b(spark, sf):
    return lg.daily_pnl(account_equity(spark, sf), "account").select("account", "dt", rnd("equity", 5).alias("equity"), rnd("pnl", 5).alias("pnl"), rnd("ret").alias("ret"))


@query(
    "a33_risk_breaches",
    with_(
        _EQ, f"b AS (SELECT *, {lag('equity', part='account')} AS s, max(equity) OVER (PARTITION BY account ORDER BY dt ROWS UNBOUNDED PRECEDING) AS p FROM eqd)",
        select=f"SELECT account, dt, {r('CASE WHEN s > 0 THEN (s - equity) / s END')} AS loss, {r('CASE WHEN p > 0 THEN (p - equity) / p END')} AS drawdown, coalesce(CASE WHEN s > 0 THEN (s - equity) / s END >= 0.05, false) AS loss_breach, coalesce(CASE WHEN p > 0 THEN (p - equity) / p END >= 0.2, false) AS drawdown_breach FROM b",
    ),
)
def a33(spark, sf):
    out = lg.risk_breaches(account_equity(spark, sf), "account")
    return out.select("account", "dt", rnd("loss").alias("loss"), rnd("drawdown").alias("drawdown"), "loss_breach", "drawdown_breach")


@query("a34_large_moves", with_(_EQ, _P, select=f"SELECT account, dt, {r('abs(pnl) / (equity - pnl)')} AS move FROM pn WHERE equity - pnl > 0 AND abs(pnl) / (equity - pnl) >= 0.1"))
def a34(spark, sf):
    return lg.large_moves(lg.daily_pnl(account_equity(spark, sf), "account")).select("account", "dt", rnd("move").alias("move"))


# ---- counts, universe, sets ---------------------------------------------------------------------------------------


@query("a01_daily_counts", "SELECT CAST(o_custkey % 10 AS BIGINT) AS sym, CAST(o_orderdate AS DATE) AS dt, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2")
def a01(spark, sf):
    o = t.table(spark, sf, "orders")
    return o.groupBy((F.col("o_custkey") % 10).cast("bigint").alias("sym"), F.col("o_orderdate").cast("date").alias("dt")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "a07_top_liquid",
    with_(
        BARS, "d AS (SELECT max(dt) AS dt FROM bars WHERE dt <= DATE '1999-06-30' AND dt > DATE '1999-06-20')",
        select="SELECT sym, dt, round(turnover, 2) AS turnover FROM bars SEMI JOIN d USING (dt) WHERE close >= 20 ORDER BY turnover DESC, sym LIMIT 10",
    ),
)
def a07(spark, sf):
    return top_liquid(t.bars(spark, sf), "1999-06-30", 10).select("sym", "dt", F.round("turnover", 2).alias("turnover"))


@query("u01_union", "SELECT 'orders' AS src, CAST(count(*) AS BIGINT) AS n, min(CAST(o_orderdate AS DATE)) AS first_dt FROM orders UNION ALL SELECT 'lineitem', count(*), min(CAST(l_shipdate AS DATE)) FROM lineitem")
def u01(spark, sf):
    a = t.table(spark, sf, "orders").select(F.lit("orders").alias("src"), F.col("o_orderdate").cast("date").alias("dt"))
    b = t.table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("dt"), F.lit("lineitem").alias("src"))
    return a.unionByName(b).groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dt").alias("first_dt"))


def _sessions(spark, sf):
    a = t.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("dt"))
    return a, t.table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("dt"))


_SETS = "SELECT dt FROM (SELECT CAST(o_orderdate AS DATE) AS dt FROM orders {op} SELECT CAST(l_shipdate AS DATE) FROM lineitem)"


@query("u02_calendar_intersection", _SETS.format(op="INTERSECT"))
def u02(spark, sf):
    a, b = _sessions(spark, sf)
    return a.intersect(b)


@query("u03_calendar_difference", "SELECT DISTINCT CAST(l_shipdate AS DATE) AS dt FROM lineitem WHERE CAST(l_shipdate AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)")
def u03(spark, sf):
    a, b = _sessions(spark, sf)
    return b.distinct().join(a, "dt", "left_anti")


@query("u04_calendar_union", _SETS.format(op="UNION"))
def u04(spark, sf):
    a, b = _sessions(spark, sf)
    return a.union(b).distinct()

