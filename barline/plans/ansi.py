"""SQL text pieces shared by the DuckDB counterparts of the queries."""

from __future__ import annotations

# fills in session order, daily bars per supplier and for ten baskets
POS = "(l_orderkey * 8 + l_linenumber) * 262144 + CAST(round(l_extendedprice * 100) AS BIGINT) % 262144"
_BARS = """{name} AS (
  SELECT {sym} AS sym, CAST(l_shipdate AS DATE) AS dt,
         first(l_extendedprice / l_quantity ORDER BY {pos}) AS open,
         max(l_extendedprice / l_quantity) AS high,
         min(l_extendedprice / l_quantity) AS low,
         last(l_extendedprice / l_quantity ORDER BY {pos}) AS close,
         sum(l_quantity) AS volume, sum(l_extendedprice) AS turnover, count(*) AS trades
  FROM lineitem GROUP BY 1, 2)"""

BARS = _BARS.format(name="bars", sym="CAST(l_suppkey AS BIGINT)", pos=POS)
BARS10 = _BARS.format(name="bars", sym="CAST(l_suppkey % 10 AS BIGINT)", pos=POS)
CAL = "cal AS (SELECT dt, CAST(row_number() OVER (ORDER BY dt) - 1 AS INTEGER) AS bar_idx FROM (SELECT DISTINCT dt FROM bars))"
DENSE = """dense AS (
  SELECT s.sym, c.dt, c.bar_idx, b.open, b.high, b.low, b.close, b.volume, b.turnover, b.trades
  FROM (SELECT sym, min(dt) AS a, max(dt) AS z FROM bars GROUP BY sym) s
  JOIN cal c ON c.dt BETWEEN s.a AND s.z
  LEFT JOIN bars b ON b.sym = s.sym AND b.dt = c.dt)"""
TICKS = """ticks AS (
  SELECT CAST(user_id % 10 AS BIGINT) AS sym, ts, CAST(ts AS DATE) AS dt, event_id, event_type, value AS px,
         coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) + 1.0 AS qty
  FROM events)"""
MINUTES = """minutes AS (
  SELECT sym, dt, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute,
         first(px ORDER BY ts, event_id) AS open, max(px) AS high, min(px) AS low,
         last(px ORDER BY ts, event_id) AS close, sum(qty) AS volume
  FROM ticks GROUP BY 1, 2, 3)"""


def with_(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


def r(expr: str, digits: int = 6) -> str:
    """Rounded, without a negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def over(n: int | None, skip: int = 0, part: str = "sym", order: str = "dt") -> str:
    start = "UNBOUNDED PRECEDING" if n is None else f"{n - 1 + skip} PRECEDING"
    end = "CURRENT ROW" if skip == 0 else f"{skip} PRECEDING"
    return f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {start} AND {end})"


def roll(fn: str, x: str, n: int | None, least: int | None = None, **kw) -> str:
    w = over(n, **kw)
    least = n if least is None else least
    return f"(CASE WHEN count({x}) {w} >= {least} THEN {fn}({x}) {w} END)"


def lag(x: str, k: int = 1, part: str = "sym", order: str = "dt") -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY {part} ORDER BY {order})"


def lead(x: str, k: int = 1, part: str = "sym", order: str = "dt") -> str:
    return f"lead({x}, {k}) OVER (PARTITION BY {part} ORDER BY {order})"


def clip(x: str, lo: float, hi: float) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, {lo}), {hi}) END)"


def z(x: str, n: int | None, least: int, skip: int = 0, **kw) -> str:
    return f"(({x} - {roll('avg', x, n, least, skip=skip, **kw)}) / nullif({roll('stddev_samp', x, n, max(least, 2), skip=skip, **kw)}, 0))"


def pct_rank(x: str, part: str, least: int = 1, percent: bool = True) -> str:
    n = f"count({x}) OVER (PARTITION BY {part})"
    rank = (
        f"(rank() OVER (PARTITION BY {part} ORDER BY {x} NULLS LAST) "
        f"+ (count({x}) OVER (PARTITION BY {part}, {x}) - 1) / 2.0)"
    )
    div = f" / {n}" if percent else ""
    return f"(CASE WHEN {x} IS NOT NULL AND {n} >= {least} THEN {rank}{div} END)"
