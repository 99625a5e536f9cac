"""Small column builders shared by every operator.

Absent values are NULL everywhere; NaN and infinities are turned into NULL at
the edge (``finite``), because Spark aggregates propagate NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def ratio(a: Column | str, b: Column | str) -> Column:
    """``a / b``, NULL where ``b`` is zero."""
    return F.try_divide(col(a), col(b))


def quotient(a: Column | str, b: Column | str) -> Column:
    """``a / b`` as floats divide: infinite, or no number, where ``b`` is zero."""
    a, b = col(a), col(b)
    by_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a.isNotNull(), float("nan"))
    return F.when(b != 0, a / b).when(b == 0, by_zero)


def nonzero(c: Column | str) -> Column:
    c = col(c)
    return F.when(c != 0, c)


def clip(c: Column | str, lo: float, hi: float) -> Column:
    """Bounds a value; NULL stays NULL (``least``/``greatest`` alone would skip it)."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def at_least(c: Column | str, lo: float) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(float(lo))))


def rnd(c: Column | str, digits: int = 6) -> Column:
    return F.round(col(c).cast("double"), digits)


def by_sym(*extra: str, sym: str = "sym", order: str = "dt") -> WindowSpec:
    """Window over one symbol's history.

    A symbol has at most one row per session in a daily panel, so such a group
    is bounded by the length of the calendar, never by the size of the input.
    """
    return Window.partitionBy(*extra, sym).orderBy(order)


def trailing(n: int, *extra: str, skip: int = 0, sym: str = "sym", order: str = "dt") -> WindowSpec:
    """The ``n`` rows ending ``skip`` rows before the current one."""
    return by_sym(*extra, sym=sym, order=order).rowsBetween(-(n - 1) - skip, -skip)


def gated(agg: Column, x: Column | str, w: WindowSpec, least: int) -> Column:
    """Window aggregate that stays NULL until ``least`` values are present."""
    return F.when(F.count(col(x)).over(w) >= least, agg.over(w))


def roll_mean(x: Column | str, n: int, least: int | None = None, **kw) -> Column:
    w = trailing(n, **kw)
    return gated(F.avg(col(x)), x, w, n if least is None else least)


def roll_std(x: Column | str, n: int, least: int | None = None, **kw) -> Column:
    w = trailing(n, **kw)
    return gated(F.stddev_samp(col(x)), x, w, max(2, n if least is None else least))


def roll_sum(x: Column | str, n: int, least: int | None = None, **kw) -> Column:
    w = trailing(n, **kw)
    return gated(F.sum(col(x)), x, w, n if least is None else least)


def roll_max(x: Column | str, n: int, least: int | None = None, **kw) -> Column:
    w = trailing(n, **kw)
    return gated(F.max(col(x)), x, w, n if least is None else least)


def roll_min(x: Column | str, n: int, least: int | None = None, **kw) -> Column:
    w = trailing(n, **kw)
    return gated(F.min(col(x)), x, w, n if least is None else least)


def change(x: Column | str, k: int = 1, *extra: str, sym: str = "sym", order: str = "dt") -> Column:
    """k-row relative change."""
    return ratio(x, F.lag(col(x), k).over(by_sym(*extra, sym=sym, order=order))) - 1


def _z(x: Column | str, w: WindowSpec, least: int) -> Column:
    # one count, one mean, one spread: Spark evaluates every occurrence anew
    c = col(x)
    return F.when(F.count(c).over(w) >= max(least, 2), ratio(c - F.avg(c).over(w), F.stddev_samp(c).over(w)))


def expanding_z(x: Column | str, least: int = 20, **kw) -> Column:
    """Z-score against all history up to and including the current row."""
    return _z(x, by_sym(**kw).rowsBetween(Window.unboundedPreceding, 0), least)


def trailing_z(x: Column | str, n: int = 60, least: int = 20, **kw) -> Column:
    """Z-score against the ``n`` rows before the current one, which is left out."""
    return _z(x, trailing(n, skip=1, **kw), least)


def squash(c: Column | str) -> Column:
    """tanh(z / 2), the bounded form of a z-score."""
    return F.tanh(col(c) / 2)


def attach(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds the columns of a one-row table (a global aggregate) to every row."""
    return df.join(F.broadcast(totals), how="cross")


def corr_from_sums(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson correlation from plain sums, NULL where a side is constant.

    The built-in ``corr`` raises on constant input under ANSI mode.
    """
    cov = sxy - sx * sy / n
    vx = sxx - sx * sx / n
    vy = syy - sy * sy / n
    return F.when((n > 1) & (vx > 1e-18) & (vy > 1e-18), cov / F.sqrt(vx * vy))


def safe_corr(x: Column | str, y: Column | str, w: WindowSpec | None = None) -> Column:
    """Correlation over pairs with both values present, NULL where undefined.

    Values are centred on a window-free basis by the moment aggregates
    themselves (``covar_pop``/``var_pop``), which keeps precision on large values.
    """
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    cov, vx, vy = F.covar_pop(px, py), F.var_pop(px), F.var_pop(py)
    if w is not None:
        cov, vx, vy = cov.over(w), vx.over(w), vy.over(w)
    return F.when((vx > 1e-18) & (vy > 1e-18), cov / (F.sqrt(vx) * F.sqrt(vy)))
