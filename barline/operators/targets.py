"""Forward-looking targets with a validity of their own per cell, and their baselines.

These are the only operators that look ahead. Input is a dense panel: a missing
bar is a row with a NULL close, so a window never silently skips over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.cols import attach, by_sym, change, ratio

EPS = 1e-8
TARGETS = ("direction_1d", "rel_strength_1d", "vol_5d", "regime_shift_5d")


def _ahead_std(ret: str, horizon: int, *extra: str) -> Column:
    w = by_sym(*extra).rowsBetween(1, horizon)
    return F.when(F.count(ret).over(w) == horizon, F.stddev_samp(ret).over(w))


def forward_return(n: int = 1, *extra: str) -> Column:
    return ratio(F.lead("close", n).over(by_sym(*extra)), "close") - 1


def relative_strength(panel: DataFrame, forward: str, out: str, *extra: str) -> DataFrame:
    """Forward return minus the mean of the names that have one on that session.

    The session mean is a partial aggregate joined back, so a session with very
    many names is never gathered in one task. With a single name it is zero.
    """
    day = panel.groupBy(*extra, "dt").agg(F.avg(forward).alias("_m"))
    names = panel.groupBy(*extra).agg(F.count_distinct("sym").alias("_names"))
    base = panel.join(day, [*extra, "dt"])
    base = base.join(names, [*extra]) if extra else attach(base, names)
    rel = F.when(F.col("_names") < 2, F.when(F.col(forward).isNotNull(), 0.0)).otherwise(F.col(forward) - F.col("_m"))
    return base.withColumn(out, rel).drop("_m", "_names")


def targets(panel: DataFrame, horizon: int = 5, *extra: str) -> DataFrame:
    """Adds the four targets; NULL means not valid."""
    base = panel.withColumns({"_r": change("close", 1, *extra), "direction_1d": forward_return(1, *extra)})
    base = base.withColumns({"vol_5d": _ahead_std("_r", horizon, *extra), "_past": _past(horizon, *extra)})
    base = base.withColumn("regime_shift_5d", F.ln((F.col("vol_5d") + EPS) / (F.col("_past") + EPS)))
    return relative_strength(base, "direction_1d", "rel_strength_1d", *extra).drop("_r", "_past")


def _past(horizon: int, *extra: str) -> Column:
    w = by_sym(*extra).rowsBetween(-(horizon - 1), 0)
    return F.when(F.count("_r").over(w) == horizon, F.stddev_samp("_r").over(w))


def long_table(wide: DataFrame, names: tuple[str, ...], key: str, value: str, *keep: str) -> DataFrame:
    """One row per (keep, name); written as an unpivot."""
    return wide.unpivot([F.col(k) for k in keep], [F.col(n) for n in names], key, value)


def target_table(panel: DataFrame, horizon: int = 5) -> DataFrame:
    """(sym, dt, target, y, valid): every target as a row; an invalid y is NULL."""
    out = long_table(targets(panel, horizon), TARGETS, "target", "y", "sym", "dt")
    return out.withColumn("valid", F.col("y").isNotNull())


def baselines(panel: DataFrame, horizon: int = 5, *extra: str) -> DataFrame:
    """What persistence alone would predict for each target; 0 where unknown."""
    base = panel.withColumn("_r", change("close", 1, *extra))
    base = base.withColumn("_past", _past(horizon, *extra))
    last = F.coalesce(F.col("_r"), F.lit(0.0))
    return base.withColumns(
        {
            "base_direction_1d": last,
            "base_rel_strength_1d": last,
            "base_vol_5d": F.coalesce("_past", F.lit(0.0)),
            "base_regime_shift_5d": F.coalesce(F.ln(F.col("_past") + EPS), F.lit(0.0)),
        }
    ).drop("_r", "_past")


def horizon_targets(panel: DataFrame, n: int) -> DataFrame:
    """n-bar forward return, its relative strength, and the trailing n-bar return."""
    base = panel.withColumns({f"direction_{n}d": forward_return(n), f"trailing_{n}d": change("close", n)})
    return relative_strength(base, f"direction_{n}d", f"rel_strength_{n}d")


def pair_ratios(panel: DataFrame, pairs: DataFrame) -> DataFrame:
    """Log price ratio of each pair on the sessions both are on the grid.

    Each side joins on its symbol and the session: two equi-joins.
    """
    px = panel.select("sym", "dt", F.when(F.col("close") > 0, F.ln("close")).alias("lc"))
    a = pairs.select("a", "b").join(px.withColumnsRenamed({"sym": "a", "lc": "la"}), "a")
    both = a.join(px.withColumnsRenamed({"sym": "b", "lc": "lb"}), ["b", "dt"])
    return both.select(F.concat_ws("/", "a", "b").alias("pair"), "dt", (F.col("la") - F.col("lb")).alias("ratio"))


def pair_changes(ratios: DataFrame, horizon: int) -> DataFrame:
    """Forward and trailing change of a pair's ratio."""
    w = by_sym(sym="pair")
    return ratios.withColumns(
        {
            "ahead": F.lead("ratio", horizon).over(w) - F.col("ratio"),
            "behind": F.col("ratio") - F.lag("ratio", horizon).over(w),
        }
    )
