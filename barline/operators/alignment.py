"""Joins that line series up by date and symbol, never by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.cols import by_sym, change, expanding_z, nonzero, ratio, squash, trailing_z
from barline.operators.technical import bars_since

def align_features(panel: DataFrame, features: DataFrame) -> DataFrame:
    """Feature columns on the price grid; a missing cell stays NULL."""
    return panel.join(features, ["sym", "dt"], "left")


def zero_filled_counts(grid: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """Counts on the grid; a session without events counts zero."""
    return grid.join(counts, ["sym", "dt"], "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("double"))


def event_features(counts: DataFrame, name: str = "ann_count") -> DataFrame:
    """Count, its strictly trailing z-score, and sessions since the last event."""
    out = counts.withColumn(f"{name}_z", trailing_z(name))
    return bars_since(out, name, "days_since")


def as_of_lagged(slow: DataFrame, calendar: DataFrame, names: list[str], lag: int = 1) -> DataFrame:
    """Market-wide series on the price calendar: last known value, then at least one bar late.

    Both calendars are united, values carried forward, and only price sessions
    kept before the shift. The rows are calendar days, so one ordered window is small.
    """
    if lag < 1:
        raise ValueError("a lag below one bar would use a report before it was published")
    days = calendar.select("dt").withColumn("_price", F.lit(True))
    both = slow.select("dt", *names).join(days, "dt", "full")
    filled = both.select(
        "dt", "_price", *[F.last(c, ignorenulls=True).over(Window.orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in names]
    ).where("_price")
    late = Window.orderBy("dt")
    return filled.select("dt", *[F.lag(c, lag).over(late).alias(c) for c in names])


def market_channels(aligned: DataFrame, names: list[str], least: int = 20) -> DataFrame:
    """Expanding z-score, squashed, undefined as 0 - for market-wide series."""
    base = aligned.withColumn("sym", F.lit(0))
    return base.select("dt", *[F.coalesce(squash(expanding_z(c, least)), F.lit(0.0)).alias(c) for c in names])


def forward_fill(panel: DataFrame, value: str, out: str, limit: int | None = None) -> DataFrame:
    """Last known value of a symbol, at most ``limit`` rows back (no limit: inside its span)."""
    start = Window.unboundedPreceding if limit is None else -limit
    return panel.withColumn(out, F.last(value, ignorenulls=True).over(by_sym().rowsBetween(start, 0)))


def cross_venue(first: DataFrame, second: DataFrame, extreme_bps: float = 500.0) -> DataFrame:
    """Return spread of two venues in basis points and the second one's volume share.

    The second close may be carried over one missing session; extreme spreads are masked.
    """
    b = second.select("sym", "dt", F.col("close").alias("close_b"), F.col("volume").alias("volume_b"))
    both = first.select("sym", "dt", "close", "volume").join(b, ["sym", "dt"], "left")
    both = forward_fill(both, "close_b", "_fb", 1)
    spread = (change("close") - change("_fb")) * 10_000
    both = both.withColumn("_s", spread)
    kept = F.when(F.abs("_s") <= extreme_bps, F.col("_s"))
    return both.select(
        "sym", "dt",
        kept.alias("spread_bps"), F.abs(kept).alias("spread_abs_bps"),
        ratio("volume_b", nonzero(F.col("volume") + F.col("volume_b"))).alias("second_share"),
    )


def underlying_price(contracts: DataFrame, equities: DataFrame) -> DataFrame:
    """Price of the underlying: the file's own, else the same session's equity close."""
    eq = equities.select("sym", "dt", F.col("close").alias("_eq"))
    return contracts.join(eq, ["sym", "dt"], "left").withColumn("spot", F.coalesce("underlying", "_eq")).drop("_eq")


def nearest(rows: DataFrame, group: list[str], at: str, target: Column, order: str, keep: list[str]) -> DataFrame:
    """Per group the row whose ``at`` lies closest to ``target``; the earlier row wins a tie."""
    return rows.groupBy(*group).agg(
        F.min_by(F.struct(at, *keep), F.struct(F.abs(F.col(at) - target), F.col(order))).alias("_n")
    ).select(*group, "_n.*")


def sector_pairs(names: DataFrame, least: int = 3) -> DataFrame:
    """Pairs ``a < b`` inside a sector of at least ``least`` names.

    The number of pairs is quadratic in a sector's size, which is the feature: callers
    state a universe of names, not fills.
    """
    ok = names.groupBy("sector").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("sector")
    kept = names.join(ok, "sector", "left_semi")
    return (
        kept.select("sector", F.col("sym").alias("a"))
        .join(kept.select("sector", F.col("sym").alias("b")), "sector")
        .where(F.col("a") < F.col("b"))
    )


def resolve_tokens(wanted: DataFrame, instruments: DataFrame, strict: bool = True) -> DataFrame:
    """Symbol -> token over equity instruments; a symbol without a token fails the job when ``strict``."""
    known = instruments.where(F.trim("instrument_type") == "EQ").select(
        F.upper(F.trim("tradingsymbol")).alias("name"), F.col("token").cast("bigint").alias("token")
    ).where(F.col("token").isNotNull()).groupBy("name").agg(F.max("token").alias("token"))
    out = wanted.join(known, "name", "left")
    if not strict:
        return out
    missing = F.raise_error(F.concat(F.lit("no token for "), F.col("name")))
    return out.withColumn("token", F.when(F.col("token").isNotNull(), F.col("token")).otherwise(missing))


def missing_names(wanted: DataFrame, have: DataFrame, key: str = "name") -> DataFrame:
    return wanted.join(have, key, "left_anti")


def walk_windows(bars: DataFrame, train: int, test: int) -> DataFrame:
    """(w, s, e, te): rolling windows over a calendar with one row holding ``n_bars``.

    Built by arithmetic on the bar count, so assigning bars needs no range join.
    """
    steps = F.sequence(F.lit(0), F.greatest(F.floor((F.col("n_bars") - train - 2) / test), F.lit(0)).cast("int"))
    return (
        bars.where(F.col("n_bars") > train + 1)
        .select(F.explode(steps).alias("w"), "n_bars")
        .select(
            "w",
            (F.col("w") * test).cast("int").alias("s"),
            (F.col("w") * test + train).cast("int").alias("e"),
            F.least(F.col("w") * test + train + test, F.col("n_bars")).cast("int").alias("te"),
        )
    )


def assign_windows(panel: DataFrame, n_bars: Column, train: int, test: int, bar: str = "bar_idx") -> DataFrame:
    """Each bar with every window it belongs to, and the side (train or test).

    A bar's windows follow from its index; they are exploded, not searched.
    """
    b = F.col(bar)
    last = F.floor((n_bars - train - 2) / test)
    hi = F.least(F.floor(b / test), last)
    lo = F.greatest(F.ceil((b - train - test + 1) / test), F.lit(0))
    ids = F.when((hi >= lo) & (n_bars > train + 1), F.sequence(lo.cast("int"), hi.cast("int")))
    out = panel.withColumn("w", F.explode(ids))
    return out.withColumn("side", F.when(b < F.col("w") * test + train, F.lit("train")).otherwise(F.lit("test")))
