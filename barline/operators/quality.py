"""Filters, validity rules and quality flags for panels and tick streams."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.cols import attach, by_sym, change, col, finite, ratio
from barline.operators.pairs import pair_correlations  # noqa: F401

# Listing codes of the venue files
EQUITY_SERIES = ("EQ",)
EQUITY_INSTRUMENT = "STK"
ISIN_COUNTRY = "IN"
EQUITY_ISIN = "INE"
SYMBOL_SUFFIXES = (".NS", ".BO", ".NSE", ".BSE")


def valid_price(c: Column | str) -> Column:
    """NULL for non-finite or non-positive prices."""
    c = finite(c)
    return F.when(c > 0, c)


def valid_volume(c: Column | str) -> Column:
    """A trade count cannot be negative; zero is a quiet session and stays."""
    c = col(c)
    return F.when(c >= 0, c)


def plain_symbol(c: Column | str) -> Column:
    """Upper-case symbol without its venue suffix."""
    tails = "|".join(s.replace(".", "\\.") for s in sorted(SYMBOL_SUFFIXES, key=len, reverse=True))
    return F.regexp_replace(F.upper(F.trim(col(c))), f"({tails})$", "")


def equities_only(rows: DataFrame, file_col: str = "dt") -> DataFrame:
    """Equity series and instruments; by ISIN only in files that carry ISINs."""
    base = rows.where(
        F.trim("series").isin(*EQUITY_SERIES) & (F.trim("instrument") == EQUITY_INSTRUMENT)
    ).withColumn("isin", F.trim("isin"))
    has = base.groupBy(file_col).agg(F.max(F.col("isin").startswith(ISIN_COUNTRY)).alias("_isins"))
    keep = ~F.coalesce(F.col("_isins"), F.lit(False)) | F.coalesce(
        F.col("isin").startswith(EQUITY_ISIN), F.lit(False)
    )
    return base.join(has, file_col).where(keep).drop("_isins")


def live_sessions(panel: DataFrame, value: str = "close") -> DataFrame:
    """Drops sessions on which no name has a value."""
    alive = panel.where(F.col(value).isNotNull()).select("dt").distinct()
    return panel.join(alive, "dt", "left_semi")


def require_live_symbols(panel: DataFrame, value: str = "close") -> DataFrame:
    """Fails the job when a symbol has no value at all.

    The check is part of the plan: it runs where the rows are, not on the driver.
    """
    seen = panel.groupBy("sym").agg(F.count(value).alias("_n"))
    checked = seen.select(
        "sym",
        F.when(F.col("_n") > 0, F.lit(True))
        .otherwise(F.raise_error(F.concat(F.lit("no usable price rows for "), F.col("sym").cast("string"))))
        .alias("_ok"),
    )
    return panel.join(checked, "sym").where("_ok").drop("_ok")


def live_span(panel: DataFrame, value: str = "close") -> DataFrame:
    """Rows between a symbol's first and last real print."""
    span = panel.where(F.col(value).isNotNull()).groupBy("sym").agg(
        F.min("dt").alias("_a"), F.max("dt").alias("_z")
    )
    return panel.join(span, "sym").where(F.col("dt").between(F.col("_a"), F.col("_z"))).drop("_a", "_z")


def symbol_coverage(panel: DataFrame, n_sessions: DataFrame, value: str = "close") -> DataFrame:
    """Share of all sessions on which each symbol printed. ``n_sessions`` is one row (n)."""
    prints = panel.groupBy("sym").agg(F.count(value).alias("prints"))
    return attach(prints, n_sessions).withColumn("coverage", F.col("prints") / F.col("n"))


def keep_covered(panel: DataFrame, least: float, value: str = "close") -> DataFrame:
    n = panel.agg(F.count_distinct("dt").alias("n"))
    good = symbol_coverage(panel, n, value).where(F.col("coverage") >= least).select("sym")
    return panel.join(good, "sym", "left_semi")


def keep_broad(panel: DataFrame, share: float, value: str = "close") -> DataFrame:
    """Sessions on which at least ``max(2, ceil(share x names))`` names are live."""
    names = panel.agg(F.count_distinct("sym").alias("_names"))
    live = panel.groupBy("dt").agg(F.count(value).alias("n_live"))
    wide = attach(live, names).where(
        F.col("n_live") >= F.greatest(F.lit(2), F.ceil(F.lit(share) * F.col("_names")))
    )
    return panel.join(wide.select("dt", "n_live"), "dt")


def clean_returns(panel: DataFrame, max_missing: float = 0.5) -> DataFrame:
    """Log returns of a dense panel: names with too many gaps leave first, then incomplete sessions."""
    prev = F.lag("close").over(by_sym())
    rets = panel.select("sym", "dt", F.ln(F.when((F.col("close") > 0) & (prev > 0), F.col("close") / prev)).alias("ret"))
    n = rets.agg(F.count_distinct("dt").alias("_t"))
    # cells outside a name's own span are missing as well, so the share is taken over all sessions
    counts = rets.groupBy("sym").agg(F.count("ret").alias("_n"))
    good = attach(counts, n).where(1 - F.col("_n") / F.col("_t") <= max_missing).select("sym")
    kept = rets.join(good, "sym", "left_semi")
    names = good.agg(F.count(F.lit(1)).alias("_names"))
    per_day = kept.groupBy("dt").agg(F.count("ret").alias("_k"))
    full = attach(per_day, names).where(F.col("_k") == F.col("_names")).select("dt")
    return kept.join(full, "dt", "left_semi")


def trim_warmup(panel: DataFrame, warmup: int = 60) -> DataFrame:
    """Keeps bars ``[warmup, T - 1)`` by calendar position, never by row count."""
    last = panel.agg(F.max("bar_idx").alias("_last"))
    return attach(panel, last).where(
        (F.col("bar_idx") >= warmup) & (F.col("bar_idx") < F.col("_last"))
    ).drop("_last")


def source_disagreement(a: DataFrame, b: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Largest relative close difference of two sources on their common cells, with a flag."""
    both = a.select("sym", "dt", F.col("close").alias("a")).join(
        b.select("sym", "dt", F.col("close").alias("b")), ["sym", "dt"]
    )
    worst = both.agg(
        F.count(F.lit(1)).alias("cells"),
        F.max(F.abs(F.col("a") - F.col("b")) / (F.abs("a") + 1e-9)).alias("max_diff"),
    )
    return worst.withColumn("flagged", F.col("max_diff") > tolerance)


def first_source(rows: DataFrame, priority: str, values: list[str]) -> DataFrame:
    """Of several sources for one cell, the one with the lowest priority number wins.

    Each source has one row per cell. A value by itself stays inside the hash aggregate; a
    struct of them would have every task sort its cells.
    """
    return rows.groupBy("sym", "dt").agg(F.min(priority).alias(priority), *[F.min_by(v, priority).alias(v) for v in values])


def illiquid_flags(panel: DataFrame, value: str = "volume", run: int = 3) -> DataFrame:
    """Per symbol: whether ``run`` zero-volume bars follow each other, and the positive median."""
    zero = F.when(F.col(value) == 0, 1).otherwise(0)
    w = by_sym().rowsBetween(-(run - 1), 0)
    marked = panel.withColumn("_run", F.sum(zero).over(w))
    # exact median of one symbol's history, bounded by the calendar
    return marked.groupBy("sym").agg(
        F.coalesce(F.max(F.col("_run") >= run), F.lit(False)).alias("is_illiquid"),
        F.coalesce(F.percentile(F.when(F.col(value) > 0, F.col(value)), 0.5), F.lit(1.0)).alias("median_volume"),
    )


def fill_volume(panel: DataFrame, value: str = "volume", run: int = 3) -> DataFrame:
    """Non-positive volumes take the symbol's positive median."""
    flags = illiquid_flags(panel, value, run)
    filled = F.when(F.col(value) > 0, F.col(value)).otherwise(F.col("median_volume"))
    return panel.join(flags, "sym").withColumn("volume_filled", filled)


def flash_crash(panel: DataFrame, limit: float = -0.2, last: int = 5) -> DataFrame:
    """Symbols with any return below ``limit`` in their last rows."""
    base = panel.withColumns({"_r": change("close"), "_k": F.row_number().over(by_sym())})
    n = base.groupBy("sym").agg(F.max("_k").alias("_n"))
    recent = base.join(n, "sym").where(F.col("_k") > F.col("_n") - last)
    return recent.groupBy("sym").agg(
        F.min("_r").alias("worst"), F.coalesce(F.max(F.col("_r") < limit), F.lit(False)).alias("flash_crash")
    )


def repair_spread(quotes: DataFrame, floor: float = 0.001) -> DataFrame:
    """A crossed quote is opened to a minimum spread and flagged."""
    crossed = F.col("ask") < F.col("bid")
    return quotes.select(
        "*",
        F.when(crossed, F.col("bid") * (1 + floor)).otherwise(F.col("ask")).alias("ask_fixed"),
        F.coalesce(crossed, F.lit(False)).alias("crossed"),
    )


def cleaning_flags(panel: DataFrame, max_missing: float = 0.2, run: int = 3) -> DataFrame:
    """One row per symbol of a dense panel: what cleaning found, as an array of flags."""
    stats = panel.groupBy("sym").agg(
        (1 - F.count("close") / F.count(F.lit(1))).alias("missing"),
        F.sum(F.coalesce(F.col("volume"), F.lit(0.0))).alias("_vol"),
    )
    liquid = illiquid_flags(panel.withColumn("volume", F.coalesce(F.col("volume"), F.lit(0.0))), "volume", run)
    dropped = F.col("missing") > max_missing
    silent = ~dropped & (F.col("_vol") == 0)
    flags = F.array_compact(
        F.array(
            F.when(dropped, F.lit("dropped")),
            F.when(~dropped & (F.col("missing") > 0), F.lit("repaired")),
            F.when(silent, F.lit("illiquid")),
            F.when(~dropped & ~silent & F.col("is_illiquid"), F.lit("illiquid_periods")),
        )
    )
    return stats.join(liquid, "sym").select("sym", "missing", flags.alias("flags"))


def local_to_utc(ts: Column | str, zone: str) -> Column:
    return F.to_utc_timestamp(col(ts), zone)


def market_open(ts: Column | str, opens: str = "09:15", closes: str = "15:30") -> Column:
    """Weekday and inside trading hours, in the column's own clock; both ends count."""
    c = col(ts)
    return (F.weekday(c) < 5) & F.date_format(c, "HH:mm").between(opens, closes)


def split_at(panel: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Rows before the cutoff date, and the rest."""
    cut = F.lit(cutoff).cast("date")
    return panel.where(F.col("dt") < cut), panel.where(F.col("dt") >= cut)


def novel_edge_share(train: DataFrame, test: DataFrame, limit: float = 0.3, tolerance: float = 0.1) -> DataFrame:
    """Strong test-set correlations absent from the training set, as a share."""
    strong = F.abs("corr") > limit
    old, new = train.where(strong).select("a", "b"), test.where(strong).select("a", "b")
    marked = new.join(old.withColumn("_old", F.lit(1)), ["a", "b"], "left")
    out = marked.agg(F.count(F.lit(1)).alias("test_edges"), F.count(F.when(F.col("_old").isNull(), 1)).alias("novel"))
    share = F.coalesce(ratio("novel", "test_edges"), F.lit(0.0))
    return out.select("test_edges", "novel", share.alias("share"), (share <= tolerance).alias("passed"))


def order_reason(
    price: Column | str, last: Column | str, weight: Column | str, max_move: float = 0.2, max_weight: float = 0.25
) -> Column:
    """Why an order is rejected, or NULL."""
    price, last, weight = col(price), col(last), col(weight)
    off = (last > 0) & (price > 0) & (F.abs(price - last) / last > max_move)
    return F.when(off, F.lit("price")).when(F.abs(weight) > max_weight, F.lit("weight"))


def stale_feeds(items: DataFrame, now: Column, max_days: float, feed: str = "feed", at: str = "published") -> DataFrame:
    """Age of the newest dated item per feed; undated feeds have no age and are stale."""
    newest = items.groupBy(feed).agg(F.max(at).alias("newest"), F.count(F.lit(1)).alias("items"))
    age = (F.unix_micros(now) - F.unix_micros("newest")) / F.lit(86_400_000_000.0)
    return newest.withColumn("age_days", age).withColumn(
        "stale", F.coalesce(F.col("age_days") > max_days, F.lit(True))
    )


def outcome_gate(log: DataFrame, bad: tuple[str, ...], max_share: float, enforce: bool = False) -> DataFrame:
    """Share of unresolved outcomes per group of an ingest log; optionally fails the job above the limit."""
    out = log.groupBy("grp").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.sum(F.when(F.col("reason").isin(*bad), 1).otherwise(0)).alias("unresolved"),
    ).withColumn("share", F.col("unresolved") / F.col("attempts"))
    passed = F.col("share") <= max_share
    if enforce:
        passed = F.when(passed, F.lit(True)).otherwise(F.raise_error(F.lit("too many unresolved sessions")))
    return out.withColumn("passed", passed)


def channel_coverage(panel: DataFrame, names: list[str], least: float = 0.05) -> DataFrame:
    """(channel, coverage, kept): finite share of each feature column."""
    stats = panel.agg(*[(F.count(finite(c)) / F.count(F.lit(1))).alias(c) for c in names])
    rows = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("coverage")) for c in names])
    out = stats.select(F.explode(rows).alias("r")).select("r.*")
    return out.withColumn("kept", F.col("coverage") >= least)


def control_channels(panel: DataFrame, donor: str, seed: int = 991) -> DataFrame:
    """Adds a noise column and a copy of ``donor`` whose sessions are shuffled together.

    The session order is drawn on the calendar (one row per day), then joined.
    """
    days = panel.select("dt").distinct().withColumn("_h", F.md5(F.concat(F.lit(f"{seed}-"), F.col("dt").cast("string"))))
    numbered = days.select(
        "dt",
        F.row_number().over(Window.orderBy("dt")).alias("_at"),
        F.row_number().over(Window.orderBy("_h", "dt")).alias("_from"),
    )
    moved = numbered.select("dt", "_at").join(
        numbered.select(F.col("dt").alias("_src"), F.col("_from").alias("_at")), "_at"
    )
    donors = panel.select(F.col("sym"), F.col("dt").alias("_src"), F.col(donor).alias("control_shuffled"))
    out = panel.join(moved.select("dt", "_src"), "dt").join(donors, ["sym", "_src"], "left").drop("_src")
    u = (F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), "sym", "dt")), 1, 13), 16, 10).cast("double") + 0.5) / 16.0**13
    v = (F.conv(F.substring(F.md5(F.concat_ws("+", F.lit(seed), "sym", "dt")), 1, 13), 16, 10).cast("double") + 0.5) / 16.0**13
    # Box-Muller on two hashed uniforms: the same noise on every retry of a task
    return out.withColumn("control_noise", F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v))
