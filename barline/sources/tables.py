"""Panels derived from the relational tables.

``lineitem`` rows are read as fills (supplier = symbol, ship date = session),
``events`` as ticks. Both are reduced by partial aggregation before any window
sees them, so a symbol that holds a third of all rows costs no more after this
step than any other one: at most one row per symbol and session (or minute).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.session import durable


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def session_pos() -> Column:
    """Order of a fill inside its session, as one integer.

    A struct as ordering value would force sort-based aggregation; an integer
    keeps ``min_by``/``max_by`` inside the hash aggregate.
    """
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 262144 + F.pmod(cents, F.lit(262144))


def fills(spark: SparkSession, sf: str, books: int | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per fill: symbol, session, price, size, order inside the session.

    ``books`` folds the suppliers into that many baskets (a dense, small universe).
    """
    sym: Column = F.col("l_suppkey") if books is None else F.col("l_suppkey") % books
    return table(spark, sf, "lineitem").select(
        sym.cast("bigint").alias("sym"),
        F.col("l_shipdate").cast("date").alias("dt"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("notional"),
        session_pos().alias("pos"),
        *extra,
    )


def daily_bars(ticks: DataFrame, *keys: str) -> DataFrame:
    """Open/high/low/close/volume/turnover per symbol and session.

    All aggregates combine on the map side.
    """
    return ticks.groupBy(*keys, "sym", "dt").agg(
        F.min_by("px", "pos").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "pos").alias("close"),
        F.sum("qty").alias("volume"),
        F.sum("notional").alias("turnover"),
        F.count(F.lit(1)).alias("trades"),
    )


def bars(spark: SparkSession, sf: str, books: int | None = None) -> DataFrame:
    return daily_bars(fills(spark, sf, books))


def saved_bars(spark: SparkSession, sf: str, books: int | None = None) -> DataFrame:
    """Bars written once to the shared folder.

    For work that reads the panel several times (its calendar, its live spans, its
    cells): the fills are scanned once instead of once per use.
    """
    return durable(bars(spark, sf, books), "bars")


def calendar(panel: DataFrame) -> DataFrame:
    """Distinct sessions, numbered. Its size is the number of days, not of rows."""
    days = panel.select("dt").distinct()
    # one row per calendar day: a few thousand rows however large the panel is
    return days.select("dt", (F.row_number().over(Window.orderBy("dt")) - 1).cast("int").alias("bar_idx"))


def live_grid(panel: DataFrame, cal: DataFrame, value: str = "close") -> DataFrame:
    """Every session between a symbol's first and last real print.

    Built by expanding each symbol's own date range and an equi-join with the
    calendar, so absent cells appear without a cross join.
    """
    span = (
        panel.where(F.col(value).isNotNull())
        .groupBy("sym")
        .agg(F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))
    )
    days = span.select("sym", F.explode(F.sequence("first_dt", "last_dt")).alias("dt"))
    return days.join(cal, "dt")


def dense_panel(panel: DataFrame, cal: DataFrame | None = None) -> DataFrame:
    """Panel on the live grid; cells without a print are NULL."""
    cal = calendar(panel) if cal is None else cal
    return live_grid(panel, cal).join(panel, ["sym", "dt"], "left")


def ticks(spark: SparkSession, sf: str, books: int | None = 10) -> DataFrame:
    """``events`` as trades: value is the price, the JSON ``k`` the size."""
    sym = F.col("user_id") if books is None else F.col("user_id") % books
    return table(spark, sf, "events").select(
        sym.cast("bigint").alias("sym"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("ts").cast("date").alias("dt"),
        F.col("event_id"),
        F.col("event_type"),
        F.col("value").alias("px"),
        (F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0)) + 1.0).alias("qty"),
    )


def tick_pos() -> Column:
    """Arrival order of a tick as one integer (time first, then identifier)."""
    return F.unix_micros("ts") * 4096 + F.pmod("event_id", F.lit(4096))


def minute_bars(tick_rows: DataFrame) -> DataFrame:
    """Minute bars; a symbol has at most 1,440 of them per day."""
    pos = tick_pos()
    return (
        tick_rows.withColumn("minute", (F.hour("ts") * 60 + F.minute("ts")).cast("int"))
        .groupBy("sym", "dt", "minute")
        .agg(
            F.min_by("px", pos).alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", pos).alias("close"),
            F.sum("qty").alias("volume"),
        )
    )
