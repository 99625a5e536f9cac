"""Block permutations of sessions, shared by every symbol and channel.

A draw's order is the hash order of its blocks, so any engine and any retry of a
task gives the same permutation. The mapping is (draws x sessions) rows and never
carries prices or features; those join it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_ids(n: int, first: int = 1) -> Column:
    return F.explode(F.sequence(F.lit(first), F.lit(first + n - 1)))


def block_order(cal: DataFrame, draws: int, block: int = 21, seed: str = "p", identity: bool = False) -> DataFrame:
    """(draw, new_idx, old_idx): blocks of consecutive bars in hash order.

    ``identity`` adds draw 0, the real order. The last, shorter block keeps its length.
    """
    n = cal.agg((F.max("bar_idx") + 1).alias("n"))
    blocks = n.select("n", draw_ids(draws).alias("draw")).select(
        "n", "draw", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block).cast("int"))).alias("blk")
    )
    size = F.least(F.lit(block), F.col("n") - F.col("blk") * block)
    key = F.md5(F.concat_ws("-", F.lit(seed), F.col("draw").cast("string"), F.col("blk").cast("string")))
    # one row per block of one draw
    order = Window.partitionBy("draw").orderBy("_h", "blk").rowsBetween(Window.unboundedPreceding, 0)
    placed = blocks.withColumns({"_h": key, "_size": size}).withColumn("_at", F.sum("_size").over(order) - F.col("_size"))
    rows = placed.select("draw", "blk", "_at", F.posexplode(F.sequence(F.col("blk") * block, F.col("blk") * block + F.col("_size") - 1)))
    out = rows.select("draw", (F.col("_at") + F.col("pos")).cast("int").alias("new_idx"), F.col("col").cast("int").alias("old_idx"))
    if identity:
        same = cal.select(F.lit(0).alias("draw"), F.col("bar_idx").alias("new_idx"), F.col("bar_idx").alias("old_idx"))
        out = same.unionByName(out)
    return out


def permuted_prices(panel: DataFrame, order: DataFrame) -> DataFrame:
    """Prices of every draw: returns moved by whole blocks and compounded again from the first price.

    ``panel(sym, bar_idx, close)`` must be dense. One equi-join on the old position;
    the window runs inside (draw, sym), a calendar's worth of rows.
    """
    w = Window.partitionBy("sym").orderBy("bar_idx")
    prev = F.lag("close").over(w)
    rets = panel.select(
        "sym", F.col("bar_idx").alias("old_idx"), F.coalesce(F.try_divide("close", prev) - 1, F.lit(0.0)).alias("_r")
    )
    first = panel.groupBy("sym").agg(F.min_by("close", "bar_idx").alias("_first"))
    moved = order.join(rets, "old_idx").withColumnRenamed("new_idx", "bar_idx")
    past = Window.partitionBy("draw", "sym").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    grown = moved.withColumn("_g", F.exp(F.sum(F.log1p("_r")).over(past)))
    return grown.join(first, "sym").select("draw", "sym", "bar_idx", (F.col("_first") * F.col("_g")).alias("close"))


def permuted_rows(features: DataFrame, order: DataFrame, names: list[str]) -> DataFrame:
    """Feature rows moved by the same mapping as the prices."""
    f = features.select("sym", F.col("bar_idx").alias("old_idx"), *names)
    return order.join(f, "old_idx").select("draw", "sym", F.col("new_idx").alias("bar_idx"), *names)


def bootstrap_paths(rets: DataFrame, n_paths: int, length: int, seed: str = "b", jitter: float = 0.1) -> DataFrame:
    """(path, t, sym, r): contiguous runs of history from hashed starts, plus a little noise.

    ``rets(sym, bar_idx, ret)`` dense. Starts are generated, offsets exploded, history
    joined on the bar number.
    """
    from barline.sources.synthetic import normal, uniform

    stats = rets.agg((F.max("bar_idx") + 1).alias("_n"), F.stddev_pop("ret").alias("_sd"))
    starts = stats.select("_n", "_sd", F.explode(F.sequence(F.lit(0), F.lit(n_paths - 1))).alias("path"))
    room = F.greatest(F.col("_n") - length, F.lit(0))
    starts = starts.withColumn("_s", F.floor(uniform(seed, "path") * room).cast("int"))
    cells = starts.select("path", "_s", "_sd", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("t"))
    cells = cells.withColumn("bar_idx", F.col("_s") + F.col("t"))
    rows = cells.join(rets.select("sym", "bar_idx", "ret"), "bar_idx")
    noise = normal(seed + "j", "path", "t", "sym") * F.col("_sd") * jitter
    return rows.select("path", "t", "sym", (F.col("ret") + noise).alias("r"))


