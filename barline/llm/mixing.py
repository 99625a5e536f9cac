"""Mixing sources to target weights.

Tokens are summed per source, targets follow from the weights (a target above ``cap`` times
its source is cut there and the excess is shared again by weight), and a document is
emitted floor(rate) times plus once more with a probability equal to the fraction, drawn
from a hash of its id, its text and a seed.

Defined cases: a null text has size 0; a null source is a source of its own, last in order;
a source without tokens has target 0 and its documents are not taken; rows draw by doc_id
and text, so that rows without a doc_id, or with a shared one, draw apart; rows alike in both draw alike; an empty table gives no rows; further columns
are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import WORD, free, step

SEED = "mix-1"
WEIGHTS = (1, 2, 3)
CAP = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(__source, __source_size, __target) from (__source, __size) rows.

    Weights are dealt in order of the source's code points, repeating. Sharing the excess
    again and again ends where all sources below their cap get the same amount per unit of
    weight. In order of cap per weight the capped sources come first, so running sums over
    the sources (one row each) give that level directly.
    """
    per = sizes.groupBy("__source").agg(F.sum("__size").alias("__source_size"))
    # one row per source from here on
    order = Window.orderBy(F.col("__source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int")).cast("long"))
    per = per.withColumn("top", F.col("__source_size") * cap)
    by_ratio = Window.orderBy(F.col("top") / F.col("w"), F.col("__source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = (per.withColumn("top_before", F.coalesce(F.sum("top").over(before), F.lit(0)))
           .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
           .withColumn("total", F.sum("__source_size").over(everything))
           .withColumn("level", (F.col("total") - F.col("top_before")) / F.col("w_left")))
    # the first source whose cap the level does not reach sets the level of all later ones
    under = F.col("level") * F.col("w") <= F.col("top")
    per = per.withColumn("final", F.min(F.when(under, F.struct("top_before", "w_left"))).over(everything))
    level = (F.col("total") - F.col("final.top_before")) / F.col("final.w_left")
    capped = F.col("final").isNull() | (F.col("top_before") < F.col("final.top_before"))
    target = F.when(F.col("__source_size") == 0, 0.0).when(capped, F.col("top").cast("double")).otherwise(F.col("w") * level)
    return per.select("__source", "__source_size", target.cast("double").alias("__target"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, name: str = "mix") -> DataFrame:
    """``docs`` with a struct column ``name`` of size, source_size, target, rate and copies.

    The table of sources is written first, so its size is known when it is joined: Spark
    broadcasts it below its own threshold and merges (splitting a hot source) above.
    """
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    own = free(docs, "__size")
    sized = docs.withColumn(own, size)
    per = step(targets(docs.select(F.col("source").alias("__source"), size.alias("__size")), weights, cap), "mix_sources")
    joined = sized.alias("d").join(per.alias("s"), F.col("d.source").eqNullSafe(F.col("s.__source")))
    rate = F.when(F.col("s.__source_size") > 0, F.col("s.__target") / F.col("s.__source_size")).otherwise(F.lit(0.0))
    text = F.md5(F.coalesce(F.col("d.text"), F.lit("")))
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col("d.doc_id").cast("string"), F.lit("")), F.lit(":"), text)
    # 52 bits of the digest as a fraction
    draw = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    copies = (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    mix = F.struct(
        F.col(f"d.{own}").alias("size"), F.col("s.__source_size").alias("source_size"), F.col("s.__target").alias("target"),
        rate.alias("rate"), copies.alias("copies"))
    return joined.select(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns], mix.alias(name))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mixture itself: each document as often as it is drawn, with the columns of ``docs``."""
    name, copy = free(docs, "mix"), free(docs, "__copy")
    planned = plan_mix(docs, weights, cap, seed, name).where(F.col(name)["copies"] > 0)
    copies = F.explode(F.sequence(F.lit(1), F.col(name)["copies"].cast("int")))
    return planned.withColumn(copy, copies).select(*[F.col(f"`{c}`") for c in docs.columns])
