"""Walk-forward selection: pick a channel on train rows, score that pick on test rows.

A study is one job: draw, window, target and feature are columns. All scores are
partial rank correlations, which follow from six sums per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.operators.alignment import assign_windows
from barline.operators.ordering import window_rank


def windowed_cells(
    panel: DataFrame, features: Sequence[str], targets: Sequence[str], train: int, test: int, base: str = "base_", mask: str | None = None
) -> DataFrame:
    """(draw, w, side, target, feature, f, y, b): every usable cell in every window it belongs to.

    ``panel`` is keyed by (draw, sym, bar_idx) with bars numbered from 0 in each draw.
    """
    n = panel.groupBy("draw").agg((F.max("bar_idx") + 1).alias("_n"))
    placed = assign_windows(panel.join(F.broadcast(n), "draw"), F.col("_n"), train, test)
    keep = ["draw", "w", "side", "sym", "bar_idx"] + ([mask] if mask else [])
    t_cells = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("y"), F.col(f"{base}{t}").alias("b")) for t in targets])
    f_cells = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(f).alias("feature"), F.col(f).alias("f")) for i, f in enumerate(features)])
    rows = placed.select(*keep, f_cells.alias("_f"), F.explode(t_cells).alias("_t")).where(F.col("_t.y").isNotNull() & F.col("_t.b").isNotNull())
    out = rows.select(*keep, "_t.*", F.explode("_f").alias("_f")).select(*keep, "target", "y", "b", "_f.*")
    return out.where(F.col("f").isNotNull())


def incremental_scores(cells: DataFrame, keys: Sequence[str], least: int = 20) -> DataFrame:
    """Partial rank correlation of f with y given b per key; 0 below ``least`` rows or for a constant side.

    A key holds one window of one feature over the stated universe.
    """
    g = list(keys)
    ranks = cells.select(*g, window_rank(g, "f").alias("rf"), window_rank(g, "y").alias("ry"), window_rank(g, "b").alias("rb"))
    s = ranks.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"),
        F.covar_pop("rf", "ry").alias("_fy"), F.covar_pop("rf", "rb").alias("_fb"), F.covar_pop("ry", "rb").alias("_yb"),
        F.var_pop("rf").alias("_ff"), F.var_pop("ry").alias("_yy"), F.var_pop("rb").alias("_bb"),
    )
    s = s.withColumn("_ib", F.when(F.col("_bb") > 0, 1 / F.col("_bb")).otherwise(0.0))
    cov = F.col("_fy") - F.col("_fb") * F.col("_yb") * F.col("_ib")
    vf = F.col("_ff") - F.col("_fb") ** 2 * F.col("_ib")
    vy = F.col("_yy") - F.col("_yb") ** 2 * F.col("_ib")
    score = F.when((F.col("n") >= least) & (vf > 1e-9) & (vy > 1e-9), cov / F.sqrt(vf * vy)).otherwise(0.0)
    return s.select(*g, "n", score.alias("score"))


KEYS = ("draw", "w", "side", "target", "k", "feature")


def select_and_score(scores: DataFrame, least: int = 20) -> DataFrame:
    """(draw, target, w, pick, in_sample, out_sample): best train score, same channel on test.

    A window needs ``least`` rows on both sides.
    """
    side = lambda s, c: F.max(F.when(F.col("side") == s, c))
    both = scores.groupBy("draw", "target", "w", "k", "feature").agg(
        side("train", F.abs("score")).alias("in_sample"), side("test", F.abs("score")).alias("out_sample"),
        side("train", F.col("n")).alias("_ntr"), side("test", F.col("n")).alias("_nte"),
    ).where((F.col("_ntr") >= least) & (F.col("_nte") >= least))
    best = both.groupBy("draw", "target", "w").agg(
        F.max_by(F.struct("feature", "in_sample", "out_sample"), F.struct("in_sample", -F.col("k"))).alias("_p")
    )
    return best.select("draw", "target", "w", F.col("_p.feature").alias("pick"), "_p.in_sample", "_p.out_sample")


def study_summary(picks: DataFrame) -> DataFrame:
    return picks.groupBy("draw", "target").agg(
        F.count(F.lit(1)).alias("n_windows"), F.avg("in_sample").alias("mean_is"), F.avg("out_sample").alias("mean_oos"),
        (F.avg("in_sample") - F.avg("out_sample")).alias("gap"), F.count_distinct("pick").alias("n_picks"),
    )


def study(panel: DataFrame, features: Sequence[str], targets: Sequence[str], train: int, test: int, **kw) -> DataFrame:
    cells = windowed_cells(panel, features, targets, train, test, **kw)
    return select_and_score(incremental_scores(cells, KEYS))


def regime_cells(cells: DataFrame, regime: str = "regime", least: int = 50) -> DataFrame:
    """Cells of high- and low-regime bars, cut at the train rows' terciles.

    The cuts come from each window's own train bars; a window with too few known
    regime values leaves.
    """
    base = cells.where(F.col("side") == "train").select("draw", "w", "sym", "bar_idx", regime).distinct()
    cuts = base.groupBy("draw", "w").agg(
        F.percentile(regime, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("_c"), F.count(regime).alias("_k")
    ).where(F.col("_k") >= least)
    both = cells.join(cuts, ["draw", "w"])
    label = F.when(F.col(regime) > F.col("_c")[1], "high").when(F.col(regime) < F.col("_c")[0], "low")
    return both.withColumn("_l", label).where(F.col("_l").isNotNull()).withColumn("target", F.concat_ws("__", "target", "_l")).drop("_c", "_k", "_l")


def pending_draws(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Draws not yet in the stored results table, so an interrupted study continues.

    Only a table that does not exist means that nothing is stored; any other failure stops
    the study instead of starting it over.
    """
    try:
        done = spark.read.parquet(path).select("draw").distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return wanted
    return wanted.join(done, "draw", "left_anti")


def prefix_unchanged(full: DataFrame, cut: DataFrame, keys: Sequence[str], names: Sequence[str], digits: int = 9) -> DataFrame:
    """Rows of the shortened run that differ from the full run: must be empty for a causal operator."""
    keys = list(keys)
    a = cut.select(*keys, *[F.round(c, digits).alias(c) for c in names])
    b = full.select(*keys, *[F.round(c, digits).alias(f"_{c}") for c in names])
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(b, keys, "left").where(~same)


def alignment_diagnostic(panel: DataFrame, feature: str, now: str, ahead: str) -> DataFrame:
    """|correlation| of a feature with the same bar's and the next bar's return."""
    parts = []
    for name, y in (("now", now), ("ahead", ahead)):
        both = F.col(feature).isNotNull() & F.col(y).isNotNull()
        x, v = F.when(both, F.col(feature)), F.when(both, F.col(y))
        parts += [F.covar_pop(x, v).alias(f"c_{name}"), F.var_pop(x).alias(f"x_{name}"), F.var_pop(v).alias(f"y_{name}")]
    s = panel.agg(*parts)
    rho = lambda n: F.when((F.col(f"x_{n}") > 0) & (F.col(f"y_{n}") > 0), F.abs(F.col(f"c_{n}") / F.sqrt(F.col(f"x_{n}") * F.col(f"y_{n}")))).otherwise(0.0)
    return s.select(rho("now").alias("rho_now"), rho("ahead").alias("rho_ahead")).withColumn("honest", F.col("rho_now") >= F.col("rho_ahead"))


