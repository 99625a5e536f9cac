"""Rolling partial-correlation networks of a stated, small universe."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.session import spread

EDGE_FLOOR = 0.05
NODE_STATS = ("strength", "centrality", "clustering", "participation")
GLOBAL_STATS = ("fiedler", "spectral_radius", "mean_abs_pcorr", "entropy", "density")


def shrunk_covariance(x: np.ndarray) -> np.ndarray:
    """Ledoit-Wolf shrinkage towards a scaled identity."""
    t, n = x.shape
    x = x - x.mean(axis=0)
    s = x.T @ x / max(t - 1, 1)
    goal = np.trace(s) / n * np.eye(n)
    gap = ((s - goal) ** 2).sum()
    if gap <= 1e-18:
        return s
    # sum over bars of ||x x' - s||^2, expanded so no outer product is formed
    sq = (x * x).sum(axis=1)
    noise = (sq @ sq - 2 * np.einsum("ti,ij,tj->", x, s, x) + t * (s * s).sum()) / t**2
    share = min(max(noise / gap, 0.0), 1.0)
    return (1 - share) * s + share * goal


def partial_correlations(cov: np.ndarray) -> np.ndarray:
    n = len(cov)
    prec = np.linalg.pinv(cov + 1e-10 * np.trace(cov) / max(n, 1) * np.eye(n))
    d = np.sqrt(np.clip(np.diag(prec), 1e-18, None))
    out = np.clip(-prec / np.outer(d, d), -1, 1)
    np.fill_diagonal(out, 0.0)
    return out


def network_stats(pc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per-node and whole-network statistics of one snapshot."""
    n = len(pc)
    a = np.abs(pc)
    a = np.where(a < EDGE_FLOOR, 0.0, a)
    strength = a.sum(axis=1)
    vals, vecs = np.linalg.eigh(a)
    lead = np.abs(vecs[:, -1]) if a.any() else np.zeros(n)
    w = np.cbrt(a / a.max()) if a.max() > 0 else a
    deg = (a > 0).sum(axis=1)
    slots = deg * (deg - 1.0)
    clustering = np.divide(np.einsum("ij,jk,ki->i", w, w, w), slots, out=np.zeros(n), where=slots > 0)
    share = np.divide(a, strength[:, None], out=np.zeros_like(a), where=strength[:, None] > 1e-18)
    participation = np.where(strength > 1e-18, 1 - (share**2).sum(axis=1), 0.0)
    lap = np.linalg.eigvalsh(np.diag(strength) - a)
    p = np.clip(lap / strength.sum(), 0, None) if strength.sum() > 1e-18 else np.zeros(0)
    p = p[p > 1e-12]
    off = ~np.eye(n, dtype=bool)
    glob = [lap[1] if n > 1 else 0.0, np.abs(vals).max() if n else 0.0, np.abs(pc[off]).mean(), float(-(p * np.log(p)).sum()), (a[off] > 0).mean()]
    return np.column_stack([strength, lead, clustering, participation]), np.array(glob)


def _known(rets: DataFrame, names: list[int]) -> None:
    """A name outside the stated universe fails the job; a pivot would drop it without a word."""
    other = rets.select("sym").where(~F.col("sym").isin(names)).limit(1).collect()
    if other:
        raise ValueError(f"{other[0][0]} is not in the stated universe")


def rolling_network(rets: DataFrame, names: list[int], window: int = 60, block: int = 240) -> DataFrame:
    """(bar_idx, sym, node stats, network stats) from the ``window`` bars strictly before each bar.

    Bars go into blocks that overlap by one window, so a bar is copied at most twice
    instead of once per window; each block is one grouped task.
    """
    _known(rets, names)
    wide = rets.groupBy("bar_idx").pivot("sym", names).agg(F.first("ret")).na.fill(0.0)
    own = F.floor(F.col("bar_idx") / block).cast("int")
    nxt = F.when(F.col("bar_idx") % block >= block - window, own + 1)
    placed = wide.withColumn("_b", F.explode(F.array_compact(F.array(own, nxt))))
    cols = [str(n) for n in names]
    stats = [*NODE_STATS, *GLOBAL_STATS]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_idx")
        idx, x = pdf["bar_idx"].to_numpy(), pdf[cols].to_numpy(dtype="float64")
        b, out = int(pdf["_b"].iloc[0]), []
        for k in range(window, len(idx)):
            if idx[k] // block == b and idx[k] - idx[k - window] == window:
                node, glob = network_stats(partial_correlations(shrunk_covariance(x[k - window : k])))
                out += [(int(idx[k]), int(n), *node[i], *glob) for i, n in enumerate(names)]
        return pd.DataFrame(out, columns=["bar_idx", "sym", *stats])

    schema = "bar_idx int, sym bigint, " + ", ".join(f"{c} double" for c in stats)
    return spread(placed, "_b").groupBy("_b").applyInPandas(run, schema)


def heart_stability(nodes: DataFrame, value: str = "centrality", top: int = 3, last: int = 10, least: int = 5) -> DataFrame:
    """How often the set of the ``top`` most central names changes over the last snapshots."""
    rank = Window.partitionBy("bar_idx").orderBy(F.desc(value), "sym")
    heart = nodes.withColumn("_k", F.row_number().over(rank)).where(F.col("_k") <= top).groupBy("bar_idx").agg(
        F.concat_ws(",", F.array_sort(F.collect_list(F.col("sym").cast("string")))).alias("heart")
    )
    # one row per session
    w = Window.orderBy("bar_idx").rowsBetween(-(last - 1), 0)
    base = heart.withColumn("_l", F.collect_list("heart").over(w))
    base = base.withColumn("consistency", 1 - (F.size(F.array_distinct("_l")) - 1) / F.size("_l"))
    c = F.col("consistency")
    label = F.when(c > 0.7, "STABLE").when(c > 0.4, "ROTATING").otherwise("CHAOTIC")
    return base.select(
        "bar_idx", "heart", "consistency", F.when(F.size("_l") < least, "INSUFFICIENT_DATA").otherwise(label).alias("trend")
    )


def node_features(rets: DataFrame, last: int = 20, edge: int = 5) -> DataFrame:
    """Per symbol over its last returns: spread, and newest-minus-oldest mean."""
    newest = Window.partitionBy("sym").orderBy(F.desc("dt"))
    recent = rets.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= last)
    n = recent.groupBy("sym").agg(F.max("_k").alias("_n"))
    r = recent.join(n, "sym")
    return r.groupBy("sym").agg(
        F.stddev_pop("ret").alias("vol"),
        (F.avg(F.when(F.col("_k") <= edge, F.col("ret"))) - F.avg(F.when(F.col("_k") > F.col("_n") - edge, F.col("ret")))).alias("momentum"),
    )


