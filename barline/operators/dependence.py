"""Rank and distance dependence between features and targets, with permutation nulls."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.cols import attach
from barline.operators import distance
from barline.operators.metrics import false_discovery
from barline.session import durable, spread


def audit_rows(panel: DataFrame, features: Sequence[str], targets: Sequence[str], base: str = "base_") -> DataFrame:
    """(target, sym, dt, y, b, x array): cells of sessions on which every symbol's target is valid."""
    names = panel.agg(F.count_distinct("sym").alias("_names"))
    rows = attach(panel, names)
    cells = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("y"), F.col(f"{base}{t}").alias("b")) for t in targets])
    x = F.array(*[F.col(f).cast("double") for f in features])
    long = rows.select("sym", "dt", "_names", x.alias("x"), F.explode(cells).alias("c")).select("sym", "dt", "_names", "x", "c.*")
    full = long.groupBy("target", "dt", "_names").agg(F.count("y").alias("_k")).where(F.col("_k") == F.col("_names"))
    return long.drop("_names").join(full.select("target", "dt"), ["target", "dt"], "left_semi")


def market_wide(panel: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, market_level): channels that have the same value for every symbol of a session."""
    spread = panel.groupBy("dt").agg(*[(F.max(f) - F.min(f)).alias(f) for f in features])
    flat = spread.agg(*[(F.coalesce(F.max(f), F.lit(0.0)) <= 1e-12).alias(f) for f in features])
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("market_level")) for f in features])
    return flat.select(F.explode(cells).alias("c")).select("c.*")


def block_ranks(n: int, block: int, draws: int, seed: str) -> np.ndarray:
    """Blocks of each draw in the order of the hash of (seed, draw, block)."""
    blocks = -(-n // block)
    out = np.empty((draws, blocks), dtype=np.int64)
    for d in range(draws):
        keys = [hashlib.md5(f"{seed}-{d + 1}-{b}".encode()).digest() for b in range(blocks)]
        out[d] = sorted(range(blocks), key=keys.__getitem__)
    return out


def block_draws(n: int, block: int, draws: int, seed: str) -> np.ndarray:
    """Row order of each draw: its blocks, one after the other."""
    rows = [np.arange(b, min(b + block, n), dtype=np.int32) for b in range(0, n, block)]
    return np.array([np.concatenate([rows[b] for b in order]) for order in block_ranks(n, block, draws, seed)], dtype=np.int32).reshape(draws, n)


def moved_sums(x: np.ndarray, y: np.ndarray, block: int, orders: np.ndarray) -> np.ndarray:
    """Sums of products of each column of ``x`` with ``y`` moved by whole blocks, per draw, without moving rows.

    Whole blocks of y stand at multiples of ``block`` before the short last one, and behind it
    at such places shifted by its length. Two tables of sums, of every block of y at every
    aligned and every shifted place, hold all that can occur; a draw adds up one cell per block.
    """
    n, columns = x.shape
    whole = n // block
    short = n - whole * block
    y_blocks = y[: whole * block].reshape(whole, block).T
    out = np.empty((len(orders), columns))
    slot = np.arange(orders.shape[1])
    # where the short block stands; behind all if there is none
    at = np.argmax(orders == whole, axis=1) if short else np.full(len(orders), orders.shape[1])
    behind = slot[None, :] > at[:, None]
    cell = (slot[None, :] - behind) * whole + orders + behind * whole * whole
    # the short block's own slot points to a cell of zero
    cell[slot[None, :] == at[:, None]] = 2 * whole * whole
    for k in range(columns):
        aligned = x[: whole * block, k].reshape(whole, block) @ y_blocks
        shifted = x[short: short + whole * block, k].reshape(whole, block) @ y_blocks
        out[:, k] = np.concatenate([aligned.ravel(), shifted.ravel(), [0.0]])[cell].sum(axis=1)
        if short:
            ends = np.array([x[s * block: s * block + short, k] @ y[whole * block:] for s in range(whole + 1)])
            out[:, k] += ends[at]
    return out


def _histories(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups from sorted Arrow batches; a group may span several of them."""
    held: pd.DataFrame | None = None
    for part in batches:
        held = part if held is None else pd.concat([held, part], ignore_index=True)
        groups = list(held.groupby(keys, sort=False))
        for _, g in groups[:-1]:
            yield g
        held = groups[-1][1] if groups else None
    if held is not None and len(held):
        yield held


SUMS = "target string, feature string, stat string, v array<double>"


def audit_sums(rows: DataFrame, features: Sequence[str], draws: int, block: int = 21, seed: str = "p") -> DataFrame:
    """(target, feature, draw, stat, v): the sums from which every correlation of every draw follows.

    Ranks are taken inside one symbol's history and pooled over symbols, so the sums
    add up over symbols: a task walks through the symbols of its partition, keeps one
    running table of draws, and emits it once. Nothing larger than a symbol's history
    is held, and what is shuffled does not grow with the number of symbols.
    """
    names = list(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[str, str, str], np.ndarray] = {}
        orders: dict[int, np.ndarray] = {}
        for h in _histories(batches, ["target", "sym"]):
            h = h.sort_values("dt")
            target, n = h["target"].iloc[0], len(h)
            x = pd.DataFrame(np.vstack(h["x"].to_numpy()), columns=names).rank().to_numpy()
            y, b = h["y"].rank().to_numpy(), h["b"].rank().to_numpy()
            mid = (n + 1) / 2
            x, y, b = np.nan_to_num(x - mid), y - mid, b - mid
            # histories with as many blocks share their draws
            blocks = -(-n // block)
            if blocks not in orders:
                orders[blocks] = block_ranks(n, block, draws, seed)
            both = np.column_stack([x, b])
            sums = np.vstack([y @ both, moved_sums(both, y, block, orders[blocks])])  # draw 0 is the real order
            xy, yb = sums[:, :-1], sums[:, -1]

            def add(feature: str, stat: str, v: np.ndarray) -> None:
                key = (target, feature, stat)
                total[key] = total.get(key, 0) + v
            for k, f in enumerate(names):
                add(f, "xy", xy[:, k])
                add(f, "xb", np.array([x[:, k] @ b]))
                add(f, "xx", np.array([x[:, k] @ x[:, k]]))
            add("", "yb", yb)
            add("", "yy", np.array([y @ y]))
            add("", "bb", np.array([b @ b]))
            add("", "n", np.array([float(n)]))
        if total:
            yield pd.DataFrame([(*k, v.tolist()) for k, v in total.items()], columns=["target", "feature", "stat", "v"])

    parts = spread(rows, "target", "sym").sortWithinPartitions("target", "sym", "dt").mapInPandas(run, SUMS)
    cells = parts.select("target", "feature", "stat", F.posexplode("v").alias("draw", "v"))
    # read several times below; written once so that the walk over the symbols runs once
    return durable(cells.groupBy("target", "feature", "stat", "draw").agg(F.sum("v").alias("v")), "audit-sums")


def audit_correlations(sums: DataFrame) -> DataFrame:
    """(target, feature, draw, spearman, incremental) from the summed table (features x draws rows)."""
    pick = lambda s: F.max(F.when(F.col("stat") == s, F.col("v"))).alias(s)
    per_target = sums.where(F.col("feature") == "").groupBy("target").agg(
        *[F.max(F.when((F.col("stat") == s) & (F.col("draw") == 0), F.col("v"))).alias(s) for s in ("yy", "bb", "n")]
    )
    yb = sums.where((F.col("feature") == "") & (F.col("stat") == "yb")).select("target", "draw", F.col("v").alias("yb"))
    fixed = sums.where((F.col("feature") != "") & (F.col("draw") == 0)).groupBy("target", "feature").agg(pick("xb"), pick("xx"))
    xy = sums.where((F.col("feature") != "") & (F.col("stat") == "xy")).select("target", "feature", "draw", F.col("v").alias("xy"))
    out = xy.join(fixed, ["target", "feature"]).join(yb, ["target", "draw"]).join(per_target, "target")
    return out.select("target", "feature", "draw", "n", *partial_pair("xy", "xb", "yb", "xx", "yy", "bb"))


def partial_pair(xy: str, xb: str, yb: str, xx: str, yy: str, bb: str) -> tuple[Column, Column]:
    """Correlation, and correlation with what the baseline explains of the target taken out."""
    safe = lambda c, a, b: F.when((F.col(a) > 1e-12) & (F.col(b) > 1e-12), F.col(c) / F.sqrt(F.col(a) * F.col(b))).otherwise(0.0)
    raw, fb, tb = safe(xy, xx, yy), safe(xb, xx, bb), safe(yb, yy, bb)
    left = 1 - tb * tb
    return raw.alias("spearman"), F.when(left > 1e-12, (raw - tb * fb) / F.sqrt(left)).otherwise(0.0).alias("incremental")


def feature_audit(
    panel: DataFrame, features: Sequence[str], targets: Sequence[str], draws: int = 2000, block: int = 21,
    alpha: float = 0.05, seed: str = "p",
) -> DataFrame:
    """Every (feature, target): rank correlations, permutation p-values, q-values.

    A channel that is the same for all symbols is scored once, on session means, so
    its evidence is not multiplied by the number of symbols.
    """
    level = market_wide(panel, features)
    means = panel.groupBy("dt").agg(
        *[F.avg(f).alias(f) for f in features],
        *[F.when(F.count(t) == F.count(F.lit(1)), F.avg(t)).alias(t) for t in targets],
        *[F.avg(f"base_{t}").alias(f"base_{t}") for t in targets],
    ).withColumn("sym", F.lit(-1).cast("bigint"))
    # both audits are one walk: the market's targets go by names of their own
    market = audit_rows(means, features, targets).withColumn("target", F.concat(F.lit(MARKET), "target"))
    rows = audit_rows(panel, features, targets).unionByName(market)
    stats = audit_correlations(audit_sums(rows, features, draws, block, seed))
    own = F.col("target").startswith(MARKET)
    stats = stats.join(level, "feature").where(F.col("market_level") == own)
    return audit_p_values(stats.withColumn("target", F.regexp_replace("target", f"^{MARKET}", "")), draws, block, alpha)


#: Marks a target that is scored on session means.
MARKET = "market "


def audit_p_values(stats: DataFrame, draws: int, block: int, alpha: float) -> DataFrame:
    real = stats.where(F.col("draw") == 0).select(
        "target", "feature", "market_level", "n", F.col("spearman").alias("_r"), F.col("incremental").alias("_i")
    )
    null = stats.where(F.col("draw") > 0).select("target", "feature", "spearman", "incremental")
    counts = null.join(real, ["target", "feature"]).groupBy("target", "feature", "market_level", "n", "_r", "_i").agg(
        ((F.count(F.when(F.abs("spearman") >= F.abs("_r"), 1)) + 1) / (draws + 1.0)).alias("p_value"),
        ((F.count(F.when(F.abs("incremental") >= F.abs("_i"), 1)) + 1) / (draws + 1.0)).alias("p_incremental"),
    )
    out = counts.withColumnsRenamed({"_r": "spearman", "_i": "spearman_incremental"})
    return false_discovery(out, "p_incremental", alpha).withColumn("n_blocks", F.ceil(F.col("n") / block).cast("bigint"))


# ---- distance correlation -----------------------------------------------------------------------------------


def distance_correlation(rows: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Distance correlation of x with y, with sign(y) and with |y|, per key.

    A key is one symbol's history of one (feature, target): its length is the calendar.
    """
    keys = list(keys)
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    schema += ", n bigint, dcor double, dcor_sign double, dcor_abs double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        both = pdf[[x, y]].dropna().to_numpy(dtype="float64")
        head = {k: pdf[k].iloc[0] for k in keys}
        if len(both) < 4:
            return pd.DataFrame([{**head, "n": len(both), "dcor": 0.0, "dcor_sign": 0.0, "dcor_abs": 0.0}])
        parts = {"dcor": both[:, 1], "dcor_sign": np.sign(both[:, 1]), "dcor_abs": np.abs(both[:, 1])}
        return pd.DataFrame([{**head, "n": len(both), **{c: distance.distance_correlation(both[:, 0], v) for c, v in parts.items()}}])

    return spread(rows.select(*keys, x, y), *keys).groupBy(*keys).applyInPandas(run, schema)


def kruskal_bins(rows: DataFrame, keys: Sequence[str], bins: int = 5, x: str = "x", y: str = "y", order: str = "dt") -> DataFrame:
    """Rank spread of y over quantile bins of x, per key (one symbol's history)."""
    keys = list(keys)
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    cuts = both.groupBy(*keys).agg(
        F.percentile(x, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("_cuts"), F.count(F.lit(1)).alias("n")
    )
    ranked = both.join(cuts, keys).withColumns(
        {
            "_g": F.size(F.filter("_cuts", lambda c: c <= F.col(x))),
            "_r": F.row_number().over(Window.partitionBy(*keys).orderBy(y, order)),
        }
    )
    per_bin = ranked.groupBy(*keys, "n", "_g").agg(F.count(F.lit(1)).alias("_k"), F.avg("_r").alias("_m"))
    out = per_bin.groupBy(*keys, "n").agg(
        F.count(F.lit(1)).alias("_bins"), F.sum(F.col("_k") * F.pow(F.col("_m") - (F.col("n") + 1) / 2, F.lit(2))).alias("_h")
    )
    h = 12 / (F.col("n") * (F.col("n") + 1)) * F.col("_h")
    return out.select(*keys, "n", F.when((F.col("_bins") == bins) & (F.col("n") >= bins * 4), h).otherwise(0.0).alias("kruskal"))


def nonlinear_scores(rows: DataFrame, draws: int = 0, block: int = 21, bins: int = 5, seed: str = "n") -> DataFrame:
    """(feature, target, draw, dcor, kruskal, dcor_sign, floor, spearman), averaged over symbols; draw 0 is the real order.

    ``rows(feature, target, sym, dt, x, y)``. All draws of a symbol go through one n log n pass each.
    Symbols with under four rows a bin, or without variation, are left out.
    """
    names = ["feature", "target", "draw", "dcor", "kruskal", "dcor_sign", "floor", "spearman"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["x", "y"]).sort_values("dt")
        x, y, n = pdf["x"].to_numpy(dtype="float64"), pdf["y"].to_numpy(dtype="float64"), len(pdf)
        if n < 4 * bins or x.std() < 1e-12 or y.std() < 1e-12:
            return pd.DataFrame(columns=names)
        group = np.searchsorted(np.quantile(x, np.arange(1, bins) / bins), x, side="right")
        member = np.eye(bins)[group]
        size = member.sum(axis=0)
        rank = np.argsort(np.argsort(y, kind="stable"), kind="stable") + 1.0
        orders = np.vstack([np.arange(n), block_draws(n, block, draws, seed)]) if draws else np.arange(n)[None, :]
        noise = np.random.default_rng(n).normal(size=(2, n))
        dcor = distance.correlation(distance.cross_parts(x, y, orders), distance.variance_part(x), distance.variance_part(y))
        mean = (rank[orders] @ member) / np.maximum(size, 1)
        h = np.zeros(len(orders)) if (size == 0).any() else 12 / (n * (n + 1)) * (size * (mean - (n + 1) / 2) ** 2).sum(axis=1)
        return pd.DataFrame({
            "feature": pdf["feature"].iloc[0], "target": pdf["target"].iloc[0], "draw": np.arange(len(orders)), "dcor": dcor, "kruskal": h,
            "dcor_sign": distance.distance_correlation(x, np.sign(y)), "floor": distance.distance_correlation(*noise),
            "spearman": pdf["x"].rank().corr(pdf["y"].rank())})[names]

    schema = "feature string, target string, draw int, dcor double, kruskal double, dcor_sign double, floor double, spearman double"
    per_sym = spread(rows, "feature", "target", "sym").groupBy("feature", "target", "sym").applyInPandas(run, schema)
    return per_sym.groupBy("feature", "target", "draw").agg(*[F.avg(c).alias(c) for c in names[3:]])


def nonlinear_audit(
    rows: DataFrame, n_pairs: int, draws: int, block: int = 21, alpha: float = 0.05, bins: int = 5, seed: str = "n"
) -> DataFrame:
    """Distance correlation and binned rank spread per (feature, target), averaged over symbols, with p-values.

    Refuses a study whose smallest possible q-value could never pass. What a rank
    correlation sees of the pair stands beside (``spearman``), so that significant pairs it
    misses can be told (``hidden_by_monotonic``).
    """
    if n_pairs / (draws + 1.0) > alpha:
        raise ValueError(f"{draws} draws cannot support {n_pairs} pairs at level {alpha}; use {int(np.ceil(n_pairs / alpha)) - 1} or more")
    stats = durable(nonlinear_scores(rows, draws, block, bins, seed), "nonlinear")
    real = stats.where(F.col("draw") == 0).select("feature", "target", F.col("dcor").alias("_d"), F.col("kruskal").alias("_k"), "dcor_sign", "floor", "spearman")
    null = stats.where(F.col("draw") > 0).select("feature", "target", "dcor", "kruskal")
    out = null.join(real, ["feature", "target"]).groupBy("feature", "target", "_d", "_k", "dcor_sign", "floor", "spearman").agg(
        ((F.count(F.when(F.col("dcor") >= F.col("_d"), 1)) + 1) / (draws + 1.0)).alias("dcor_p"),
        ((F.count(F.when(F.col("kruskal") >= F.col("_k"), 1)) + 1) / (draws + 1.0)).alias("kruskal_p"),
    )
    out = out.withColumnsRenamed({"_d": "dcor", "_k": "kruskal"})
    out = false_discovery(out, "dcor_p", alpha).withColumn("magnitude_only", F.col("dcor_sign") <= F.col("floor"))
    return out.withColumn("hidden_by_monotonic", F.col("significant") & (F.abs("spearman") < 0.05))


def pick_features(relevance: DataFrame, redundancy: DataFrame, k: int, beta: float = 0.5) -> DataFrame:
    """Greedy choice of ``k`` features: relevance minus mean redundancy with those already chosen.

    ``relevance(feature, score)`` and ``redundancy(a, b, score)`` (each pair once) hold
    one row per channel and per pair; each round is one top-1 query on them.
    """
    pairs = redundancy.unionByName(redundancy.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    relevance, pairs = durable(relevance, "relevance"), durable(pairs, "redundancy")
    chosen = relevance.orderBy(F.desc("score"), "feature").limit(1).select("feature", F.lit(1).alias("place"), F.col("score").alias("gain"))
    for place in range(2, k + 1):
        # k rows at most, written so that a round does not compute all earlier ones again
        chosen = durable(chosen, "chosen")
        cost = pairs.join(chosen.select(F.col("feature").alias("b")), "b", "left_semi").groupBy(F.col("a").alias("feature")).agg(F.avg("score").alias("_c"))
        rest = relevance.join(chosen.select("feature"), "feature", "left_anti").join(cost, "feature", "left")
        gain = F.col("score") - beta * F.coalesce("_c", F.lit(0.0))
        best = rest.withColumn("gain", gain).orderBy(F.desc("gain"), "feature").limit(1)
        chosen = chosen.unionByName(best.select("feature", F.lit(place).alias("place"), "gain"))
    return chosen
