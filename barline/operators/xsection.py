"""Cross-sectional operators: ranks, signals to weights, sizing, votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.cols import attach, by_sym, change, clip, ratio
from barline.functions.costs import cost_fraction
from barline.operators.ordering import average_rank, value_ranks


def cross_rank(panel: DataFrame, value: str, out: str, least: int = 5) -> DataFrame:
    """Percentile rank inside a session, average ties, NULL where fewer than ``least`` names are present."""
    return average_rank(panel, ["dt"], value, out, least=least, percent=True)


def rank_products(panel: DataFrame, names: Sequence[str], least: int = 5) -> DataFrame:
    """Product of session ranks for every pair of channels, as generated columns (no self-join)."""
    out = panel
    for c in names:
        out = cross_rank(out, c, f"_k_{c}", least)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    return out.select(*panel.columns, *[(F.col(f"_k_{a}") * F.col(f"_k_{b}")).alias(f"{a}_x_{b}") for a, b in pairs])


def unit_residual(panel: DataFrame, y: str, control: str, group: Sequence[str] = ("sym",)) -> DataFrame:
    """Centred, unit-length ``y`` and what a least-squares fit on ``control`` leaves of it."""
    g = list(group)
    both = panel.where(F.col(y).isNotNull() & F.col(control).isNotNull())
    stats = both.groupBy(*g).agg(
        F.avg(y).alias("_my"), F.avg(control).alias("_mc"), F.count(y).alias("_n"),
        F.var_pop(y).alias("_vy"), F.var_pop(control).alias("_vc"), F.covar_pop(y, control).alias("_cv"),
    )
    unit = lambda c, m, v: ratio(F.col(c) - F.col(m), F.sqrt(F.col(v) * F.col("_n")))
    rho = F.coalesce(ratio("_cv", F.sqrt(F.col("_vy") * F.col("_vc"))), F.lit(0.0))
    out = both.join(stats, g)
    out = out.withColumns(
        {"unit": F.coalesce(unit(y, "_my", "_vy"), F.lit(0.0)), "_c": F.coalesce(unit(control, "_mc", "_vc"), F.lit(0.0))}
    )
    return out.withColumn("residual", F.col("unit") - rho * F.col("_c")).drop("_my", "_mc", "_n", "_vy", "_vc", "_cv", "_c")


def signal_weights(
    signals: DataFrame, group: Sequence[str], signal: str = "signal", gain: Column | float = 1.0,
    deadband: Column | float = 0.0, top_share: Column | float = 1.0, bias: Column | float = 0.0, cap: Column | float = 0.25,
    out: str = "weight",
) -> DataFrame:
    """Gain, dead band, top share by absolute strength (ties stay), bias, cap.

    The strength order inside a group comes from the bucketed rank, so a group may
    be as wide as the whole universe.
    """
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    s = F.tanh(F.col(signal) * as_col(gain))
    base = signals.withColumn("_s", F.when(F.abs(s) < as_col(deadband), 0.0).otherwise(s))
    base = base.withColumn("_a", F.abs("_s"))
    ranks = value_ranks(base, list(group), "_a").select(
        *group, "_a", (F.col("total") - F.col("below") - F.col("cnt")).alias("_above"), F.col("total").alias("_n")
    )
    base = base.join(ranks, [*group, "_a"])
    k = F.greatest(F.bround(as_col(top_share) * F.col("_n")), F.lit(1))
    kept = F.when((as_col(top_share) >= 1) | (F.col("_above") < k), F.col("_s")).otherwise(0.0)
    weight = F.least(F.greatest(kept + as_col(bias), -as_col(cap)), as_col(cap))
    return base.withColumn(out, weight).drop("_s", "_a", "_above", "_n")


def blended_strategies(signals: DataFrame, strategies: DataFrame, top_n: int = 8, temperature: float = 1.0) -> DataFrame:
    """Weights of the best strategies mixed by a softmax over their fitness.

    ``strategies`` is cut to ``top_n`` rows before it meets the signals.
    """
    best = strategies.orderBy(F.desc("fitness"), "strategy").limit(top_n)
    peak = best.agg(F.max("fitness").alias("_max"))
    z = F.exp((F.col("fitness") - F.col("_max")) / max(temperature, 1e-6))
    weighted = attach(best, peak).withColumn("_z", z)
    total = weighted.agg(F.sum("_z").alias("_total"))
    mix = attach(weighted, total).withColumn("mix", F.col("_z") / F.col("_total")).drop("_z", "_total", "_max")
    # top_n rows on the broadcast side, whatever the size of the strategy table
    crossed = signals.join(F.broadcast(mix), how="cross")
    out = signal_weights(
        crossed, ["strategy", "dt"], gain=F.col("gain"), deadband=F.col("deadband"), top_share=F.col("top_share"),
        bias=F.col("bias"), cap=F.col("cap"),
    )
    return out.groupBy("sym", "dt").agg(F.sum(F.col("mix") * F.col("weight")).alias("weight"))


def momentum_weights(panel: DataFrame, lookback: int = 20, cap: float = 0.25) -> DataFrame:
    """Sign of the mean return of the bars before, shared among active names, capped."""
    w = by_sym().rowsBetween(-lookback, -1)
    base = panel.withColumn("_r", change("close"))
    base = base.withColumn("_s", F.coalesce(F.signum(F.avg("_r").over(w)), F.lit(0.0)))
    active = base.groupBy("dt").agg(F.greatest(F.sum(F.abs("_s")), F.lit(1.0)).alias("_n"))
    return base.join(active, "dt").withColumn("weight", clip(F.col("_s") / F.col("_n"), -cap, cap)).drop("_r", "_s", "_n")


def equal_weights(panel: DataFrame) -> DataFrame:
    n = panel.groupBy("dt").agg(F.count(F.lit(1)).alias("_n"))
    return panel.join(n, "dt").withColumn("weight", 1 / F.col("_n")).drop("_n")


def top_movers(panel: DataFrame, k: int = 3, signal: str | None = None, bars: int = 5) -> DataFrame:
    """The ``k`` names with the strongest signal; without one, the mean of the last returns."""
    if signal is None:
        base = panel.withColumns({"_r": F.coalesce(change("close"), F.lit(0.0)), "_k": F.row_number().over(by_sym())})
        last = base.groupBy("sym").agg(F.max("_k").alias("_n"))
        recent = base.join(last, "sym").where(F.col("_k") > F.col("_n") - bars)
        scores = recent.groupBy("sym").agg(F.avg("_r").alias("signal"))
    else:
        scores = panel.select("sym", F.col(signal).alias("signal"))
    side = F.when(F.col("signal") > 0, "LONG").otherwise("SHORT")
    return scores.orderBy(F.desc(F.abs("signal")), "sym").limit(k).withColumn("direction", side)


def spillover_pairs(links: DataFrame, n_nodes: DataFrame, k: int = 10, wide: float = 2.0) -> DataFrame:
    """Node pairs whose mean two-way strength lies ``wide`` spreads above the average cell.

    ``links(a, b, strength)`` holds the non-zero cells; absent cells count as zero
    through the node count (one row, column ``n``).
    """
    sums = links.agg(F.sum("strength").alias("_s"), F.sum(F.col("strength") ** 2).alias("_q"))
    stats = attach(sums, n_nodes).select(
        (F.col("_s") / (F.col("n") * F.col("n"))).alias("_m"), (F.col("_q") / (F.col("n") * F.col("n"))).alias("_m2")
    ).select((F.col("_m") + wide * F.sqrt(F.greatest(F.col("_m2") - F.col("_m") ** 2, F.lit(0.0)))).alias("_limit"))
    two_way = links.where(F.col("a") != F.col("b")).groupBy(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).agg((F.sum("strength") / 2).alias("strength"))
    kept = attach(two_way, stats).where(F.col("strength") > F.col("_limit")).drop("_limit")
    return kept.orderBy(F.desc("strength"), "a", "b").limit(k)


def trading_permission(assets: DataFrame, pairs: DataFrame, stability: DataFrame, least: float = 0.6, strong: float = 0.8) -> DataFrame:
    """Permission and risk class per asset from market stability (one row) and spillover pairs."""
    risky = pairs.where(F.col("strength") > strong).select(F.explode(F.array("a", "b")).alias("sym")).distinct()
    marked = attach(assets.join(risky.withColumn("_p", F.lit(True)), "sym", "left"), stability)
    unstable = F.col("stability") < least
    risk = (
        F.when(F.col("stability") > 0.8, "LOW").when(F.col("stability") > 0.6, "MODERATE")
        .when(F.col("stability") > 0.4, "ELEVATED").otherwise("CRITICAL")
    )
    note = F.when(unstable, "halted").when(F.col("_p"), "half_size").otherwise("normal")
    return marked.select("sym", (~unstable).alias("allowed"), note.alias("note"), risk.alias("risk"))


def share_sizes(
    targets: DataFrame, account: str = "account", cap: float = 0.25, allow_short: bool = False,
    min_edge_bps: float | None = None, edge: str | None = None, round_trip_bps: float = 0.0, lot: int = 1,
) -> DataFrame:
    """Whole shares from target weights, cut to cash by dropping the weakest first, with costs.

    Expects ``sym, dt, weight, price, held, equity`` per account. Names are kept from
    the strongest down while their running cost fits the equity, which is what
    dropping the weakest one by one leaves. An account's book on one day is its own
    list of names.
    """
    w = F.col("weight") if allow_short else F.greatest(F.col("weight"), F.lit(0.0))
    w = clip(w, -cap, cap)
    if edge is not None:
        w = F.when(F.abs(F.col(edge)) < max(min_edge_bps or 0.0, round_trip_bps), 0.0).otherwise(w)
    base = targets.withColumn("target_weight", w)
    raw = F.when(F.col("price") > 0, F.col("target_weight") * F.col("equity") / F.col("price")).otherwise(0.0)
    shares = F.when(raw >= 0, F.floor(raw)).otherwise(F.ceil(raw)).cast("bigint")
    if lot > 1:
        shares = F.floor(shares / lot).cast("bigint") * lot
    base = base.withColumn("_q", shares).withColumn("_g", F.abs(F.col("_q") * F.col("price")))
    strong = Window.partitionBy(account, "dt").orderBy(F.desc(F.col("_q") != 0), F.desc(F.abs("target_weight")), F.desc("sym"))
    base = base.withColumn("_run", F.sum("_g").over(strong.rowsBetween(Window.unboundedPreceding, 0)))
    base = base.withColumn("shares", F.when(F.col("_run") <= F.col("equity"), F.col("_q")).otherwise(F.lit(0).cast("bigint")))
    trade = F.col("shares") - F.col("held")
    out = base.withColumn("trade", trade)
    return out.withColumns(
        {
            "cost": F.abs(F.col("trade") * F.col("price")) * cost_fraction(F.col("trade") > 0),
            "realised_weight": F.when(F.col("equity") > 0, F.col("shares") * F.col("price") / F.col("equity")).otherwise(0.0),
            "untradeable": (F.abs("target_weight") > 1e-9) & (F.col("shares") == 0),
        }
    ).drop("_q", "_g", "_run")


# Ranges of the decoded strategy parameters
HOLD_DAYS = (5, 90)
TRAILING_STOP = (0.02, 0.2)
KELLY_SHARE = (0.0, 1.0)
REGIME_SENSITIVITY = (0.0, 1.0)
CONVICTION = (0.05, 0.6)
VOL_TARGET = (0.0, 0.3)


def decode_vectors(vectors: DataFrame, n_channels: int, genes: str = "genes") -> DataFrame:
    """Parameter vectors in [0, 1] to strategies: channel weights, thresholds, and six scalars."""
    g = F.transform(F.col(genes), lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    base = vectors.withColumn("_g", g)
    raw = F.slice("_g", 1, n_channels)
    base = base.withColumn("_sum", F.aggregate(raw, F.lit(0.0), lambda a, x: a + x))
    weights = F.when(F.col("_sum") > 1e-9, F.transform(raw, lambda x: x / F.col("_sum"))).otherwise(
        F.array_repeat(F.lit(1.0 / n_channels), n_channels)
    )
    def scaled(i: int, span: tuple[float, float]) -> Column:
        return span[0] + (span[1] - span[0]) * F.element_at("_g", 3 * n_channels + i)
    return base.withColumns(
        {
            "weights": weights,
            "entry": F.slice("_g", n_channels + 1, n_channels),
            "exit": F.slice("_g", 2 * n_channels + 1, n_channels),
            "hold_days": F.bround(scaled(1, HOLD_DAYS)).cast("int"),
            "trailing_stop": scaled(2, TRAILING_STOP),
            "kelly_share": scaled(3, KELLY_SHARE),
            "regime_sensitivity": scaled(4, REGIME_SENSITIVITY),
            "conviction": scaled(5, CONVICTION),
            "vol_target": scaled(6, VOL_TARGET),
        }
    ).drop("_g", "_sum")


def vote_score(channels: Column | str, weights: Column | str, entry: Column | str, exit_: Column | str) -> Column:
    """Weighted votes: +1 above a channel's entry level, -1 below its mirrored exit level."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    x, w, e, o = as_col(channels), as_col(weights), as_col(entry), as_col(exit_)
    cells = F.arrays_zip(x.alias("x"), w.alias("w"), e.alias("e"), o.alias("o"))
    vote = lambda c: F.when(c["x"] > c["e"], 1.0).otherwise(0.0) - F.when(c["x"] < -c["o"], 1.0).otherwise(0.0)
    return F.aggregate(cells, F.lit(0.0), lambda a, c: a + c["w"] * vote(c))


def fixed_bin(x: Column | str, n: int) -> Column:
    """Bin of a value over [-1, 1] cut into ``n`` equal parts, ends clipped."""
    c = F.col(x) if isinstance(x, str) else x
    return F.least(F.greatest(F.floor((c + 1) / 2 * n), F.lit(0)), F.lit(n - 1)).cast("int")


def state_counts(panel: DataFrame, regime: str, strength: str, trend: str) -> DataFrame:
    """Rows per discrete state: three bins of the first channel, five of the others."""
    return panel.groupBy(
        fixed_bin(regime, 3).alias("regime"), fixed_bin(strength, 5).alias("strength"), fixed_bin(trend, 5).alias("trend")
    ).agg(F.count(F.lit(1)).alias("n"))


def gated_targets(rows: DataFrame, kelly_share: float = 0.5, max_position: float = 0.25) -> DataFrame:
    """Target weight from a signal, a second forecast and caps.

    Agreement with ``bias`` scales by 1.15, disagreement by 0.7 (no bias: untouched);
    longs are cut where the market-wide or the name's own cap is zero.
    """
    agree = F.signum("signal") == F.signum("bias")
    s = F.when(F.col("bias").isNull(), F.col("signal")).otherwise(
        clip(F.col("signal") * F.when(agree, 1.15).otherwise(0.7), -1.0, 1.0)
    )
    blocked = (F.col("market_cap") == 0) | (F.col("name_cap") == 0)
    base = rows.withColumn("gated", F.when(blocked, F.least(s, F.lit(0.0))).otherwise(s))
    cap = F.least("market_cap", "name_cap")
    goal = F.col("gated") * kelly_share * max_position
    # a cap scales what may be bought, never what may be sold
    limit = F.when(goal > 0, max_position * F.least(cap, F.lit(1.0))).otherwise(max_position)
    return base.withColumn("target", F.least(F.greatest(goal, -limit), limit))


def blend_signals(base: DataFrame, other: DataFrame, weight: float) -> DataFrame:
    """Linear mix where the second source covers a name, the first one elsewhere."""
    out = base.join(other.select("sym", "dt", F.col("signal").alias("_o")), ["sym", "dt"], "left")
    mixed = (1 - weight) * F.col("signal") + weight * F.col("_o")
    return out.withColumn("blended", F.coalesce(mixed, "signal")).drop("_o")


