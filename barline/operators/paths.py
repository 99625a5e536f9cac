"""Return-path tables ``(path, t, sym, r)``: surfaces, tails, severity, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.cols import attach, clip
from barline.operators.ordering import exact_quantiles

LARGE = 1e6
MIN_PRICE = 0.01


def cut_paths(rets: DataFrame, length: int) -> DataFrame:
    """History cut into adjacent stretches of ``length`` bars; the last one may be shorter."""
    rows = rets.withColumn("path", F.floor(F.col("bar_idx") / length).cast("int"))
    return rows.select(
        "path", (F.col("bar_idx") % length).cast("int").alias("t"), "sym", F.coalesce("ret", F.lit(0.0)).alias("r")
    )


def sanitised(r: Column | str) -> Column:
    """NaN becomes 0, infinities become large finite moves."""
    c = F.col(r) if isinstance(r, str) else r
    return F.when(F.isnan(c) | c.isNull(), 0.0).when(c == float("inf"), LARGE).when(c == float("-inf"), -LARGE).otherwise(c)


def surface(paths: DataFrame, bands: dict[str, float]) -> DataFrame:
    """Percentile bands and share of gains per (t, sym); exact over any number of paths."""
    q = exact_quantiles(paths, ["t", "sym"], "r", bands).drop("n")
    up = paths.groupBy("t", "sym").agg(F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("p_positive"))
    return q.join(up, ["t", "sym"])


def compounded(paths: DataFrame, lo: float = -0.5, hi: float = 2.0) -> DataFrame:
    """Compounded return of each path and symbol; single moves are bounded first."""
    return paths.groupBy("path", "sym").agg((F.exp(F.sum(F.log1p(clip("r", lo, hi)))) - 1).alias("final"))


def tail_risk(finals: DataFrame, value: str = "final", level: float = 0.05) -> DataFrame:
    """Value at risk and the mean beyond it per symbol; without anything beyond, the value itself."""
    var = exact_quantiles(finals, ["sym"], value, {"var_95": level}).drop("n")
    both = finals.join(var, "sym")
    return both.groupBy("sym").agg(
        F.max("var_95").alias("var_95"), F.coalesce(F.avg(F.when(F.col(value) < F.col("var_95"), F.col(value))), F.max("var_95")).alias("cvar_95")
    )


def path_summary(paths: DataFrame) -> DataFrame:
    """Per symbol: moments, median and tails of the last bar's return, with compounded tail risk."""
    end = paths.agg(F.max("t").alias("_end"))
    last = attach(paths, end).where(F.col("t") == F.col("_end")).select("sym", "r")
    q = exact_quantiles(last, ["sym"], "r", {"median_return": 0.5, "worst_case_1": 0.01, "best_case_99": 0.99}).drop("n")
    m = last.groupBy("sym").agg(F.avg("r").alias("expected_return"), F.stddev_pop("r").alias("std"), F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("p_positive"))
    third = last.join(m.select("sym", "expected_return", "std"), "sym").groupBy("sym").agg(
        (F.avg(F.pow(F.col("r") - F.col("expected_return"), F.lit(3))) / (F.pow(F.max("std"), F.lit(3)) + 1e-8)).alias("skewness")
    )
    return m.join(q, "sym").join(third, "sym").join(tail_risk(compounded(paths)), "sym")


def scenario_records(paths: DataFrame, lead_sym: int, sigma_mult: Column) -> DataFrame:
    """Per path: drawdown of the lead symbol, severity, peak move, mean pairwise correlation.

    The mean correlation of all pairs follows from per-bar sums of standardised
    returns, so no pair is ever formed.
    """
    w = Window.partitionBy("path").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    lead = paths.where(F.col("sym") == lead_sym).withColumn("_c", F.exp(F.sum(F.log1p(clip("r", -0.99, 10.0))).over(w)))
    lead = lead.withColumn("_p", F.max("_c").over(w))
    draw = lead.groupBy("path").agg(F.min((F.col("_c") - F.col("_p")) / (F.col("_p") + 1e-8)).alias("max_drawdown"))
    peak = paths.groupBy("path").agg(F.max(F.abs("r")).alias("peak_move"))
    per = paths.groupBy("path", "sym").agg(F.avg("r").alias("_m"), F.stddev_pop("r").alias("_s"), F.count("r").alias("_k"))
    bars = paths.groupBy("path").agg((F.max("t") + 1).alias("_len"))
    # symbols present on every bar of the path
    per = per.join(bars, "path").where((F.col("_s") > 0) & (F.col("_k") == F.col("_len"))).drop("_k", "_len")
    z = paths.join(per, ["path", "sym"]).withColumn("_z", (F.col("r") - F.col("_m")) / F.col("_s"))
    bar = z.groupBy("path", "t").agg(F.sum("_z").alias("_zs"), F.sum(F.col("_z") ** 2).alias("_zq"), F.count(F.lit(1)).alias("_n"))
    corr = bar.groupBy("path").agg((F.avg(F.col("_zs") ** 2 - F.col("_zq")) / F.max(F.col("_n") * (F.col("_n") - 1))).alias("mean_corr"))
    out = draw.join(peak, "path").join(corr, "path", "left").withColumn("sigma_mult", sigma_mult)
    return out.withColumn("severity", F.col("sigma_mult") * F.col("peak_move"))


def library_summary(records: DataFrame, extreme: Column) -> DataFrame:
    """Counts, mean, 99th percentile and extremes of severity and drawdown (one row)."""
    q = exact_quantiles(records.withColumn("_g", F.lit(0)), ["_g"], "severity", {"severity_p99": 0.99}).select("severity_p99")
    d = exact_quantiles(records.withColumn("_g", F.lit(0)), ["_g"], "max_drawdown", {"drawdown_p99": 0.99}).select("drawdown_p99")
    s = records.agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(~extreme, 1)).alias("templated"), F.count(F.when(extreme, 1)).alias("pure_extreme"),
        F.avg("severity").alias("severity_mean"), F.max("severity").alias("severity_max"), F.avg("max_drawdown").alias("drawdown_mean"), F.min("max_drawdown").alias("drawdown_worst"),
    )
    return attach(attach(s, q), d)


def tail_coverage(paths: DataFrame, k: float = 3.0, least_pct: float = 1.0) -> DataFrame:
    """Share of paths with a bar beyond k spreads, pooled kurtosis and skew, worst running sum, verdict."""
    pooled = paths.agg((F.stddev_pop("r") + 1e-8).alias("_sd"), F.kurtosis("r").alias("kurtosis"), F.skewness("r").alias("skewness"))
    hit = attach(paths, pooled.select("_sd")).groupBy("path").agg(F.max(F.abs("r") > k * F.col("_sd")).alias("_x"))
    share = hit.agg((100 * F.avg(F.col("_x").cast("double"))).alias("coverage_pct"), F.count(F.lit(1)).alias("n_paths"))
    w = Window.partitionBy("path", "sym").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    worst = paths.select(F.sum("r").over(w).alias("_c")).agg(F.min("_c").alias("worst_drawdown"))
    out = attach(attach(share, pooled.drop("_sd")), worst)
    return out.withColumn("passed", (F.col("kurtosis") > 0) & (F.col("coverage_pct") >= least_pct))


def price_paths(paths: DataFrame, start: Column) -> DataFrame:
    """Prices along cleaned returns, never below the floor.

    A return may reach or pass -100 %, so size and sign of the growth factor run
    separately; a zero factor ends the path at the floor.
    """
    w = Window.partitionBy("path", "sym").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    g = 1 + sanitised("r")
    base = paths.withColumn("_g", g)
    base = base.withColumns(
        {
            "_log": F.sum(F.when(F.col("_g") != 0, F.ln(F.abs("_g"))).otherwise(0.0)).over(w),
            "_neg": F.sum(F.when(F.col("_g") < 0, 1).otherwise(0)).over(w),
            "_zero": F.sum(F.when(F.col("_g") == 0, 1).otherwise(0)).over(w),
        }
    )
    sign = F.when(F.col("_neg") % 2 == 1, -1.0).otherwise(1.0)
    level = F.when(F.col("_zero") > 0, 0.0).otherwise(start * sign * F.exp("_log"))
    return base.withColumn("price", F.greatest(level, F.lit(MIN_PRICE))).drop("_g", "_log", "_neg", "_zero")


def severity_top(records: DataFrame, k: int) -> DataFrame:
    return records.orderBy(F.desc("severity"), "path").limit(k)


def worst_paths(paths: DataFrame, weights: Column, k: int) -> DataFrame:
    """The ``k`` paths with the lowest portfolio result."""
    pnl = paths.groupBy("path").agg(F.sum(F.col("r") * weights).alias("pnl"))
    return pnl.orderBy("pnl", "path").limit(k)


def curriculum(records: DataFrame) -> DataFrame:
    """easy / medium / hard by the 33rd and 66th severity percentile."""
    q = exact_quantiles(records.withColumn("_g", F.lit(0)), ["_g"], "severity", {"_lo": 0.33, "_hi": 0.66}).drop("_g", "n")
    band = F.when(F.col("severity") <= F.col("_lo"), "easy").when(F.col("severity") <= F.col("_hi"), "medium").otherwise("hard")
    return attach(records, q).withColumn("band", band).drop("_lo", "_hi")


def stratified_sample(records: DataFrame, n: int, strata: int = 5, seed: str = "s") -> DataFrame:
    """``n / strata`` records per severity stratum, drawn in hash order; bounds belong to both neighbours."""
    probs = {f"_b{i}": i / strata for i in range(strata + 1)}
    q = exact_quantiles(records.withColumn("_g", F.lit(0)), ["_g"], "severity", probs).drop("_g", "n")
    inside = F.array_compact(
        F.array(*[F.when(F.col("severity").between(F.col(f"_b{i}"), F.col(f"_b{i + 1}")), F.lit(i)) for i in range(strata)])
    )
    rows = attach(records, q).withColumn("stratum", F.explode(inside)).drop(*probs)
    draw = Window.partitionBy("stratum").orderBy(F.md5(F.concat_ws("-", F.lit(seed), "stratum", "path")), "path")
    # a rank filter: only the first rows of each stratum are shuffled
    return rows.withColumn("_k", F.row_number().over(draw)).where(F.col("_k") <= n // strata).drop("_k")


def adversarial_mix(paths: DataFrame, weights: Column, n: int, bias: float = 0.7, seed: str = "a") -> DataFrame:
    """Of all paths the worst ``bias`` share of ``n`` by portfolio result, the rest of ``n`` at random."""
    pnl = paths.groupBy("path").agg(F.sum(F.col("r") * weights).alias("pnl"))
    n_bad = int(n * bias)
    bad = pnl.orderBy("pnl", "path").limit(n_bad).withColumn("kind", F.lit("worst"))
    rest = pnl.join(bad.select("path"), "path", "left_anti")
    rand = rest.orderBy(F.md5(F.concat_ws("-", F.lit(seed), F.col("path").cast("string"))), "path").limit(n - n_bad).withColumn("kind", F.lit("random"))
    return bad.unionByName(rand)


def augmented(paths: DataFrame, copies: int, length: int, seed: str = "u") -> DataFrame:
    """Scaled (0.8 to 1.2) and rotated copies of every path."""
    from barline.sources.synthetic import uniform

    rows = paths.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    scale = 0.8 + 0.4 * uniform(seed + "s", "path", "copy")
    roll = F.floor(uniform(seed + "r", "path", "copy") * max(length // 4, 1)).cast("int")
    return rows.select("path", "copy", ((F.col("t") + roll) % length).alias("t"), "sym", (F.col("r") * scale).alias("r"))


def trade_recommendations(stats: DataFrame, sizes: DataFrame, restricted: bool = False, k: int = 5) -> DataFrame:
    """Of the ``k`` strongest names those worth a trade, with direction, size and conviction."""
    top = stats.orderBy(F.desc(F.abs("expected_return")), "sym").limit(k).join(sizes, "sym", "left")
    e, p = F.col("expected_return"), F.col("p_positive")
    kept = top.where(~((F.abs(e) < 0.001) | ((p < 0.45) & (e > 0))))
    up = e > 0
    return kept.select(
        "sym", F.when(up, "LONG").otherwise("SHORT").alias("direction"), "expected_return", F.when(up, p).otherwise(1 - p).alias("probability"),
        (F.abs(F.coalesce("fraction", F.lit(0.0))) * 100 * (0.3 if restricted else 1.0)).alias("size_pct"), "var_95",
        F.when((F.abs(e) > 0.02) & (p > 0.65), "HIGH").otherwise("MODERATE").alias("conviction"),
    )


def risk_summary(stats: DataFrame, sizes: DataFrame) -> DataFrame:
    """Worst tail, exposures and risk level (one row)."""
    f = F.col("fraction")
    book = sizes.agg(
        F.coalesce(F.sum(F.when(f > 0, f)), F.lit(0.0)).alias("long_exposure"), F.coalesce(F.sum(F.when(f < 0, -f)), F.lit(0.0)).alias("short_exposure"),
        F.sum(f).alias("net_exposure"), F.count(F.when(f != 0, 1)).alias("n_active"),
    )
    worst = stats.agg(F.coalesce(F.min("var_95"), F.lit(-0.05)).alias("worst_var"))
    level = F.when(F.col("worst_var") < -0.15, "HIGH").when(F.col("worst_var") < -0.08, "MODERATE").otherwise("LOW")
    return attach(worst, book).withColumn("risk_level", level)


def quiet_directions(cov: list[list[float]], k: int) -> list[list[float]]:
    """The ``k`` directions of least variance of a small covariance matrix."""
    import numpy as np

    return np.linalg.eigh(np.asarray(cov))[1][:, :k].T.tolist()


def no_arbitrage_score(train: DataFrame, predictions: DataFrame, names: list[int], k: int = 2) -> DataFrame:
    """RMS of predicted returns along the quietest directions of the training covariance.

    A missing return counts as zero, so products are summed over the sessions both names
    have and centred with the totals; only the N x N matrix of the stated universe reaches
    the driver. Projections are sums over a session's rows, for any number of names.
    """
    import numpy as np

    spark, n = train.sparkSession, len(names)
    listed = spark.createDataFrame([(v, i) for i, v in enumerate(names)], ["sym", "_i"]).withColumn("sym", F.col("sym").cast(train.schema["sym"].dataType))
    days = train.select("dt").distinct().count()
    rows = train.join(listed, "sym").groupBy("dt", "_i").agg(F.coalesce(F.first("ret"), F.lit(0.0)).alias("_r"))
    other = rows.select("dt", F.col("_i").alias("_j"), F.col("_r").alias("_s"))
    cross = np.zeros((n, n))
    for r in rows.join(other, "dt").groupBy("_i", "_j").agg(F.sum(F.col("_r") * F.col("_s")).alias("v")).collect():
        cross[r["_i"], r["_j"]] = r["v"]
    sums = np.zeros(n)
    for r in rows.groupBy("_i").agg(F.sum("_r").alias("v")).collect():
        sums[r["_i"]] = r["v"]
    basis = quiet_directions(((cross - np.outer(sums, sums) / days) / (days - 1)).tolist(), k)
    loads = spark.createDataFrame([(i, *[float(v[i]) for v in basis]) for i in range(n)], ["_i", *[f"_l{m}" for m in range(k)]])
    pred = predictions.join(listed, "sym", "left").join(loads, "_i", "left").groupBy("dt").agg(
        *[F.coalesce(F.sum(F.col("pred") * F.col(f"_l{m}")), F.lit(0.0)).alias(f"_p{m}") for m in range(k)])
    score = F.sqrt(sum((F.col(f"_p{m}") * F.col(f"_p{m}") for m in range(k)), F.lit(0.0)) / k)
    return pred.select("dt", score.alias("score"))


