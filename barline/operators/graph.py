"""Queries on directed edge tables ``(source, target, weight, confidence)``.

In an acyclic graph every walk is a simple path, so sums over paths are a short
chain of join + aggregate steps: state per node, never a list of paths.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.functions.cols import attach
from barline.functions.mathx import chi2_sf
from barline.session import durable


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node): all nodes below each root, until a round finds no new one.

    Each round writes its frontier only; what was seen is the union of the frontiers,
    written together now and then to keep plans short.
    """
    e = durable(edges.select("source", "target").distinct(), "edges")
    seen = durable(roots.select("root", F.col("root").alias("node")).distinct(), "seen")
    front, rounds = seen, 0
    while True:
        step = front.join(e, front.node == e.source).select("root", F.col("target").alias("node")).distinct()
        front = durable(step.join(seen, ["root", "node"], "left_anti"), "front")
        if front.isEmpty():
            break
        rounds += 1
        seen = seen.unionByName(front)
        if rounds % 16 == 0:
            seen = durable(seen, "seen")
    return seen.where(F.col("root") != F.col("node"))


def path_effects(edges: DataFrame, treatment: int | str, max_edges: int = 5) -> DataFrame:
    """(node, effect, confidence, n_paths): path sums from one node over at most ``max_edges`` edges."""
    e = edges.select("source", "target", "weight", "confidence")
    state = edges.sparkSession.range(1).select(F.lit(treatment).alias("node"), F.lit(1.0).alias("w"), F.lit(1.0).alias("c"), F.lit(1).cast("bigint").alias("n"))
    levels = None
    for _ in range(max_edges):
        state = state.join(e, state.node == e.source).groupBy(F.col("target").alias("node")).agg(
            F.sum(F.col("w") * F.col("weight")).alias("w"), F.sum(F.col("c") * F.col("confidence")).alias("c"), F.sum("n").alias("n")
        )
        levels = state if levels is None else levels.unionByName(state)
    return levels.groupBy("node").agg(F.sum("w").alias("effect"), F.sum("c").alias("_c"), F.sum("n").alias("n_paths")).select(
        "node", "effect", (F.col("_c") / F.col("n_paths")).alias("confidence"), "n_paths"
    )


def intervention(edges: DataFrame, treatment, value: float, max_edges: int = 5) -> DataFrame:
    return path_effects(edges, treatment, max_edges).withColumn("effect", F.col("effect") * value)


def counterfactual(edges: DataFrame, treatment, factual: float, other: float, max_edges: int = 5) -> DataFrame:
    """Difference of two interventions; both follow from the same path sums."""
    p = path_effects(edges, treatment, max_edges)
    return p.select(
        "node", (F.col("effect") * factual).alias("factual"), (F.col("effect") * other).alias("counterfactual"),
        (F.col("effect") * (other - factual)).alias("delta"), "confidence",
    )


def attribution(edges: DataFrame, outcome, change: float, top_k: int = 10, max_edges: int = 4) -> DataFrame:
    """Share of a change by ancestor, with the most confident path.

    Walks backwards from the outcome; per node and length only the sum and one best
    path are kept.
    """
    e = edges.select("source", "target", "weight", "confidence")
    state = edges.sparkSession.range(1).select(
        F.lit(outcome).alias("node"), F.lit(1.0).alias("w"), F.struct(F.lit(1.0).alias("c"), F.array(F.lit(outcome)).alias("p")).alias("best")
    )
    levels = None
    for _ in range(max_edges):
        grown = state.join(e, state.node == e.target).select(
            "source", (F.col("w") * F.col("weight")).alias("w"),
            F.struct((F.col("best.c") * F.col("confidence")).alias("c"), F.concat(F.array("source"), F.col("best.p")).alias("p")).alias("best"),
        )
        state = grown.groupBy(F.col("source").alias("node")).agg(F.sum("w").alias("w"), F.max_by("best", F.col("best.c")).alias("best"))
        levels = state if levels is None else levels.unionByName(state)
    out = levels.groupBy("node").agg((F.sum("w") * change).alias("effect"), F.max_by("best", F.col("best.c")).alias("best"))
    total = out.agg(F.sum(F.abs("effect")).alias("_t"))
    out = attach(out, total).withColumn("share_pct", F.when(F.col("_t") > 0, F.abs("effect") / F.col("_t") * 100).otherwise(0.0))
    return out.orderBy(F.desc(F.abs("effect")), "node").limit(top_k).select("node", "effect", "share_pct", F.col("best.c").alias("path_confidence"), F.col("best.p").alias("path"))


def confounders(edges: DataFrame, treatment, outcome) -> DataFrame:
    """Common ancestors of two nodes that are not parents of the treatment (the adjustment set)."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    roots = edges.sparkSession.createDataFrame([(treatment,), (outcome,)], ["root"])
    above = reachable(back, roots.select(F.col("root").cast(edges.schema["source"].dataType)))
    a = above.where(F.col("root") == treatment).select("node")
    b = above.where(F.col("root") == outcome).select("node")
    parents = edges.where(F.col("target") == treatment).select(F.col("source").alias("node")).distinct()
    return a.join(b, "node", "left_semi").join(parents, "node", "left_anti")


def longest_path(edges: DataFrame) -> int:
    """Nodes on the longest path of an acyclic graph: rounds until no node is left.

    More rounds than nodes mean a cycle, which has no longest path and fails.
    """
    e = durable(edges.select("source", "target").distinct(), "edges")
    level = durable(e.select(F.col("source").alias("node")).distinct(), "level")
    steps = 0 if level.isEmpty() else 1
    nodes = e.select("source").union(e.select("target")).distinct().count()
    while steps:
        if steps > nodes:
            raise ValueError("the graph has a cycle")
        level = durable(level.join(e, level.node == e.source).select(F.col("target").alias("node")).distinct(), "level")
        if level.isEmpty():
            return steps
        steps += 1
    return steps


def graph_summary(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """(kind, name, n): node counts by category, size of the graph, longest path, widest nodes."""
    spark = edges.sparkSession
    cats = nodes.groupBy("category").agg(F.count(F.lit(1)).alias("n")).select(F.lit("category").alias("kind"), F.col("category").alias("name"), "n")
    size = nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("kind"), F.lit("").alias("name"), "n").unionByName(
        edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("kind"), F.lit("").alias("name"), "n")
    )
    wide = edges.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(k)
    wide = wide.select(F.lit("out_degree").alias("kind"), F.col("source").cast("string").alias("name"), "n")
    deep = spark.range(1).select(F.lit("longest_path").alias("kind"), F.lit("").alias("name"), F.lit(longest_path(edges)).cast("bigint").alias("n"))
    return cats.unionByName(size).unionByName(wide).unionByName(deep)


def ridge_effect(wide: DataFrame, outcome: str, treatment: str, controls: list[str], value: float, alpha: float = 1.0) -> DataFrame:
    """Ridge coefficient of the treatment with controls and intercept, times a value.

    The normal equations are one aggregate row; only that small matrix is solved.
    """
    cols = [treatment, *controls]
    rows = wide.na.drop(subset=[*cols, outcome])
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.covar_pop(a, b).alias(f"x{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)]
    aggs += [F.covar_pop(a, outcome).alias(f"y{i}") for i, a in enumerate(cols)]
    s = rows.agg(*aggs).first()
    n, p = s["n"], len(cols)
    if n < 10:
        return wide.sparkSession.range(1).select(F.lit(0.0).alias("effect"), F.lit(n).alias("n"))
    gram = np.array([[s[f"x{i}_{j}"] for j in range(p)] for i in range(p)]) * n + alpha * np.eye(p)
    beta = np.linalg.solve(gram, np.array([s[f"y{i}"] for i in range(p)]) * n)
    return wide.sparkSession.range(1).select(F.lit(float(beta[0] * value)).alias("effect"), F.lit(n).alias("n"))


def chi_square(rows: DataFrame, x: str, y: str, bins: int = 3) -> DataFrame:
    """Chi-square test of two variables cut at their quantiles: statistic, n and p_value."""
    from barline.operators.ordering import exact_quantiles

    base = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y, F.lit(0).alias("_g"))
    probs = [(i, i / bins) for i in range(1, bins)]
    qx = exact_quantiles(base, ["_g"], x, {f"_x{i}": p for i, p in probs}).drop("_g", "n")
    qy = exact_quantiles(base, ["_g"], y, {f"_y{i}": p for i, p in probs}).drop("_g", "n")
    place = lambda c, t: sum((F.when(F.col(c) >= F.col(f"_{t}{i}"), 1).otherwise(0) for i, _ in probs), F.lit(0))
    binned = attach(attach(base, qx), qy).select(place(x, "x").alias("i"), place(y, "y").alias("j"))
    cells = binned.groupBy("i", "j").agg(F.count(F.lit(1)).alias("o"))
    a = cells.groupBy("i").agg(F.sum("o").alias("ri"))
    b = cells.groupBy("j").agg(F.sum("o").alias("cj"))
    n = cells.agg(F.sum("o").alias("n"))
    # bins x bins expected cells, empty ones included
    grid = attach(a.join(F.broadcast(b), how="cross"), n).join(cells, ["i", "j"], "left")
    e = F.col("ri") * F.col("cj") / F.col("n")
    d = F.coalesce("o", F.lit(0)) - e
    out = grid.agg(F.sum(d * d / e).alias("statistic"), F.max("n").alias("n"))
    return out.withColumn("p_value", chi2_sf("statistic", (bins - 1) ** 2))


