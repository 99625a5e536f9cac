"""Skeleton of conditional independences among a stated list of variables, level by level on the cluster.

One pass over the data gives the correlation matrix, which every task gets; its size is that
of the list squared. At each level, the conditioning sets of a pair are numbered in
lexicographic order and dealt out in runs of numbers; a task turns its first number into a
set, walks on from there, and reports the first set that makes the pair independent. What
is cut, and by which set, is written per level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.session import durable

#: Conditioning sets tested in one row's run.
RUN = 4096


def correlations(wide: DataFrame, names: list[str]) -> tuple[np.ndarray, int]:
    """(matrix, rows) over the rows on which every variable is known."""
    rows = wide.na.drop(subset=names)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    s = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs], *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(names)]).first()
    corr = np.eye(len(names))
    for i, j in pairs:
        scale = math.sqrt((s[f"v{i}"] or 0.0) * (s[f"v{j}"] or 0.0))
        corr[i, j] = corr[j, i] = s[f"c{i}_{j}"] / scale if scale > 0 else 0.0
    return corr, s["n"]


def combination(rank: int, n: int, size: int) -> list[int]:
    """The subset of range(n) with this number in lexicographic order."""
    out, at = [], 0
    for left in range(size, 0, -1):
        while rank >= (here := math.comb(n - at - 1, left - 1)):
            rank -= here
            at += 1
        out.append(at)
        at += 1
    return out


def combinations_from(rank: int, count: int, n: int, size: int) -> np.ndarray:
    """``count`` subsets from a number on, as far as there are some."""
    out = []
    own = combination(rank, n, size)
    while len(out) < count:
        out.append(list(own))
        k = size - 1
        while k >= 0 and own[k] == n - size + k:
            k -= 1
        if k < 0:
            break
        own[k] += 1
        own[k + 1:] = range(own[k] + 1, own[k] + size - k)
    return np.array(out, np.int64).reshape(len(out), size)


def p_values(corr: np.ndarray, n: int, i: int, j: int, given: np.ndarray) -> np.ndarray:
    """p-values of zero partial correlation of i and j for each row of conditioning sets (Fisher transform)."""
    sets, size = given.shape
    if size:
        idx = np.concatenate([np.broadcast_to([i, j], (sets, 2)), given], axis=1)
        prec = np.linalg.pinv(corr[idx[:, :, None], idx[:, None, :]])
        r = -prec[:, 0, 1] / np.sqrt(prec[:, 0, 0] * prec[:, 1, 1])
    else:
        r = np.full(sets, corr[i, j])
    r = np.clip(np.nan_to_num(r), -0.9999999, 0.9999999)
    z = np.abs(np.arctanh(r)) * math.sqrt(max(n - size - 3, 1))
    return np.array([math.erfc(x / math.sqrt(2)) for x in z])


def _cut(linked: DataFrame, sent, size: int, alpha: float, run: int) -> DataFrame:
    """(i, j, given): linked pairs that some set of ``size`` neighbours of i separates, and the first such set."""
    both = linked.select("i", "j").unionByName(linked.select(F.col("j").alias("i"), F.col("i").alias("j")))
    near = both.groupBy("i").agg(F.sort_array(F.collect_list("j")).alias("near"))
    cells = linked.join(near, "i").withColumn("others", F.array_remove("near", F.col("j"))).where(F.size("others") >= size)
    k = F.size("others").cast("long")
    # the number of sets, a product that divides evenly at each step
    sets = reduce(lambda a, s: F.floor(a * (k - s) / (s + 1)), range(size), F.lit(1).cast("long"))
    runs = cells.select("i", "j", "others", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((sets - 1) / run).cast("long"))).alias("part"))

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        corr, n = sent.value
        for pdf in batches:
            out = []
            for i, j, others, part in pdf.itertuples(index=False):
                others = np.asarray(others, np.int64)
                given = others[combinations_from(part * run, run, len(others), size)]
                hit = np.flatnonzero(p_values(corr, n, i, j, given.reshape(len(given), size)) > alpha)
                if len(hit):
                    out.append((i, j, part * run + int(hit[0]), given[hit[0]].tolist()))
            yield pd.DataFrame(out, columns=["i", "j", "number", "given"])

    n = int(linked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tested = runs.repartition(n, "i", "j", "part").mapInPandas(test, "i int, j int, number long, given array<int>")
    return tested.groupBy("i", "j").agg(F.min_by("given", "number").alias("given"))


def _oriented(linked: DataFrame, split: DataFrame) -> DataFrame:
    """(x, z): edges with a head at z, from colliders, then by two rules until nothing changes.

    Colliders: x - z - y with x and y apart and z not in the set that separates them. Then
    z - y gets its head at y if some x -> z is apart from y, or if z -> w -> y for some w.
    """
    both = durable(linked.select(F.col("i").alias("x"), F.col("j").alias("z")).unionByName(linked.select(F.col("j").alias("x"), F.col("i").alias("z"))), "links")
    pairs = both.join(both.select(F.col("x").alias("y"), "z"), "z").where("x <> y")
    apart = both.select("x", F.col("z").alias("y"))
    either = split.select(F.col("i").alias("x"), F.col("j").alias("y"), "given").unionByName(split.select(F.col("j").alias("x"), F.col("i").alias("y"), "given"))
    open_ = pairs.join(apart, ["x", "y"], "left_anti").join(either, ["x", "y"], "left")
    free = F.col("given").isNull() | ~F.array_contains("given", F.col("z"))
    heads = durable(open_.where(free).select("x", "z").distinct(), "heads")
    while True:
        turned = heads.unionByName(heads.select(F.col("z").alias("x"), F.col("x").alias("z")))
        loose = both.join(turned, ["x", "z"], "left_anti")
        away = heads.join(loose.select(F.col("x").alias("z"), F.col("z").alias("y")), "z").where("x <> y").join(apart, ["x", "y"], "left_anti")
        through = heads.join(heads.select(F.col("x").alias("z"), F.col("z").alias("y")), "z").select("x", F.col("y").alias("z"))
        more = away.select(F.col("z").alias("x"), F.col("y").alias("z")).unionByName(through.join(loose, ["x", "z"], "left_semi")).distinct()
        more = durable(more.join(heads, ["x", "z"], "left_anti"), "more-heads")
        if more.isEmpty():
            return heads
        heads = durable(heads.unionByName(more), "heads")


def skeleton(wide: DataFrame, names: list[str], alpha: float = 0.01, max_set: int = 3, run: int = RUN) -> DataFrame:
    """(a, b, corr, into_b, into_a): pairs that no set of up to ``max_set`` neighbours separates, and their heads."""
    spark = wide.sparkSession
    corr, n = correlations(wide, names)
    sent = spark.sparkContext.broadcast((corr, n))
    one = lambda c: spark.range(len(names)).select(F.col("id").cast("int").alias(c))
    linked = durable(one("i").join(one("j"), F.col("i") < F.col("j")), "links")
    split = []
    for size in range(max_set + 1):
        cut = durable(_cut(linked, sent, size, alpha, run), "cut")
        split.append(cut)
        linked = durable(linked.join(cut, ["i", "j"], "left_anti"), "links")
    heads = _oriented(linked, reduce(DataFrame.unionByName, split))
    # the list's names and matrix, a row per pair
    told = spark.createDataFrame([(i, j, names[i], names[j], float(corr[i, j])) for i in range(len(names)) for j in range(i + 1, len(names))],
                                 "i int, j int, a string, b string, corr double")
    mark = lambda x, z, name: heads.select(F.col("x").alias(x), F.col("z").alias(z), F.lit(True).alias(name))
    out = linked.join(told, ["i", "j"]).join(mark("i", "j", "into_b"), ["i", "j"], "left").join(mark("j", "i", "into_a"), ["i", "j"], "left")
    return out.select("a", "b", "corr", F.coalesce("into_b", F.lit(False)).alias("into_b"), F.coalesce("into_a", F.lit(False)).alias("into_a"))
