"""User-supplied pieces: strategies, sources, feature builders, losses, expansions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from barline.functions.cols import attach
from barline.operators.alignment import assign_windows
from barline.session import spread

#: (train returns [bars x names]) -> anything the weight function wants
Fit = Callable[[np.ndarray], object]
#: (fitted object, returns known so far [bars x names]) -> weights [names]
WeightsFor = Callable[[object, np.ndarray], np.ndarray]

STRATEGIES: dict[str, tuple[Fit, WeightsFor]] = {}
SOURCES: dict[str, Callable[[SparkSession, list[str]], DataFrame]] = {}
BUILDERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def strategy(name: str, fit: Fit, weights_for: WeightsFor) -> None:
    STRATEGIES[name] = (fit, weights_for)


def _equal(_: object, seen: np.ndarray) -> np.ndarray:
    return np.full(seen.shape[1], 1.0 / seen.shape[1])


def _trend(_: object, seen: np.ndarray, last: int = 20, cap: float = 0.25) -> np.ndarray:
    side = np.sign(seen[-last:].mean(axis=0))
    return np.clip(side / max(np.abs(side).sum(), 1), -cap, cap)


strategy("equal", lambda train: None, _equal)
strategy("trend", lambda train: None, _trend)


def run_strategy(rets: DataFrame, name: str, names: list[int], train: int, test: int) -> DataFrame:
    """(w, bar_idx, sym, weight) of a registered strategy over all walk-forward windows.

    Every window is one grouped task that holds its own train and test bars of a
    stated universe; the function never sees a bar it should not know yet.
    """
    fit, weights_for = STRATEGIES[name]
    cols = [str(n) for n in names]
    wide = rets.groupBy("bar_idx").pivot("sym", names).agg(F.first("ret")).na.fill(0.0)
    n = wide.agg((F.max("bar_idx") + 1).alias("_n"))
    placed = assign_windows(attach(wide, n), F.col("_n"), train, test)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_idx")
        x, idx = pdf[cols].to_numpy(dtype="float64"), pdf["bar_idx"].to_numpy()
        start = int((pdf["side"] == "train").sum())
        model, out = fit(x[:start]), []
        for k in range(start, len(idx)):
            w = np.nan_to_num(np.asarray(weights_for(model, x[:k]), dtype="float64"))
            out += [(int(pdf["w"].iloc[0]), int(idx[k]), int(s), float(v)) for s, v in zip(names, w)]
        return pd.DataFrame(out, columns=["w", "bar_idx", "sym", "weight"])

    return spread(placed, "w").groupBy("w").applyInPandas(run, "w int, bar_idx int, sym bigint, weight double")


def source(name: str, reader: Callable[[SparkSession, list[str]], DataFrame]) -> None:
    SOURCES[name] = reader


def read_sources(spark: SparkSession, order: list[str], symbols: list[str]) -> DataFrame:
    """Rows of all named sources with their priority, ready for ``first_source``."""
    out: DataFrame | None = None
    for k, name in enumerate(order):
        rows = SOURCES[name](spark, symbols).withColumn("priority", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no source given")
    return out


def builder(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    BUILDERS[name] = build


def build_features(panel: DataFrame, order: list[str]) -> DataFrame:
    """Runs registered feature builders one after another; each is a DataFrame transform."""
    for name in order:
        panel = panel.transform(BUILDERS[name])
    return panel


def mean_loss(rows: DataFrame, loss: Callable[[Column, Column], Column], *keys: str, pred: str = "pred", target: str = "target") -> DataFrame:
    """Mean of a user-supplied loss; the loss is a column expression, so it stays inside the JVM."""
    return rows.groupBy(*keys).agg(F.avg(loss(F.col(pred), F.col(target))).alias("loss"))


@udtf(returnType="a string, b string")
class NamePairs:
    """Table function: every pair ``a < b`` of one short list of names ."""

    def eval(self, names: list[str]) -> Iterator[tuple[str, str]]:
        ordered = sorted(names)
        for i, a in enumerate(ordered):
            for b in ordered[i + 1 :]:
                yield a, b
