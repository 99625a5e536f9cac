"""Admission of directed edges, one after the other, into a graph that stays acyclic.

Taken in order, a proposal is accepted unless its source can be reached from its target
over edges that stand or were accepted before. Whether that is so never depends on edges
outside the strong component, in the graph of all edges and proposals, that holds both
ends; a proposal between two components closes no cycle. So components are found on
the cluster, proposals between them are accepted at once, and each component is settled
by itself: in one task by an incremental topological order if it has few edges, else
after its proposals are cut in two halves, the earlier first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.session import durable, spread

#: The most edges of a component that one task takes; larger ones are halved.
TASK_EDGES = 200_000


def _peeled(edges: DataFrame) -> DataFrame:
    """``edges`` without those that start at a node nothing leads to, or end at one that leads nowhere, until none is left."""
    while True:
        n = edges.count()
        ends = edges.select(F.col("target").alias("source")).distinct()
        kept = edges.join(ends, "source", "left_semi")
        kept = kept.join(kept.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        kept = durable(kept.select(*edges.columns), "peeled")
        if kept.count() == n:
            return kept
        edges = kept


def _spread_least(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, least): the least label of all nodes that reach a node, itself included; ``start`` is (node, least).

    Every node that got a smaller label passes it on; each round writes the labels.
    """
    labels = durable(start, "labels")
    moved = labels
    while True:
        heard = moved.join(edges, F.col("node") == F.col("source")).groupBy(F.col("target").alias("node")).agg(F.min("least").alias("heard"))
        both = durable(labels.join(heard, "node", "left").select("node", F.least("least", "heard").alias("least"), (F.col("heard") < F.col("least")).alias("new")), "labels")
        moved = both.where("new").select("node", "least")
        labels = both.select("node", "least")
        if moved.isEmpty():
            return labels


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes that lie on a cycle of (source, target) edges; the component is one of its nodes.

    Every node learns the least node that reaches it. The node a label is named after and
    those of its label that reach it back are one component. These nodes go, and the rest
    is labelled again.
    """
    left = _peeled(durable(edges.select("source", "target").where("source <> target").distinct(), "edges"))
    found = None
    while not left.isEmpty():
        nodes = left.select(F.col("source").alias("node")).distinct()
        labels = _spread_least(left, nodes.select("node", F.col("node").alias("least")))
        a = labels.select(F.col("node").alias("source"), F.col("least").alias("_a"))
        b = labels.select(F.col("node").alias("target"), F.col("least").alias("_b"))
        # edges between labels lie on no cycle
        inside = durable(left.join(a, "source").join(b, "target").where("_a = _b").select("source", "target"), "inside")
        # backwards from the node of each label: 0 for it and all that reach it
        back = inside.select(F.col("target").alias("source"), F.col("source").alias("target"))
        ends = _spread_least(back, labels.select("node", F.when(F.col("node") == F.col("least"), 0).otherwise(1).alias("least")))
        part = durable(ends.where("least = 0").select("node").join(labels, "node").select("node", F.col("least").alias("component")), "components")
        found = part if found is None else found.unionByName(part)
        rest = inside.join(part.select(F.col("node").alias("source")), "source", "left_anti")
        left = _peeled(durable(rest.join(part.select(F.col("node").alias("target")), "target", "left_anti").select("source", "target"), "edges"))
    if found is None:
        kind = edges.schema["source"].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    # a node that is alone in its component lies on no cycle
    shared = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    return durable(found.join(shared, "component", "left_semi").select("node", "component"), "components")


class Order:
    """A topological order of a growing acyclic graph.

    An edge that agrees with the order costs nothing. One that does not is followed forward
    from its target and backward from its source, only between their places; meeting the
    source is a cycle, and otherwise the nodes met exchange places.
    """

    def __init__(self):
        self.place: dict[int, int] = {}
        self.after: dict[int, list[int]] = {}
        self.before: dict[int, list[int]] = {}

    def _node(self, x: int) -> int:
        return self.place.setdefault(x, len(self.place))

    def add(self, source: int, target: int) -> bool:
        """Whether the edge was taken in."""
        low, high = self._node(target), self._node(source)
        if source == target:
            return False
        if low < high:
            ahead = self._walk(target, self.after, lambda p: p <= high)
            if source in ahead:
                return False
            behind = self._walk(source, self.before, lambda p: p >= low)
            moved = sorted(behind, key=self.place.get) + sorted(ahead, key=self.place.get)
            for x, p in zip(moved, sorted(self.place[x] for x in moved), strict=True):
                self.place[x] = p
        self.after.setdefault(source, []).append(target)
        self.before.setdefault(target, []).append(source)
        return True

    def _walk(self, start: int, ways: dict[int, list[int]], near) -> set[int]:
        met, todo = {start}, [start]
        while todo:
            for y in ways.get(todo.pop(), ()):
                if y not in met and near(self.place[y]):
                    met.add(y)
                    todo.append(y)
        return met


def _settle(rows: pd.DataFrame) -> pd.DataFrame:
    """Verdicts of one component's proposals, in order of seq, after the edges that stand."""
    order = Order()
    standing = rows[rows["stands"]]
    for s, t in zip(standing["source"].tolist(), standing["target"].tolist(), strict=True):
        if not order.add(s, t):
            raise ValueError("the edges that stand already hold a cycle")
    asked = rows[~rows["stands"]].sort_values("seq")
    taken = [order.add(s, t) for s, t in zip(asked["source"].tolist(), asked["target"].tolist(), strict=True)]
    return pd.DataFrame({"seq": asked["seq"], "taken": taken})


def _verdicts(standing: DataFrame, asked: DataFrame, task_edges: int) -> Iterator[DataFrame]:
    """(seq, taken) tables that together hold every row of ``asked``, whose (source, target) differ from each other."""
    spark = asked.sparkSession
    graph = standing.select("source", "target").unionByName(asked.select("source", "target"))
    parts = strong_components(graph)
    a = parts.select(F.col("node").alias("source"), F.col("component").alias("_a"))
    b = parts.select(F.col("node").alias("target"), F.col("component").alias("_b"))
    every = standing.select("source", "target", F.lit(0).cast("long").alias("seq"), F.lit(True).alias("stands")).unionByName(
        asked.select("source", "target", F.col("seq").cast("long").alias("seq"), F.lit(False).alias("stands")))
    placed = every.join(a, "source", "left").join(b, "target", "left").withColumn("component", F.when(F.col("_a") == F.col("_b"), F.col("_a")))
    placed = durable(placed.select("source", "target", "seq", "stands", "component"), "placed")
    yield placed.where("component IS NULL AND NOT stands").select("seq", F.lit(True).alias("taken"))
    sizes = durable(placed.where("component IS NOT NULL").groupBy("component").agg(
        F.count(F.lit(1)).alias("n")), "sizes")
    small = placed.join(sizes.where(F.col("n") <= task_edges).select("component"), "component")
    yield durable(spread(small, "component").groupBy("component").applyInPandas(lambda rows: _settle(rows), "seq long, taken boolean"), "verdicts")
    large = sizes.where(F.col("n") > task_edges)
    if large.isEmpty():
        return
    rest = durable(placed.join(large.select("component"), "component").drop("component"), "large")
    stands, asks = rest.where("stands").select("source", "target"), rest.where("NOT stands").drop("stands")
    if asks.count() == 1:
        # one proposal inside a component of edges that stand: it closes the cycle
        yield asks.select("seq", F.lit(False).alias("taken"))
        return
    middle = asks.agg(F.expr("percentile_approx(seq, 0.5, 10000)")).first()[0]
    if middle == asks.agg(F.max("seq")).first()[0]:
        middle -= 1
    first, second = asks.where(F.col("seq") <= middle), asks.where(F.col("seq") > middle)
    early = [durable(v, "early") for v in _verdicts(stands, first, task_edges)]
    yield from early
    settled = early[0]
    for v in early[1:]:
        settled = settled.unionByName(v)
    accepted = first.join(settled.where("taken").select("seq"), "seq", "left_semi").select("source", "target")
    yield from _verdicts(durable(stands.unionByName(accepted), "stands"), second, task_edges)


def admit_edges(nodes: DataFrame, existing: DataFrame, proposed: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``proposed`` (source, target, seq) with a verdict: unknown, cycle or accepted, as if taken one by one in order of seq.

    ``seq`` is distinct. ``nodes`` are the known ones, ``existing`` an acyclic set of edges. An edge that
    stands or was proposed before is accepted or refused with its first occurrence.
    """
    known = nodes.select("node").distinct()
    p = proposed.join(known.select(F.col("node").alias("source"), F.lit(1).alias("_s")), "source", "left").join(
        known.select(F.col("node").alias("target"), F.lit(1).alias("_t")), "target", "left")
    loop = F.col("source") == F.col("target")
    early = F.when(F.col("_s").isNull() | F.col("_t").isNull(), "unknown").when(loop, "cycle")
    p = durable(p.withColumn("verdict", early).drop("_s", "_t"), "proposed")
    open_ = p.where("verdict IS NULL")
    stands = durable(existing.select("source", "target").distinct(), "stands")
    # an edge keeps the verdict of its first proposal: what closed a cycle then still does
    first = open_.groupBy("source", "target").agg(F.min("seq").alias("seq")).join(stands, ["source", "target"], "left_anti")
    taken = None
    for v in _verdicts(stands, durable(first, "asked"), task_edges):
        taken = v if taken is None else taken.unionByName(v)
    refused = first.join(taken.where("NOT taken").select("seq"), "seq", "left_semi").select("source", "target", F.lit("cycle").alias("_v"))
    out = p.join(refused, ["source", "target"], "left")
    return out.withColumn("verdict", F.coalesce("verdict", "_v", F.lit("accepted"))).drop("_v")
