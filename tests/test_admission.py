"""Ordered edge admission against a loop over all proposals."""

import random

import pytest

from barline.operators import admission


def reaches(edges, a, b):
    todo, met = [a], {a}
    while todo:
        x = todo.pop()
        if x == b:
            return True
        for s, t in edges:
            if s == x and t not in met:
                met.add(t)
                todo.append(t)
    return False


def one_by_one(nodes, standing, asked):
    edges, out = set(standing), {}
    for seq, s, t in sorted(asked):
        if s not in nodes or t not in nodes:
            out[seq] = "unknown"
        elif (s, t) not in edges and reaches(edges, t, s):
            out[seq] = "cycle"
        else:
            out[seq] = "accepted"
            edges.add((s, t))
    return out, edges


def proposals(seed, nodes, n):
    rng = random.Random(seed)
    standing = sorted({(a, b) for a, b in ((rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n // 6)) if a < b})
    asked = [(i * 7 + 3, rng.randrange(nodes), rng.randrange(nodes + 1)) for i in range(n)]
    return standing, asked


def verdicts(spark, nodes, standing, asked, **kw):
    n = spark.createDataFrame([(i,) for i in range(nodes)], "node long")
    e = spark.createDataFrame(standing, "source long, target long")
    p = spark.createDataFrame(asked, "seq long, source long, target long")
    return {r["seq"]: r["verdict"] for r in admission.admit_edges(n, e, p, **kw).collect()}


@pytest.mark.parametrize("seed, nodes, n, task_edges", [(1, 30, 60, 1000), (2, 12, 70, 1000), (3, 9, 24, 5)])
def test_edges_are_admitted_as_one_by_one(spark, seed, nodes, n, task_edges):
    standing, asked = proposals(seed, nodes, n)
    want, edges = one_by_one(set(range(nodes)), standing, asked)
    assert verdicts(spark, nodes, standing, asked, task_edges=task_edges) == want
    assert {"cycle", "accepted", "unknown"} <= set(want.values())
    # nothing accepted leads back, so no pair was taken in both directions
    assert not any(reaches(edges, t, s) for s, t in edges)


def test_both_directions_and_repeats(spark):
    asked = [(1, 0, 1), (2, 1, 0), (3, 0, 1), (4, 1, 0), (5, 2, 2), (6, 1, 2), (7, 2, 0)]
    got = verdicts(spark, 3, [], asked)
    assert got == {1: "accepted", 2: "cycle", 3: "accepted", 4: "cycle", 5: "cycle", 6: "accepted", 7: "cycle"}
    assert verdicts(spark, 3, [(0, 1)], []) == {}


def test_strong_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (7, 1), (6, 8), (9, 10), (10, 9), (11, 11), (2, 9)]
    rows = admission.strong_components(spark.createDataFrame(edges, "source long, target long")).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["component"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4, 5, 6], [9, 10]]


@pytest.mark.parametrize("seed", range(20))
def test_order_of_a_growing_graph(seed):
    rng = random.Random(seed)
    order, edges = admission.Order(), set()
    for _ in range(200):
        s, t = rng.randrange(25), rng.randrange(25)
        taken = not reaches(edges, t, s)
        assert order.add(s, t) == taken
        if taken:
            edges.add((s, t))
        assert all(order.place[a] < order.place[b] for a, b in edges)
