"""The skeleton against a plain loop over all subsets, and on graphs that are known."""

import itertools
import math

import numpy as np
import pytest

from barline.operators import skeleton as sk


def test_numbered_subsets_are_in_order():
    for n, size in ((5, 0), (5, 2), (7, 3), (6, 6)):
        want = [list(c) for c in itertools.combinations(range(n), size)]
        assert [sk.combination(i, n, size) for i in range(len(want))] == want
        for start in range(len(want)):
            assert sk.combinations_from(start, 4, n, size).tolist() == want[start: start + 4]


def by_hand(corr, n, alpha, max_set):
    count = len(corr)
    linked = {i: set(range(count)) - {i} for i in range(count)}
    for size in range(max_set + 1):
        cut = []
        for i, j in itertools.combinations(range(count), 2):
            if j in linked[i] and len(linked[i] - {j}) >= size:
                for given in itertools.combinations(sorted(linked[i] - {j}), size):
                    idx = [i, j, *given]
                    prec = np.linalg.pinv(corr[np.ix_(idx, idx)])
                    r = -prec[0, 1] / math.sqrt(prec[0, 0] * prec[1, 1])
                    if math.erfc(abs(math.atanh(max(min(r, 0.9999999), -0.9999999))) * math.sqrt(n - size - 3) / math.sqrt(2)) > alpha:
                        cut.append((i, j))
                        break
        for i, j in cut:
            linked[i].discard(j)
            linked[j].discard(i)
    return {(i, j) for i in range(count) for j in linked[i] if i < j}


@pytest.mark.parametrize("seed", [1, 2])
def test_skeleton_equals_all_subsets(spark, seed):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(150, 7)) @ (np.eye(7) + rng.normal(0, 0.5, (7, 7)) * (rng.random((7, 7)) < 0.4))
    names = [f"v{i}" for i in range(7)]
    wide = spark.createDataFrame(data.tolist(), names)
    got = {(names.index(r["a"]), names.index(r["b"])) for r in sk.skeleton(wide, names, 0.05, 3, run=3).collect()}
    assert got == by_hand(np.corrcoef(data.T), 150, 0.05, 3) and 0 < len(got) < 21


def planted(spark, columns, names):
    return sk.skeleton(spark.createDataFrame(np.column_stack(columns).tolist(), names), names, 0.01, 2)


def test_a_chain_has_no_heads_and_a_collider_has(spark):
    rng = np.random.default_rng(7)
    e = rng.normal(size=(6, 4000))
    a, b = e[0], e[0] + e[1]
    chain = {(r["a"], r["b"]): (r["into_b"], r["into_a"]) for r in planted(spark, [a, b, b + e[2]], ["a", "b", "c"]).collect()}
    assert chain == {("a", "b"): (False, False), ("b", "c"): (False, False)}
    # a -> c <- b, and c -> d follows by the first rule
    c = e[0] + e[1] + 0.5 * e[2]
    got = {(r["a"], r["b"]): (r["into_b"], r["into_a"]) for r in planted(spark, [e[0], e[1], c, c + e[3]], ["a", "b", "c", "d"]).collect()}
    assert got == {("a", "c"): (True, False), ("b", "c"): (True, False), ("c", "d"): (True, False)}
