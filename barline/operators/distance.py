"""Distance covariance of series in n log n steps, for one pairing or many at once.

The mean product of two doubly centred distance matrices needs three sums: of products
of distances over all pairs, of products of row sums, and of all distances. Row sums follow
from sorting. For the first, pairs are taken in order of x: a product of differences
has its right sign where y rises too, so twice the sum over rising pairs less the sum over all
pairs is what is sought. Rising pairs are counted (with weights 1, x, y, xy) by splitting
the places in x by their bits, from the highest: in order of y, what lies in the lower half before an
element of the upper half is one running sum. No matrix of all pairs is made.
"""

from __future__ import annotations

import numpy as np

#: Cells of one array worked on at once (pairings x length).
CELLS = 1 << 18


def row_sums(x: np.ndarray) -> np.ndarray:
    """Sum of distances of each element to all."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    below = np.cumsum(s) - s
    out = np.empty(len(x))
    out[order] = s * (2 * np.arange(len(x)) - len(x)) - 2 * below + s.sum()
    return out


def variance_part(x: np.ndarray) -> float:
    """Mean square of the doubly centred distances."""
    x = x - x.mean()
    n, rows = len(x), row_sums(x)
    return float(2 * (x * x).mean() - 2 * (rows @ rows) / n**3 + (rows.sum() / n**2) ** 2)


def _rising(place: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum over pairs with a lower place and a lower y of the product of their differences, per row of (rows, n) arrays.

    The columns are in order of y. The sum is a mean over n * n pairs.
    """
    rows, n = place.shape
    base = (np.arange(rows) * n)[:, None]
    total = np.zeros(rows)
    for bit in range(max(n - 1, 0).bit_length() - 1, -1, -1):
        upper = (place >> bit) & 1 == 1
        start = (place >> (bit + 1)) << (bit + 1)
        low = ~upper
        # running sums over the lower half, from the start of each block on
        level = np.zeros(rows)
        zeros = None
        for left, right in ((low.astype(float), x * y), (low * x, -y), (low * y, -x), (low * x * y, None)):
            run = np.zeros((rows, n + 1))
            np.cumsum(left, axis=1, out=run[:, 1:])
            inside = run[:, :-1] - np.take_along_axis(run, start, axis=1)
            zeros = inside if zeros is None else zeros
            level += np.where(upper, inside if right is None else inside * right, 0.0).sum(axis=1)
        total += level / n / n
        # each block falls into its two halves, both still in order of y
        before = zeros.astype(np.int64)
        at = np.where(upper, (place >> bit << bit) + (np.arange(n) - start) - before, start + before) + base
        back = np.empty(rows * n, np.int64)
        back[at.ravel()] = np.arange(rows * n)
        place, x, y = (a.ravel()[back].reshape(rows, n) for a in (place, x, y))
    return total


def cross_parts(x: np.ndarray, y: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """Mean product of the centred distances of ``x`` and ``y[order]``, for each row of ``orders``."""
    n = len(x)
    x, y = x - x.mean(), y - y.mean()
    by_x = np.argsort(x, kind="stable")
    place_of = np.empty(n, np.int64)
    place_of[by_x] = np.arange(n)
    rows_x, rows_y = row_sums(x), row_sums(y)
    by_y = np.argsort(y, kind="stable")
    out = np.empty(len(orders))
    step = max(1, CELLS // max(n, 1))
    for i in range(0, len(orders), step):
        idx = orders[i: i + step]
        # where each y goes, then the draws' columns in order of y
        to = np.empty_like(idx)
        np.put_along_axis(to, idx, np.broadcast_to(np.arange(n), idx.shape), axis=1)
        to = np.ascontiguousarray(to[:, by_y])
        xs = x[to]
        ys = np.broadcast_to(y[by_y], to.shape).copy()
        every = (xs * ys).sum(axis=1) / n  # all pairs, with sign, of centred series
        pairs = 2 * (2 * _rising(place_of[to], xs, ys) - every)
        out[i: i + step] = pairs - 2 * (rows_y[idx] @ rows_x) / n**3 + rows_x.sum() * rows_y.sum() / n**4
    return out


def correlation(cross, vx: float, vy: float):
    """Distance correlation from the mean products; 0 where a series does not vary."""
    scale = np.sqrt(max(vx, 0.0) * max(vy, 0.0))
    return np.sqrt(np.maximum(cross, 0.0) / scale) if scale > 1e-15 else np.zeros_like(cross)


def distance_correlation(x: np.ndarray, y: np.ndarray) -> float:
    if len(x) < 4:
        return 0.0
    cross = cross_parts(x, y, np.arange(len(x))[None, :])
    return float(correlation(cross, variance_part(x), variance_part(y))[0])
