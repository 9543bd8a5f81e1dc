"""A sample with one regressor, folded to a few weighted points that stand for all of its events.

The sums of a logit over differences d and weights w are sums of w f(d), where f(d) is log sigmoid(d beta) or one of its
derivatives. The line of differences is cut into cells; inside a cell f is, to the last digits of a double, the
polynomial through its values at `NODES` Chebyshev points, as long as |beta| is at most `BETA`: the nearest pole
of the sigmoid is pi away, half a cell times beta at most one, and the error falls by 6.4 with every point. Hence every
event adds w times the Lagrange polynomials at its d to the points of its cell, and fits of the points are fits of the events.
Coefficients beyond `BETA` and differences beyond `REACH` are not folded: their samples are summed event by event.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from dyadscope.operators.fit import CELLS_PER_BLOCK

HALF = 1 / 16  # half a cell
NODES = 20
BETA = 1 / HALF
REACH = 16.0

_ANGLES = (np.arange(NODES) + 0.5) * np.pi / NODES
POINTS = np.cos(_ANGLES)
# Lagrange polynomials of the points from Chebyshev polynomials: those of the points are orthogonal over them.
_LAGRANGE = 2.0 / NODES * np.cos(np.arange(NODES)[:, None] * _ANGLES[None, :])
_LAGRANGE[0] /= 2.0


def cells(reach: float) -> int:
    """Cells that hold all differences from -reach to reach."""
    return 2 * (int(reach / (2 * HALF)) + 1)


def points(n_cells: int) -> np.ndarray:
    """Differences that the weights of a folded sample belong to."""
    centres = (np.arange(n_cells) - n_cells / 2 + 0.5) * 2 * HALF
    return (centres[:, None] + HALF * POINTS[None, :]).ravel()


def lagrange(t: np.ndarray) -> np.ndarray:
    """Values at t, from -1 to 1, of the polynomials that are one at one point and zero at the others."""
    t = np.clip(t, -1.0, 1.0)
    chebyshev = np.empty((NODES, len(t)))
    chebyshev[0], chebyshev[1] = 1.0, t
    for j in range(2, NODES):
        chebyshev[j] = 2.0 * t * chebyshev[j - 1] - chebyshev[j - 2]
    return chebyshev.T @ _LAGRANGE


def fold(into: np.ndarray, d: np.ndarray, weights: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
    """Add events to `into` (slots x points); `weights` gives those of chosen events (positions) and slots."""
    n_cells = into.shape[1] // NODES
    cell = np.clip(np.floor(d / (2 * HALF)).astype(int) + n_cells // 2, 0, n_cells - 1)
    order = np.argsort(cell, kind="stable")
    cell, d = cell[order], d[order]
    values = lagrange((d - (cell - n_cells / 2 + 0.5) * 2 * HALF) / HALF)
    starts = np.flatnonzero(np.diff(cell, prepend=-1))
    ends = np.append(starts[1:], len(cell))
    block = max(1, CELLS_PER_BLOCK // max(len(d), 1))
    for s in range(0, len(into), block):
        part = np.arange(s, min(s + block, len(into)))
        w = weights(order, part)
        for c, a, b in zip(cell[starts], starts, ends, strict=True):
            into[s : s + block, c * NODES : (c + 1) * NODES] += w[a:b].T @ values[a:b]
