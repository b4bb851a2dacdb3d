"""Newton's method on likelihoods that are sums over rows.

A step is one pass: each task adds up gradients of its Arrow batches, at the
point and at small steps from it, and returns one row; the Hessian is the
difference of the gradients.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_sums(df: DataFrame, f: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over batches of ``f`` of the batch's values as a matrix; ``df`` holds doubles only."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += f(np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]))
        yield pa.RecordBatch.from_pydict({"v": [total.tolist()]}, schema=pa.schema([("v", pa.list_(pa.float64()))]))

    each = df.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("i", "v"))
    out = np.zeros(size)
    for r in each.groupBy("i").agg(F.sum("v").alias("v")).collect():  # added up by place, not on the driver
        out[r["i"]] = r["v"]
    return out


def maximise(df: DataFrame, loglik: Callable[[np.ndarray, np.ndarray], float], gradient: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, steps: int = 50, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray, float]:
    """Point, inverse negative Hessian and value of the maximum of ``loglik(rows, point)``.

    ``gradient`` has the same arguments.  Steps are halved while they lose.
    """
    p = len(start)
    eps = 1e-5

    def at(point):
        points = [point] + [point + eps * s * np.eye(p)[i] for i in range(p) for s in (1, -1)]

        def f(rows):
            return np.concatenate([[loglik(rows, point)], *(gradient(rows, q) for q in points)])

        out = row_sums(df, f, 1 + p * len(points))
        g = out[1:].reshape(-1, p)
        h = (g[1::2] - g[2::2]) / (2 * eps)
        return out[0], g[0], (h + h.T) / 2

    point = np.array(start, float)
    value, g, h = at(point)
    for _ in range(steps):
        # curvature of the wrong sign far from the maximum is turned round
        size, axes = np.linalg.eigh(-h)
        move = axes @ ((axes.T @ g) / np.maximum(np.abs(size), 1e-9 * np.abs(size).max()))
        scale = 1.0
        while True:
            new = at(point + scale * move)
            if new[0] >= value - 1e-12 * abs(value) or scale < 1e-6:
                break
            scale /= 2
        done = abs(new[0] - value) <= tol * (abs(value) + 0.1)
        point = point + scale * move
        value, g, h = new
        if done:
            break
    return point, np.linalg.inv(-h), value
