"""Elastic-net paths of generalized linear models with cross-validation.

All penalties and all left-out folds are fitted side by side: a pass gives every one of these
models its weighted sums of products (a fold's rows are in all models but its own), the
driver moves each by coordinate descent on those sums, and a few passes later all stand.
The number of passes does not grow with the path or the folds, and no row leaves its task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.plans.newton import row_sums
from quillstat.plans.ordered import cut


@dataclass
class PenalizedPath:
    """Coefficients (intercept first, of the predictors as they are) by penalty, with the cross-validated deviance of a row."""

    names: list[str]
    lambdas: np.ndarray
    coefficients: np.ndarray
    deviance: np.ndarray  # of a row, on all rows
    cv_mean: np.ndarray | None
    cv_error: np.ndarray | None
    family: str
    alpha: float
    predictors: list[str]

    def best(self, rule: str = "min") -> int:
        """The place of the penalty of least deviance, or of the largest within one standard error of it (``1se``)."""
        if self.cv_mean is None:
            raise ValueError("the path was fitted without folds")
        low = int(self.cv_mean.argmin())
        if rule == "min":
            return low
        if rule != "1se":
            raise ValueError("rule must be min or 1se")
        return int(np.flatnonzero(self.cv_mean <= self.cv_mean[low] + self.cv_error[low])[0])

    def predict(self, df: DataFrame, at: int, name: str = "fit", kind: str = "response") -> DataFrame:
        """``df`` with the prediction at the penalty of place ``at``; null where a predictor is missing."""
        eta: Column = F.lit(float(self.coefficients[at, 0])) + sum((F.col(c).cast("double") * float(b) for c, b in zip(self.predictors, self.coefficients[at, 1:], strict=True)), F.lit(0.0))
        return df.withColumn(name, eta if kind == "link" or self.family == "gaussian" else F.exp(eta) if self.family == "poisson" else 1 / (1 + F.exp(-eta)))


def descend(h: np.ndarray, g: np.ndarray, beta: np.ndarray, l1: float, l2: float, rounds: int = 10_000, tol: float = 1e-12) -> np.ndarray:
    """The minimum of (b - beta)'h(b - beta)/2 - g'(b - beta) + l1 |b| + l2 b'b/2 over b, the first of which is free: coordinate by coordinate, over those that are not 0 until they stand."""
    b, rest = beta.copy(), g.copy()  # rest: the slope of the smooth part's fall at b
    p = len(b)
    active = np.arange(p)
    for _ in range(rounds):
        most = 0.0
        for j in active:
            if h[j, j] <= 0:
                continue
            z = rest[j] + h[j, j] * b[j]
            new = z / h[j, j] if j == 0 else np.sign(z) * max(abs(z) - l1, 0.0) / (h[j, j] + l2)
            move = new - b[j]
            if move:
                rest -= h[:, j] * move
                b[j] = new
                most = max(most, move * move * h[j, j])
        if most < tol:
            if len(active) == p:
                break
            active = np.arange(p)  # once more over all
        else:
            active = np.flatnonzero(b) if len(active) == p else active
    return b


def _mean(family: str, eta: np.ndarray) -> np.ndarray:
    if family == "gaussian":
        return eta
    return np.exp(np.clip(eta, -500, 50)) if family == "poisson" else 1 / (1 + np.exp(-np.clip(eta, -500, 500)))


def deviances(family: str, y: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """The deviance of each row."""
    if family == "gaussian":
        return (y - mu) ** 2
    if family == "poisson":
        return 2 * (np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / np.maximum(mu, 1e-300)), 0.0) - (y - mu))
    mu = np.clip(mu, 1e-12, 1 - 1e-12)
    return -2 * (y * np.log(mu) + (1 - y) * np.log1p(-mu))


def penalized_path(df: DataFrame, outcome: str, predictors: list[str], unit: str, *, family: str = "gaussian", alpha: float = 1.0, n_lambda: int = 30, ratio: float = 1e-3, lambdas: list[float] | None = None, folds: int = 5, seed: int = 0, steps: int = 40, tol: float = 1e-8) -> PenalizedPath:
    """Minimises -log-likelihood / n + lambda (alpha |b| + (1 - alpha) b'b / 2) over a path of lambdas.

    Predictors are scaled to variance 1 for the penalty.  The path falls from the least lambda
    without any predictor by ``ratio``.  Folds are hashes of ``unit``; 0 folds leave out the
    cross-validation.  Rows that lack a column are left out; a predictor without spread stays at 0.
    """
    if family not in ("gaussian", "binomial", "poisson"):
        raise ValueError(f"unknown family {family}")
    if not 0 < alpha <= 1 or folds == 1 or folds < 0:
        raise ValueError("alpha must be over 0 and at most 1, and folds 0 or more than one")
    num = lambda c: F.col(c).cast("double")
    p = len(predictors)
    fold = F.pmod(F.xxhash64(F.lit(seed), F.col(unit)), F.lit(max(folds, 1))).cast("double")
    rows = cut(df.select(num(outcome).alias("y"), fold.alias("f"), *(num(c).alias(f"x{i}") for i, c in enumerate(predictors))).na.drop())
    one = rows.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *(F.avg(f"x{i}").alias(f"m{i}") for i in range(p)), *(F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(p))).first()
    if not one["n"]:
        raise ValueError("there are no complete rows")
    centre, spread = (np.array([one[f"{k}{i}"] for i in range(p)]) for k in "ms")
    scale = np.where(spread > 0, spread, 1.0)
    start = one["y"] if family == "gaussian" else np.log(one["y"] / (1 - one["y"])) if family == "binomial" else np.log(one["y"])

    def split(m):
        return m[:, 0], m[:, 1].astype(int), np.column_stack([np.ones(len(m)), np.where(spread > 0, (m[:, 2:] - centre) / scale, 0.0)])

    if lambdas is None:

        def slope(m):
            y, _, x = split(m)
            return x.T @ (y - one["y"])

        top = np.abs(row_sums(rows, slope, p + 1)[1:]).max() / one["n"] / alpha
        grid = top * np.exp(np.linspace(0, np.log(ratio), n_lambda))
    else:
        grid = np.sort(np.asarray(lambdas, float))[::-1]
    # models: all rows first, then each fold left out, for every lambda
    left = np.repeat(np.arange(-1, folds if folds else 0), len(grid))
    penalty = np.tile(grid, len(left) // len(grid))
    beta = np.zeros((len(left), p + 1))
    beta[:, 0] = start
    size = (p + 1) * (p + 2) + 1
    live = np.arange(len(left))
    for _ in range(steps):

        def sums(m, live=live, beta=beta):
            y, f, x = split(m)
            out = np.empty((len(live), size))
            for at, k in enumerate(live):
                mu = _mean(family, x @ beta[k])
                w = mu if family == "poisson" else mu * (1 - mu) if family == "binomial" else np.ones(len(y))
                w, r, one = (np.where(f == left[k], 0.0, v) for v in (w, y - mu, np.ones(len(y))))
                out[at] = np.concatenate([x.T @ r, ((x * w[:, None]).T @ x).ravel(), [one.sum()]])
            return out.ravel()

        found = row_sums(rows, sums, len(live) * size).reshape(len(live), size)
        still = []
        for k, s in zip(live, found, strict=True):
            n, g, h = s[-1], s[: p + 1] / s[-1], s[p + 1 : -1].reshape(p + 1, p + 1) / s[-1]
            if not n:
                continue
            new = descend(h + 1e-12 * np.eye(p + 1), g, beta[k], penalty[k] * alpha, penalty[k] * (1 - alpha))
            move = new - beta[k]
            far = np.abs(move).max()
            beta[k] = beta[k] + move * min(1.0, 4.0 / far) if far else new
            if move @ h @ move > tol * 1e-2:
                still.append(k)
        live = np.array(still, int)
        if not len(live) or family == "gaussian":
            break

    def judged(m):
        y, f, x = split(m)
        out = np.empty((len(left), 2))
        for k in range(len(left)):
            seen = f == left[k] if left[k] >= 0 else np.ones(len(y), bool)
            out[k] = deviances(family, y[seen], _mean(family, x[seen] @ beta[k])).sum(), seen.sum()
        return out.ravel()

    dev = row_sums(rows, judged, 2 * len(left)).reshape(-1, len(grid), 2)
    mean = error = None
    if folds:
        n = dev[1:, 0, 1]
        each = dev[1:, :, 0] / np.maximum(n, 1)[:, None]
        share = n / n.sum()
        mean = share @ each
        error = np.sqrt(share @ (each - mean) ** 2 / (folds - 1))
    raw = beta[: len(grid)].copy()
    raw[:, 1:] /= scale
    raw[:, 0] -= raw[:, 1:] @ centre
    return PenalizedPath(["(Intercept)", *predictors], grid, raw, dev[0, :, 0] / one["n"], mean, error, family, alpha, predictors)
