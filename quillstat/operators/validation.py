"""Bootstrap of linear and logistic models: covariance of the coefficients, and optimism of their fit.

A row's weight in a replicate is a Poisson draw from a hash of seed, replicate and unit (or
cluster), so nothing is resampled or moved, replicates do not depend on how rows are
partitioned, and all of them are fitted from the same passes: a task sums what every
replicate needs of its batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.operators.regression import design
from quillstat.plans.newton import row_sums
from quillstat.plans.ordered import cut

_POISSON = np.cumsum([np.exp(-1.0) / f for f in (1.0, 1.0, 2.0, 6.0, 24.0, 120.0, 720.0, 5040.0, 40320.0, 362880.0)])


def replicate_weights(key: np.ndarray, replicate: int) -> np.ndarray:
    """Poisson weights of mean 1 from 64-bit keys: a mixed key as a number in [0, 1), by the distribution's steps."""
    with np.errstate(over="ignore"):
        z = key.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(replicate + 1)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
    z ^= z >> np.uint64(31)
    return np.searchsorted(_POISSON, (z >> np.uint64(11)).astype(np.float64) / 2.0**53, "right").astype(np.float64)


@dataclass
class Bootstrap:
    """Estimates on all rows, and of every replicate."""

    names: list[str]
    estimate: np.ndarray
    replicates: np.ndarray

    @property
    def covariance(self) -> np.ndarray:
        return np.atleast_2d(np.cov(self.replicates, rowvar=False))

    def limits(self, level: float = 0.95) -> np.ndarray:
        """Percentile limits of each coefficient."""
        return np.quantile(self.replicates, [(1 - level) / 2, (1 + level) / 2], axis=0).T


class _Data:
    """Rows (key, y, x...) of a model, and sums over them for each replicate."""

    def __init__(self, df: DataFrame, formula: str, unit: str, seed: int) -> None:
        d = design(formula, df)
        self.names, self.p = d.names, len(d.names)
        y = d.response - d.offset if d.offset is not None else d.response
        rows = df.select(F.xxhash64(F.lit(seed), F.col(unit)).alias("key"), y.alias("y"), *(c.alias(f"x{i}") for i, c in enumerate(d.columns)))
        # a hash does not fit into a double, so it travels in two halves
        low = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))
        self.rows = cut(rows.na.drop().select(low.cast("double").alias("low"), F.shiftrightunsigned("key", 32).cast("double").alias("high"), "y", *(f"x{i}" for i in range(self.p))))

    def sums(self, each, size: int, b: int) -> np.ndarray:
        """``each(x, y, w, replicate)`` summed over rows: by replicate, those with weights, and last with weights of 1."""

        def f(m):
            key = m[:, 0].astype(np.uint64) | (m[:, 1].astype(np.uint64) << np.uint64(32))
            x, y = m[:, 3:], m[:, 2]
            return np.concatenate([each(x, y, replicate_weights(key, k) if k < b else np.ones(len(y)), k) for k in range(b + 1)])

        return row_sums(self.rows, f, (b + 1) * size).reshape(b + 1, size)

    def fits(self, family: str, b: int, of=lambda x, k: x, p: int | None = None, weighted: bool = True) -> np.ndarray:
        """Coefficients of every replicate, and last of all rows; ``of`` makes the predictors of a replicate from the rows'."""
        p = self.p if p is None else p
        beta = np.zeros((b + 1, p))
        for _ in range(1 if family == "gaussian" else 30):

            def each(x, y, w, k, beta=beta):
                x, w = of(x, k), w if weighted else np.ones(len(y))
                if family == "gaussian":
                    v, r = w, w * (y - x @ beta[k])
                else:
                    mu = 1 / (1 + np.exp(-np.clip(x @ beta[k], -500, 500)))
                    v, r = w * mu * (1 - mu), w * (y - mu)
                return np.concatenate([x.T @ r, ((x * v[:, None]).T @ x).ravel()])

            out = self.sums(each, p + p * p, b)
            move = np.array([np.linalg.pinv(h.reshape(p, p), hermitian=True) @ g for g, h in zip(out[:, :p], out[:, p:], strict=True)])
            move *= np.minimum(1.0, 5.0 / np.maximum(np.abs(move).max(axis=1, keepdims=True), 1e-300))
            beta = beta + move
            if np.abs(move).max() < 1e-8:
                break
        return beta


def _checked(family: str, b: int) -> None:
    if family not in ("gaussian", "binomial"):
        raise ValueError("family must be gaussian or binomial")
    if b < 2:
        raise ValueError("at least two replicates are needed")


def bootstrap(df: DataFrame, formula: str, unit: str, *, family: str = "gaussian", b: int = 200, seed: int = 0) -> Bootstrap:
    """Replicates of a model's coefficients.

    ``unit`` names what is drawn: rows, or clusters, whose rows then share their weight.  Rows that
    lack a column of the model are left out; b replicates of p coefficients are p*p numbers each a task.
    """
    _checked(family, b)
    data = _Data(df, formula, unit, seed)
    beta = data.fits(family, b)
    return Bootstrap(data.names, beta[-1], beta[:-1])


def validate(df: DataFrame, formula: str, unit: str, *, family: str = "gaussian", b: int = 40, seed: int = 0) -> list[dict]:
    """Indexes of fit (index, original, training, test, optimism, corrected) by the bootstrap.

    A replicate's model is judged on its own weighted rows (training) and on all rows as they
    are (test); the mean difference is taken from the original.  Gaussian: r2, mse, intercept and
    slope of the calibration line; binomial: brier, and intercept and slope of the logistic calibration.
    """
    _checked(family, b)
    data = _Data(df, formula, unit, seed)
    beta = data.fits(family, b)

    def fitted(x, k):
        eta = x @ beta[k]
        return eta if family == "gaussian" else 1 / (1 + np.exp(-eta))

    def each(x, y, w, k):
        f = fitted(x, k)
        return np.array([v for u in (w, np.ones(len(y))) for v in (u.sum(), u @ y, u @ (y * y), u @ (y - f) ** 2)])

    out = data.sums(each, 8, b)
    lines = data.fits(family, b, of=lambda x, k: np.column_stack([np.ones(len(x)), x @ beta[k]]), p=2, weighted=False)

    def indexes(s, line):
        n, sy, syy, rest = s
        error = {"mse": rest / n, "r2": 1 - rest / (syy - sy * sy / n)} if family == "gaussian" else {"brier": rest / n}
        return error | {"intercept": line[0], "slope": line[1]}

    straight = np.array([0.0, 1.0])  # a model's line on the rows it was fitted to
    original = indexes(out[-1, 4:], straight)
    training = [indexes(s[:4], straight) for s in out[:-1]]
    test = [indexes(s[4:], line) for s, line in zip(out[:-1], lines[:-1], strict=True)]
    table = []
    for name, value in original.items():
        a, t = float(np.mean([r[name] for r in training])), float(np.mean([r[name] for r in test]))
        table.append({"index": name, "original": float(value), "training": a, "test": t, "optimism": a - t, "corrected": float(value) - (a - t)})
    return table
