"""Conditional logistic regression of matched sets, exact.

The likelihood of a set is that of its events among all choices of as many of its rows.
Sums over choices are built row by row, for all sets of a batch side by side, with first and
second derivatives; rows of a set lie together after one shuffle, and a Newton step is a
pass that returns a few sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.functions.dist import chi2_sf, norm_ppf
from quillstat.plans.ordered import cut


@dataclass
class ClogitFit:
    names: list[str]
    coefficients: np.ndarray
    covariance: np.ndarray
    loglik: tuple[float, float]
    score_test: float
    n: int  # rows of sets with events and others
    n_sets: int

    def tidy(self, level: float = 0.95, exponentiate: bool = False) -> list[dict]:
        """term, estimate, std_error, statistic, p_value and limits."""
        z = norm_ppf(1 - (1 - level) / 2)
        of = (lambda x: float(np.exp(x))) if exponentiate else float
        return [
            {"term": n, "estimate": of(b), "std_error": float(s), "statistic": float(b / s), "p_value": chi2_sf(float(b / s) ** 2, 1), "lower": of(b - z * s), "upper": of(b + z * s)}
            for n, b, s in zip(self.names, self.coefficients, np.sqrt(np.diag(self.covariance)), strict=True)
        ]


def choices(x: np.ndarray, eta: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log of the sum over choices of ``k`` rows of exp(sum of eta), mean, covariance of the chosen rows' sum) of each set.

    Rows of the sets stand one after the other; all sets take their next row at once.
    """
    starts, p, sets = np.cumsum(sizes) - sizes, x.shape[1], len(sizes)
    top = np.maximum.reduceat(eta, starts)
    phi, u, v = np.zeros((sets, k + 1)), np.zeros((sets, k + 1, p)), np.zeros((sets, k + 1, p, p))
    phi[:, 0] = 1.0
    scale = np.zeros(sets)
    for i in range(int(sizes.max())):
        on = np.flatnonzero(sizes > i)
        row = starts[on] + i
        r = np.exp(eta[row] - top[on])[:, None]
        z = x[row]
        a, b, c = phi[on, :-1], u[on, :-1], v[on, :-1]
        zb = z[:, None, :, None] * b[:, :, None, :]
        v[on, 1:] += r[:, :, None, None] * (c + zb + zb.swapaxes(2, 3) + a[:, :, None, None] * (z[:, :, None] * z[:, None, :])[:, None])
        u[on, 1:] += r[:, :, None] * (b + a[:, :, None] * z[:, None, :])
        phi[on, 1:] += r * a
        most = phi[on].max(1)
        far = on[most > 1e100]
        if len(far):
            by = phi[far].max(1)
            phi[far] /= by[:, None]
            u[far] /= by[:, None, None]
            v[far] /= by[:, None, None, None]
            scale[far] += np.log(by)
    mean = u[:, k] / phi[:, k, None]
    return np.log(phi[:, k]) + scale + k * top, mean, v[:, k] / phi[:, k, None, None] - mean[:, :, None] * mean[:, None, :]


def conditional_logit(df: DataFrame, outcome: str, predictors: list[str], strata: str, *, offset: str | None = None, steps: int = 30, tol: float = 1e-10) -> ClogitFit:
    """Fits by Newton steps, halved while they lose.

    Sets with only events or none carry nothing and are left out, as are rows that lack a
    column.  A set is one row of arrays, and its work grows with its rows times its events.
    """
    p = len(predictors)
    num = lambda c: F.col(c).cast("double")
    rows = df.select(F.col(strata).alias("g"), (num(outcome) > 0).cast("int").alias("e"), (num(offset) if offset else F.lit(0.0)).alias("o"), *(num(c).alias(f"x{i}") for i, c in enumerate(predictors))).na.drop()
    sets = rows.groupBy("g").agg(F.count("*").alias("n"), F.sum("e").alias("k"), *(F.sum(F.when(F.col("e") == 1, F.col(c))).alias(f"d{c}") for c in ("o", *(f"x{i}" for i in range(p)))), F.collect_list(F.struct("o", *(f"x{i}" for i in range(p)))).alias("rows"))
    sets = sets.where("k > 0 and k < n").select("n", "k", *(f"d{c}" for c in ("o", *(f"x{i}" for i in range(p)))), *(F.col(f"rows.{c}").alias(c) for c in ("o", *(f"x{i}" for i in range(p)))))
    sets = cut(sets)
    one = sets.agg(F.count("*").alias("sets"), F.sum("n").alias("n")).first()
    if not one["sets"]:
        raise ValueError("no set has both an event and another row")

    def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(batches):
            import pyarrow as pa

            total = np.zeros(1 + p + p * p)
            for b in batches:
                n, k = b.column("n").to_numpy(), b.column("k").to_numpy()
                for events in np.unique(k):
                    some = b.take(pa.array(np.flatnonzero(k == events)))
                    x = np.column_stack([some.column(f"x{i}").flatten().to_numpy() for i in range(p)])
                    eta = x @ beta + some.column("o").flatten().to_numpy()
                    log, mean, var = choices(x, eta, n[k == events], int(events))
                    own = np.column_stack([some.column(f"dx{i}").to_numpy() for i in range(p)])
                    total[0] += (own @ beta + some.column("do").to_numpy() - log).sum()
                    total[1 : 1 + p] += (own - mean).sum(0)
                    total[1 + p :] += var.sum(0).ravel()
            yield pa.RecordBatch.from_pydict({"v": [total.tolist()]}, schema=pa.schema([("v", pa.list_(pa.float64()))]))

        out = np.zeros(1 + p + p * p)
        for r in sets.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r["i"]] = r["v"]
        return out[0], out[1 : 1 + p], out[1 + p :].reshape(p, p)

    beta = np.zeros(p)
    value, u, h = at(beta)
    first, score = value, float(u @ np.linalg.solve(h, u))
    for _ in range(steps):
        move, scale = np.linalg.solve(h, u), 1.0
        new = at(beta + move)
        while not new[0] >= value - tol * (abs(value) + 0.1) and scale > 1e-6:
            scale /= 2
            new = at(beta + scale * move)
        done = abs(new[0] - value) <= tol * (abs(value) + 0.1)
        beta, (value, u, h) = beta + scale * move, new
        if done:
            break
    return ClogitFit(predictors, beta, np.linalg.inv(h), (float(first), float(value)), score, int(one["n"]), int(one["sets"]))
