"""Additive models of penalised smooths, whose smoothing is chosen by restricted likelihood.

All that is asked of the rows are sums of products of the model matrix: one pass for a
gaussian outcome, one for each weighted step otherwise.  The search over smoothing
parameters works on those sums alone, so its cost does not depend on the number of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.functions.dist import chi2_sf, f_sf
from quillstat.operators.splines import Spline, resolve
from quillstat.plans.newton import row_sums


@dataclass
class Smooth:
    """One smooth term: a cubic B-spline whose coefficients lie in the columns of ``free``, with mean 0 over the rows."""

    name: str
    spline: Spline
    free: np.ndarray
    penalty: np.ndarray

    def matrix(self, x: np.ndarray) -> np.ndarray:
        return self.spline.evaluate(x) @ self.free

    def column(self, coefficients: np.ndarray) -> Column:
        return sum((c * float(b) for c, b in zip(self.spline.columns(F.col(self.name)), self.free @ coefficients, strict=True)), F.lit(0.0))


def roughness(spline: Spline) -> np.ndarray:
    """Integrals of products of second derivatives, exact by two points on each interval."""
    left, whole = spline._polynomials()
    ends = np.append(left[1:-1], spline.boundary[1])
    power = np.arange(whole.shape[2])
    out = np.zeros((whole.shape[1],) * 2)
    for k in range(len(ends) - 1):
        wide = ends[k + 1] - ends[k]
        for z in (-1 / math.sqrt(3), 1 / math.sqrt(3)):
            s = wide * (1 + z) / 2
            d = whole[k + 1][:, 2:] @ ((power * (power - 1))[2:] * s ** (power[2:] - 2))
            out += wide / 2 * np.outer(d, d)
    return out


@dataclass
class GamFit:
    """Coefficients (linear terms first, then those of each smooth) with their Bayesian covariance."""

    names: list[str]
    coefficients: np.ndarray
    covariance: np.ndarray
    smooths: list[Smooth]
    places: list[slice]
    log_lambda: np.ndarray
    edf: dict[str, float]
    total_edf: float
    scale: float
    reml: float
    deviance: float
    n: int
    family: str
    linear: list[str]
    products: list[np.ndarray]  # of each smooth's columns, over the rows

    def predict(self, df: DataFrame, name: str = "fit", kind: str = "response") -> DataFrame:
        """``df`` with the prediction; null where a predictor is missing."""
        eta = F.lit(float(self.coefficients[0])) + sum((F.col(c).cast("double") * float(b) for c, b in zip(self.linear, self.coefficients[1:], strict=False)), F.lit(0.0))
        for s, at in zip(self.smooths, self.places, strict=True):
            eta = eta + s.column(self.coefficients[at])
        return df.withColumn(name, eta if kind == "link" or self.family == "gaussian" else F.exp(eta) if self.family == "poisson" else 1 / (1 + F.exp(-eta)))

    def smooth_at(self, name: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(effect, standard error) of a smooth at given values."""
        k = [s.name for s in self.smooths].index(name)
        m = self.smooths[k].matrix(np.asarray(x, float))
        return m @ self.coefficients[self.places[k]], np.sqrt(np.einsum("ij,jk,ik->i", m, self.covariance[self.places[k], self.places[k]], m))

    def tests(self) -> list[dict]:
        """Wald tests (term, edf, statistic, p_value) of the smooths' values at the rows, in as many directions as their rounded degrees of freedom."""
        out = []
        for s, at, xx in zip(self.smooths, self.places, self.products, strict=True):
            rank = max(1, round(self.edf[s.name]))
            root = np.linalg.cholesky(xx + 1e-12 * np.trace(xx) * np.eye(len(xx))).T
            size, axes = np.linalg.eigh(root @ self.covariance[at, at] @ root.T)
            keep = np.argsort(size)[::-1][:rank]
            stat = float(((axes[:, keep].T @ root @ self.coefficients[at]) ** 2 / size[keep]).sum())
            p = f_sf(stat / rank, rank, self.n - self.total_edf) if self.family == "gaussian" else chi2_sf(stat, rank)
            out.append({"term": s.name, "edf": self.edf[s.name], "statistic": stat / rank if self.family == "gaussian" else stat, "p_value": p})
        return out


def _weights(family: str, y: np.ndarray, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(weight, working response without offset, deviance)."""
    if family == "poisson":
        mu = np.exp(eta)
        dev = 2 * float((np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0.0) - (y - mu)).sum())
        return mu, eta + (y - mu) / mu, dev
    mu = 1 / (1 + np.exp(-eta))
    mu = np.clip(mu, 1e-12, 1 - 1e-12)
    w = mu * (1 - mu)
    return w, eta + (y - mu) / w, -2 * float((y * np.log(mu) + (1 - y) * np.log1p(-mu)).sum())


class _Criterion:
    """The restricted likelihood of a working model, from its sums of products."""

    def __init__(self, a: np.ndarray, b: np.ndarray, zz: float, n: int, blocks: list[tuple[slice, np.ndarray, int]], fixed: float | None) -> None:
        self.a, self.b, self.zz, self.n, self.blocks, self.fixed = a, b, zz, n, blocks, fixed
        self.null = len(b) - sum(r for _, _, r in blocks)

    def penalised(self, rho: np.ndarray) -> np.ndarray:
        out = self.a.copy()
        for r, (at, s, _) in zip(rho, self.blocks, strict=True):
            out[at, at] += math.exp(r) * s
        return out

    def value(self, rho: np.ndarray) -> float:
        """Minus the logarithm, but for constants."""
        m = self.penalised(rho)
        root = np.linalg.cholesky(m + 1e-12 * np.trace(m) / len(m) * np.eye(len(m)))
        half = np.linalg.solve(root, self.b)
        rest = max(self.zz - float(half @ half), 1e-300)
        logs = 2 * np.log(np.diag(root)).sum() - sum(k * r for r, (_, _, k) in zip(rho, self.blocks, strict=True))
        if self.fixed is not None:
            return (rest / self.fixed + logs) / 2
        free = self.n - self.null
        return (free * math.log(rest / free) + logs) / 2

    def best(self, rho: np.ndarray, low: float = -15.0, high: float = 20.0) -> np.ndarray:
        """The minimum: golden sections along one parameter after the other until none moves."""
        rho = rho.copy()
        g = (math.sqrt(5) - 1) / 2
        width = high - low
        for _ in range(60):
            before = rho.copy()
            for k in range(len(rho)):
                a, b = max(low, rho[k] - width), min(high, rho[k] + width)

                def at(v, k=k):
                    return self.value(np.concatenate([rho[:k], [v], rho[k + 1 :]]))

                if width == high - low:  # first find the valley among several
                    grid = np.linspace(a, b, 36)
                    j = int(np.argmin([at(v) for v in grid]))
                    a, b = grid[max(j - 1, 0)], grid[min(j + 1, 35)]
                c, d = b - g * (b - a), a + g * (b - a)
                fc, fd = at(c), at(d)
                while b - a > 1e-5:
                    if fc <= fd:
                        b, d, fd = d, c, fc
                        c = b - g * (b - a)
                        fc = at(c)
                    else:
                        a, c, fc = c, d, fd
                        d = a + g * (b - a)
                        fd = at(d)
                rho[k] = (a + b) / 2
            width = max(4 * float(np.abs(rho - before).max()), 1e-3) if width != high - low else 4.0
            if np.abs(rho - before).max() < 1e-4:
                break
        return rho


def fit_gam(df: DataFrame, outcome: str, smooths: dict[str, int], linear: list[str] | None = None, *, family: str = "gaussian", offset: str | None = None, steps: int = 40, tol: float = 1e-8) -> GamFit:
    """Fits outcome ~ linear terms + a smooth of ``k`` functions for each (column, k) of ``smooths``.

    Inner knots are exact quantiles.  Families: gaussian, binomial (0 or 1) and poisson; the latter
    two choose the smoothing anew at each weighted step.  Rows that lack a column are left out.
    """
    if family not in ("gaussian", "binomial", "poisson"):
        raise ValueError(f"unknown family {family}")
    if not smooths or min(smooths.values()) < 4:
        raise ValueError("a smooth needs at least 4 functions")
    linear = list(linear or [])
    num = lambda c: F.col(c).cast("double")
    rows = df.select(num(outcome).alias("y"), (num(offset) if offset else F.lit(0.0)).alias("o"), *(num(c).alias(f"l{i}") for i, c in enumerate(linear)), *(num(c).alias(f"s{i}") for i, c in enumerate(smooths))).na.drop()
    kept = df.where(" and ".join(f"`{c}` is not null" for c in [outcome, *linear, *smooths, *([offset] if offset else [])]))
    bases = [resolve(kept, c, "bs", df_columns=k, intercept=True) for c, k in smooths.items()]
    q = len(linear)
    k = [len(b.knots) + 4 for b in bases]

    def means(m):
        return np.concatenate([[len(m)], *(b.evaluate(m[:, 2 + q + i]).sum(0) for i, b in enumerate(bases))])

    first = row_sums(rows, means, 1 + sum(k))
    n, at, terms = int(first[0]), 1, []
    for (name, _), b, size in zip(smooths.items(), bases, k, strict=True):
        side, _ = np.linalg.qr(first[at : at + size, None], mode="complete")
        terms.append(Smooth(name, b, side[:, 1:], side[:, 1:].T @ roughness(b) @ side[:, 1:]))
        at += size
    ends = np.cumsum([1 + q, *(size - 1 for size in k)])
    places = [slice(int(a), int(b)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    p = int(ends[-1])

    def matrix(m):
        return np.column_stack([np.ones(len(m)), m[:, 2 : 2 + q], *(s.matrix(m[:, 2 + q + i]) for i, s in enumerate(terms))])

    def sums(beta):
        def f(m):
            x, y, o = matrix(m), m[:, 0], m[:, 1]
            if family == "gaussian":
                w, z, dev = np.ones(len(m)), y - o, 0.0
            else:
                w, z, dev = _weights(family, y, (x @ beta if beta is not None else np.full(len(m), start)) + o)
                z = z - o
            return np.concatenate([((x * w[:, None]).T @ x).ravel(), x.T @ (w * z), [w @ (z * z), dev]])

        out = row_sums(rows, f, p * p + p + 2)
        return out[: p * p].reshape(p, p), out[p * p : -2], float(out[-2]), float(out[-1])

    start = 0.0
    if family != "gaussian":
        mean = rows.agg(F.avg("y")).first()[0]
        start = math.log(mean) if family == "poisson" else math.log(mean / (1 - mean))
    # penalties are brought to the size of the products, so that their parameters start from 0
    a, b, zz, dev = sums(None)
    blocks = []
    for s, at in zip(terms, places, strict=True):
        s.penalty = s.penalty * (np.trace(a[at, at]) / np.trace(s.penalty))
        blocks.append((at, s.penalty, int(np.linalg.matrix_rank(s.penalty, tol=1e-9 * np.abs(s.penalty).max()))))
    rho, beta, last = np.zeros(len(terms)), None, None
    for _ in range(steps):
        found = _Criterion(a, b, zz, n, blocks, None if family == "gaussian" else 1.0)
        rho = found.best(rho)
        beta = np.linalg.solve(found.penalised(rho), b)
        if family == "gaussian":
            break
        a, b, zz, dev = sums(beta)
        whole = dev + sum(math.exp(r) * float(beta[at] @ s @ beta[at]) for r, (at, s, _) in zip(rho, blocks, strict=True))
        if last is not None and abs(whole - last) < tol * (abs(whole) + 1):
            break
        last = whole
    found = _Criterion(a, b, zz, n, blocks, None if family == "gaussian" else 1.0)
    inverse = np.linalg.inv(found.penalised(rho))
    share = np.diag(inverse @ a)
    rest = zz - 2 * float(beta @ b) + float(beta @ a @ beta)
    scale = rest / (n - share.sum()) if family == "gaussian" else 1.0
    names = ["(Intercept)", *linear, *(f"s({s.name}).{j + 1}" for s, at in zip(terms, places, strict=True) for j in range(at.stop - at.start))]
    edf = {s.name: float(share[at].sum()) for s, at in zip(terms, places, strict=True)}
    return GamFit(names, beta, inverse * scale, terms, places, rho, edf, float(share.sum()), float(scale), found.value(rho), rest if family == "gaussian" else dev, n, family, linear, [a[at, at] for at in places])
