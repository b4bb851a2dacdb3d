"""Generalized linear mixed models with a random intercept: binomial or Poisson, by Laplace's
approximation or adaptive Gauss-Hermite quadrature.

Rows stay where they are.  A pass adds up what a group's likelihood needs (residuals, weights
and their products with the predictors), with partial sums before the shuffle, so a group
may hold any share of the rows.  Passes of Newton's method move the modes of all
groups at once; the outer search over the coefficients and the standard deviation starts each
time from the modes before.  The table of modes has one row a group and is joined by
broadcast where it is small.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.functions.dist import chi2_sf, norm_ppf
from quillstat.plans.newton import row_sums
from quillstat.plans.ordered import ONE_TASK, cut


@dataclass
class GlmmFit:
    """Coefficients (the intercept first), their covariance, the standard deviation of the groups, and their modes (group, mode, sd)."""

    names: list[str]
    coefficients: np.ndarray
    covariance: np.ndarray
    sd: float
    sd_error: float  # of its logarithm
    loglik: float
    n: int
    n_groups: int
    modes: DataFrame
    family: str
    evaluations: int

    def tidy(self, level: float = 0.95, exponentiate: bool = False) -> list[dict]:
        z = norm_ppf(1 - (1 - level) / 2)
        of = (lambda x: float(np.exp(x))) if exponentiate else float
        return [
            {"term": n, "estimate": of(b), "std_error": float(s), "statistic": float(b / s), "p_value": chi2_sf(float(b / s) ** 2, 1), "lower": of(b - z * s), "upper": of(b + z * s)}
            for n, b, s in zip(self.names, self.coefficients, np.sqrt(np.diag(self.covariance)), strict=True)
        ]

    def median_odds_ratio(self) -> float:
        """The median ratio of odds (or rates) between the higher and the lower of two groups."""
        return math.exp(math.sqrt(2.0) * self.sd * norm_ppf(0.75))

    def icc(self) -> float:
        """The groups' share of the variance on the scale of the logit."""
        if self.family != "binomial":
            raise ValueError("the share of variance is that of a binomial model")
        return self.sd**2 / (self.sd**2 + math.pi**2 / 3)

    def aic(self) -> float:
        return 2 * (len(self.coefficients) + 1) - 2 * self.loglik


def nodes(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and logarithms of weights times exp(z^2) of Gauss-Hermite quadrature."""
    z, w = np.polynomial.hermite.hermgauss(k)
    return z, np.log(w) + z * z


class _Model:
    def __init__(self, rows: DataFrame, groups: DataFrame, p: int, family: str, n_agq: int) -> None:
        self.rows, self.groups, self.p, self.family, self.n_agq = rows, groups, p, family, n_agq
        self.n_groups = groups.count()
        self.modes = groups.select("g", F.lit(0.0).alias("u"))
        self.evaluations = 0

    def _eta(self, beta: np.ndarray) -> Column:
        # an array keeps the text of the generated code the same for all coefficients
        b = F.array(*(F.lit(float(v)) for v in beta))
        return F.col("o") + sum((F.get(b, F.lit(i)) * F.col(f"x{i}") for i in range(self.p)), F.lit(0.0))

    def _parts(self, eta: Column) -> tuple[Column, Column, Column, Column]:
        """Log-likelihood, residual, weight, and derivative of the weight, of a row."""
        if self.family == "poisson":
            mu = F.exp(eta)
            return F.col("y") * eta - mu - F.col("lgamma"), F.col("y") - mu, mu, mu
        mu = 1 / (1 + F.exp(-eta))
        soft = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))
        w = F.col("size") * mu * (1 - mu)
        return F.col("y") * eta - F.col("size") * soft + F.col("lgamma"), F.col("y") - F.col("size") * mu, w, w * (1 - 2 * mu)

    def _joined(self, beta: np.ndarray) -> DataFrame:
        modes = F.broadcast(self.modes) if self.n_groups <= ONE_TASK else self.modes
        return self.rows.join(modes, "g").withColumn("eta", self._eta(beta) + F.col("u"))

    def settle(self, beta: np.ndarray, var: float, tol: float = 1e-5) -> None:
        """Moves all modes to the maxima of their groups' likelihoods; what is left after a step is about its square."""
        for _ in range(60):
            _, r, w, _ = self._parts(F.col("eta"))
            each = self._joined(beta).groupBy("g").agg(F.first("u").alias("u"), F.sum(r).alias("r"), F.sum(w).alias("w"))
            move = (F.col("r") - F.col("u") / F.lit(var)) / (F.col("w") + F.lit(1.0 / var))
            # far from the maximum steps are bounded
            each = cut(each.withColumn("move", F.greatest(F.least(move, F.lit(3.0)), F.lit(-3.0))).select("g", (F.col("u") + F.col("move")).alias("u"), "move"))
            self.modes = each.select("g", "u")
            if each.agg(F.max(F.abs("move"))).first()[0] <= tol:
                return

    def value(self, point: np.ndarray) -> tuple[float, np.ndarray]:
        """The approximate log-likelihood at (coefficients, log sd), and its gradient."""
        self.evaluations += 1
        beta, var = point[:-1], math.exp(2 * point[-1])
        self.settle(beta, var)
        return self._laplace(beta, var) if self.n_agq == 1 else self._quadrature(beta, var)

    def _laplace(self, beta: np.ndarray, var: float) -> tuple[float, np.ndarray]:
        ll, r, w, dw = self._parts(F.col("eta"))
        p = self.p
        x = [F.col(f"x{i}") for i in range(p)]
        each = self._joined(beta).groupBy("g").agg(
            F.first("u").alias("u"), F.sum(ll).alias("ll"), F.sum(w).alias("w"), F.sum(dw).alias("dw"), *(F.sum(r * x[i]).alias(f"r{i}") for i in range(p)), *(F.sum(w * x[i]).alias(f"w{i}") for i in range(p)), *(F.sum(dw * x[i]).alias(f"d{i}") for i in range(p))
        )
        h, u = F.col("w") + F.lit(1.0 / var), F.col("u")
        value = F.col("ll") - u * u / F.lit(2 * var) - 0.5 * F.log(F.lit(var) * h)
        slopes = [F.col(f"r{i}") - 0.5 / h * (F.col(f"d{i}") - F.col("dw") * F.col(f"w{i}") / h) for i in range(p)]
        # by the variance, at the mode and through it; twice the variance makes it the slope by the log sd
        by_var = u * u / F.lit(2 * var * var) - F.lit(0.5 / var) + 0.5 / (F.lit(var * var) * h) - 0.5 * F.col("dw") / h * u / (F.lit(var * var) * h)
        out = each.agg(F.sum(value).alias("v"), *(F.sum(s).alias(f"g{i}") for i, s in enumerate(slopes)), F.sum(by_var).alias("gv")).first()
        return out["v"], np.array([*(out[f"g{i}"] for i in range(p)), 2 * var * out["gv"]])

    def _quadrature(self, beta: np.ndarray, var: float) -> tuple[float, np.ndarray]:
        z, lw = nodes(self.n_agq)
        p, k = self.p, range(self.n_agq)
        _, _, w, _ = self._parts(F.col("eta"))
        curved = self._joined(beta).groupBy("g").agg(F.first("u").alias("u"), F.sum(w).alias("w"))
        scale = cut(curved.select("g", "u", (math.sqrt(2.0) / F.sqrt(F.col("w") + F.lit(1.0 / var))).alias("s")))
        rows = self.rows.join(F.broadcast(scale) if self.n_groups <= ONE_TASK else scale, "g").withColumn("base", self._eta(beta))
        aggs = [F.first("u").alias("u"), F.first("s").alias("s")]
        for q in k:
            ll, r, _, _ = self._parts(F.col("base") + F.col("u") + F.col("s") * float(z[q]))
            aggs += [F.sum(ll).alias(f"l{q}"), *(F.sum(r * F.col(f"x{i}")).alias(f"r{q}_{i}") for i in range(p))]
        each = rows.groupBy("g").agg(*aggs)
        at = [F.col("u") + F.col("s") * float(z[q]) for q in k]
        each = each.withColumns({f"t{q}": F.col(f"l{q}") - at[q] * at[q] / F.lit(2 * var) + float(lw[q]) for q in k})
        top = F.greatest(*(f"t{q}" for q in k))
        each = each.withColumn("top", top).withColumns({f"e{q}": F.exp(F.col(f"t{q}") - top) for q in k}).withColumn("sum", sum((F.exp(F.col(f"t{q}") - top) for q in k), F.lit(0.0)))
        value = F.col("top") + F.log("sum") + F.log("s") - 0.5 * math.log(2 * math.pi * var)
        # slopes by the nodes' shares of the integral
        slopes = [sum((F.col(f"e{q}") * F.col(f"r{q}_{i}") for q in k), F.lit(0.0)) / F.col("sum") for i in range(p)]
        by_sd = sum((F.col(f"e{q}") * (at[q] * at[q] / F.lit(var) - 1) for q in k), F.lit(0.0)) / F.col("sum")
        out = each.agg(F.sum(value).alias("v"), *(F.sum(s).alias(f"g{i}") for i, s in enumerate(slopes)), F.sum(by_sd).alias("gv")).first()
        return out["v"], np.array([*(out[f"g{i}"] for i in range(p)), out["gv"]])


def _plain(rows: DataFrame, p: int, family: str) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients without groups, and their information."""

    def sums(beta):
        def f(m):
            x, y, o, size = m[:, 3:], m[:, 0], m[:, 1], m[:, 2]
            eta = x @ beta + o
            mu = np.exp(eta) if family == "poisson" else size / (1 + np.exp(-eta))
            w = mu if family == "poisson" else mu * (1 - mu / size)
            return np.concatenate([x.T @ (y - mu), ((x * w[:, None]).T @ x).ravel()])

        out = row_sums(rows.select("y", "o", "size", *(f"x{i}" for i in range(p))), f, p + p * p)
        return out[:p], out[p:].reshape(p, p)

    beta = np.zeros(p)
    for _ in range(30):
        u, h = sums(beta)
        move = np.linalg.solve(h, u)
        beta = beta + move * min(1.0, 3.0 / max(np.abs(move).max(), 1e-300))
        if np.abs(move).max() < 1e-7:
            break
    return beta, h


def fit_glmm(df: DataFrame, outcome: str, predictors: list[str], group: str, *, family: str = "binomial", n_agq: int = 1, offset: str | None = None, trials: str | None = None, steps: int = 60, tol: float = 1e-7) -> GlmmFit:
    """Fits outcome ~ predictors + (1 | group); ``n_agq`` 1 is Laplace's approximation.

    A binomial outcome is 0 or 1, or a number of successes of ``trials``.  Rows that lack a
    column are left out.  The search is quasi-Newton with the information of the model without
    groups as its start; errors come from differences of slopes at the maximum.
    """
    if family not in ("binomial", "poisson"):
        raise ValueError("family must be binomial or poisson")
    if n_agq < 1:
        raise ValueError("n_agq must be at least 1")
    num = lambda c: F.col(c).cast("double")
    p = len(predictors) + 1
    x = df.select(F.col(group).alias("g"), num(outcome).alias("y"), (num(offset) if offset else F.lit(0.0)).alias("o"), (num(trials) if trials else F.lit(1.0)).alias("size"), F.lit(1.0).alias("x0"), *(num(c).alias(f"x{i}") for i, c in enumerate(predictors, 1))).na.drop()
    constant = _log_factorial(F.col("y")) if family == "poisson" else _log_factorial(F.col("size")) - _log_factorial(F.col("y")) - _log_factorial(F.col("size") - F.col("y"))
    x = cut(x.withColumn("lgamma", constant))
    one = x.agg(F.count("*").alias("n"), F.count_if((F.col("y") < 0) | (F.col("y") > F.col("size"))).alias("out"), F.count_if(F.col("y") < 0).alias("neg")).first()
    if one["neg"] or (family == "binomial" and one["out"]):
        raise ValueError("the outcome is out of the family's range")
    if not one["n"]:
        raise ValueError("there are no complete rows")
    model = _Model(x, cut(x.select("g").distinct()), p, family, n_agq)
    beta, h = _plain(x, p, family)
    point = np.append(beta, math.log(0.5))
    inverse = np.zeros((p + 1, p + 1))
    inverse[:p, :p], inverse[p, p] = np.linalg.inv(h), 1.0 / max(4.0, model.n_groups / 4)
    value, g = model.value(point)
    for _ in range(steps):
        move = inverse @ g
        move *= min(1.0, 2.0 / max(np.abs(move).max(), 1e-300))
        if abs(g @ move) < tol * (abs(value) + 1) * 1e-3:
            break
        scale = 1.0
        while True:
            new = model.value(point + scale * move)
            if new[0] >= value + 1e-4 * scale * (g @ move) or scale < 1e-4:
                break
            scale /= 2
        if new[0] < value:
            break
        s, d = scale * move, g - new[1]  # the information times s, about
        if s @ d > 1e-12:
            hd = inverse @ d
            inverse = inverse + (1 + d @ hd / (s @ d)) * np.outer(s, s) / (s @ d) - (np.outer(hd, s) + np.outer(s, hd)) / (s @ d)
        gain = new[0] - value
        point, (value, g) = point + s, new
        if gain < tol * 1e-2 * (abs(value) + 1) and np.abs(g @ inverse @ g) < tol * (abs(value) + 1):
            break
        if point[-1] < -9:  # no variance between groups
            break
    info = np.zeros((p + 1, p + 1))
    free = p + 1 if point[-1] > -7 else p
    for k in range(free):
        step = np.zeros(p + 1)
        step[k] = 1e-4 * max(1.0, math.sqrt(max(inverse[k, k], 0.0)) if inverse[k, k] > 0 else 1.0)
        info[k] = (model.value(point - step)[1] - model.value(point + step)[1]) / (2 * step[k])
    info = (info + info.T) / 2
    v = np.linalg.inv(info[:free, :free])
    value, _ = model.value(point)
    var = math.exp(2 * point[-1])
    _, _, w, _ = model._parts(F.col("eta"))
    modes = model._joined(point[:-1]).groupBy("g").agg(F.first("u").alias("mode"), F.sum(w).alias("w")).select(F.col("g").alias("group"), "mode", (1 / F.sqrt(F.col("w") + 1.0 / var)).alias("sd"))
    return GlmmFit(["(Intercept)", *predictors], point[:-1], v[:p, :p], math.exp(point[-1]), float(math.sqrt(v[p, p])) if free > p else math.nan, float(value), int(one["n"]), model.n_groups, cut(modes), family, model.evaluations)


def _log_factorial(k: Column) -> Column:
    """log(k!): a sum up to 20, Stirling's series beyond."""
    x = F.greatest(k, F.lit(20.0)) + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, 5))
    exact = F.get(F.array(*(F.lit(math.lgamma(i + 1)) for i in range(21))), k.cast("int"))
    return F.when((k >= 0) & (k <= 20) & (k == F.floor(k)), exact).otherwise(series)
