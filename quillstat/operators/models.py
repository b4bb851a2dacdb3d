"""Further regression models: Firth, multinomial, ordinal, elastic net, survival times, risk ratios, random intercepts."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.functions.dist import norm_cdf, norm_ppf
from quillstat.operators.regression import Fit, _gram, _matrix, design, fit_glm, hc_covariance
from quillstat.plans.newton import maximise


@dataclass
class Estimates:
    names: list[str]
    coef: np.ndarray
    cov: np.ndarray
    loglik: float

    def tidy(self, spark, *, level: float = 0.95, exponentiate: bool = False) -> DataFrame:
        q, g = norm_ppf(1 - (1 - level) / 2), math.exp if exponentiate else float
        rows = [(n, g(b), float(s), float(b / s), 2 * norm_cdf(-abs(b / s)), g(b - q * s), g(b + q * s)) for n, b, s in zip(self.names, self.coef, np.sqrt(np.diag(self.cov)), strict=True)]
        return spark.createDataFrame(rows, "term string, estimate double, std_error double, statistic double, p_value double, conf_low double, conf_high double")


def _held(rows: DataFrame, *how):
    """:func:`maximise` over cached rows, which are let go after it."""
    rows = rows.persist()
    try:
        return maximise(rows, *how)
    finally:
        rows.unpersist()


def fit_risk_ratio(df: DataFrame, formula: str) -> tuple[Fit, np.ndarray]:
    """Modified Poisson: the fit and its robust covariance, for ratios of risks."""
    fit = fit_glm(df, formula, "poisson")
    return fit, hc_covariance(fit, "HC0")


def fit_firth(df: DataFrame, formula: str, steps: int = 50, tol: float = 1e-8) -> Estimates:
    """Logistic regression with Jeffreys' penalty: finite estimates under separation."""
    d = design(formula, df)
    m, p = _matrix(df, d, None).persist(), len(d.names)
    x, y = [F.col(f"x{i}") for i in range(p)], F.col("y")
    beta = np.zeros(p)
    for _ in range(steps):
        eta = sum((F.lit(float(b)) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0)) + F.col("o")
        mu = 1 / (1 + F.exp(-eta))
        w = mu * (1 - mu)
        info, _, _ = _gram(m, p, w, F.lit(0.0), {})
        inv = np.linalg.inv(info)
        h = w * sum((F.lit(float(inv[i, j])) * x[i] * x[j] for i in range(p) for j in range(p)), F.lit(0.0))
        out = m.agg(*(F.sum((y - mu + h * (0.5 - mu)) * x[i]).alias(f"u{i}") for i in range(p)), F.sum(y * eta - F.log1p(F.exp(eta))).alias("ll")).first()
        move = inv @ np.array([out[f"u{i}"] for i in range(p)])
        move *= min(1.0, 5.0 / max(1e-12, np.abs(move).max()))
        beta = beta + move
        if np.abs(move).max() < tol:
            break
    m.unpersist()
    return Estimates(d.names, beta, inv, out["ll"] + 0.5 * float(np.linalg.slogdet(info)[1]))


def _rows(df: DataFrame, formula: str, drop_intercept: bool = False):
    """Matrix of x0.. and the response as a text column, for responses of several levels."""
    left, right = (s.strip() for s in formula.split("~"))
    d = design("~ " + right, df)
    keep = [i for i, n in enumerate(d.names) if not (drop_intercept and n == "(Intercept)")]
    have = df.where(F.col(left).isNotNull())
    for c in d.reads:
        have = have.where(F.col(c).isNotNull())
    return [d.names[i] for i in keep], have.select(*(d.columns[i].alias(f"x{k}") for k, i in enumerate(keep)), F.col(left).alias("y"))


def _coded(rows: DataFrame, levels: list | None) -> tuple[list, DataFrame]:
    levels = levels or [r[0] for r in rows.select("y").distinct().orderBy("y").collect()]
    code = F.array_position(F.array(*map(F.lit, levels)), F.col("y")) - 1
    return levels, rows.where(code >= 0).withColumn("y", code.cast("double"))


def multinomial_regression(df: DataFrame, formula: str, levels: list | None = None) -> Estimates:
    """Baseline-category logits against the first level."""
    names, rows = _rows(df, formula)
    levels, rows = _coded(rows, levels)
    p, k = len(names), len(levels) - 1

    def probs(m, b):
        z = np.c_[np.zeros(len(m)), m[:, :p] @ b.reshape(k, p).T]
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(1, keepdims=True)

    def loglik(m, b):
        return float(np.log(probs(m, b)[np.arange(len(m)), m[:, p].astype(int)]).sum())

    def gradient(m, b):
        r = -probs(m, b)
        r[np.arange(len(m)), m[:, p].astype(int)] += 1
        return (r[:, 1:].T @ m[:, :p]).ravel()

    coef, cov, ll = _held(rows, loglik, gradient, np.zeros(p * k))
    return Estimates([f"{lv}:{n}" for lv in levels[1:] for n in names], coef, cov, ll)


def ordinal_regression(df: DataFrame, formula: str, levels: list | None = None) -> Estimates:
    """Proportional odds: slopes, then thresholds (of P(Y <= level))."""
    names, rows = _rows(df, formula, drop_intercept=True)
    levels, rows = _coded(rows, levels)
    p, k = len(names), len(levels) - 1
    share = rows.groupBy("y").count().orderBy("y").collect()
    cum = np.cumsum([r["count"] for r in share])[:-1] / sum(r["count"] for r in share)

    def parts(m, b):
        cuts = np.r_[-np.inf, b[p:], np.inf]
        eta, y = m[:, :p] @ b[:p], m[:, p].astype(int)
        f = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        hi, lo = f(cuts[y + 1] - eta), f(cuts[y] - eta)
        return y, hi, lo, np.maximum(hi - lo, 1e-300)

    def loglik(m, b):
        return float(np.log(parts(m, b)[3]).sum())

    def gradient(m, b):
        y, hi, lo, pr = parts(m, b)
        dh, dl = hi * (1 - hi) / pr, lo * (1 - lo) / pr
        g = np.zeros(p + k)
        g[:p] = -((dh - dl) @ m[:, :p])
        g[p:] += np.bincount(y, dh, k + 1)[:k] - np.bincount(y, dl, k + 1)[1:]
        return g

    coef, cov, ll = _held(rows, loglik, gradient, np.r_[np.zeros(p), np.log(cum / (1 - cum))])
    return Estimates(names + [f"{a}|{b}" for a, b in zip(levels, levels[1:], strict=False)], coef, cov, ll)


def accelerated_failure(df: DataFrame, time: str, event: str, predictors: str, dist: str = "weibull") -> Estimates:
    """Log-linear survival times with Weibull, exponential or lognormal errors; last the log of the scale."""
    d = design("~ " + predictors, df)
    p = len(d.names)
    have = df.where(F.col(time).isNotNull() & F.col(event).isNotNull())
    for c in d.reads:
        have = have.where(F.col(c).isNotNull())
    rows = have.select(*(c.alias(f"x{i}") for i, c in enumerate(d.columns)), F.log(F.col(time).cast("double")).alias("t"), F.col(event).cast("double").alias("e"))
    fixed = dist == "exponential"
    normal = dist == "lognormal"
    erfc = np.vectorize(math.erfc)

    def pieces(m, b):
        s = 0.0 if fixed else b[p]
        z = (m[:, p] - m[:, :p] @ b[:p]) / math.exp(s)
        if normal:
            surv = np.maximum(0.5 * erfc(z / math.sqrt(2)), 1e-300)
            dens = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
            return s, z, -z * z / 2 - 0.5 * math.log(2 * math.pi), np.log(surv), -z, -dens / surv
        w = np.exp(np.minimum(z, 500))
        return s, z, z - w, -w, 1 - w, -w

    def loglik(m, b):
        s, _, lf, ls, _, _ = pieces(m, b)
        e = m[:, p + 1]
        return float((e * (lf - s - m[:, p]) + (1 - e) * ls).sum())

    def gradient(m, b):
        s, z, _, _, df_, ds = pieces(m, b)
        e = m[:, p + 1]
        dz = e * df_ + (1 - e) * ds
        g = -(dz @ m[:, :p]) / math.exp(s)
        return g if fixed else np.r_[g, (-dz * z - e).sum()]

    mean = rows.agg(F.avg("t")).first()[0]
    start = np.r_[mean, np.zeros(p - 1)] if d.names[0] == "(Intercept)" else np.zeros(p)
    coef, cov, ll = _held(rows, loglik, gradient, start if fixed else np.r_[start, 0.0])
    return Estimates(d.names + ([] if fixed else ["log(scale)"]), coef, cov, ll)


def elastic_net(df: DataFrame, formula: str, lambdas: list[float], alpha: float = 1.0, steps: int = 10_000, tol: float = 1e-10) -> dict[float, np.ndarray]:
    """Coefficients (intercept first) of the gaussian elastic net: one Gram, then coordinate descent on it."""
    d = design(formula, df)
    p = len(d.names)
    g, b, s = _gram(_matrix(df, d, None), p, F.lit(1.0), F.col("y"), {"n": F.count("*"), "y": F.sum("y")})
    n = s["n"]
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.diag(cov))
    r, xy = cov / np.outer(sd, sd), (b[1:] / n - mean * s["y"] / n) / sd
    beta, out = np.zeros(p - 1), {}
    for lam in sorted(lambdas, reverse=True):  # each starts from the last
        for _ in range(steps):
            old = beta.copy()
            for j in range(p - 1):
                z = xy[j] - r[j] @ beta + beta[j]
                beta[j] = math.copysign(max(abs(z) - lam * alpha, 0.0), z) / (1 + lam * (1 - alpha))
            if np.abs(beta - old).max() < tol:
                break
        out[lam] = np.r_[s["y"] / n - mean @ (beta / sd), beta / sd]
    return out


def random_intercept(df: DataFrame, formula: str, group: str, reml: bool = True) -> dict:
    """Linear mixed model with a random intercept: fixed effects, standard errors and variances.

    Rows are summed by group once; for each ratio of the variances the profiled
    likelihood needs sums over groups only.
    """
    d = design(formula, df)
    p = len(d.names)
    have = df.where(F.col(group).isNotNull())
    for c in d.reads:
        have = have.where(F.col(c).isNotNull())
    v = [*d.columns, d.response]
    x = have.select(F.col(group).alias("g"), *(c.alias(f"v{i}") for i, c in enumerate(v)))
    pairs = [(i, j) for i in range(p + 1) for j in range(i + 1)]
    whole = x.agg(F.count("*").alias("n"), *(F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"q{i}_{j}") for i, j in pairs)).first()
    groups = x.groupBy("g").agg(F.count("*").alias("m"), *(F.sum(f"v{i}").alias(f"v{i}") for i in range(p + 1))).persist()
    n = whole["n"]
    total = np.zeros((p + 1, p + 1))
    for i, j in pairs:
        total[i, j] = total[j, i] = whole[f"q{i}_{j}"]

    def at(ratio: float):
        w = ratio / (1 + F.col("m") * ratio)
        out = groups.agg(F.sum(F.log1p(F.col("m") * ratio)).alias("log"), *(F.sum(w * F.col(f"v{i}") * F.col(f"v{j}")).alias(f"q{i}_{j}") for i, j in pairs)).first()
        a = total.copy()
        for i, j in pairs:
            a[i, j] -= out[f"q{i}_{j}"]
            a[j, i] = a[i, j]
        beta = np.linalg.solve(a[:p, :p], a[:p, p])
        rss = a[p, p] - a[:p, p] @ beta
        k = n - p if reml else n
        dev = k * (math.log(2 * math.pi * rss / k) + 1) + out["log"] + (np.linalg.slogdet(a[:p, :p])[1] if reml else 0.0)
        return dev, beta, rss / k, a[:p, :p]

    lo, hi = math.log(1e-6), math.log(1e4)
    gold = (math.sqrt(5) - 1) / 2
    c, e = hi - gold * (hi - lo), lo + gold * (hi - lo)
    fc, fe = at(math.exp(c))[0], at(math.exp(e))[0]
    while hi - lo > 1e-5:
        if fc < fe:
            hi, e, fe = e, c, fc
            c = hi - gold * (hi - lo)
            fc = at(math.exp(c))[0]
        else:
            lo, c, fc = c, e, fe
            e = lo + gold * (hi - lo)
            fe = at(math.exp(e))[0]
    ratio = math.exp((lo + hi) / 2)
    dev, beta, sigma2, info = at(ratio)
    groups.unpersist()
    return {"names": d.names, "coef": beta, "std_error": np.sqrt(np.diag(np.linalg.inv(info)) * sigma2), "sigma2": sigma2, "tau2": ratio * sigma2, "loglik": -dev / 2}
