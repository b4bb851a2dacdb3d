"""Linear and generalized linear models: sums of products on the executors, small solves on the driver."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstat.functions.dist import chi2_sf, f_sf, norm_cdf, norm_ppf, t_ppf, t_sf
from quillstat.operators import splines
from quillstat.plans.ordered import lagged

_FUNCTIONS = {"log": F.log, "exp": F.exp, "sqrt": F.sqrt, "log10": F.log10, "abs": F.abs}


@dataclass
class Design:
    """Named Columns of a model matrix, and the response."""

    names: list[str]
    columns: list[Column]
    response: Column | None
    reads: list[str]
    levels: dict[str, list] = field(default_factory=dict)
    offset: Column | None = None


def _atom(text: str, df: DataFrame, levels: dict[str, list], reads: list[str]) -> list[tuple[str, Column]]:
    """The columns of one variable or call: one of a number, one less than the levels of a factor."""
    text = text.strip()
    if m := re.fullmatch(r"([A-Za-z0-9]+)\((.*)\)", text):
        inner = m[2].strip()
        if m[1] == "I":
            reads += re.findall(r"[A-Za-z_.][\w.]*", inner)
            return [(text, F.expr(re.sub(r"([\w.]+)\s*\^\s*([\w.]+)", r"pow(\1, \2)", inner)).cast("double"))]
        if m[1] in _FUNCTIONS:
            reads.append(inner)
            return [(text, _FUNCTIONS[m[1]](F.col(inner).cast("double")))]
        if m[1] in ("ns", "bs", "rcs"):
            name, *args = inner.split(",")
            reads.append(name)
            if text not in levels:  # knots stay those of the table the model was made with
                levels[text] = _spline(df, m[1], name, args)
            return [(f"{text}{end}", c) for end, c in zip(levels[text].suffixes(), levels[text].columns(F.col(name)), strict=True)]
        raise ValueError(f"unknown function {m[1]}")
    if text not in df.columns:
        raise KeyError(text)
    reads.append(text)
    if isinstance(df.schema[text].dataType, T.NumericType):
        return [(text, F.col(text).cast("double"))]
    if text not in levels:
        levels[text] = [r[0] for r in df.where(F.col(text).isNotNull()).select(text).distinct().orderBy(text).collect()]
    # a level that was not there when the model was made has no columns: an error, and of a null nothing is known
    known = F.when(F.col(text).isin(*levels[text]), 0.0).when(F.col(text).isNull(), F.lit(None).cast("double")).otherwise(F.raise_error(F.concat(F.lit(f"{text} has a new level "), F.col(text).cast("string"))).cast("double"))
    return [(f"{text}{x}", F.when(F.col(text) == F.lit(x), 1.0).otherwise(known)) for x in levels[text][1:]]


def _spline(df: DataFrame, kind: str, name: str, args: list[str]) -> splines.Spline:
    """``ns(x, df=4)``, ``bs(x, df=5, degree=3)``, ``rcs(x, 5)``."""
    given = dict(a.split("=") if "=" in a else ("n_knots" if kind == "rcs" else "df", a) for a in args)
    options = {"df": "df_columns", "degree": "degree", "n_knots": "n_knots", "intercept": "intercept"}
    if wrong := set(given) - set(options):
        raise ValueError(f"{kind} has no argument {sorted(wrong)[0]}")
    return splines.resolve(df, name, kind, **{options[k]: v.upper() in ("TRUE", "T") if k == "intercept" else int(v) for k, v in given.items()})


def _undotted(formula: str, df: DataFrame) -> str:
    """``formula`` with all columns that its left side does not name in place of a dot."""
    left, right = formula.split("~")
    others = [c for c in df.columns if c not in re.findall(r"[A-Za-z_.][\w.]*", left)]
    return left + "~" + re.sub(r"(?<![\w.)])\.(?![\w.(])", lambda _: "+".join(others), right)


def design(formula: str, df: DataFrame, levels: dict[str, list] | None = None) -> Design:
    """``y ~ a + b * c - 1``: operators ``+ : * -``, ``0``, ``1``, ``.``, ``offset()``, ``I()``, functions, and splines ``ns(x, df=4)``, ``bs(x, df=5)``, ``rcs(x, 5)``."""
    left, right = formula.split("~")
    levels, reads = dict(levels or {}), []
    right = re.sub(r"\s+", "", _undotted(formula, df).split("~")[1])
    intercept, terms, offset = True, [], None
    for sign, part in re.findall(r"([+-]?)((?:[^+\-()]|\([^()]*\))+)", right):
        if part in ("0", "1"):
            intercept = (part == "1") != (sign == "-")
        elif sign == "-":
            terms = [t for t in terms if t != tuple(part.split(":"))]
        elif part.startswith("offset("):
            ((_, c),) = _atom(part[7:-1], df, levels, reads)
            offset = c if offset is None else offset + c
        elif "*" in part:
            names = part.split("*")
            for mask in sorted(range(1, 1 << len(names)), key=lambda m: (m.bit_count(), [i for i in range(len(names)) if m >> i & 1])):
                t = tuple(names[i] for i in range(len(names)) if mask >> i & 1)
                terms += [t] if t not in terms else []
        elif tuple(part.split(":")) not in terms:
            terms.append(tuple(part.split(":")))
    terms.sort(key=len)
    cols: list[tuple[str, Column]] = [("(Intercept)", F.lit(1.0))] if intercept else []
    for t in terms:
        now = [("", None)]
        for atom in t:
            made = _atom(atom, df, levels, reads)
            now = [(f"{n}:{m}" if n else m, c if o is None else o * c) for m, c in made for n, o in now]
        cols += now
    response = None
    if left.strip():
        ((_, response),) = _atom(left, df, levels, reads) if left.strip() in df.columns and isinstance(df.schema[left.strip()].dataType, T.NumericType) or "(" in left else [(left, F.col(left.strip()).cast("double"))]
        reads.append(left.strip())
    return Design([n for n, _ in cols], [c for _, c in cols], response, sorted({r for r in reads if r in df.columns}), levels, offset)


@dataclass
class Fit:
    names: list[str]
    coef: np.ndarray
    cov: np.ndarray
    n: int
    df_residual: float
    family: str
    scale: float
    deviance: float
    null_deviance: float
    loglik: float
    rows: DataFrame
    bread: np.ndarray
    design: Design
    iterations: int = 1
    weights: str | None = None

    def tidy(self, spark=None, *, level: float = 0.95, exponentiate: bool = False):
        se = np.sqrt(np.diag(self.cov))
        z = self.coef / se
        normal = self.family not in ("gaussian", "gamma")
        p = [2 * (norm_cdf(-abs(x)) if normal else t_sf(abs(x), self.df_residual)) for x in z]
        q = norm_ppf(1 - (1 - level) / 2) if normal else t_ppf(1 - (1 - level) / 2, self.df_residual)
        g = np.exp if exponentiate else lambda v: v
        rows = [(n, float(g(b)), float(s), float(t), float(v), float(g(b - q * s)), float(g(b + q * s))) for n, b, s, t, v in zip(self.names, self.coef, se, z, p, strict=True)]
        schema = "term string, estimate double, std_error double, statistic double, p_value double, conf_low double, conf_high double"
        return self.rows.sparkSession.createDataFrame(rows, schema)

    def glance(self):
        k = len(self.coef) + (self.family in ("gaussian", "gamma"))
        row = [(self.n, float(self.df_residual), float(self.deviance), float(self.null_deviance), float(self.loglik), float(-2 * self.loglik + 2 * k), float(-2 * self.loglik + k * math.log(self.n)))]
        return self.rows.sparkSession.createDataFrame(row, "n long, df_residual double, deviance double, null_deviance double, loglik double, aic double, bic double")

    def predict(self, data: DataFrame, *, kind: str = "response", out: str = "fitted") -> DataFrame:
        """``data`` with ``out``; null in rows with a missing predictor, and an error in those with an unknown factor level."""
        eta = sum((F.lit(float(b)) * c for b, c in zip(self.coef, self.design.columns, strict=True)), F.lit(0.0))
        if self.design.offset is not None:
            eta = eta + self.design.offset
        return data.withColumn(out, eta if kind == "link" else _inverse(self.family)(eta))


def _inverse(family: str):
    return {"gaussian": lambda e: e, "binomial": lambda e: 1 / (1 + F.exp(-e)), "poisson": F.exp, "gamma": lambda e: 1 / e}[family]


def _complete(df: DataFrame, d: Design, weights: str | None = None) -> DataFrame:
    """The rows without a null in what the design reads."""
    for c in d.reads + ([weights] if weights else []):
        df = df.where(F.col(c).isNotNull())
    return df


def _matrix(df: DataFrame, d: Design, weights: str | None) -> DataFrame:
    """Complete cases as x0.., y, w, o; a null drops a row, a NaN does not."""
    return _complete(df, d, weights).select(*(c.alias(f"x{i}") for i, c in enumerate(d.columns)), d.response.alias("y"), (F.col(weights).cast("double") if weights else F.lit(1.0)).alias("w"), (d.offset if d.offset is not None else F.lit(0.0)).alias("o"))


def _gram(m: DataFrame, p: int, w: Column, z: Column, extra: dict[str, Column]) -> tuple[np.ndarray, np.ndarray, dict]:
    """X'WX, X'Wz and further sums in one pass."""
    x = [F.col(f"x{i}") for i in range(p)]
    out = m.agg(*(F.sum(w * x[i] * x[j]).alias(f"g{i}_{j}") for i in range(p) for j in range(i + 1)), *(F.sum(w * x[i] * z).alias(f"b{i}") for i in range(p)), *(v.alias(k) for k, v in extra.items())).first()
    g = np.zeros((p, p))
    for i in range(p):
        for j in range(i + 1):
            g[i, j] = g[j, i] = out[f"g{i}_{j}"]
    return g, np.array([out[f"b{i}"] for i in range(p)], float), {k: out[k] for k in extra}


def _solve(g: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sqrt(np.maximum(np.diag(g), 1e-300))  # scaled, for columns of unlike size
    inv = np.linalg.pinv(g / np.outer(s, s), rcond=1e-12, hermitian=True) / np.outer(s, s)
    return inv @ b, inv


def _rank(g: np.ndarray) -> int:
    s = np.sqrt(np.maximum(np.diag(g), 1e-300))
    return int(np.linalg.matrix_rank(g / np.outer(s, s), tol=1e-11, hermitian=True))


def fit_ols(df: DataFrame, formula: str, weights: str | None = None) -> Fit:
    d = design(formula, df)
    m, p = _matrix(df, d, weights), len(d.names)
    y, w = F.col("y") - F.col("o"), F.col("w")
    g, b, s = _gram(m, p, w, y, {"n": F.count_if(w != 0), "yy": F.sum(w * y * y), "yw": F.sum(w * y), "ww": F.sum(w), "lw": F.sum(F.when(w > 0, F.log(w)))})
    coef, inv = _solve(g, b)
    resid = y - sum((F.lit(float(c)) * F.col(f"x{i}") for i, c in enumerate(coef)), F.lit(0.0))
    rows = m.withColumn("resid", resid)
    rss = rows.agg(F.sum(w * F.col("resid") * F.col("resid"))).first()[0]  # a second pass, for cancellation
    n, dof = s["n"], s["n"] - _rank(g)
    scale = rss / dof if dof else math.nan
    loglik = 0.5 * ((s["lw"] or 0.0) - n * (math.log(2 * math.pi) + 1 - math.log(n) + math.log(rss))) if rss > 0 else math.inf
    return Fit(d.names, coef, inv * scale, n, dof, "gaussian", scale, rss, s["yy"] - s["yw"] ** 2 / s["ww"], loglik, rows.withColumn("weight", w), inv, d, weights=weights)


def fit_glm(df: DataFrame, formula: str, family: str = "gaussian", weights: str | None = None, steps: int = 25, tol: float = 1e-8) -> Fit:
    """Iteratively reweighted least squares; each step is one aggregation over the cached matrix, for the sums and the deviance of the step before."""
    if family == "gaussian":
        return fit_ols(df, formula, weights)
    d = design(formula, df)
    m, p = _matrix(df, d, weights).persist(), len(d.names)
    y, w, o = F.col("y"), F.col("w"), F.col("o")
    base = m.agg(F.sum(w * y).alias("wy"), F.sum(w).alias("w"), F.count_if(w != 0).alias("n")).first()
    mean, n = base["wy"] / base["w"], base["n"]
    ylog = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)

    def dev(mu):
        return {"binomial": lambda: 2 * (ylog(y, mu) + ylog(1 - y, 1 - mu)), "poisson": lambda: 2 * (ylog(y, mu) - (y - mu)), "gamma": lambda: 2 * ((y - mu) / mu - F.log(y / mu))}[family]()

    start = {"binomial": (w * y + 0.5) / (w + 1), "poisson": y + 0.1, "gamma": y}[family]
    link = {"binomial": lambda u: F.log(u / (1 - u)), "poisson": F.log, "gamma": lambda u: 1 / u}[family]
    slope = {"binomial": lambda u: u * (1 - u), "poisson": lambda u: u, "gamma": lambda u: -u * u}[family]  # d mu / d eta
    variance = {"binomial": lambda u: u * (1 - u), "poisson": lambda u: u, "gamma": lambda u: u * u}[family]
    eta, coef, old = link(start), None, None
    for it in range(steps + 1):
        mu = _inverse(family)(eta) if coef is not None else start
        k = slope(mu)
        g, b, more = _gram(m, p, w * k * k / variance(mu), eta - o + (y - mu) / k, {"dev": F.sum(w * dev(mu))})
        new, inv = more["dev"], _solve(g, b)[1]
        if coef is not None and old is not None and abs(new - old) / (abs(new) + 0.1) < tol:
            break
        old = new if coef is not None else None
        coef = inv @ b
        eta = sum((F.lit(float(c)) * F.col(f"x{i}") for i, c in enumerate(coef)), F.lit(0.0)) + o
    mu = _inverse(family)(eta)
    sums = m.agg(F.sum(w * F.pow(y - mu, 2) / variance(mu)).alias("pearson"), F.sum(w * dev(F.lit(mean))).alias("null"), F.sum(_loglik(family, y, mu, w)).alias("ll")).first()
    dof = n - _rank(g)
    scale = sums["pearson"] / dof if family == "gamma" else 1.0
    ll = sums["ll"]
    if family == "gamma":
        disp = new / n
        ll = m.agg(F.sum(-(y / mu / disp) + (1 / disp - 1) * F.log(y) - F.log(mu * disp) / disp)).first()[0] - n * math.lgamma(1 / disp)
    k = slope(mu)
    # working residuals and weights, so that scores are weight * resid * x
    rows = m.withColumn("resid", (y - mu) / k).withColumn("weight", w * k * k / variance(mu))
    m.unpersist()
    return Fit(d.names, coef, inv * scale, n, dof, family, scale, new, sums["null"], ll, rows, inv, d, it, weights)


def _loglik(family: str, y: Column, mu: Column, w: Column) -> Column:
    if family == "binomial":
        return w * (F.when(y > 0, y * F.log(mu)).otherwise(0.0) + F.when(y < 1, (1 - y) * F.log(1 - mu)).otherwise(0.0))
    if family == "poisson":
        # log y! by Stirling's series, exact sums below 20
        small = F.array(*(F.lit(math.lgamma(i + 1)) for i in range(20)))
        big = (y + 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, 3))
        return w * (y * F.log(mu) - mu - F.when(y < 20, F.get(small, y.cast("int"))).otherwise(big))
    return F.lit(0.0)


def _leverage(fit: Fit) -> Column:
    p = len(fit.coef)
    return F.col("weight") * sum((F.lit(float(fit.bread[i, j])) * F.col(f"x{i}") * F.col(f"x{j}") for i in range(p) for j in range(p)), F.lit(0.0))


def hc_covariance(fit: Fit, kind: str = "HC3") -> np.ndarray:
    """Heteroscedasticity-consistent covariance HC0 to HC3."""
    p, h = len(fit.coef), _leverage(fit)
    factor = {"HC0": F.lit(1.0), "HC1": F.lit(fit.n / (fit.n - p)), "HC2": 1 / (1 - h), "HC3": 1 / F.pow(1 - h, 2), "HC4": 1 / F.pow(1 - h, F.least(F.lit(4.0), fit.n * h / p))}[kind]
    meat, _, _ = _gram(fit.rows, p, factor * F.pow(F.col("weight") * F.col("resid"), 2), F.lit(0.0), {})
    return fit.bread @ meat @ fit.bread


def cluster_covariance(fit: Fit, df: DataFrame, formula: str, clusters: list[str], adjust: bool = True) -> np.ndarray:
    """One- or multi-way clustered covariance, by inclusion and exclusion over sets of clusters.

    ``adjust`` scales by clusters / (clusters - 1) and, of least squares, by (n - 1) / (n - p).
    A row of the fit without a cluster is an error.
    """
    d, p = fit.design, len(fit.coef)
    x = fit.predict(_complete(df, d, fit.weights), kind="link", out="__eta")
    mu = _inverse(fit.family)(F.col("__eta"))
    if lost := [c for c in clusters if x.where(F.col(c).isNull()).limit(1).count()]:
        raise ValueError(f"cluster {lost[0]} is missing in some rows")
    w = F.col(fit.weights).cast("double") if fit.weights else F.lit(1.0)
    score = [w * (d.response - mu) * c for c in d.columns]  # canonical links
    if fit.family == "gamma":  # the inverse link falls where the canonical one rises
        score = [-s for s in score]
    out = np.zeros((p, p))
    for mask in range(1, 1 << len(clusters)):
        own = [c for i, c in enumerate(clusters) if mask >> i & 1]
        sums = x.groupBy(*own).agg(*(F.sum(s).alias(f"x{i}") for i, s in enumerate(score)))
        meat, _, extra = _gram(sums, p, F.lit(1.0), F.lit(0.0), {"g": F.count("*")})
        g = extra["g"]
        k = g / (g - 1) * ((fit.n - 1) / (fit.n - p) if fit.family == "gaussian" else 1.0) if adjust else 1.0
        out += (-1) ** (len(own) + 1) * k * meat
    return fit.bread @ out @ fit.bread


def newey_west(df: DataFrame, formula: str, order_by: list[str], lags: int) -> np.ndarray:
    """Bartlett-weighted covariance of a least-squares fit, rows in the order of ``order_by``."""
    fit = fit_ols(df, formula)
    d, p = fit.design, len(fit.coef)
    resid = d.response - (d.offset if d.offset is not None else 0.0) - sum((F.lit(float(b)) * c for b, c in zip(fit.coef, d.columns, strict=True)), F.lit(0.0))
    # rows that are not in the fit take no place in the order
    s = _complete(df, d).select(*order_by, *((resid * c).alias(f"s{i}") for i, c in enumerate(d.columns)))
    s = lagged(s, order_by, [f"s{i}" for i in range(p)], lags)
    out = s.agg(*(F.sum(F.col(f"s{i}") * F.col(f"s{j}" if k == 0 else f"s{j}_{k}")).alias(f"m{k}_{i}_{j}") for k in range(lags + 1) for i in range(p) for j in range(p))).first()
    meat = np.zeros((p, p))
    for k in range(lags + 1):
        m = np.array([[out[f"m{k}_{i}_{j}"] for j in range(p)] for i in range(p)], float)
        meat += m if k == 0 else (1 - k / (lags + 1)) * (m + m.T)
    return fit.bread @ meat @ fit.bread


def durbin_watson(df: DataFrame, formula: str, order_by: list[str]) -> DataFrame:
    fit = fit_ols(df, formula)
    scored = fit.predict(_complete(df, fit.design), out="__f").select(*order_by, (fit.design.response - F.col("__f")).alias("e"))
    return lagged(scored, order_by, ["e"], 1).agg((F.sum(F.pow(F.col("e") - F.col("e_1"), 2)) / F.sum(F.col("e") * F.col("e"))).alias("dw"))


def breusch_pagan(df: DataFrame, formula: str) -> tuple[float, int, float]:
    """Koenker's studentised statistic, degrees of freedom and p value."""
    fit = fit_ols(df, formula)
    scored = fit.predict(df, out="__f").withColumn("__e2", F.pow(fit.design.response - F.col("__f"), 2))
    aux = fit_ols(scored, "__e2 ~ " + formula.split("~")[1])
    stat = fit.n * (1 - aux.deviance / aux.null_deviance)
    return stat, len(fit.coef) - 1, chi2_sf(stat, len(fit.coef) - 1)


def ramsey_reset(df: DataFrame, formula: str, powers: tuple[int, ...] = (2, 3)) -> tuple[float, int, float]:
    """F statistic, numerator degrees of freedom and p value of powers of the fitted values added to the model.

    With all powers from 2 on, those of standardised values span the same and are less alike.
    """
    formula = _undotted(formula, df)
    fit = fit_ols(df, formula)
    more = fit.predict(_complete(df, fit.design), out="__f")
    if list(powers) == list(range(2, 2 + len(powers))) and "(Intercept)" in fit.names:
        m = more.agg(F.avg("__f").alias("m"), F.stddev_pop("__f").alias("s")).first()
        more = more.withColumn("__f", (F.col("__f") - F.lit(m["m"])) / F.lit(m["s"] or 1.0))
    more = more.withColumns({f"__f{k}": F.pow("__f", F.lit(k)) for k in powers})
    full = fit_ols(more, formula + "".join(f" + __f{k}" for k in powers))
    f = (fit.deviance - full.deviance) / (fit.df_residual - full.df_residual) / (full.deviance / full.df_residual)
    return f, int(fit.df_residual - full.df_residual), f_sf(f, fit.df_residual - full.df_residual, full.df_residual)


def breusch_godfrey(df: DataFrame, formula: str, order_by: list[str], lags: int = 1) -> tuple[float, int, float]:
    """Statistic, degrees of freedom and p value for serial correlation up to ``lags``, residuals before the first row counting as 0."""
    formula = _undotted(formula, df)
    fit = fit_ols(df, formula)
    resid = fit.predict(_complete(df, fit.design), out="__f").withColumn("__e", fit.design.response - F.col("__f"))
    rows = lagged(resid, order_by, ["__e"], lags).fillna(0.0, [f"__e_{k}" for k in range(1, lags + 1)])
    aux = fit_ols(rows, "__e ~ " + formula.split("~")[1] + "".join(f" + __e_{k}" for k in range(1, lags + 1)))
    stat = fit.n * (1 - aux.deviance / aux.null_deviance)
    return stat, lags, chi2_sf(stat, lags)


def wald_test(full: Fit, reduced: Fit, cov: np.ndarray | None = None) -> tuple[float, int, float]:
    """F statistic, its numerator degrees of freedom and p value of the coefficients only ``full`` has."""
    at = [i for i, n in enumerate(full.names) if n not in reduced.names]
    v = (full.cov if cov is None else cov)[np.ix_(at, at)]
    stat = float(full.coef[at] @ np.linalg.solve(v, full.coef[at])) / len(at)
    return stat, len(at), f_sf(stat, len(at), full.df_residual)


def likelihood_ratio_test(full: Fit, reduced: Fit) -> tuple[float, int, float]:
    stat, k = 2 * (full.loglik - reduced.loglik), len(full.coef) - len(reduced.coef)
    return stat, k, chi2_sf(stat, k)


def vif(fit: Fit) -> dict[str, float]:
    """Variance inflation of each non-constant term."""
    at = [i for i, n in enumerate(fit.names) if n != "(Intercept)"]
    s = np.sqrt(np.diag(fit.cov))[at]
    r = np.linalg.inv(fit.cov[np.ix_(at, at)] / np.outer(s, s))
    c = fit.cov[np.ix_(at, at)] / np.outer(s, s)
    return {fit.names[i]: float(r[k, k] * c[k, k]) for k, i in enumerate(at)}


def ridge(df: DataFrame, formula: str, lambdas: list[float]) -> dict[float, np.ndarray]:
    """Coefficients (intercept first) of penalised least squares on standardised predictors, one Gram for all lambdas."""
    d = design(formula, df)
    p = len(d.names)
    g, b, s = _gram(_matrix(df, d, None), p, F.lit(1.0), F.col("y"), {"n": F.count("*"), "y": F.sum("y")})
    n = s["n"]
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.diag(cov))
    xy = (b[1:] / n - mean * s["y"] / n) / sd
    out = {}
    for lam in lambdas:
        beta = np.linalg.solve(cov / np.outer(sd, sd) + lam * np.eye(p - 1), xy) / sd
        out[lam] = np.r_[s["y"] / n - mean @ beta, beta]
    return out
