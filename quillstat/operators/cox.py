"""Cox regression with weights, delayed entry, strata, clusters and offsets, and what follows from a fit.

Every quantity is a sum over rows by stratum and time, or a running sum over the times
of a stratum: a Newton step is one aggregation, one running sum and one pass over the
times.  Ties of d deaths under Efron are d terms of one time, taken by numpy in portions
where the time lies, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.functions.dist import chi2_sf, norm_ppf
from quillstat.operators.survival import survival_curve
from quillstat.plans.dominance import dominance
from quillstat.plans.newton import row_sums
from quillstat.plans.ordered import ONE_TASK, cut, running

#: Terms of ties that are held at a time.
_PORTION = 1 << 16


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= ONE_TASK else df


class _Times:
    """Rows (d, dw, ll, r, dr, sx, a, da, b, db) of times with deaths, as arrays."""

    def __init__(self, m: np.ndarray, p: int) -> None:
        self.d, self.dw, self.ll, self.r, self.dr = m[:, 0], m[:, 1], m[:, 2], m[:, 3], m[:, 4]
        self.sx, self.a, self.da = m[:, 5 : 5 + p], m[:, 5 + p : 5 + 2 * p], m[:, 5 + 2 * p : 5 + 3 * p]
        k, (i, j) = p * (p + 1) // 2, np.tril_indices(p)
        self.b, self.db = np.zeros((len(m), p, p)), np.zeros((len(m), p, p))
        for out, at in ((self.b, 5 + 3 * p), (self.db, 5 + 3 * p + k)):
            out[:, i, j] = m[:, at : at + k]
            out[:, j, i] = m[:, at : at + k]

    def terms(self, efron: bool) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, fraction, weight, denominator, mean, variance) of the terms of each time, in portions."""
        d = self.d.astype(np.int64) if efron else np.ones(len(self.d), np.int64)
        ends = np.cumsum(d)
        for at in range(0, int(ends[-1]) if len(ends) else 0, _PORTION):
            nth = np.arange(at, min(at + _PORTION, int(ends[-1])))
            row = np.searchsorted(ends, nth, "right")
            f = (nth - (ends[row] - d[row])) / d[row]
            weight = self.dw[row] / d[row]
            den = self.r[row] - f * self.dr[row]
            mean = (self.a[row] - f[:, None] * self.da[row]) / den[:, None]
            var = (self.b[row] - f[:, None, None] * self.db[row]) / den[:, None, None] - mean[:, :, None] * mean[:, None, :]
            yield row, f, weight, den, mean, var

    def totals(self, efron: bool) -> np.ndarray:
        """log-likelihood, score and information."""
        p = self.sx.shape[1]
        ll, u, h = self.ll.sum(), self.sx.sum(0), np.zeros((p, p))
        for _, _, weight, den, mean, var in self.terms(efron):
            ll -= weight @ np.log(den)
            u = u - weight @ mean
            h += np.tensordot(weight, var, 1)
        return np.concatenate([[ll], u, h.ravel()])

    def table(self, efron: bool) -> dict[str, np.ndarray]:
        """By time: hazard and hazard-weighted means, all and as they count for the dying; the plain mean and the variance."""
        n, p = self.sx.shape
        out = {"h": np.zeros(n), "hd": np.zeros(n), "bh": np.zeros((n, p)), "bd": np.zeros((n, p)), "mean": np.zeros((n, p)), "var": np.zeros((n, p, p))}
        for row, f, weight, den, mean, var in self.terms(efron):
            h = weight / den
            np.add.at(out["h"], row, h)
            np.add.at(out["hd"], row, (1 - f) * h)
            np.add.at(out["bh"], row, mean * h[:, None])
            np.add.at(out["bd"], row, mean * ((1 - f) * h)[:, None])
            np.add.at(out["mean"], row, mean / (self.d[row] if efron else np.ones(len(row)))[:, None])
            np.add.at(out["var"], row, var * weight[:, None, None])
        return out


@dataclass
class CoxFit:
    """A fitted model; ``rows`` holds the complete rows with centred predictors, ``times`` the risk sets at the fit."""

    names: list[str]
    coefficients: np.ndarray
    covariance: np.ndarray  # robust where the fit has clusters or asks for it
    model_covariance: np.ndarray
    loglik: tuple[float, float]
    score_test: float
    n: int
    n_events: int
    centre: np.ndarray
    ties: str
    rows: DataFrame
    times: DataFrame
    n_times: int
    clustered: bool
    delayed: bool

    def tidy(self, level: float = 0.95, exponentiate: bool = False) -> list[dict]:
        """term, estimate, std_error, statistic, p_value and limits."""
        z = norm_ppf(1 - (1 - level) / 2)
        out = []
        for name, b, se in zip(self.names, self.coefficients, np.sqrt(np.diag(self.covariance)), strict=True):
            limits = (b - z * se, b + z * se)
            of = np.exp if exponentiate else (lambda x: x)
            out.append({"term": name, "estimate": float(of(b)), "std_error": float(se), "statistic": float(b / se), "p_value": chi2_sf(float(b / se) ** 2, 1), "lower": float(of(limits[0])), "upper": float(of(limits[1]))})
        return out

    def tests(self) -> dict[str, tuple[float, int, float]]:
        """Likelihood-ratio, Wald and score tests of all coefficients: statistic, degrees of freedom, p."""
        k = len(self.names)
        wald = float(self.coefficients @ np.linalg.solve(self.covariance, self.coefficients))
        stats = {"likelihood_ratio": 2 * (self.loglik[1] - self.loglik[0]), "wald": wald, "score": self.score_test}
        return {name: (x, k, chi2_sf(x, k)) for name, x in stats.items()}

    def eta(self) -> Column:
        """The linear predictor of ``rows``, centred."""
        return F.col("o") + sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(self.coefficients)), F.lit(0.0))

    def _filled(self) -> DataFrame:
        """(s, t, h, hd, bh, bd, mean, var, cum, cumb) of every time of a row or an entry: running sums of the hazards up to and with it."""
        p = len(self.names)
        sums = {"cum": ("sum", "h")} | {f"cumb{i}": ("sum", f"bh{i}") for i in range(p)}
        return running(self.times, "t", sums, ("s",), rows=self.n_times)

    def baseline(self) -> DataFrame:
        """(stratum, t, hazard, cumhaz, surv) of a row whose predictors and offset are 0, at the times with deaths."""
        at_zero = float(np.exp(-self.centre @ self.coefficients))
        own = self._filled().where("h > 0").select(F.col("s").alias("stratum"), "t", (F.col("h") * at_zero).alias("hazard"), (F.col("cum") * at_zero).alias("cumhaz"))
        return own.withColumn("surv", F.exp(-F.col("cumhaz")))

    def predict_survival(self, df: DataFrame, times: list[float], predictors: list[str] | None = None, stratum: str | None = None) -> DataFrame:
        """``df`` with ``at`` and ``surv``: a row for each of the ``times``; null where a predictor is missing or the stratum unknown."""
        lp = sum((F.lit(float(b)) * F.col(c).cast("double") for b, c in zip(self.coefficients, predictors or self.names, strict=True)), F.lit(0.0))
        base = self.baseline().groupBy("stratum").agg(*(F.coalesce(F.sum(F.when(F.col("t") <= x, F.col("hazard"))), F.lit(0.0)).alias(f"h{i}") for i, x in enumerate(times)))
        base = base.select(F.col("stratum").alias("__s"), F.array(*(F.struct(F.lit(float(x)).alias("at"), F.col(f"h{i}").alias("h")) for i, x in enumerate(times))).alias("__h"))
        key = F.col(stratum).cast("string") if stratum else F.lit("")
        joined = df.withColumn("__s", key).join(F.broadcast(base), "__s", "left").withColumn("__h", F.explode_outer("__h"))
        return joined.select(*(F.col(f"`{c}`") for c in df.columns), F.col("__h.at").alias("at"), F.exp(-F.col("__h.h") * F.exp(lp)).alias("surv"))

    def _scored(self) -> DataFrame:
        """``rows`` with their hazard since entry, and the parts g_i (of their own death) and m_i (of the risk sets) of their scores."""
        p = len(self.names)
        filled = cut(self._filled())
        at = _small(filled.select("s", "t", "h", "hd", "cum", *(f"{c}{i}" for c in ("bh", "bd", "mean", "cumb") for i in range(p))), self.n_times)
        rows = self.rows.join(at, ["s", "t"])
        if self.delayed:
            before = filled.select("s", F.col("t").alias("u"), F.col("cum").alias("cum_u"), *(F.col(f"cumb{i}").alias(f"cumb_u{i}") for i in range(p)))
            rows = rows.join(_small(before, self.n_times), ["s", "u"])
        since = lambda c, i="": F.col(f"{c}{i}") - (F.col(f"{c}_u{i}") if self.delayed else F.lit(0.0))
        dead = F.col("e") > 0
        out = {"hazard": since("cum") + F.when(dead, F.col("hd") - F.col("h")).otherwise(0.0), "risk": F.exp(self.eta())}
        out |= {f"g{i}": F.when(dead, F.col(f"x{i}") - F.col(f"mean{i}")) for i in range(p)}
        out |= {f"m{i}": since("cumb", i) + F.when(dead, F.col(f"bd{i}") - F.col(f"bh{i}")).otherwise(0.0) for i in range(p)}
        rows = rows.withColumns(out)
        return rows.withColumns({f"v{i}": F.coalesce(f"g{i}", F.lit(0.0)) - F.col("risk") * (F.col(f"x{i}") * F.col("hazard") - F.col(f"m{i}")) for i in range(p)})

    def residuals(self, kind: str = "martingale") -> DataFrame:
        """(id, ...) of every row: martingale or deviance as ``residual``; score, dfbeta or dfbetas as one column a coefficient.

        schoenfeld and scaled_schoenfeld have (id, t, one column a coefficient) of every death.
        Rows stay where they are: only the table of times is joined to them.
        """
        p = len(self.names)
        rows = self._scored()
        dead = F.col("e") > 0
        named = lambda columns: [c.alias(n) for c, n in zip(columns, self.names, strict=True)]
        m = F.col("e") - F.col("risk") * F.col("hazard")
        if kind == "martingale":
            return rows.select("id", m.alias("residual"))
        if kind == "deviance":
            inner = m + F.when(dead, F.log(F.col("risk") * F.col("hazard"))).otherwise(0.0)
            return rows.select("id", (F.signum(m) * F.sqrt(F.greatest(-2 * inner, F.lit(0.0)))).alias("residual"))
        if kind == "schoenfeld":
            return rows.where(dead).select("id", "t", *named(F.col(f"g{i}") for i in range(p)))
        v = self.model_covariance
        if kind == "scaled_schoenfeld":
            by = v * self.n_events
            return rows.where(dead).select("id", "t", *named(sum((F.col(f"g{i}") * float(by[i, j]) for i in range(p)), F.lit(float(self.coefficients[j]))) for j in range(p)))
        if kind == "score":
            return rows.select("id", *named(F.col(f"v{i}") for i in range(p)))
        if kind not in ("dfbeta", "dfbetas"):
            raise ValueError(f"unknown kind {kind}")
        if kind == "dfbetas":
            v = v / np.sqrt(np.diag(v))[None, :]
        return rows.select("id", *named(F.col("w") * sum((F.col(f"v{i}") * float(v[i, j]) for i in range(p)), F.lit(0.0)) for j in range(p)))

    def _robust(self) -> np.ndarray:
        """The sandwich of the rows' (or clusters') weighted scores."""
        p = len(self.names)
        own = self._scored().select(*(["c"] if self.clustered else []), *((F.col("w") * F.col(f"v{i}")).alias(f"v{i}") for i in range(p)))
        if self.clustered:
            own = own.groupBy("c").agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(p))).drop("c")
        meat = row_sums(own, lambda m: (m.T @ m).ravel(), p * p).reshape(p, p)
        return self.model_covariance @ meat @ self.model_covariance

    def concordance(self) -> dict[str, float]:
        """Harrell's C of the linear predictor, within strata."""
        return concordance(self.rows.withColumn("lp", self.eta()), "t", "e", "lp", weight="w", entry="u" if self.delayed else None, stratum="s", cluster="c" if self.clustered else None)

    def proportional_hazards(self, transform: str = "km") -> list[dict]:
        """Score tests (term, statistic, df, p_value) of coefficients that change with a function of time: km, identity or log; GLOBAL last."""
        p = len(self.names)
        times = self.times.where("h > 0")
        if transform == "km":
            km = survival_curve(self.rows, "t", "e", entry="u" if self.delayed else None).select("t", "surv")
            g = running(km, "t", {"before": ("min", "surv")}, before=True).select("t", (1 - F.coalesce("before", F.lit(1.0))).alias("g"))
            times = times.join(_small(g, self.n_times), "t")
        else:
            times = times.withColumn("g", {"identity": F.col("t"), "log": F.log("t")}[transform])
        flat = [f"var{i}_{j}" for i in range(p) for j in range(i + 1)]
        middle = times.agg(F.sum(F.col("g") * F.col("d")) / F.sum("d")).first()[0]

        def sums(m):
            g, u, v = m[:, 0] - middle, m[:, 1 : 1 + p], m[:, 1 + p :]
            return np.concatenate([g @ u, v.sum(0), g @ v, (g * g) @ v])

        k = len(flat)
        out = row_sums(times.select("g", *((F.col(f"sx{i}") - F.col("dw") * F.col(f"mean{i}")).alias(f"r{i}") for i in range(p)), *flat), sums, p + 3 * k)

        def square(x):
            m = np.zeros((p, p))
            m[np.tril_indices(p)] = x
            return m + m.T - np.diag(np.diag(m))

        u, (i0, i1, i2) = out[:p], (square(out[p + k * n : p + k * (n + 1)]) for n in range(3))
        rest = i2 - i1 @ np.linalg.solve(i0, i1)
        found = [{"term": n, "statistic": float(u[j] ** 2 / rest[j, j]), "df": 1} for j, n in enumerate(self.names)]
        found.append({"term": "GLOBAL", "statistic": float(u @ np.linalg.solve(rest, u)), "df": p})
        return [r | {"p_value": chi2_sf(r["statistic"], r["df"])} for r in found]


def fit_cox(df: DataFrame, time: str, event: str, predictors: list[str], *, ties: str = "efron", entry: str | None = None, weight: str | None = None, stratum: str | None = None, cluster: str | None = None, offset: str | None = None, robust: bool = False, unit: str | None = None, steps: int = 30, tol: float = 1e-9) -> CoxFit:
    """Fits by Newton steps, halved while they lose.

    Rows that lack any named column are left out, as are those that enter at or after
    their time.  ``unit`` names rows in residuals; without it they are numbered.  With a
    ``cluster`` or ``robust`` the covariance is that of the clusters' or rows' scores.
    """
    if ties not in ("efron", "breslow"):
        raise ValueError("ties must be efron or breslow")
    p = len(predictors)
    num = lambda c: F.col(c).cast("double")
    x = df.select(
        (F.col(unit) if unit else F.monotonically_increasing_id()).alias("id"), (F.col(stratum).cast("string") if stratum else F.lit("")).alias("s"), num(time).alias("t"), num(event).cast("int").alias("e"),
        (num(entry) if entry else F.lit(0.0)).alias("u"), (num(weight) if weight else F.lit(1.0)).alias("w"), (num(offset) if offset else F.lit(0.0)).alias("o"), *([F.col(cluster).alias("c")] if cluster else []), *(num(c).alias(f"x{i}") for i, c in enumerate(predictors)),
    ).na.drop()
    if entry:
        x = x.where("u < t")
    x = cut(x)
    one = x.agg(F.count("*").alias("n"), F.sum("e").alias("d"), *((F.sum(F.col("w") * F.col(f"x{i}")) / F.sum("w")).alias(f"m{i}") for i in range(p))).first()
    if not one["d"]:
        raise ValueError("there are no events")
    centre = np.array([one[f"m{i}"] for i in range(p)])
    x = x.withColumns({f"x{i}": F.col(f"x{i}") - F.lit(centre[i]) for i in range(p)})
    moments = x.select("s", "t").unionByName(x.select("s", F.col("u").alias("t"))) if entry else x.select("s", "t")
    n_times = moments.distinct().count()
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    efron = ties == "efron"
    columns = ["d", "dw", "ll", "r", "dr", *(f"sx{i}" for i in range(p)), *(f"a{i}" for i in range(p)), *(f"da{i}" for i in range(p)), *(f"b{i}_{j}" for i, j in pairs), *(f"db{i}_{j}" for i, j in pairs)]

    def risk_sets(beta: np.ndarray) -> DataFrame:
        """The sums over deaths and over rows at risk, of every time of a row or an entry."""
        eta = F.col("o") + sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(beta)), F.lit(0.0))
        rows = x.withColumn("eta", eta).withColumn("risk", F.col("w") * F.exp("eta"))
        terms = {"r": F.col("risk")} | {f"a{i}": F.col("risk") * F.col(f"x{i}") for i in range(p)} | {f"b{i}_{j}": F.col("risk") * F.col(f"x{i}") * F.col(f"x{j}") for i, j in pairs}
        dead = lambda c: F.sum(F.when(F.col("e") > 0, c).otherwise(0.0))
        each = rows.groupBy("s", "t").agg(
            dead(F.lit(1.0)).alias("d"), dead(F.col("w")).alias("dw"), dead(F.col("w") * F.col("eta")).alias("ll"), *(dead(F.col("w") * F.col(f"x{i}")).alias(f"sx{i}") for i in range(p)), *(F.sum(v).alias(k) for k, v in terms.items()), *(dead(v).alias(f"d{k}") for k, v in terms.items())
        )
        if entry:
            late = rows.groupBy("s", F.col("u").alias("t")).agg(*((-F.sum(v)).alias(k) for k, v in terms.items()))
            own = [c for c in each.columns if c not in ("s", "t")]
            each = each.unionByName(late, allowMissingColumns=True).groupBy("s", "t").agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in own))
        each = running(each, "t", {f"c_{k}": ("sum", k) for k in terms}, ("s",), descending=True, rows=n_times)
        return each.drop(*terms).withColumnsRenamed({f"c_{k}": k for k in terms}).select("s", "t", *columns)

    def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        out = row_sums(risk_sets(beta).where("d > 0").select(*columns), lambda m: _Times(m, p).totals(efron), 1 + p + p * p)
        return out[0], out[1 : 1 + p], out[1 + p :].reshape(p, p)

    beta = np.zeros(p)
    value, u, h = at(beta)
    first, score = value, float(u @ np.linalg.solve(h, u))
    for _ in range(steps):
        move, scale = np.linalg.solve(h, u), 1.0
        new = at(beta + move)
        while not new[0] >= value - tol * (abs(value) + 0.1) and scale > 1e-4:
            scale /= 2
            new = at(beta + scale * move)
        done = abs(new[0] - value) <= tol * (abs(value) + 0.1)
        beta, (value, u, h) = beta + scale * move, new
        if done:
            break
    v = np.linalg.inv(h)

    def table(batches):
        import pyarrow as pa

        for b in batches:
            m = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in columns])
            some = m[:, 0] > 0
            found = _Times(m[some], p).table(efron)
            data = {"s": b.column("s"), "t": b.column("t"), "d": m[:, 0], "dw": m[:, 1]} | {f"sx{i}": m[:, 5 + i] for i in range(p)}
            for name, of in (("h", lambda f: f["h"]), ("hd", lambda f: f["hd"]), *((f"{k}{i}", lambda f, k=k, i=i: f[k][:, i]) for k in ("bh", "bd", "mean") for i in range(p)), *((f"var{i}_{j}", lambda f, i=i, j=j: f["var"][:, i, j]) for i, j in pairs)):
                data[name] = np.zeros(len(m))
                data[name][some] = of(found)
            yield pa.RecordBatch.from_pydict({k: pa.array(c) if not isinstance(c, pa.Array) else c for k, c in data.items()})

    names = ["d", "dw", *(f"sx{i}" for i in range(p)), "h", "hd", *(f"{k}{i}" for k in ("bh", "bd", "mean") for i in range(p)), *(f"var{i}_{j}" for i, j in pairs)]
    times = cut(risk_sets(beta).mapInArrow(table, "s string, t double, " + ", ".join(f"{c} double" for c in names)))
    fit = CoxFit(predictors, beta, v, v, (float(first), float(value)), score, int(one["n"]), int(one["d"]), centre, ties, x, times, n_times, cluster is not None, entry is not None)
    if cluster or robust:
        fit.covariance = fit._robust()
    return fit


def concordance(df: DataFrame, time: str, event: str, score: str, *, weight: str | None = None, entry: str | None = None, stratum: str | None = None, cluster: str | None = None) -> dict[str, float]:
    """Harrell's C of ``score`` (higher: earlier event) with its infinitesimal-jackknife error, and the weights of concordant, discordant and tied pairs.

    A death is compared with the rows of its stratum that outlive it, or are censored at
    its time, and that had entered before.  No pairs are made: rows become cells of time
    and score, whose pairs are counted by dominance in two orders.  Rows that lack a column are
    left out, as are those that enter at or after their time.
    """
    num = lambda c: F.col(c).cast("double")
    rows = df.select(
        (F.col(stratum).cast("string") if stratum else F.lit("")).alias("g"), num(time).alias("t"), (num(event) > 0).alias("e"), num(score).alias("y"), (num(weight) if weight else F.lit(1.0)).alias("w"),
        *([num(entry).alias("u")] if entry else []), *([F.col(cluster).alias("c")] if cluster else []),
    ).na.drop()
    if entry:
        rows = rows.where("u < t")
    # at one time deaths come before those censored; an entry at a death's time is too late for it
    rows = cut(rows.withColumn("k", F.when(F.col("e"), 0).otherwise(1)))
    one = F.lit(0.0)
    cells = rows.select("g", "t", "k", "y", "w", F.when(F.col("e"), F.col("w")).otherwise(one).alias("v"))
    if entry:
        cells = cells.unionByName(rows.select("g", F.col("u").alias("t"), F.lit(1).alias("k"), "y", (-F.col("w")).alias("w"), one.alias("v")))
    cells = cells.groupBy("g", "t", "k", "y").agg(F.sum("w").alias("w"), F.sum("v").alias("v"))
    counted = cut(dominance(cells, ["t", "k"], "y", "w", "v", ("g",)))
    of = counted.select("g", "t", "k", "y", "after_less", "after_equal", "after_more", "before_less", "before_equal", "before_more")
    deaths = counted.where("v > 0").agg(*(F.coalesce(F.sum(F.col("v") * F.col(c)), one) for c in ("after_less", "after_more", "after_equal"))).first()
    concordant, discordant, tied = deaths
    usable = concordant + discordant + tied
    if usable <= 0:
        return {"concordance": float("nan"), "std_error": float("nan"), "concordant": 0.0, "discordant": 0.0, "tied": 0.0}
    somers = (concordant - discordant) / usable
    joined = rows.join(of, ["g", "t", "k", "y"])
    if entry:
        late = of.select("g", F.col("t").alias("u"), F.col("k").alias("ku"), "y", *(F.col(f"before_{c}").alias(f"late_{c}") for c in ("less", "equal", "more")))
        joined = joined.withColumn("ku", F.lit(1)).join(late, ["g", "u", "ku", "y"])
    was = lambda c: F.col(f"before_{c}") - (F.col(f"late_{c}") if entry else one)
    own = lambda c: F.when(F.col("e"), F.col(f"after_{c}")).otherwise(one)
    good, bad, even = own("less") + was("more"), own("more") + was("less"), own("equal") + was("equal")
    influence = joined.select(*(["c"] if cluster else []), (F.col("w") / (2 * usable) * (good - bad - (good + bad + even) * somers)).alias("i"))
    if cluster:
        influence = influence.groupBy("c").agg(F.sum("i").alias("i"))
    spread = influence.agg(F.sum(F.col("i") * F.col("i"))).first()[0]
    return {"concordance": (concordant + tied / 2) / usable, "std_error": float(np.sqrt(spread)), "concordant": concordant, "discordant": discordant, "tied": tied}
