"""Survival estimates.  Rows are summed by group and time first; windows then run over distinct times."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.functions.dist import chi2_sf, norm_ppf
from quillstat.plans.ordered import running


def risk_table(df: DataFrame, time: str, event: str, by: str | None = None, weight: str | None = None, entry: str | None = None) -> DataFrame:
    """(grp, t, d, c, n): events, censorings and rows at risk (entry < t <= time) at each time.

    A sweep of +1 and -1: rows enter just after ``entry`` and leave at ``time``.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    g = F.col(by) if by else F.lit("all")
    t, e = F.col(time).cast("double"), F.col(event).cast("int")
    have = df.select(g.alias("grp"), t.alias("t"), e.alias("e"), w.alias("w"), *([F.col(entry).cast("double").alias("s")] if entry else [])).where("t is not null and e is not null and w is not null and not isnan(t)")
    out = have.groupBy("grp", "t").agg(F.sum(F.when(F.col("e") > 0, F.col("w")).otherwise(0.0)).alias("d"), F.sum("w").alias("leave"))
    if entry:
        enter = have.groupBy("grp", F.col("s").alias("t")).agg(F.sum("w").alias("enter"))
        both = out.withColumn("enter", F.lit(0.0)).unionByName(enter.select("grp", "t", F.lit(None).cast("double").alias("d"), F.lit(0.0).alias("leave"), "enter"))
        each = both.groupBy("grp", "t").agg(F.sum("d").alias("d"), F.sum("leave").alias("leave"), F.sum("enter").alias("enter"))
        each = running(each, "t", {"__in": ("sum", "enter"), "__out": ("sum", "leave")}, ("grp",), before=True)
        each = each.withColumn("n", F.coalesce("__in", F.lit(0.0)) - F.coalesce("__out", F.lit(0.0)))
        return each.where("d is not null").select("grp", "t", "d", (F.col("leave") - F.col("d")).alias("c"), "n")
    return running(out, "t", {"n": ("sum", "leave")}, ("grp",), descending=True).select("grp", "t", "d", (F.col("leave") - F.col("d")).alias("c"), "n")


def survival_curve(df: DataFrame, time: str, event: str, by: str | None = None, *, weight: str | None = None, entry: str | None = None, kind: str = "kaplan_meier", conf: str = "log", level: float = 0.95) -> DataFrame:
    """(grp, t, n, d, surv, std_error, lower, upper), or ``cumhaz`` for ``kind="nelson_aalen"``.

    Standard errors by Greenwood (of the survival) or Aalen (of the hazard);
    none once the survival is 0.  ``conf``: log, log-log, plain or logit.
    """
    r = risk_table(df, time, event, by, weight, entry)
    z = norm_ppf(1 - (1 - level) / 2)
    d, n = F.col("d"), F.col("n")
    if kind == "nelson_aalen":
        r = running(r.withColumns({"__h": d / n, "__v": d / (n * n)}), "t", {"cumhaz": ("sum", "__h"), "__var": ("sum", "__v")}, ("grp",)).withColumn("std_error", F.sqrt("__var"))
        h, se = F.col("cumhaz"), F.col("std_error")
        return r.select("grp", "t", "n", "d", "cumhaz", "std_error", F.greatest(h - z * se, F.lit(0.0)).alias("lower"), (h + z * se).alias("upper"))
    r = r.withColumns({"__p": 1 - d / n, "__g": F.when(n > d, d / (n * (n - d))).otherwise(0.0), "__z": (d >= n) & (d > 0)})
    r = running(r, "t", {"surv": ("product", "__p"), "gw": ("sum", "__g"), "zero": ("max", "__z")}, ("grp",))
    s, root = F.col("surv"), F.sqrt("gw")
    if conf == "log":
        lo, hi = s * F.exp(-z * root), F.least(s * F.exp(z * root), F.lit(1.0))
    elif conf == "plain":
        lo, hi = F.greatest(s - z * s * root, F.lit(0.0)), F.least(s + z * s * root, F.lit(1.0))
    elif conf == "log-log":
        k = F.when((s < 1) & (s > 0), root / F.log(s))
        lo, hi = F.pow(s, F.exp(-z * k)), F.pow(s, F.exp(z * k))
    elif conf == "logit":
        k, q = F.when(s < 1, root / (1 - s)), F.log(s / (1 - s))
        lo, hi = 1 / (1 + F.exp(-(q - z * k))), 1 / (1 + F.exp(-(q + z * k)))
    else:
        raise ValueError(f"unknown conf {conf}")
    live = lambda c: F.when(~F.col("zero"), c)
    return r.select("grp", "t", "n", "d", "surv", live(s * root).alias("std_error"), live(lo).alias("lower"), live(hi).alias("upper"))


def curve_at(curve: DataFrame, times: list[float], value: str = "surv", start: float = 1.0) -> DataFrame:
    """(grp, at, value): the step function at given times, by the last time not after each."""
    last = [F.max(F.when(F.col("t") <= float(x), F.struct("t", F.col(value).alias("v"))))["v"].alias(f"v{i}") for i, x in enumerate(times)]
    rows = F.array(*(F.struct(F.lit(float(x)).alias("at"), F.coalesce(F.col(f"v{i}"), F.lit(start)).alias(value)) for i, x in enumerate(times)))
    return curve.groupBy("grp").agg(*last).select("grp", F.explode(rows).alias("r")).select("grp", "r.*")


def curve_quantile(curve: DataFrame, q: float = 0.5) -> DataFrame:
    """(grp, time, lower, upper): the first time at which the survival is at most ``q``, and the same of its limits; null if never.

    Where a curve equals ``q`` over a stretch of time, the middle of the stretch counts.
    """
    tol = 1e-8 * max(1.0, abs(q))
    at = lambda c, d: F.min(F.when(F.col(c) <= q + d, F.col("t")))
    firsts = curve.groupBy("grp").agg(*(x for c in ("surv", "lower", "upper") for x in (at(c, tol).alias(f"{c}_at"), at(c, -tol - 1e-15).alias(f"{c}_below"))))
    mid = lambda c: F.when(F.col(f"{c}_below") > F.col(f"{c}_at"), (F.col(f"{c}_at") + F.col(f"{c}_below")) / 2).otherwise(F.col(f"{c}_at"))
    return firsts.select("grp", mid("surv").alias("time"), mid("lower").alias("lower"), mid("upper").alias("upper"))


def rmst(df: DataFrame, time: str, event: str, tau: float, by: str | None = None) -> DataFrame:
    """(grp, rmst, variance): the area under the Kaplan-Meier curve up to ``tau``; of a group without times before it, ``tau`` and 0."""
    curve = survival_curve(df, time, event, by)
    c = curve.where(F.col("t") <= tau)
    # the next time, and the area from each time on
    c = running(c, "t", {"__next": ("min", "t")}, ("grp",), descending=True, before=True)
    c = c.withColumn("__area", (F.coalesce("__next", F.lit(float(tau))) - F.col("t")) * F.col("surv"))
    c = running(c, "t", {"tail": ("sum", "__area")}, ("grp",), descending=True)
    n, d = F.col("n"), F.col("d")
    out = c.groupBy("grp").agg(
        (F.min("t") + F.sum("__area")).alias("rmst"),
        F.sum(F.when(n > d, F.pow("tail", 2) * d / (n * (n - d))).otherwise(0.0)).alias("variance"),
    )
    every = curve.select("grp").distinct()
    return every.join(out, "grp", "left").select("grp", F.coalesce("rmst", F.lit(float(tau))).alias("rmst"), F.coalesce("variance", F.lit(0.0)).alias("variance"))


def log_rank_table(df: DataFrame, time: str, event: str, by: str, *, strata: str | None = None, rho: float = 0.0) -> DataFrame:
    """(grp, n, observed, expected): weighted by S(t-)**rho, summed over strata."""
    x = df.withColumn("__s", F.col(strata).cast("string") if strata else F.lit(""))
    each = x.groupBy("__s", F.col(by).alias("grp"), F.col(time).cast("double").alias("t")).agg(F.sum(F.col(event).cast("int")).alias("d"), F.count("*").alias("m"))
    total = each.groupBy("__s", "t").agg(F.sum("d").alias("dt"), F.sum("m").alias("mt"))
    total = _weighted(running(total, "t", {"nt": ("sum", "mt")}, ("__s",), descending=True), "dt", "nt", rho)
    # a group's rows at risk at t are those of its own times from t on: sum dt/nt over times up to each row's time
    cum = running(total.withColumn("__h", F.col("weight") * F.col("dt") / F.col("nt")), "t", {"h": ("sum", "__h")}, ("__s",))
    rows = each.join(cum.select("__s", "t", "h", "weight"), ["__s", "t"])
    return rows.groupBy("grp").agg(F.sum("m").alias("n"), F.sum(F.col("weight") * F.col("d")).alias("observed"), F.sum(F.col("m") * F.col("h")).alias("expected"))


def _weighted(total: DataFrame, d: str, n: str, rho: float) -> DataFrame:
    """``total`` with ``weight``, the power of the survival just before each time."""
    if not rho:
        return total.withColumn("weight", F.lit(1.0))
    total = running(total.withColumn("__p", 1 - F.col(d) / F.col(n)), "t", {"__before": ("product", "__p")}, ("__s",), before=True)
    return total.withColumn("weight", F.pow(F.coalesce("__before", F.lit(1.0)), rho))


def log_rank(df: DataFrame, time: str, event: str, by: str, *, strata: str | None = None, rho: float = 0.0) -> tuple[float, int, float]:
    """Statistic, degrees of freedom and p value of the (stratified, Fleming-Harrington) log-rank test."""
    import numpy as np

    x = df.withColumn("__s", F.col(strata).cast("string") if strata else F.lit("")).withColumn("__g", F.col(by).cast("string"))
    groups = sorted(r[0] for r in x.select("__g").distinct().collect())
    aggs = [F.sum(F.col(event).cast("int")).alias("d")] + [F.count_if(F.col("__g") == g).alias(f"m{i}") for i, g in enumerate(groups)] + [F.sum(F.when(F.col("__g") == g, F.col(event).cast("int")).otherwise(0)).alias(f"d{i}") for i, g in enumerate(groups)]
    each = x.groupBy("__s", F.col(time).cast("double").alias("t")).agg(*aggs)
    each = running(each, "t", {f"n{i}": ("sum", f"m{i}") for i in range(len(groups))}, ("__s",), descending=True)
    each = each.withColumn("n", sum((F.col(f"n{i}") for i in range(len(groups))), F.lit(0)))
    each = _weighted(each, "d", "n", rho).withColumnRenamed("weight", "w").where("d > 0")
    k = len(groups)
    share = lambda i: F.col(f"n{i}") / F.col("n")
    spread = F.pow("w", 2) * F.col("d") * F.when(F.col("n") > 1, (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)
    out = each.agg(
        *(F.sum(F.col("w") * (F.col(f"d{i}") - F.col("d") * share(i))).alias(f"u{i}") for i in range(k)),
        *(F.sum(spread * share(i) * ((1.0 if i == j else 0.0) - share(j))).alias(f"v{i}_{j}") for i in range(k) for j in range(k)),
    ).first()
    u, v = np.array([out[f"u{i}"] for i in range(k)]), np.array([[out[f"v{i}_{j}"] for j in range(k)] for i in range(k)])
    stat = float(u[1:] @ np.linalg.pinv(v[1:, 1:]) @ u[1:])
    return stat, k - 1, chi2_sf(stat, k - 1)


def cumulative_incidence(df: DataFrame, time: str, cause: str, by: str | None = None) -> DataFrame:
    """(grp, t, cause, cif): Aalen-Johansen estimates; cause 0 is censoring."""
    g = F.col(by) if by else F.lit("all")
    x = df.select(g.alias("grp"), F.col(time).cast("double").alias("t"), F.col(cause).cast("int").alias("k"))
    each = x.groupBy("grp", "t").agg(F.count_if(F.col("k") > 0).alias("d"), F.count("*").alias("m"))
    each = running(each, "t", {"n": ("sum", "m")}, ("grp",), descending=True).withColumn("__p", 1 - F.col("d") / F.col("n"))
    each = running(each, "t", {"before": ("product", "__p")}, ("grp",), before=True).withColumn("before", F.coalesce("before", F.lit(1.0)))
    causes = x.where("k > 0").groupBy("grp", "t", F.col("k").alias("cause")).agg(F.count("*").alias("dk"))
    step = causes.join(each, ["grp", "t"]).withColumn("jump", F.col("before") * F.col("dk") / F.col("n"))
    return running(step, "t", {"cif": ("sum", "jump")}, ("grp", "cause")).select("grp", "t", "cause", "cif")


def split_follow_up(df: DataFrame, time: str, event: str, cuts: list[float], start: str = "tstart", stop: str = "tstop") -> DataFrame:
    """Rows split at ``cuts``: one row for each interval of follow-up, the event in the last."""
    edges = F.array(F.lit(0.0), *(F.lit(float(c)) for c in sorted(cuts)), F.lit(math.inf))
    out = df.select("*", F.posexplode(F.slice(edges, 1, len(cuts) + 1)).alias("__i", start)).where(F.col(start) < F.col(time))
    ends = F.least(F.col(time).cast("double"), F.get(edges, F.col("__i") + 1))
    return out.withColumn(stop, ends).withColumn(event, F.when(F.col(stop) == F.col(time), F.col(event)).otherwise(F.lit(0)).cast(df.schema[event].dataType)).drop("__i")


def at_risk(df: DataFrame, time: str, times: list[float], by: str) -> DataFrame:
    """(grp, at, n): rows with time >= at."""
    return df.groupBy(F.col(by).alias("grp")).agg(*(F.count_if(F.col(time) >= x).alias(f"n{i}") for i, x in enumerate(times))).select("grp", F.explode(F.array(*(F.struct(F.lit(float(x)).alias("at"), F.col(f"n{i}").alias("n")) for i, x in enumerate(times)))).alias("r")).select("grp", "r.*")


def cox_ph(df: DataFrame, time: str, event: str, predictors: list[str], ties: str = "efron", steps: int = 20, tol: float = 1e-9, stratum: str | None = None):
    """Cox regression: (names, coefficients, covariance, log-likelihoods at 0 and at the fit).

    A Newton step sums exp(eta), its products with the predictors and their
    products by time on the executors; running sums over the times give the
    risk sets, so only sums by distinct time meet in a window.
    """
    import numpy as np

    p = len(predictors)
    x = df.select(F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), (F.col(stratum).cast("string") if stratum else F.lit("")).alias("s"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(predictors))).na.drop().persist()
    held = x
    centre = x.agg(*(F.avg(f"x{i}").alias(f"m{i}") for i in range(p))).first()
    x = x.withColumns({f"x{i}": F.col(f"x{i}") - F.lit(centre[i]) for i in range(p)})
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    beta, first, last = np.zeros(p), None, None
    for _ in range(steps + 1):
        eta = sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(beta)), F.lit(0.0))
        terms = {"r": F.exp(eta)} | {f"a{i}": F.exp(eta) * F.col(f"x{i}") for i in range(p)} | {f"b{i}_{j}": F.exp(eta) * F.col(f"x{i}") * F.col(f"x{j}") for i, j in pairs}
        dead = F.col("e") > 0
        each = x.groupBy("s", "t").agg(F.count_if(dead).alias("d"), F.sum(F.when(dead, eta).otherwise(0.0)).alias("ll"), *(F.sum(F.when(dead, F.col(f"x{i}")).otherwise(0.0)).alias(f"sx{i}") for i in range(p)), *(F.sum(v).alias(k) for k, v in terms.items()), *(F.sum(F.when(dead, v).otherwise(0.0)).alias(f"d_{k}") for k, v in terms.items()))
        each = running(each, "t", {f"c_{k}": ("sum", k) for k in terms}, ("s",), descending=True).drop(*terms).withColumnsRenamed({f"c_{k}": k for k in terms}).where("d > 0")
        if ties == "efron":  # a row for each event of a tie, made from short arrays however many they are
            each = each.withColumn("f", F.explode(F.sequence(F.lit(0).cast("long"), F.col("d") - 1, F.lit(1000).cast("long"))))
            each = each.withColumn("f", F.explode(F.sequence(F.col("f"), F.least(F.col("f") + 999, F.col("d") - 1)))).withColumn("f", F.col("f") / F.col("d"))
        else:
            each = each.withColumn("f", F.lit(0.0))
        times = F.lit(1.0) if ties == "efron" else F.col("d").cast("double")
        share = F.lit(1.0) / F.col("d") if ties == "efron" else F.lit(1.0)
        v = {k: F.col(k) - F.col("f") * F.col(f"d_{k}") for k in terms}
        out = each.agg(
            F.sum(F.col("ll") * share - times * F.log(v["r"])).alias("ll"),
            *(F.sum(F.col(f"sx{i}") * share - times * v[f"a{i}"] / v["r"]).alias(f"u{i}") for i in range(p)),
            *(F.sum(times * (v[f"b{i}_{j}"] / v["r"] - v[f"a{i}"] * v[f"a{j}"] / (v["r"] * v["r"]))).alias(f"h{i}_{j}") for i, j in pairs),
        ).first()
        u = np.array([out[f"u{i}"] for i in range(p)])
        h = np.zeros((p, p))
        for i, j in pairs:
            h[i, j] = h[j, i] = out[f"h{i}_{j}"]
        first = out["ll"] if first is None else first
        done = last is not None and abs(out["ll"] - last) <= tol * (abs(out["ll"]) + 0.1)
        last = out["ll"]
        if done:
            break
        beta = beta + np.linalg.solve(h, u)
    held.unpersist()
    return predictors, beta, np.linalg.inv(h), (first, last)
