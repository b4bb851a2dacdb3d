"""Competing risks: Fine-Gray regression with its sandwich, the expanded rows, and Gray's test.

A row that failed of another cause stays at risk with a weight that falls as censoring
goes on.  The weight is a product over times of a quotient of the censoring curve at two
times, so risk sets are two running sums, one over rows still under observation and one over
those that failed otherwise, and no row is ever expanded to fit the model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.functions.dist import chi2_sf, norm_ppf
from quillstat.plans.newton import row_sums
from quillstat.plans.ordered import ONE_TASK, cut, running


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= ONE_TASK else df


def _zero(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0))


@dataclass
class FineGrayFit:
    """A fitted model; ``baseline`` has (t, jump, cumhaz) of the subdistribution hazard at predictors of 0."""

    names: list[str]
    coefficients: np.ndarray
    covariance: np.ndarray
    loglik: tuple[float, float]
    n: int
    n_events: int
    baseline: DataFrame

    def tidy(self, level: float = 0.95, exponentiate: bool = False) -> list[dict]:
        """term, estimate, std_error, statistic, p_value and limits."""
        z = norm_ppf(1 - (1 - level) / 2)
        of = (lambda x: float(np.exp(x))) if exponentiate else float
        return [
            {"term": n, "estimate": of(b), "std_error": float(se), "statistic": float(b / se), "p_value": chi2_sf(float(b / se) ** 2, 1), "lower": of(b - z * se), "upper": of(b + z * se)}
            for n, b, se in zip(self.names, self.coefficients, np.sqrt(np.diag(self.covariance)), strict=True)
        ]

    def glance(self) -> dict[str, float]:
        stat = 2 * (self.loglik[1] - self.loglik[0])
        return {"n": self.n, "n_events": self.n_events, "loglik_null": self.loglik[0], "loglik": self.loglik[1], "statistic": stat, "df": len(self.names), "p_value": chi2_sf(stat, len(self.names))}

    def predict(self, df: DataFrame, times: list[float]) -> DataFrame:
        """``df`` with ``at`` and ``cif``, the cumulative incidence of the cause at each of ``times``; null where a predictor is missing."""
        lp = sum((F.lit(float(b)) * F.col(c).cast("double") for b, c in zip(self.coefficients, self.names, strict=True)), F.lit(0.0))
        sums = self.baseline.agg(*(_zero(F.sum(F.when(F.col("t") <= x, F.col("jump")))).alias(f"h{i}") for i, x in enumerate(times))).first()
        at = F.array(*(F.struct(F.lit(float(x)).alias("at"), F.lit(float(sums[f"h{i}"])).alias("h")) for i, x in enumerate(times)))
        return df.withColumn("__a", F.explode(at)).select(*(F.col(f"`{c}`") for c in df.columns), F.col("__a.at").alias("at"), (1 - F.exp(-F.col("__a.h") * F.exp(lp))).alias("cif"))


def fine_gray_regression(df: DataFrame, time: str, event: str, predictors: list[str], *, cause: int = 1, censor: int = 0, censor_group: str | None = None, steps: int = 30, tol: float = 1e-9) -> FineGrayFit:
    """Proportional subdistribution hazards of ``cause``; events of code ``censor`` are censored, ties as Breslow.

    The censoring curve is estimated within each ``censor_group``; past its last row a group
    has no weight.  Rows that lack a named column are left out.
    """
    p = len(predictors)
    num = lambda c: F.col(c).cast("double")
    code = F.when(F.col(event) == cause, 1).when(F.col(event) == censor, 0).when(F.col(event).isNotNull(), 2)
    x = df.select((F.col(censor_group).cast("string") if censor_group else F.lit("")).alias("k"), num(time).alias("t"), code.alias("e"), *(num(c).alias(f"x{i}") for i, c in enumerate(predictors))).na.drop()
    x = cut(x)
    one = x.agg(F.count("*").alias("n"), F.count_if(F.col("e") == 1).alias("d"), *(F.avg(f"x{i}").alias(f"m{i}") for i in range(p))).first()
    if not one["d"]:
        raise ValueError("there are no events of the cause")
    centre = np.array([one[f"m{i}"] for i in range(p)])
    x = x.withColumns({f"x{i}": F.col(f"x{i}") - F.lit(float(centre[i])) for i in range(p)})
    curve, n_times = _censoring(x)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    terms = ["r", *(f"a{i}" for i in range(p)), *(f"b{i}_{j}" for i, j in pairs)]
    columns = ["d", *(f"sx{i}" for i in range(p)), *terms]

    def cells(beta: np.ndarray) -> DataFrame:
        """Of every group and time of ``curve``: deaths, and the sums of rows at risk and of weighted rows of other causes before it."""
        eta = sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(beta)), F.lit(0.0))
        rows = x.withColumn("risk", F.exp(eta))
        of = {"r": F.col("risk")} | {f"a{i}": F.col("risk") * F.col(f"x{i}") for i in range(p)} | {f"b{i}_{j}": F.col("risk") * F.col(f"x{i}") * F.col(f"x{j}") for i, j in pairs}
        when = lambda k, c: F.sum(F.when(F.col("e") == k, c).otherwise(0.0))
        each = rows.groupBy("k", "t").agg(when(1, F.lit(1.0)).alias("d"), *(when(1, F.col(f"x{i}")).alias(f"sx{i}") for i in range(p)), *(F.sum(c).alias(n) for n, c in of.items()), *(when(2, c).alias(f"o_{n}") for n, c in of.items()))
        each = curve.join(each, ["k", "t"], "left")
        # a row of another cause has, from then on, the curve at each time over that at its own
        each = each.withColumns({c: _zero(c) for c in ["d", *(f"sx{i}" for i in range(p)), *terms]} | {f"o_{n}": _zero(F.col(f"o_{n}") / F.col("own")) for n in terms})
        each = running(each, "t", {f"at_{n}": ("sum", n) for n in terms}, ("k",), descending=True, rows=n_times)
        return running(each, "t", {f"past_{n}": ("sum", f"o_{n}") for n in terms}, ("k",), before=True, rows=n_times)

    def risk_sets(each: DataFrame) -> DataFrame:
        whole = [F.sum(F.col(f"at_{n}") + F.col("g") * _zero(f"past_{n}")).alias(n) for n in terms]
        return each.groupBy("t").agg(*(F.sum(c).alias(c) for c in columns if c not in terms), *whole).where("d > 0")

    def totals(m: np.ndarray) -> np.ndarray:
        d, sx, r, a = m[:, 0], m[:, 1 : 1 + p], m[:, 1 + p], m[:, 2 + p : 2 + 2 * p]
        b = np.zeros((len(m), p, p))
        i, j = np.tril_indices(p)
        b[:, i, j] = b[:, j, i] = m[:, 2 + 2 * p :]
        mean = a / r[:, None]
        h = np.tensordot(d, b / r[:, None, None] - mean[:, :, None] * mean[:, None, :], 1)
        return np.concatenate([[-(d @ np.log(r))], (sx - d[:, None] * mean).sum(0), h.ravel(), sx.sum(0)])

    def at(beta: np.ndarray):
        out = row_sums(risk_sets(cells(beta)).select(*columns), totals, 1 + 2 * p + p * p)
        return out[0] + out[-p:] @ beta, out[1 : 1 + p], out[1 + p : 1 + p + p * p].reshape(p, p)

    beta = np.zeros(p)
    value, u, h = at(beta)
    first = value
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
    each = cut(cells(beta))
    sets = cut(risk_sets(each).select("t", (F.col("d") / F.col("r")).alias("jump"), "r", *((F.col(f"a{i}") / F.col("r")).alias(f"mean{i}") for i in range(p))))
    meat = _meat(x, each, sets, beta, n_times)
    v = np.linalg.inv(h)
    scale = float(np.exp(-centre @ beta))
    jumps = sets.select("t", (F.col("jump") * scale).alias("jump"))
    baseline = running(jumps, "t", {"cumhaz": ("sum", "jump")}, rows=n_times)
    return FineGrayFit(predictors, beta, v @ meat @ v, (float(first), float(value)), int(one["n"]), int(one["d"]), baseline)


def _censoring(x: DataFrame) -> tuple[DataFrame, int]:
    """(k, t, m, c, n, own, g) of each group at its own times and at all event times, and how many rows that are.

    Rows, censored rows and rows at risk; the censoring curve just before the time, as
    ``own`` for rows of the group and as ``g``, which is 0 past its last row.
    """
    own = x.groupBy("k", "t").agg(F.count("*").alias("m"), F.count_if(F.col("e") == 0).alias("c"))
    events = x.where("e = 1").select("t").distinct()
    last = cut(x.groupBy("k").agg(F.max("t").alias("last")))
    every = events.join(F.broadcast(last.select("k")), F.lit(True)).select("k", "t")
    both = own.unionByName(every.select("k", "t", F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("c"))).groupBy("k", "t").agg(F.sum("m").alias("m"), F.sum("c").alias("c"))
    both = cut(both)
    n = both.count()
    both = running(both, "t", {"n": ("sum", "m")}, ("k",), descending=True, rows=n)
    both = both.withColumn("stay", F.when(F.col("c") > 0, 1 - F.col("c") / F.col("n")).otherwise(1.0))
    both = running(both, "t", {"before": ("product", "stay")}, ("k",), before=True, rows=n)
    both = both.join(F.broadcast(last), "k").withColumn("own", F.coalesce("before", F.lit(1.0)))
    both = both.withColumn("g", F.when(F.col("t") <= F.col("last"), F.col("own")).otherwise(0.0))
    return cut(both.select("k", "t", "m", "c", "n", "own", "g")), n


def _meat(x: DataFrame, each: DataFrame, sets: DataFrame, beta: np.ndarray, n_times: int) -> np.ndarray:
    """The sum of squares of the rows' scores, with what each adds through the estimated censoring curve."""
    p = len(beta)
    of = lambda name: [f"{name}{i}" for i in range(p)]
    # by group and time: hazards, weighted by the curve for those who failed otherwise, of all and of the group's own events
    t = each.select("k", "t", "c", "n", "own", "g", "d", _zero("past_r").alias("past"), *(_zero(f"past_a{i}").alias(f"pasta{i}") for i in range(p)))
    t = t.join(_small(sets, n_times), "t", "left")
    jump, mean = _zero("jump"), [_zero(m) for m in of("mean")]
    inc = F.when(F.col("d") > 0, F.col("g") * F.col("d") / F.col("r")).otherwise(0.0)
    made = {"j": jump, "w": F.col("g") * jump, "q": inc}
    made |= {f"j{i}": jump * mean[i] for i in range(p)} | {f"w{i}": F.col("g") * jump * mean[i] for i in range(p)} | {f"q{i}": inc * mean[i] for i in range(p)}
    t = t.withColumns(made)
    t = running(t, "t", {f"upto_{c}": ("sum", c) for c in ("j", *of("j"))}, ("k",), rows=n_times)
    t = running(t, "t", {f"after_{c}": ("sum", c) for c in ("w", *of("w"))}, ("k",), descending=True, before=True, rows=n_times)
    t = running(t, "t", {f"from_{c}": ("sum", c) for c in ("q", *of("q"))}, ("k",), descending=True, rows=n_times)
    # at a time of censoring: what its rows at risk share of the weights of those who failed otherwise before
    share = [F.when(F.col("c") > 0, (F.col(f"pasta{i}") * F.col("from_q") - F.col("past") * F.col(f"from_q{i}")) / F.col("n")).otherwise(0.0) for i in range(p)]
    t = t.withColumns({f"s{i}": share[i] for i in range(p)})
    t = t.withColumns({f"z{i}": F.when(F.col("c") > 0, F.col(f"s{i}") * F.col("c") / F.col("n")).otherwise(0.0) for i in range(p)})
    t = running(t, "t", {f"upto_z{i}": ("sum", f"z{i}") for i in range(p)}, ("k",), rows=n_times)
    t = cut(t.select("k", "t", "own", "upto_j", _zero("after_w").alias("after_w"), *(f"upto_j{i}" for i in range(p)), *(_zero(f"after_w{i}").alias(f"after_w{i}") for i in range(p)), *of("mean"), *of("s"), *(f"upto_z{i}" for i in range(p))))
    rows = x.join(_small(t, n_times), ["k", "t"])
    risk = F.exp(sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(beta)), F.lit(0.0)))
    other = lambda c: F.when(F.col("e") == 2, F.col(c) / F.col("own")).otherwise(0.0)
    score = []
    for i in range(p):
        whole = F.col(f"x{i}") * (F.col("upto_j") + other("after_w")) - (F.col(f"upto_j{i}") + other(f"after_w{i}"))
        censored = F.when(F.col("e") == 0, F.col(f"s{i}")).otherwise(0.0) - F.col(f"upto_z{i}")
        score.append((F.when(F.col("e") == 1, F.col(f"x{i}") - F.col(f"mean{i}")).otherwise(0.0) - risk * whole + censored).alias(f"u{i}"))
    return row_sums(rows.select(*score), lambda m: (m.T @ m).ravel(), p * p).reshape(p, p)


def fine_gray_rows(df: DataFrame, time: str, event: str, cause: int = 1, entry: str | None = None) -> DataFrame:
    """``df`` without its time, event and entry, as weighted rows (fgstart, fgstop, fgstatus, fgwt) for a Cox model.

    A row that failed of another cause goes on in pieces between the times at which the
    censoring curve falls, weighted by the curve over its value at the failure; pieces in
    which nobody fails of the cause are left out.  Event 0 is censored.  The pieces of a row
    are made from one array of such times, which is as long as there are pieces of a
    row that fails at once; rows that lack a time, event or entry are left out.
    """
    have = df.select("*", F.col(time).cast("double").alias("__t"), F.col(event).cast("int").alias("__e"), *([F.col(entry).cast("double").alias("__u")] if entry else []))
    for c in have.columns[len(df.columns) :]:
        have = have.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    have = cut(have)
    least, last = have.agg(F.min("__t"), F.max("__t")).first()
    start = F.col("__u") if entry else F.lit(0.0 if least is None or least > 0 else 2 * least - 1)
    # of those censored and those who go on: at a tie, failures have left before
    leave = have.groupBy(F.col("__t").alias("t")).agg(F.count_if(F.col("__e") == 0).alias("c"), F.count_if(F.col("__e") != 0).alias("f"), F.max((F.col("__e") == cause).cast("int")).alias("hit"))
    enter = have.groupBy(start.alias("t")).agg(F.count("*").alias("in"))
    line = leave.join(enter, "t", "full_outer").select("t", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("c", "f", "hit", "in")))
    line = running(line, "t", {"left": ("sum", "c"), "gone": ("sum", "f")}, before=True)
    line = running(line, "t", {"came": ("sum", "in")}, before=True)
    n = F.coalesce("came", F.lit(0)) - F.coalesce("left", F.lit(0)) - F.coalesce("gone", F.lit(0)) - F.col("f")
    line = line.withColumn("stay", F.when((F.col("c") > 0) & (n > 0), 1 - F.col("c") / n).otherwise(1.0)).withColumn("edge", F.when(F.col("c") > 0, F.col("t")))
    line = running(line, "t", {"g": ("product", "stay"), "piece": ("max", "edge")})
    line = running(line, "t", {"g_before": ("product", "stay"), "lo": ("max", "edge")}, before=True)
    line = cut(line.select("t", "c", "hit", "g", F.coalesce("g_before", F.lit(1.0)).alias("g_before"), "lo"))
    # pieces (lo, hi] between two falls with a failure of the cause inside; the last ends with the last row
    ends = line.where("hit = 1 and lo is not null").groupBy("lo").agg(F.max("t").alias("inside"))
    falls = line.where("c > 0").select(F.col("t").alias("lo"), "g")
    ahead = running(falls.withColumn("next", F.col("lo")), "lo", {"hi": ("min", "next")}, descending=True, before=True)
    pieces = ahead.join(ends, "lo").select("lo", F.coalesce("hi", F.lit(float(last or 0.0))).alias("hi"), "g")
    listed = pieces.agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "g"))).alias("__pieces"))
    first = running(line.withColumn("edge", F.when(F.col("c") > 0, F.col("t"))), "t", {"stop": ("min", "edge")}, descending=True).select(F.col("t").alias("__t"), F.coalesce("stop", F.lit(float(last or 0.0))).alias("__stop"), "g_before")
    rows = have.join(first, "__t").join(F.broadcast(listed))
    lives = (F.col("__e") == 0) | (F.col("__e") == cause)
    own = F.struct(start.alias("fgstart"), F.when(lives, F.col("__t")).otherwise(F.col("__stop")).alias("fgstop"), F.when(F.col("__e") == cause, 1.0).otherwise(0.0).alias("fgstatus"), F.lit(1.0).alias("fgwt"))
    later = F.transform(F.filter("__pieces", lambda q: q["lo"] >= F.col("__stop")), lambda q: F.struct(q["lo"].alias("fgstart"), q["hi"].alias("fgstop"), F.lit(0.0).alias("fgstatus"), (q["g"] / F.col("g_before")).alias("fgwt")))
    every = F.when(lives, F.array(own)).otherwise(F.concat(F.array(own), later))
    return rows.select(*(F.col(f"`{c}`") for c in df.columns if c not in (time, event, entry)), F.inline(every))


def gray_test(df: DataFrame, time: str, event: str, by: str, *, strata: str | None = None, rho: float = 0.0, causes: list[int] | None = None) -> list[dict]:
    """(cause, statistic, df, p_value): equality of the groups' cumulative incidences of each cause.

    Event 0 is censored.  Scores and their variance are sums over the failure times of sums
    and products by group up to or after each, so the groups (a column for each two) are
    few and the times as many as there are.  Rows that lack a column are left out.
    """
    x = df.select((F.col(strata).cast("string") if strata else F.lit("")).alias("s"), F.col(by).cast("string").alias("k"), F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e")).na.drop()
    x = cut(x)
    names = sorted(r[0] for r in x.select("k").distinct().collect())
    if causes is None:
        causes = sorted(r[0] for r in x.where("e <> 0").select("e").distinct().collect())
    return [_gray(x, names, c, rho) for c in causes]


def _gray(x: DataFrame, names: list[str], cause: int, rho: float) -> dict:
    m = range(len(names))
    own = lambda i: F.col("k") == names[i]
    t = x.groupBy("s", "t").agg(
        *(F.count_if(own(i)).cast("double").alias(f"n{i}") for i in m), *(F.count_if(own(i) & (F.col("e") == cause)).cast("double").alias(f"d{i}") for i in m),
        *(F.count_if(own(i) & (F.col("e") != 0) & (F.col("e") != cause)).cast("double").alias(f"o{i}") for i in m),
    )
    t = cut(t)
    n = t.count()
    key = ("s",)
    total = lambda cols: sum(cols, F.lit(0.0))
    per = lambda a, b: F.when(b != 0, a / b).otherwise(0.0)
    t = running(t, "t", {f"y{i}": ("sum", f"n{i}") for i in m}, key, descending=True, rows=n).where(total(F.col(f"{c}{i}") for c in "do" for i in m) > 0)
    t = t.withColumns({f"p{i}": F.when(F.col(f"y{i}") > 0, 1 - (F.col(f"d{i}") + F.col(f"o{i}")) / F.col(f"y{i}")).otherwise(1.0) for i in m})
    t = running(t, "t", {f"after{i}": ("product", f"p{i}") for i in m}, key, rows=n)
    t = running(t, "t", {f"s{i}": ("product", f"p{i}") for i in m}, key, before=True, rows=n)
    t = cut(t.withColumns({f"s{i}": F.coalesce(f"s{i}", F.lit(1.0)) for i in m}))
    t = t.withColumns({f"f{i}": F.col(f"s{i}") * per(F.col(f"d{i}"), F.col(f"y{i}")) for i in m} | {f"h{i}": F.when(F.col(f"y{i}") > 0, per(F.col(f"y{i}"), F.col(f"s{i}"))).otherwise(0.0) for i in m})
    t = t.withColumns({"h": total(F.col(f"h{i}") for i in m), "d": total(F.col(f"d{i}") for i in m)}).withColumn("df", per(F.col("d"), F.col("h")))
    t = running(t, "t", {f"c{i}": ("sum", f"f{i}") for i in m} | {"c": ("sum", "df")}, key, before=True, rows=n)
    t = t.withColumns({"before": 1 - _zero("c")} | {f"r{i}": F.col(f"h{i}") * (1 - _zero(f"c{i}")) for i in m})
    t = cut(t.withColumns({"g": F.col("before") - F.col("df"), "step": per(F.col("df"), F.col("before")), "l": F.pow("before", F.lit(float(rho))), "r": total(F.col(f"r{i}") for i in m)}))
    t = t.withColumns({f"e{i}_{j}": F.col("l") * F.col(f"h{i}") * ((1.0 if i == j else 0.0) - per(F.col(f"h{j}"), F.col("h"))) for i in m for j in m})
    t = t.withColumns({f"q{i}_{j}": F.col(f"e{i}_{j}") * F.col("step") for i in m for j in m})
    t = running(t, "t", {f"rest{i}_{j}": ("sum", f"q{i}_{j}") for i in m for j in m}, key, descending=True, before=True, rows=n)
    ratio = {j: per(F.col("g"), F.col(f"after{j}")) for j in m}
    a = {(i, j): F.col(f"e{i}_{j}") + (1 - ratio[j]) * _zero(f"rest{i}_{j}") for i in m for j in m}
    b = {(i, j): -ratio[j] * _zero(f"rest{i}_{j}") for i in m for j in m}
    tied = lambda whole, part: F.when(whole > 1, (whole - part) / (whole - 1)).otherwise(1.0)
    live = {j: F.col(f"y{j}") > 0 for j in m}
    one = {j: F.when(live[j], per(F.col("df"), F.col(f"h{j}"))).otherwise(0.0) * tied(F.col("h") * F.col(f"s{j}"), F.col("d")) for j in m}
    two = {j: F.when(live[j], per(F.col(f"s{j}") * per(F.col(f"o{j}"), F.col(f"y{j}")), F.col(f"h{j}"))).otherwise(0.0) * tied(F.col(f"y{j}"), F.col(f"o{j}")) for j in m}
    t = cut(t.select("l", "d", "r", *(f"{c}{i}" for c in "dr" for i in m), *(a[k].alias(f"a{k[0]}_{k[1]}") for k in a), *(b[k].alias(f"b{k[0]}_{k[1]}") for k in b), *(one[j].alias(f"u{j}") for j in m), *(two[j].alias(f"v{j}") for j in m)))
    out = t.agg(
        *(_zero(F.sum(F.col("l") * (F.col(f"d{i}") - per(F.col(f"r{i}"), F.col("r")) * F.col("d")))).alias(f"z{i}") for i in m),
        *(_zero(F.sum(total(F.col(f"a{i}_{r}") * F.col(f"a{j}_{r}") * F.col(f"u{r}") + F.col(f"b{i}_{r}") * F.col(f"b{j}_{r}") * F.col(f"v{r}") for r in m))).alias(f"w{i}_{j}") for i in m for j in m if j <= i),
    ).first()
    z = np.array([out[f"z{i}"] for i in m])
    v = np.array([[out[f"w{max(i, j)}_{min(i, j)}"] for j in m] for i in m])
    k = len(names) - 1
    stat = float(z[:k] @ np.linalg.pinv(v[:k, :k]) @ z[:k]) if k else 0.0
    return {"cause": cause, "statistic": stat, "df": k, "p_value": chi2_sf(stat, k) if k else 1.0}
