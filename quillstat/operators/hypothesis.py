"""Classical hypothesis tests: one or two aggregations on Spark, then arithmetic on their few numbers."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstat.functions.columns import col
from quillstat.functions.dist import beta_i, beta_ppf, chi2_sf, f_sf, norm_cdf, norm_ppf, t_ppf, t_sf
from quillstat.plans.ordered import mid_ranks, running, running_sums


@dataclass
class HTest:
    method: str
    statistic: float
    p_value: float
    df: float | tuple | None = None
    estimates: dict[str, float] = field(default_factory=dict)
    conf_low: float | None = None
    conf_high: float | None = None

    def estimate(self) -> float:
        return next(iter(self.estimates.values()))

    def frame(self, spark) -> DataFrame:
        df = self.df[0] if isinstance(self.df, tuple) else self.df
        row = [(self.method, float(self.statistic), float(self.p_value), None if df is None else float(df), self.conf_low, self.conf_high)]
        return spark.createDataFrame(row, "method string, statistic double, p_value double, df double, conf_low double, conf_high double")


def format_pvalue(p: float | None, *, omit: bool = True) -> str:
    """Two decimals from .01, three from .001, else ``P<.001`` or two significant digits."""
    if p is None or math.isnan(p) or math.isinf(p):
        return "-"
    if p >= 0.01:
        return f"{p:.2f}"
    if p >= 0.001:
        return f"{p:.3f}"
    return "P<.001" if omit else f"{p:.1e}"


def _tail(t: float, df: float, alternative: str) -> float:
    if alternative == "two.sided":
        return 2 * t_sf(abs(t), df)
    return t_sf(t, df) if alternative == "greater" else t_sf(-t, df)


def _moments(df: DataFrame, c: Column) -> tuple[int, float, float]:
    r = df.agg(F.count(c).alias("n"), F.avg(c).alias("m"), F.var_samp(c).alias("v")).first()
    return r["n"], r["m"], r["v"]


def t_test(df: DataFrame, x: str | Column, y: str | Column | None = None, *, group: str | None = None, alternative: str = "two.sided", mu: float = 0.0, paired: bool = False, var_equal: bool = False, conf_level: float = 0.95) -> HTest:
    """One-sample, paired, Welch or pooled t test of ``x``, of ``x`` and ``y``, or of ``x`` by a column of two groups."""
    x = col(x).cast("double")
    if paired:
        x, y = x - col(y).cast("double"), None
    if y is None and group is None:
        n, m, v = _moments(df, x)
        se, dof, diff, est, name = math.sqrt(v / n), n - 1, m, {"mean": m}, "paired" if paired else "one sample"
    else:
        if group is not None:
            rows = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v")).orderBy(group).collect()
            (n1, m1, v1), (n2, m2, v2) = [(r["n"], r["m"], r["v"]) for r in rows]
        else:
            (n1, m1, v1), (n2, m2, v2) = _moments(df, x), _moments(df, col(y).cast("double"))
        diff, est = m1 - m2, {"mean_x": m1, "mean_y": m2}
        if var_equal:
            dof, name = n1 + n2 - 2, "pooled"
            pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / dof
            se = math.sqrt(pooled * (1 / n1 + 1 / n2))
        else:
            a, b, name = v1 / n1, v2 / n2, "Welch"
            se, dof = math.sqrt(a + b), (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1))
    t = (diff - mu) / se
    q = t_ppf(1 - (1 - conf_level) / (2 if alternative == "two.sided" else 1), dof)
    low, high = diff - q * se, diff + q * se
    low, high = (-math.inf if alternative == "less" else low), (math.inf if alternative == "greater" else high)
    return HTest(f"{name} t test", t, _tail(t, dof, alternative), dof, est, low, high)


def anova(df: DataFrame, value: str, group: str) -> HTest:
    """One-way analysis of variance."""
    x = F.col(value).cast("double")
    rows = df.where(F.col(group).isNotNull() & x.isNotNull()).groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v")).collect()
    return anova_of([(r["n"], r["m"], r["v"]) for r in rows])


def anova_of(rows: list[tuple[int, float, float]]) -> HTest:
    """One-way analysis of variance from (n, mean, population variance) of each group."""
    n, k = sum(r[0] for r in rows), len(rows)
    if k < 2 or n <= k:
        return HTest("anova", math.nan, math.nan)
    mean = sum(r[0] * r[1] for r in rows) / n
    between, within = sum(r[0] * (r[1] - mean) ** 2 for r in rows), sum(r[0] * r[2] for r in rows)
    f = (between / (k - 1)) / (within / (n - k)) if within else math.inf
    return HTest("anova", f, f_sf(f, k - 1, n - k), (k - 1, n - k))


def crosstab(df: DataFrame, a: str, b: str) -> tuple[list, list, list[list[int]]]:
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).count().collect()
    left, right = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    n = {(r[0], r[1]): r[2] for r in rows}
    return left, right, [[n.get((i, j), 0) for j in right] for i in left]


def chisq_test(df: DataFrame, a: str, b: str, correct: bool = True) -> HTest:
    """Pearson chi-square of a contingency table, with Yates' correction for two by two."""
    return chisq_of(crosstab(df, a, b)[2], correct)


def chisq_of(n: list[list[int]], correct: bool = True) -> HTest:
    """The same of a table of counts."""
    if len(n) < 2 or len(n[0]) < 2:
        return HTest("chi-square", math.nan, math.nan)
    total = sum(map(sum, n))
    rows, cols = [sum(r) for r in n], [sum(c) for c in zip(*n, strict=True)]
    off = [[abs(x - rows[i] * cols[j] / total) for j, x in enumerate(r)] for i, r in enumerate(n)]
    yates = min(0.5, min(map(min, off))) if correct and len(rows) == len(cols) == 2 else 0.0
    stat = sum((off[i][j] - yates) ** 2 / (rows[i] * cols[j] / total) for i in range(len(rows)) for j in range(len(cols)))
    dof = (len(rows) - 1) * (len(cols) - 1)
    return HTest("chi-square", stat, chi2_sf(stat, dof), dof)


def _two_sided(log_prob, own: int, low: int, high: int) -> float:
    """The sum of all probabilities up to that of ``own``, of a distribution with one peak.

    Where the tails begin is found by halving, and terms are added from there until
    they vanish, so their number goes with the spread and not with the counts.
    """
    limit = log_prob(own) + 1e-7
    a, b = low, high
    while a < b:  # the peak
        mid = (a + b) // 2
        a, b = (mid + 1, b) if log_prob(mid + 1) > log_prob(mid) else (a, mid)
    peak = a

    def first(near: int, far: int) -> int | None:
        """The place nearest to the peak, from ``near`` to ``far``, that is up to the limit."""
        if log_prob(far) > limit:
            return None
        while near != far:
            mid = near + (far - near) // 2 if far > near else near - (near - far) // 2
            near, far = (near, mid) if log_prob(mid) <= limit else (mid + (1 if far > near else -1), far)
        return far

    total = 0.0
    for near, far, step in ((peak, low, -1), (peak + 1, high, 1)):
        x = first(near, far) if (far - near) * step >= 0 else None
        while x is not None and (far - x) * step >= 0:
            term = math.exp(log_prob(x))
            total += term
            if term < 1e-18 * total:
                break
            x += step
    return min(1.0, total)


def _log_choose(m: int, j: int) -> float:
    return math.lgamma(m + 1) - math.lgamma(j + 1) - math.lgamma(m - j + 1)


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p value of a two-by-two table."""
    n, r, k = a + b + c + d, a + b, a + c
    return _two_sided(lambda x: _log_choose(r, x) + _log_choose(n - r, k - x) - _log_choose(n, k), a, max(0, k + r - n), min(k, r))


def kruskal(df: DataFrame, value: str, group: str) -> HTest:
    """Kruskal-Wallis with tie correction, from mid-ranks of distinct values."""
    have = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(value).cast("double").alias("x"), F.col(group).alias("g"))
    cells = have.groupBy("g", "x").count()
    ranks = mid_ranks(have, "x")
    sums = cells.join(ranks, "x").groupBy("g").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("rank")).alias("r")).collect()
    ties = ranks.agg(F.sum(F.pow(F.col("ties").cast("double"), 3) - F.col("ties")).alias("t")).first()["t"]
    n, k = sum(r["n"] for r in sums), len(sums)
    if k < 2 or ties >= float(n) ** 3 - n:
        return HTest("Kruskal-Wallis", math.nan, math.nan)
    h = (12 / (n * (n + 1)) * sum(r["r"] ** 2 / r["n"] for r in sums) - 3 * (n + 1)) / (1 - ties / (float(n) ** 3 - n))
    return HTest("Kruskal-Wallis", h, chi2_sf(h, k - 1), k - 1)


def wilcox_test(df: DataFrame, x: str, group: str | None = None, *, mu: float = 0.0, alternative: str = "two.sided", correct: bool = True, exact: bool | None = None) -> HTest:
    """Rank-sum test of ``x`` by two groups, or signed-rank test of ``x``; exact for small samples without ties."""
    have = df.where(F.col(x).isNotNull()).select((F.col(x).cast("double") - (0.0 if group else mu)).alias("x"), *([F.col(group).alias("g")] if group else []))
    if group is None:
        have = have.where("x <> 0").select(F.abs("x").alias("x"), (F.col("x") > 0).cast("int").alias("g"))
        first = 1
    else:
        have = have.where("g is not null")
        first = have.agg(F.min("g")).first()[0]
        have = have.withColumn("x", F.when(F.col("g") == F.lit(first), F.col("x") - mu).otherwise(F.col("x")))
    ranks = mid_ranks(have, "x")
    r = have.groupBy("g", "x").count().join(ranks, "x").groupBy((F.col("g") == F.lit(first)).alias("own")).agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("rank")).alias("r")).collect()
    n = {row["own"]: row["n"] for row in r}
    sums = {row["own"]: row["r"] for row in r}
    tie = ranks.agg(F.sum(F.pow(F.col("ties").cast("double"), 3) - F.col("ties")).alias("t"), F.max("ties").alias("m")).first()
    n1, n2 = n.get(True, 0), n.get(False, 0)
    if group is None:
        total = n1 + n2
        w, mean = sums.get(True, 0.0), total * (total + 1) / 4
        var = total * (total + 1) * (2 * total + 1) / 24 - tie["t"] / 48
        small = total < 50
    else:
        w, mean = sums.get(True, 0.0) - n1 * (n1 + 1) / 2, n1 * n2 / 2
        m = n1 + n2
        var = n1 * n2 / 12 * ((m + 1) - tie["t"] / (m * (m - 1)))
        small = n1 < 50 and n2 < 50
    if exact and tie["m"] > 1:
        raise ValueError("there are ties, for which the exact distribution does not hold")
    if (small and tie["m"] == 1) if exact is None else exact:
        pmf = _signed_rank_pmf(n1 + n2) if group is None else _rank_sum_pmf(n1, n2)
        low, high = sum(pmf[: int(w) + 1]), sum(pmf[int(w) :])
        p = {"two.sided": min(1.0, 2 * min(low, high)), "greater": high, "less": low}[alternative]
    else:
        z = w - mean
        shift = {"two.sided": math.copysign(0.5, z) if z else 0.0, "greater": 0.5, "less": -0.5}[alternative] if correct else 0.0
        z = (z - shift) / math.sqrt(var)
        p = {"two.sided": 2 * min(norm_cdf(z), norm_cdf(-z)), "greater": norm_cdf(-z), "less": norm_cdf(z)}[alternative]
    return HTest("signed rank" if group is None else "rank sum", w, p)


def _rank_sum_pmf(n1: int, n2: int) -> list[float]:
    """Of the rank-sum statistic, by counting subsets of ranks."""
    ways = [[0] * (n1 * n2 + 1) for _ in range(n1 + 1)]
    ways[0][0] = 1
    for rank in range(1, n1 + n2 + 1):
        for k in range(min(rank, n1), 0, -1):
            shift = rank - k  # how many of the other sample lie below
            if shift > n2:
                continue
            for u in range(n1 * n2, shift - 1, -1):
                ways[k][u] += ways[k - 1][u - shift]
    total = math.comb(n1 + n2, n1)
    return [x / total for x in ways[n1]]


def _signed_rank_pmf(n: int) -> list[float]:
    ways = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for s in range(len(ways) - 1, rank - 1, -1):
            ways[s] += ways[s - rank]
    return [x / 2**n for x in ways]


def mcnemar_test(df: DataFrame, x: str, y: str, correct: bool = True) -> HTest:
    """McNemar's test, or Bowker's for more than two levels."""
    left, right, n = crosstab(df, x, y)
    names = sorted({*left, *right})
    at = lambda i, j: n[left.index(i)][right.index(j)] if i in left and j in right else 0
    pairs = [(at(i, j), at(j, i)) for k, i in enumerate(names) for j in names[k + 1 :]]
    yates = 1.0 if correct and len(names) == 2 else 0.0
    stat = sum((abs(a - b) - (yates if a != b else 0)) ** 2 / (a + b) for a, b in pairs if a + b)
    dof = len(names) * (len(names) - 1) // 2
    return HTest("McNemar", stat, chi2_sf(stat, dof), dof)


def _limits(x: int, n: int, level: float) -> tuple[float, float]:
    """Clopper-Pearson limits."""
    a = (1 - level) / 2
    return (0.0 if x == 0 else beta_ppf(a, x, n - x + 1)), (1.0 if x == n else beta_ppf(1 - a, x + 1, n - x))


def binom_test(x: int, n: int, p: float = 0.5, conf_level: float = 0.95, alternative: str = "two.sided") -> HTest:
    """Exact binomial test of counts; limits by Clopper and Pearson."""
    if alternative == "two.sided":
        q = float(x == n * p) if p in (0.0, 1.0) else _two_sided(lambda k: _log_choose(n, k) + k * math.log(p) + (n - k) * math.log1p(-p), x, 0, n)
        low, high = _limits(x, n, conf_level)
    elif alternative == "less":
        q = 1.0 if x >= n else 1 - beta_i(x + 1, n - x, p)
        low, high = 0.0, _limits(x, n, 2 * conf_level - 1)[1]
    else:
        q = 1.0 if x <= 0 else beta_i(x, n - x + 1, p)
        low, high = _limits(x, n, 2 * conf_level - 1)[0], 1.0
    return HTest("exact binomial", x, min(1.0, q), None, {"probability": x / n}, low, high)


def prop_test(counts: list[tuple[int, int]], p: float | None = None, conf_level: float = 0.95, correct: bool = True) -> HTest:
    """Test of one proportion against ``p``, of several against ``p``, or without it of their equality; ``counts`` of (successes, trials).

    Several against a given ``p`` have as many degrees of freedom as there are, and no correction.
    """
    z = norm_ppf(1 - (1 - conf_level) / 2)
    if len(counts) == 1:
        (x, n), p = counts[0], 0.5 if p is None else p
        yates = min(0.5, abs(x - n * p)) if correct else 0.0
        stat = (abs(x - n * p) - yates) ** 2 / (n * p * (1 - p))
        e, zz = x / n, z * z / (2 * n)
        low = (e + zz - yates / n - z * math.sqrt((e - yates / n) * (1 - e + yates / n) / n + zz / (2 * n))) / (1 + 2 * zz) if x else 0.0
        high = (e + zz + yates / n + z * math.sqrt((e + yates / n) * (1 - e - yates / n) / n + zz / (2 * n))) / (1 + 2 * zz) if x < n else 1.0
        return HTest("proportion", stat, chi2_sf(stat, 1), 1, {"p": e}, max(0.0, low), min(1.0, high))
    pool = sum(x for x, _ in counts) / sum(n for _, n in counts) if p is None else p
    df = len(counts) - (p is None)
    yates, low, high = 0.0, None, None
    if len(counts) == 2 and p is None:
        (x1, n1), (x2, n2) = counts
        d = x1 / n1 - x2 / n2
        yates = min(0.5, abs(d) / (1 / n1 + 1 / n2)) if correct else 0.0
        half = z * math.sqrt(x1 / n1 * (1 - x1 / n1) / n1 + x2 / n2 * (1 - x2 / n2) / n2) + yates * (1 / n1 + 1 / n2)
        low, high = max(-1.0, d - half), min(1.0, d + half)
    stat = sum((abs(x - n * pool) - yates) ** 2 / (n * pool * (1 - pool)) for x, n in counts)
    return HTest("proportions", stat, chi2_sf(stat, df), df, {f"p{i + 1}": x / n for i, (x, n) in enumerate(counts)}, low, high)


def p_adjust(df: DataFrame, p: str, method: str = "holm", out: str = "adjusted", n: int | None = None) -> DataFrame:
    """``df`` with adjusted p values: holm, hochberg, bonferroni, BH (fdr), BY or none; nulls and NaN stay.

    Running maxima and minima over the distinct p values, range-partitioned when
    there are many; of equal values the least favourable rank counts, as it does for
    the sorted rows.
    """
    x = F.col(p).cast("double")
    good = x.isNotNull() & ~F.isnan(x)
    each = df.where(good).groupBy(x.alias("__p")).agg(F.count("*").alias("__k"))
    total = n or df.where(good).count()
    rank = running_sums(each, "__p", {"__last": "__k"})
    first, last, v = F.col("__last") - F.col("__k") + 1, F.col("__last"), F.col("__p")
    if method == "holm":
        rank = running(rank.withColumn("__s", (total - first + 1) * v), "__p", {"__a": ("max", "__s")})
    elif method == "hochberg":
        rank = running(rank.withColumn("__s", (total - last + 1) * v), "__p", {"__a": ("min", "__s")}, descending=True)
    elif method in ("BH", "fdr", "BY"):
        q = _harmonic(total) if method == "BY" else 1.0
        rank = running(rank.withColumn("__s", q * total / last * v), "__p", {"__a": ("min", "__s")}, descending=True)
    elif method == "bonferroni":
        rank = rank.withColumn("__a", total * v)
    elif method == "none":
        rank = rank.withColumn("__a", v)
    else:
        raise ValueError(f"unknown method {method}")
    rank = rank.select(F.col("__p"), F.least(F.col("__a"), F.lit(1.0)).alias("__a"))
    return df.join(rank, x == F.col("__p"), "left").withColumn(out, F.coalesce("__a", x)).drop("__p", "__a")


def _harmonic(n: int) -> float:
    """Sum of 1/i up to n; beyond 100 terms by Euler and Maclaurin, right to the last digit."""
    if n <= 100:
        return sum(1 / i for i in range(1, n + 1))
    return math.log(n) + 0.57721566490153286 + 1 / (2 * n) - 1 / (12 * n**2) + 1 / (120 * n**4)


def stat_of_counts(n: list[list[int]]) -> str:
    """Formatted p value of a table of counts: Fisher's of two by two, else chi-square."""
    if len(n) == 2 and len(n[0]) == 2:
        return format_pvalue(fisher_exact(*n[0], *n[1]))
    return format_pvalue(chisq_of(n).p_value)


def stat_auto(df: DataFrame, a: str, b: str) -> str:
    """Formatted p value by type: nominal by nominal (Fisher or chi-square), numeric by nominal (ANOVA)."""
    nominal = lambda c: isinstance(df.schema[c].dataType, (T.StringType, T.BooleanType))
    if nominal(b) and nominal(a):
        return stat_of_counts(crosstab(df, a, b)[2])
    if nominal(b) and isinstance(df.schema[a].dataType, T.NumericType):
        return format_pvalue(anova(df, a, b).p_value)
    return "-"
