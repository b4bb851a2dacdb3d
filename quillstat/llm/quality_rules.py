"""Quality rules with robust multivariate outliers.

Each text gets counts (words, their characters, symbols, repeated lines, words
in repeated five-word windows) and two fixed rules over them.  Texts that pass
the fixed rules are then judged by a vector of transformed statistics: for each
language and source a minimum-covariance-determinant estimate of centre and
scatter is found, and a text whose Mahalanobis distance from its group's centre
passes a chi-square quantile is rejected.

The estimate starts from four deterministic ones: medians with median absolute
deviations, and with these the correlation of values squeezed by tanh, the scatter of
directions from the centre, and the moments of rows that are near in every
statistic.  Concentration steps (the half of a group's rows nearest to the centre gives
the next estimate) improve all four twice, that of the least determinant goes on
until its determinant falls no more.  Scatter is regularised: the square of a least
spread of each statistic is added to its variance, so statistics that hardly vary
in clean texts do not reject them.

Everything is DataFrame expressions.  A concentration step sums the vectors and
their products by group and by bin of the current distance; medians come from
binned counts too, so no group is ever gathered in one task and nothing depends on
the partitioning.

Defined results: a null text has no words and fails the fixed rules, as any
text under ten words; repeated rows repeat their result; rows at the same distance
are all in a half or all out of it; null languages and sources are groups of their
own; groups under ``min_group`` rows are pooled by language, and languages under it
together; an empty table gives an empty result; a group without spread in a
statistic gets that statistic's floor; a very long text takes memory of some times
its size; input columns named as a result column are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstat.llm.common import cut, if_small

#: The statistics, and the least spread (one standard deviation) that each is given.
FLOORS = {"word_length": 0.06, "symbols": 0.12, "dup_lines": 0.4, "repeats": 0.4, "upper": 0.12}
NAMES = tuple(FLOORS)
P = len(NAMES)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Most groups that are broadcast.
SMALL = 20_000
_BIN = 0.02  # of log(1 + squared distance)
_GRID = 0.002  # of a statistic, for medians


def chi2_cdf(x: float, df: int) -> float:
    """Chi-square distribution function, by the series of the incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi2_quantile(q: float, df: int) -> float:
    low, high = 0.0, 10.0 * df + 200
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, df) < q else (low, mid)
    return high


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of ``text``, ``n_lines``, ``n_upper`` and ``base_failed``."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    names = (*COUNTS, "n_lines", "n_upper", "base_failed")
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    df = docs.select(
        *keep,
        F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "").alias("__w"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__l"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )
    w = F.col("__w")
    window = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(5))))
    df = df.select(
        *keep,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_upper",
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(w) >= 6, window).alias("__h"),
    )
    # windows in the order of their hashes; only texts with some window twice are sorted
    h = F.col("__h")
    twice = F.size(F.array_distinct(h)) < F.size(h)
    df = df.withColumn("__s", F.when(twice, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    s = F.col("__s")
    alike = F.transform(s, lambda e, j: F.when((F.get(s, j - 1)["x"] == e["x"]) | (F.get(s, j + 1)["x"] == e["x"]), e["i"]))
    df = df.withColumn("__p", F.sort_array(F.array_compact(alike)))
    p = F.col("__p")
    covered = F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(5), F.coalesce(F.get(p, j + 1) - x, F.lit(5)))), F.lit(0), lambda a, b: a + b)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__h", "__s", "__p")
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def statistics() -> list[Column]:
    """The transformed statistics, in the order of NAMES.

    A few pseudo-counts hold the averages of short texts near the usual.
    """
    n, chars = F.col("n_words"), F.col("word_chars")
    return [
        F.log((chars + 250.0) / (n + 50.0)),
        F.log1p(100.0 * F.col("n_symbols") / (chars + 200.0)),
        F.log1p(20.0 * F.col("n_dup_lines") / (F.col("n_lines") + 5.0)),
        F.log1p(20.0 * F.col("n_repeat_words") / (n + 50.0)),
        F.log((100.0 * F.col("n_upper") + 400.0) / (chars + 200.0)),
    ]


def _keys(df: DataFrame, lang: str, source: str) -> DataFrame:
    mark = lambda c: F.when(F.col(f"`{c}`").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(f"`{c}`").cast("string")))
    return df.withColumns({"__lang": mark(lang), "__group": F.concat_ws("\u0001", mark(lang), mark(source))})


def _median(rows: DataFrame, value: Column) -> DataFrame:
    """(g, dim, median) of ``value`` by group and statistic, from counts by grid cell."""
    cells = rows.groupBy("g", "dim", F.floor(value / _GRID).alias("cell")).count()
    upto = Window.partitionBy("g", "dim").orderBy("cell")
    whole = Window.partitionBy("g", "dim")
    cells = cells.withColumn("c", F.sum("count").over(upto)).withColumn("n", F.sum("count").over(whole))
    return cells.where(2 * F.col("c") >= F.col("n")).groupBy("g", "dim").agg(((F.min("cell") + 0.5) * _GRID).alias("median"))


def _factor(params: DataFrame) -> DataFrame:
    """(g, start, logdet, m0.., l..): centres with the Cholesky factor of the scatter, from centres and s_i_j."""
    out = params
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"s{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    return out.select("g", "start", sum((2 * F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0)).alias("logdet"), *(f"m{i}" for i in range(P)), *(f"l{i}{j}" for i in range(P) for j in range(i + 1)))


def _distance(df: DataFrame) -> DataFrame:
    """``df`` of x0.., m0.., l.. with the squared Mahalanobis distance ``d2``."""
    for i in range(P):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        df = df.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    return df.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)), F.lit(0.0))).drop(*(f"z{i}" for i in range(P)))


def _estimate(near: DataFrame, factor: float) -> DataFrame:
    """Centres and floored scatter of summed rows n, a_i, b_i_j."""
    mean = {i: F.col(f"a{i}") / F.col("n") for i in range(P)}
    cols = [mean[i].alias(f"m{i}") for i in range(P)]
    for i in range(P):
        for j in range(i + 1):
            cov = F.col(f"b{i}{j}") / F.col("n") - mean[i] * mean[j]
            # sums of squares may fall a little below zero when there is no spread
            cols.append((F.greatest(cov, F.lit(0.0)) * factor + FLOORS[NAMES[i]] ** 2 if i == j else cov * factor).alias(f"s{i}{j}"))
    return near.select("g", "start", *cols)


_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _moments(values: list[Column], name: str, where: Column | None = None) -> list[Column]:
    """Sums of ``values`` and of their products."""
    own = values if where is None else [F.when(where, v).otherwise(0.0) for v in values]
    return [F.sum(v).alias(f"{name}a{i}") for i, v in enumerate(own)] + [F.sum(own[i] * own[j]).alias(f"{name}b{i}{j}") for i, j in _PAIRS]


def _starts(x: DataFrame) -> DataFrame:
    """The four first estimates of each group: (g, start, m_i, s_i_j)."""
    long = x.select("g", F.posexplode(F.array(*(f"x{i}" for i in range(P)))).alias("dim", "x"))
    middle = cut(_median(long, F.col("x")))
    away = _median(long.join(if_small(middle, SMALL * P), ["g", "dim"]), F.abs(F.col("x") - F.col("median"))).withColumnRenamed("median", "mad")
    both = middle.join(away, ["g", "dim"])
    of = lambda value, i: F.max(F.when(F.col("dim") == i, value))
    floor = F.element_at(F.array(*(F.lit(f * f) for f in FLOORS.values())), F.col("dim") + 1)
    centre = cut(both.groupBy("g").agg(*(of(F.col("median"), i).alias(f"c{i}") for i in range(P)), *(of(F.sqrt(F.pow(1.4826 * F.col("mad"), 2) + floor), i).alias(f"r{i}") for i in range(P))))
    df = x.join(if_small(centre, SMALL), "g").select("g", *(((F.col(f"x{i}") - F.col(f"c{i}")) / F.col(f"r{i}")).alias(f"z{i}") for i in range(P)))
    z = [F.col(f"z{i}") for i in range(P)]
    squares = sum((v * v for v in z), F.lit(0.0))
    near = F.greatest(*(F.abs(v) for v in z)) <= 3
    direction = [F.when(squares > 0, v / F.sqrt(squares)).otherwise(0.0) for v in z]
    sums = df.groupBy("g").agg(F.count("*").alias("n"), F.count_if(near).alias("k"), *_moments([F.tanh(v) for v in z], "t"), *_moments(direction, "u"), *_moments(z, "v", near)).join(centre, "g")
    n, k = F.col("n"), F.greatest(F.col("k"), F.lit(1))

    def cov(name, count, i, j, centred=True):
        i, j = max(i, j), min(i, j)
        return F.col(f"{name}b{i}{j}") / count - (F.col(f"{name}a{i}") / count * F.col(f"{name}a{j}") / count if centred else F.lit(0.0))

    def corr(i, j):
        both = cov("t", n, i, i) * cov("t", n, j, j)
        return F.when(both > 1e-18, cov("t", n, i, j) / F.sqrt(both)).otherwise(0.0)

    r = lambda i, j: F.col(f"r{i}") * F.col(f"r{j}")
    made = []
    for start in range(4):
        cols = [(F.col(f"c{i}") + (F.col(f"r{i}") * F.col(f"va{i}") / k if start == 3 else 0.0)).alias(f"m{i}") for i in range(P)]
        for i, j in _PAIRS:
            # correlations a little under 1, so that every scatter has full rank
            value = [F.lit(1.0 if i == j else 0.0), F.lit(1.0) if i == j else 0.99 * corr(i, j), P * cov("u", n, i, j, False) + (0.01 if i == j else 0.0), cov("v", k, i, j) + (0.01 if i == j else 0.0)][start]
            cols.append((r(i, j) * value).alias(f"s{i}{j}"))
        made.append(sums.select("g", F.lit(start).alias("start"), *cols))
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


def fit(counted: DataFrame, lang: str = "lang", source: str = "source", min_group: int = 200, tol: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """(assignment of groups, parameters of groups) from the rows that pass the fixed rules.

    ``counted`` comes from :func:`counts` and is read twice.  Steps end when no
    group's logarithm of the determinant falls by more than ``tol``.
    """
    rows = _keys(counted, lang, source).where(~F.col("base_failed"))
    sizes = rows.groupBy("__lang", "__group").count()
    small = F.col("count") < min_group
    # small groups are pooled by language, and small pools together
    pooled = F.sum(F.when(small, F.col("count"))).over(Window.partitionBy("__lang"))
    groups = cut(sizes.select("__group", F.when(~small, F.concat(F.lit("g"), "__group")).when(pooled >= min_group, F.concat(F.lit("l"), "__lang")).otherwise("a").alias("g")))
    x = cut(rows.join(if_small(groups, SMALL), "__group").select("g", *(s.alias(f"x{i}") for i, s in enumerate(statistics()))))
    half = 0.5 / chi2_cdf(chi2_quantile(0.5, P), P + 2)  # makes the scatter of the nearer half that of a normal whole
    cutoff = chi2_quantile(0.975, P)
    most = 0.975 / chi2_cdf(cutoff, P + 2)
    values = [F.col(f"x{i}") for i in range(P)]
    sums = [F.count("*").alias("n"), *_moments(values, "")]
    again = [F.sum(c).alias(c) for c in ("n", *(f"a{i}" for i in range(P)), *(f"b{i}{j}" for i, j in _PAIRS))]
    own = Window.partitionBy("g", "start")

    def step(params: DataFrame) -> DataFrame:
        bins = _distance(x.join(if_small(params, 4 * SMALL), "g")).groupBy("g", "start", F.floor(F.log1p("d2") / _BIN).alias("bin")).agg(*sums)
        before = F.coalesce(F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        near = bins.withColumn("before", before).withColumn("all", F.sum("n").over(own))
        near = near.where(2 * F.col("before") < F.col("all")).groupBy("g", "start").agg(*again)
        return cut(_factor(_estimate(near, half)))

    def least(params: DataFrame) -> DataFrame:
        """The one of the least determinant of each group."""
        every = F.struct("logdet", "start", *(c for c in params.columns if c not in ("g", "logdet", "start")))
        return cut(params.groupBy("g").agg(F.min(every).alias("p")).select("g", "p.*"))

    best = least(step(step(cut(_factor(_starts(x))))))
    while True:
        new = step(best)
        falls = new.join(best.select("g", F.col("logdet").alias("old")), "g").where(F.col("logdet") < F.col("old") - tol)
        if falls.isEmpty():
            break
        best = least(best.unionByName(new.select(*best.columns)))
    # the usual reweighting: all rows within the 97.5 % quantile
    near = _distance(x.join(if_small(best, SMALL), "g")).where(F.col("d2") <= cutoff).groupBy("g", "start").agg(*sums)
    return groups, cut(_factor(_estimate(near, most)).drop("start", "logdet"))


def judge(counted: DataFrame, fitted: tuple[DataFrame, DataFrame], lang: str = "lang", source: str = "source", tail: float = 1e-6) -> DataFrame:
    """``counted`` with ``distance2`` and ``kept``.

    ``tail`` is the share of a normal group that the method may reject.
    """
    groups, params = fitted
    limit = chi2_quantile(1 - tail, P)
    names = counted.columns
    df = _keys(counted, lang, source).join(if_small(groups, SMALL), "__group", "left").join(if_small(params, SMALL), "g", "left")
    df = _distance(df.withColumns({f"x{i}": s for i, s in enumerate(statistics())}))
    # all groups of rows that pass the fixed rules were fitted; one condition on both sides of the
    # join, so that no part of it is moved below the counts and makes them twice
    kept = F.coalesce(F.when(F.col("base_failed"), F.lit(False)).otherwise(F.col("d2") <= limit), F.lit(False))
    return df.select(*(F.col(f"`{c}`") for c in names if c.lower() not in ("distance2", "kept")), F.col("d2").alias("distance2"), kept.alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", **how) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.

    Texts are counted twice, for the estimates and for the verdicts: keeping whole
    rows between would take more memory and as much disk as the documents.
    """
    slim = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"))
    fitted = fit(cut(counts(slim).drop("text")), **how)
    whole = counts(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source")))
    return judge(whole, fitted).where("kept").select("__row.*")
