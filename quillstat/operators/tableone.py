"""Table One: descriptive tables by group, as text and as numbers."""

from __future__ import annotations

import html
from collections.abc import Callable
from functools import partial
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstat.functions import columns as C


class TableOneError(ValueError):
    pass


class ColumnNotFoundError(TableOneError):
    pass


class InvalidParameterError(TableOneError):
    pass


def categories(df: DataFrame, column: str, by: str | None = None, levels: list | None = None) -> DataFrame:
    """(by, level, n, total, p) of every level in every group, zero counts included; nulls left out."""
    have = df.where(F.col(column).isNotNull())
    keys = [by] if by else []
    if by:
        have = have.where(F.col(by).isNotNull())
    counts = have.groupBy(*keys, F.col(column).cast("string").alias("level")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    names = counts.select("level").distinct() if levels is None else df.sparkSession.createDataFrame([(str(x),) for x in levels], "level string")
    # groups and levels are what a table prints, so their product is too
    grid = totals.withColumn("level", F.explode(F.array(*(F.lit(r[0]) for r in names.orderBy("level").collect()))))
    out = grid.join(counts, [*keys, "level"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.select(*keys, "level", "n", "total", (100.0 * F.col("n") / F.col("total")).alias("p"))


_CATEGORY = {
    "np": lambda n, t, p, d: F.concat(n.cast("string"), F.lit(" ("), C.fixed(p, d), F.lit("%)")),
    "p": lambda n, t, p, d: C.fixed(p, d),
    "n": lambda n, t, p, d: n.cast("string"),
    "pnn": lambda n, t, p, d: F.concat(C.fixed(p, d), F.lit("% ("), n.cast("string"), F.lit("/"), t.cast("string"), F.lit(")")),
}


def category_text(df: DataFrame, column: str, by: str | None = None, levels: list | None = None, style: str = "np", precision: int = 1) -> DataFrame:
    """(by, level, text): ``categories`` formatted as n (p%), p, n or p% (n/total)."""
    rows = categories(df, column, by, levels)
    return rows.select(*([by] if by else []), "level", _CATEGORY[style](F.col("n"), F.col("total"), F.col("p"), precision).alias("text"))


def numeric_summary(df: DataFrame, column: str, by: str, add_all: bool = True) -> DataFrame:
    """(group, n, mean, sd, q1, median, q3) of a numeric column by group, and over all groups; no task holds the values of a group."""
    from quillstat.plans.ordered import quantiles

    x = F.col("__x")
    have = df.where(F.col(by).isNotNull()).select(F.col(by).cast("string").alias("group"), F.col(column).cast("double").alias("__x"))
    if add_all:  # grouping sets ((group), ())
        have = have.withColumn("group", F.explode(F.array(F.col("group"), F.lit("All"))))
    moments = have.groupBy("group").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    quarters = quantiles(have, "__x", [0.25, 0.5, 0.75], ("group",)).select("group", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    return moments.join(quarters, "group", "left")


def _pairs_smd(rows: list[tuple[float, float]]) -> float:
    """Mean over pairs of groups of |mean difference| over the root mean variance; ``rows`` are (mean, variance)."""
    each = [abs(a[0] - b[0]) / np.sqrt((a[1] + b[1]) / 2) if a[1] + b[1] else 0.0 if a[0] == b[0] else np.inf for a, b in combinations(rows, 2)]
    return float(np.mean(each)) if each else float("nan")


def _shares_smd(counts: list[list[int]]) -> float:
    """The multinomial form, of the counts of levels (columns) by group."""
    shares = [np.array(c, float) / sum(c) for c in counts if sum(c)]
    each = []
    for a, b in combinations(shares, 2):
        p, q = a[1:], b[1:]
        cov = sum(np.diag(v) - np.outer(v, v) for v in (p, q)) / 2
        each.append(float(np.sqrt(max(0.0, (p - q) @ np.linalg.pinv(cov) @ (p - q)))))
    return float(np.mean(each)) if each else float("nan")


def standardized_difference(df: DataFrame, column: str, groups: str, categorical: bool | None = None) -> float:
    """|mean difference| over the root mean variance, or its multinomial form; the mean over pairs of groups."""
    from quillstat.operators.hypothesis import crosstab

    if categorical is None:
        categorical = isinstance(df.schema[column].dataType, (T.StringType, T.BooleanType))
    if categorical:
        return _shares_smd(crosstab(df, groups, column)[2])
    x = F.col(column).cast("double")
    have = df.where(x.isNotNull() & F.col(groups).isNotNull())
    return _pairs_smd([(r["m"], r["v"]) for r in have.groupBy(groups).agg(F.avg(x).alias("m"), F.var_samp(x).alias("v")).collect()])


def tableone_raw(df: DataFrame, params: list[tuple[str, Callable[[Column], Column] | str]], hue: str | None = None, *, add_all: bool = False, add_pvalue: bool = False, add_smd: bool = False, levels: dict[str, list] | None = None) -> DataFrame:
    """(name, one text column a group, ``All``, ``P value``, ``SMD``).

    ``params`` lists a column with an aggregate, or with ``"category"`` for one
    row a level.  Groups are ordered by value; rows with a null group are left
    out of groups but not of ``All``.
    """
    from quillstat.operators.hypothesis import anova_of, crosstab, format_pvalue, stat_of_counts
    from quillstat.plans.ordered import quantiles

    for name, _ in params:
        if name not in df.columns:
            raise ColumnNotFoundError(name)
    if hue is not None and hue not in df.columns:
        raise ColumnNotFoundError(hue)
    if (add_pvalue or add_smd) and hue is None:
        raise InvalidParameterError("p values and differences need a group column")
    scalars = [(n, f) for n, f in params if callable(f)]
    groups = [] if hue is None else [r[0] for r in df.where(F.col(hue).isNotNull()).select(hue).distinct().orderBy(hue).collect()]
    cells: dict[tuple[str, str], str | None] = {}

    def take(frame: DataFrame, label) -> None:
        by = (hue,) if label is None else ()
        aggs = []
        for i, (n, f) in enumerate(scalars):
            # quantiles that an aggregate shows are found without one task that holds a group's values
            if probs := getattr(getattr(f, "func", f), "probs", None):
                own = quantiles(frame.select(*by, F.col(n).cast("double").alias("__x")), "__x", probs, by).withColumnsRenamed({f"q{k}": f"__{i}_{k}" for k in range(len(probs))})
                frame = frame.join(F.broadcast(own), list(by), "left") if by else frame.join(F.broadcast(own), how="left")
                f = partial(f, q=F.array(*(F.max(f"__{i}_{k}") for k in range(len(probs)))))
            aggs.append(f(F.col(n)).cast("string").alias(f"c{i}"))
        if not aggs:
            return
        rows = (frame.groupBy(hue) if label is None else frame).agg(*aggs).collect()
        for r in rows:
            for i, (n, _) in enumerate(scalars):
                cells[n, str(r[hue]) if label is None else label] = r[f"c{i}"]

    if hue is not None:
        take(df.where(F.col(hue).isNotNull()), None)
    if add_all or hue is None:
        take(df, "All")
    # p values and differences of all numeric variables from one pass of moments, of others from one of counts each
    pvalue, smd = {}, {}
    if add_pvalue or add_smd:
        nominal = [n for n, _ in params if isinstance(df.schema[n].dataType, (T.StringType, T.BooleanType))]
        numeric = [n for n, _ in params if n not in nominal]
        x = lambda n: F.col(n).cast("double")
        aggs = [a for i, n in enumerate(numeric) for a in (F.count(x(n)).alias(f"n{i}"), F.avg(x(n)).alias(f"m{i}"), F.var_samp(x(n)).alias(f"v{i}"), F.var_pop(x(n)).alias(f"p{i}"))]
        rows = df.where(F.col(hue).isNotNull()).groupBy(hue).agg(*aggs).collect() if aggs else []
        for i, n in enumerate(numeric):
            own = [r for r in rows if r[f"n{i}"]]
            smd[n] = _pairs_smd([(r[f"m{i}"], r[f"v{i}"]) for r in own])
            tested = isinstance(df.schema[n].dataType, T.NumericType) and isinstance(df.schema[hue].dataType, (T.StringType, T.BooleanType))
            pvalue[n] = format_pvalue(anova_of([(r[f"n{i}"], r[f"m{i}"], r[f"p{i}"]) for r in own]).p_value) if tested else "-"
        for n in nominal:
            counts = crosstab(df, hue, n)[2]
            smd[n] = _shares_smd(counts)
            pvalue[n] = stat_of_counts([list(c) for c in zip(*counts, strict=True)]) if isinstance(df.schema[hue].dataType, (T.StringType, T.BooleanType)) else "-"
    order = []
    for n, f in params:
        order.append(n)
        if callable(f):
            continue
        own = (levels or {}).get(n)
        for by, frame in ((hue, df), (None, df)):
            if (by is None and not (add_all or hue is None)) or (by is not None and hue is None):
                continue
            for r in category_text(frame, n, by, own).collect():
                cells[f"  {r['level']}", n, str(r[by]) if by else "All"] = r["text"]  # type: ignore[index]
        seen = sorted({k[0] for k in cells if len(k) == 3 and k[1] == n}) if own is None else [f"  {x}" for x in own]
        order += [(x, n) for x in seen]
    heads = (["All"] if add_all or hue is None else []) + [str(g) for g in groups]
    out = []
    for item in order:
        row = [item[0] if isinstance(item, tuple) else item]
        row += [cells.get((*item, h) if isinstance(item, tuple) else (item, h)) for h in heads]
        top = not isinstance(item, tuple)
        if add_pvalue:
            row.append(pvalue[item] if top else None)
        if add_smd:
            row.append(f"{smd[item]:.3f}" if top else None)
        out.append(tuple(row))
    names = ["name", *heads] + ["P value"] * add_pvalue + ["SMD"] * add_smd
    return df.sparkSession.createDataFrame(out, T.StructType([T.StructField(n, T.StringType()) for n in names]))


def to_html(table: DataFrame, title: str | None = None) -> str:
    """An HTML table of a small frame."""
    cell = lambda x: html.escape("" if x is None else str(x)).replace("  ", "&emsp;")
    rows = ["<tr>" + "".join(f"<td>{cell(x)}</td>" for x in r) + "</tr>" for r in table.collect()]
    head = "<tr>" + "".join(f"<th>{cell(c)}</th>" for c in table.columns) + "</tr>"
    return (f"<h2>{html.escape(title)}</h2>" if title else "") + "<table>" + head + "".join(rows) + "</table>"


def tableone(df: DataFrame, params, hue: str | None = None, **how) -> str:
    """``tableone_raw`` as HTML with the sizes of the groups in the header."""
    table = tableone_raw(df, params, hue, **how)
    sizes = {"All": df.count()} | ({} if hue is None else {str(r[0]): r[1] for r in df.where(F.col(hue).isNotNull()).groupBy(hue).count().collect()})
    return to_html(table.toDF(*(f"{c} (n={sizes[c]})" if c in sizes else c for c in table.columns)))


def weighted_qcut(df: DataFrame, value: str, weight: str, q: int, out: str = "bin") -> DataFrame:
    """``df`` with the number (0 to q - 1) of its bin of cumulative weight in the order of ``value``.

    The first bin is closed on both sides, others are (left, right]; equal
    values share the cumulative weight of their last row.
    """
    from quillstat.plans.ordered import running_sums

    each = df.groupBy(value).agg(F.sum(weight).alias("__w"))
    upto = running_sums(each, value, {"__c": "__w"})
    total = F.lit(df.agg(F.sum(weight)).first()[0])
    bins = upto.select(value, F.greatest(F.ceil(F.round(F.col("__c") / total * q, 9)) - 1, F.lit(0)).cast("int").alias(out))
    return df.join(bins, value, "left")


def smd_table(df: DataFrame, column: str, groups: str) -> DataFrame:
    """(a, b, smd) of a numeric column for each pair of groups."""
    x = F.col(column).cast("double")
    each = df.groupBy(F.col(groups).alias("g")).agg(F.avg(x).alias("m"), F.var_samp(x).alias("v"))
    a, b = each.select(F.col("g").alias("a"), F.col("m").alias("ma"), F.col("v").alias("va")), each.select(F.col("g").alias("b"), F.col("m").alias("mb"), F.col("v").alias("vb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", (F.abs(F.col("ma") - F.col("mb")) / F.sqrt((F.col("va") + F.col("vb")) / 2)).alias("smd"))


def weighted_moments(df: DataFrame, x: str, y: str, weight: str, by: str) -> DataFrame:
    """(by, mean_x, mean_y, cov, corr): weighted moments of rows without nulls, in two passes, so values far from 0 lose nothing."""
    v = lambda c: F.col(c).cast("double")
    rows = df.select(F.col(by), v(x).alias("__x"), v(y).alias("__y"), v(weight).alias("__w")).where("__x is not null and __y is not null and __w is not null")
    mean = rows.groupBy(by).agg((F.sum(F.col("__x") * F.col("__w")) / F.sum("__w")).alias("mean_x"), (F.sum(F.col("__y") * F.col("__w")) / F.sum("__w")).alias("mean_y"))
    d = rows.join(mean, by)
    a, b, w = F.col("__x") - F.col("mean_x"), F.col("__y") - F.col("mean_y"), F.col("__w")
    out = d.groupBy(by, "mean_x", "mean_y").agg((F.sum(a * b * w) / F.sum(w)).alias("cov"), (F.sum(a * b * w) / F.sqrt(F.sum(a * a * w) * F.sum(b * b * w))).alias("corr"))
    return out.select(by, "mean_x", "mean_y", "cov", "corr")
