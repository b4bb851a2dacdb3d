"""Matching, weighting and standardization on observed confounders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.plans.ordered import running


def exact_match(df: DataFrame, treatment: str, covariates: list[str], estimand: str = "ATT") -> DataFrame:
    """(covariates, treated, controls, weight of each treated and each control) of strata with both arms."""
    t = F.col(treatment).cast("int") > 0
    cells = df.groupBy(*covariates).agg(F.count_if(t).alias("treated"), F.count_if(~t).alias("controls")).where("treated > 0 and controls > 0")
    total = cells.agg(F.sum("treated").alias("t"), F.sum("controls").alias("c"))
    cells = cells.join(F.broadcast(total))
    nt, nc = F.col("treated"), F.col("controls")
    if estimand == "ATT":
        wt, wc = F.lit(1.0), nt / nc * F.col("c") / F.col("t")
    elif estimand == "ATC":
        wt, wc = nc / nt * F.col("t") / F.col("c"), F.lit(1.0)
    else:
        wt, wc = (nt + nc) / nt * F.col("t") / (F.col("t") + F.col("c")), (nt + nc) / nc * F.col("c") / (F.col("t") + F.col("c"))
    return cells.select(*covariates, "treated", "controls", wt.alias("w_treated"), wc.alias("w_control"))


def coarsen(df: DataFrame, column: str, breaks: list[float]) -> Column:
    """Number of the bin of ``column`` between ``breaks``, for coarsened exact matching."""
    return sum((F.when(F.col(column) >= b, 1).otherwise(0) for b in sorted(breaks)), F.lit(0))


def cem(df: DataFrame, treatment: str, breaks: dict[str, list[float]], estimand: str = "ATT") -> DataFrame:
    """Coarsened exact matching: ``exact_match`` on the bins."""
    binned = df.withColumns({f"{c}_bin": coarsen(df, c, b) for c, b in breaks.items()})
    return exact_match(binned, treatment, [f"{c}_bin" for c in breaks], estimand)


def nearest_match(df: DataFrame, unit: str, treatment: str, score: str, exact: list[str] | None = None, caliper: float | None = None, std_caliper: bool = True) -> DataFrame:
    """(exact, treated, control, distance): for each treated unit the control of the nearest score, controls being used again.

    Of equally near controls that of the lower score counts, of one score that of
    the least unit.  ``caliper`` is in standard deviations of the score over all
    units, or in its own measure.  Controls are summed by score, and running maxima
    and minima over the scores find the next lower and the next higher one, so no
    pairs are made.  Rows without a unit, treatment, score or exact value are left out.
    """
    keys = exact or []
    have = df.select(*keys, F.col(unit).alias("__u"), (F.col(treatment).cast("double") > 0).alias("__t"), F.col(score).cast("double").alias("__s"))
    for c in have.columns:
        have = have.where(F.col(f"`{c}`").isNotNull())
    have = have.where(~F.isnan("__s"))
    controls = have.where(~F.col("__t")).groupBy(*keys, F.col("__s").alias("__c")).agg(F.min("__u").alias("control"))
    line = have.groupBy(*keys, "__s").agg(F.max(F.when(~F.col("__t"), F.col("__s"))).alias("__own"))
    line = running(line, "__s", {"__low": ("max", "__own")}, tuple(keys))
    line = running(line, "__s", {"__high": ("min", "__own")}, tuple(keys), descending=True)
    low, high = F.col("__s") - F.col("__low"), F.col("__high") - F.col("__s")
    line = line.withColumn("__c", F.when(F.col("__high").isNull() | (low <= high), F.col("__low")).otherwise(F.col("__high"))).select(*keys, "__s", "__c")
    out = have.where("__t").join(line, [*keys, "__s"]).join(controls, [*keys, "__c"])
    out = out.select(*keys, F.col("__u").alias("treated"), "control", F.abs(F.col("__s") - F.col("__c")).alias("distance"))
    if caliper is None:
        return out
    limit = caliper * (have.agg(F.stddev_samp("__s")).first()[0] or 0.0) if std_caliper else caliper
    return out.where(F.col("distance") <= F.lit(float(limit)))


def match_weights(pairs: DataFrame) -> DataFrame:
    """(unit, weight) of matched units: 1 of a treated one; of a control how often it was taken, scaled so that all controls sum to their number."""
    taken = pairs.groupBy(F.col("control").alias("unit")).agg(F.count("*").alias("k"))
    total = taken.agg((F.count("*") / F.sum("k")).alias("scale"))
    return pairs.select(F.col("treated").alias("unit"), F.lit(1.0).alias("weight")).unionByName(taken.join(F.broadcast(total)).select("unit", (F.col("k") * F.col("scale")).alias("weight")))


def propensity_weights(df: DataFrame, treatment: str, ps: str, estimand: str = "ATE", stabilize: bool = False, out: str = "weight") -> DataFrame:
    """``df`` with weights of the estimand from a propensity column: ATE, ATT, ATC or ATO."""
    t, p = F.col(treatment).cast("double"), F.col(ps)
    w = {
        "ATE": F.when(t > 0, 1 / p).otherwise(1 / (1 - p)),
        "ATT": F.when(t > 0, 1.0).otherwise(p / (1 - p)),
        "ATC": F.when(t > 0, (1 - p) / p).otherwise(1.0),
        "ATO": F.when(t > 0, 1 - p).otherwise(p),
    }[estimand]
    if stabilize:
        share = df.agg(F.avg(t).alias("s"))
        return df.join(F.broadcast(share)).withColumn(out, w * F.when(t > 0, F.col("s")).otherwise(1 - F.col("s"))).drop("s")
    return df.withColumn(out, w)


def saturated_propensity(df: DataFrame, treatment: str, covariates: list[str], out: str = "ps") -> DataFrame:
    """``df`` with the share treated in its cell of ``covariates``."""
    cells = df.groupBy(*covariates).agg(F.avg(F.col(treatment).cast("double")).alias(out))
    return df.join(cells, covariates)


def weight_summary(df: DataFrame, treatment: str, weight: str) -> DataFrame:
    """(arm, n, mean, max, ess) of the weights."""
    w = F.col(weight)
    return df.groupBy(F.col(treatment).cast("int").alias("arm")).agg(F.count("*").alias("n"), F.avg(w).alias("mean_w"), F.max(w).alias("max_w"), (F.pow(F.sum(w), 2) / F.sum(w * w)).alias("ess"))


def balance(df: DataFrame, treatment: str, covariates: list[str], weight: str | None = None) -> DataFrame:
    """(covariate, mean_treated, mean_control, smd): weighted means over the unweighted pooled deviation."""
    t = F.col(treatment).cast("int") > 0
    w = F.col(weight) if weight else F.lit(1.0)
    aggs = []
    for i, c in enumerate(covariates):
        x = F.col(c).cast("double")
        for k, arm in (("t", t), ("c", ~t)):
            aggs += [(F.sum(F.when(arm, w * x)) / F.sum(F.when(arm, w))).alias(f"{k}{i}"), F.var_samp(F.when(arm, x)).alias(f"v{k}{i}")]
    one = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(c).alias("covariate"), F.col(f"t{i}").alias("mean_treated"), F.col(f"c{i}").alias("mean_control"), ((F.col(f"t{i}") - F.col(f"c{i}")) / F.sqrt((F.col(f"vt{i}") + F.col(f"vc{i}")) / 2)).alias("smd")) for i, c in enumerate(covariates)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def standardize(df: DataFrame, treatment: str, outcome: str, covariates: list[str]) -> DataFrame:
    """(arm, mean, share): the outcome's mean in each arm, standardised over cells of ``covariates`` with both arms, and the share of rows in such cells."""
    t = F.col(treatment).cast("int") > 0
    y = F.col(outcome).cast("double")
    cells = df.groupBy(*covariates).agg(F.count("*").alias("n"), F.avg(F.when(t, y)).alias("m1"), F.avg(F.when(~t, y)).alias("m0"))
    both = F.when(F.col("m1").isNotNull() & F.col("m0").isNotNull(), F.col("n"))
    one = cells.agg((F.sum(both * F.col("m1")) / F.sum(both)).alias("m1"), (F.sum(both * F.col("m0")) / F.sum(both)).alias("m0"), (F.sum(both) / F.sum("n")).alias("share"))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.col(f"m{a}").alias("mean"), F.col("share")) for a in (0, 1)))).alias("r")).select("r.*")


def pool_rubin(fits: DataFrame, m: int) -> DataFrame:
    """(term, estimate, std_error, fmi) by Rubin's rules of rows (term, estimate, std_error), one for each of ``m`` imputations."""
    g = fits.groupBy("term").agg(F.avg("estimate").alias("estimate"), F.avg(F.pow("std_error", 2)).alias("w"), F.coalesce(F.var_samp("estimate"), F.lit(0.0)).alias("b"))
    total = F.col("w") + (1 + 1 / m) * F.col("b")
    return g.select("term", "estimate", F.sqrt(total).alias("std_error"), ((1 + 1 / m) * F.col("b") / total).alias("lambda"))
