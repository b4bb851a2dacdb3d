"""Queries over the standard tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.functions import columns as C
from quillstat.operators import causal, clogit, competing, cox, economics, fisher, gam, glmm, impute, matching, models, penalized, prediction, regression, splines, survival, tableone, tree, validation
from quillstat.operators import hypothesis as tests
from quillstat.sources.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SURV = "surv as (select l_quantity::double as time, (l_linestatus = 'F')::int as event, l_returnflag as grp, l_linenumber % 2 as stratum, (l_linenumber - 1)::double as entry, 1 + l_discount::double * 10 as w, case l_returnflag when 'A' then 1 when 'R' then 2 else 0 end as cause from lineitem)"
REG = "reg as (select l_extendedprice::double / 1000 as y, l_quantity::double as x1, l_discount::double as x2, l_tax::double as x3, (l_linestatus = 'F')::int as treat, l_returnflag as flag, 'm' || (l_suppkey % 5) as mode, l_suppkey as supp, l_orderkey * 10 + l_linenumber as ord from lineitem)"
PRED = "pred as (select (l_linestatus = 'F')::int as truth, l_quantity::double / 51.0 as prob, l_discount::double as score2 from lineitem)"


def mode():
    """A category of five levels."""
    return F.concat(F.lit("m"), (F.col("l_suppkey") % 5).cast("string"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def surv(spark: SparkSession, d: str) -> DataFrame:
    q = lambda c: F.col(c).cast("double")
    return read(spark, d, "lineitem").select(
        q("l_quantity").alias("time"), (F.col("l_linestatus") == "F").cast("int").alias("event"), F.col("l_returnflag").alias("grp"), (F.col("l_linenumber") % 2).alias("stratum"), (q("l_linenumber") - 1).alias("entry"),
        (1 + q("l_discount") * 10).alias("w"), F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(0).alias("cause"),
    )


def reg(spark: SparkSession, d: str) -> DataFrame:
    q = lambda c: F.col(c).cast("double")
    return read(spark, d, "lineitem").select(
        (q("l_extendedprice") / 1000).alias("y"), q("l_quantity").alias("x1"), q("l_discount").alias("x2"), q("l_tax").alias("x3"), (F.col("l_linestatus") == "F").cast("int").alias("treat"),
        F.col("l_returnflag").alias("flag"), mode().alias("mode"), F.col("l_suppkey").alias("supp"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )


def pred(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select((F.col("l_linestatus") == "F").cast("int").alias("truth"), (F.col("l_quantity").cast("double") / 51.0).alias("prob"), F.col("l_discount").cast("double").alias("score2"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of sums does not show; counts as long."""
    out = []
    for f in df.schema:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        out.append(F.round(c, digits).alias(f.name) if kind == "double" else c.cast("long").alias(f.name) if kind in ("int", "smallint", "tinyint") else c)
    return df.select(*out)


# Table One


@query("""select l_returnflag as grp, count(*) as size, count(nullif(l_tax::double, 0)) as n, count(distinct nullif(l_tax::double, 0)) + max((nullif(l_tax::double, 0) is null)::int) as nunique
from lineitem group by 1""")
def t1_counts(spark, d):
    x = read(spark, d, "lineitem").withColumn("tax", F.expr("nullif(cast(l_tax as double), 0)"))
    return rounded(x.groupBy(F.col("l_returnflag").alias("grp")).agg(C.agg_size("tax").alias("size"), C.agg_count("tax").alias("n"), C.agg_nunique("tax").alias("nunique")))


_T1 = "select {g} as \"group\", count(x) as n, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as sd, round(quantile_cont(x, 0.25), 6) as q1, round(quantile_cont(x, 0.5), 6) as median, round(quantile_cont(x, 0.75), 6) as q3 from (select l_returnflag, l_extendedprice::double as x from lineitem) group by 1"


@query(f"{_T1.format(g='l_returnflag')} union all {_T1.format(g=chr(39) + 'All' + chr(39))}")
def t1_numeric(spark, d):
    return rounded(tableone.numeric_summary(read(spark, d, "lineitem"), "l_extendedprice", "l_returnflag"))


@query("""with x as (select l_returnflag as grp, 'm' || (l_suppkey % 5) as level from lineitem), c as (select grp, level, count(*) as n from x where level <> 'm1' or grp <> 'A' group by all),
t as (select grp, sum(n)::bigint as total from c group by 1), l as (select distinct level from c)
select grp, level, coalesce(n, 0)::bigint as n, total, round(100.0 * coalesce(n, 0) / total, 6)::double as p from t cross join l left join c using (grp, level)""")
def t1_category(spark, d):
    x = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), mode().alias("mode")).where("mode <> 'm1' or grp <> 'A'")
    return rounded(tableone.categories(x, "mode", "grp"))


@query("""select l_returnflag as grp, count(*) filter (l_discount > 0.05) as n, round_even(100.0::double * count(*) filter (l_discount > 0.05) / count(*) * 10, 0) / 10 as p from lineitem group by 1""")
def t1_bool(spark, d):
    x = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), (F.col("l_discount") > 0.05).alias("b"))
    return rounded(x.groupBy("grp").agg(C.agg_bool_n("b").alias("n"), C.agg_bool_p("b").alias("p")))


@query("""with g as (select l_returnflag as g, avg(l_extendedprice::double) as m, var_samp(l_extendedprice::double) as v from lineitem group by 1)
select a.g as a, b.g as b, round(abs(a.m - b.m) / sqrt((a.v + b.v) / 2), 6) as smd from g a join g b on a.g < b.g""")
def t1_smd(spark, d):
    return rounded(tableone.smd_table(read(spark, d, "lineitem"), "l_extendedprice", "l_returnflag"))


@query(f"""with {REG} select flag, round(sum(y * x1) / sum(x1), 6) as wmean, round(sum(x1 * y * w) / sum(w) - sum(x1 * w) / sum(w) * sum(y * w) / sum(w), 5) as wcov,
round((sum(x1 * y * w) / sum(w) - sum(x1 * w) / sum(w) * sum(y * w) / sum(w)) / sqrt((sum(x1 * x1 * w) / sum(w) - pow(sum(x1 * w) / sum(w), 2)) * (sum(y * y * w) / sum(w) - pow(sum(y * w) / sum(w), 2))), 6) as wcorr from (select *, 1 + x2 as w from reg) group by 1""")
def t1_weighted(spark, d):
    x = reg(spark, d).withColumn("w", 1 + F.col("x2"))
    out = x.groupBy("flag").agg(C.weighted_mean("y", "x1").alias("wmean"), F.round(C.weighted_cov("x1", "y", "w"), 5).alias("wcov"), C.weighted_corr("x1", "y", "w").alias("wcorr"))
    return rounded(out)


@query("""with g as (select l_returnflag as grp, count(*)::double as n, count(*) filter (l_discount > 0.05)::double as k from lineitem group by 1), p as (select *, k / n as p, 1.959963984540054 as z from g)
select grp, round(greatest(p - z * sqrt(p * (1 - p) / n), 0), 6) as wald_lo, round(least(p + z * sqrt(p * (1 - p) / n), 1), 6) as wald_hi,
round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) as wilson_lo, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) as wilson_hi from p""")
def t1_proportion_ci(spark, d):
    x = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), (F.col("l_discount") > 0.05).alias("b"))
    ci = x.groupBy("grp").agg(C.proportion_ci("b").alias("a"), C.proportion_ci("b", method="wilson").alias("w"))
    return rounded(ci.select("grp", F.col("a.lo").alias("wald_lo"), F.col("a.hi").alias("wald_hi"), F.col("w.lo").alias("wilson_lo"), F.col("w.hi").alias("wilson_hi")))


@query(f"""with {REG}, v as (select x1, sum(1 + x2) as w from reg group by 1), c as (select x1, sum(w) over (order by x1) / sum(w) over () as c from v)
select greatest(ceil(round(c * 4, 9)) - 1, 0)::bigint as bin, count(*) as n from reg join c using (x1) group by 1""")
def t1_weighted_qcut(spark, d):
    return rounded(tableone.weighted_qcut(reg(spark, d).withColumn("w", 1 + F.col("x2")), "x1", "w", 4).groupBy("bin").agg(F.count("*").alias("n")))


# tests: statistics, of which SQL has no distribution functions for the p values


def _one(spark: SparkSession, **values: float) -> DataFrame:
    return rounded(spark.createDataFrame([tuple(float(v) for v in values.values())], ", ".join(f"{k} double" for k in values)), 5)


@query(f"""with {REG}, g as (select flag, count(*) as n, avg(y) as m, var_pop(y) as v from reg group by 1), t as (select sum(n) as n, count(*) as k, sum(n * m) / sum(n) as m from g)
select round((sum(g.n * pow(g.m - t.m, 2)) / (any_value(t.k) - 1)) / (sum(g.n * g.v) / (any_value(t.n) - any_value(t.k))), 5) as f from g, t""")
def test_anova(spark, d):
    return _one(spark, f=tests.anova(reg(spark, d), "y", "flag").statistic)


@query(f"""with {REG}, r as (select flag, x1, rank() over (order by x1) + (count(*) over (partition by x1) - 1) / 2.0 as rk, count(*) over (partition by x1) as t from reg),
g as (select flag, count(*)::double as n, sum(rk)::double as s from r group by 1), a as (select count(*)::double as n, sum(t * t - 1)::double as ties from r)
select round((12 / (a.n * (a.n + 1)) * (select sum(s * s / n) from g) - 3 * (a.n + 1)) / (1 - a.ties / (pow(a.n, 3) - a.n)), 5) as h from a""")
def test_kruskal(spark, d):
    return _one(spark, h=tests.kruskal(reg(spark, d), "x1", "flag").statistic)


@query(f"""with {REG}, c as (select flag, mode, count(*)::double as n from reg group by all), e as (select *, sum(n) over (partition by flag) * sum(n) over (partition by mode) / sum(n) over () as e from c)
select round(sum(pow(n - e, 2) / e), 5) as chisq from e""")
def test_chisq(spark, d):
    return _one(spark, chisq=tests.chisq_test(reg(spark, d), "flag", "mode").statistic)


@query(f"""with {REG}, g as (select treat, count(*)::double as n, avg(y) as m, var_samp(y) as v from reg group by 1), p as (select a.m - b.m as d, a.v / a.n as p, b.v / b.n as q, a.n as na, b.n as nb from g a, g b where a.treat = 0 and b.treat = 1)
select round(d / sqrt(p + q), 5) as t, round(pow(p + q, 2) / (p * p / (na - 1) + q * q / (nb - 1)), 5) as df from p""")
def test_welch_t(spark, d):
    r = tests.t_test(reg(spark, d), "y", group="treat")
    return _one(spark, t=r.statistic, df=r.df)


@query("""with c as (select l_returnflag = 'A' as a, l_linestatus = 'F' as b, count(*)::double as n from lineitem group by all) select round(pow(abs(x.n - y.n) - 1, 2) / (x.n + y.n), 5) as stat from c x, c y where x.a and not x.b and y.b and not y.a""")
def test_mcnemar(spark, d):
    x = read(spark, d, "lineitem").select((F.col("l_returnflag") == "A").alias("a"), (F.col("l_linestatus") == "F").alias("b"))
    return _one(spark, stat=tests.mcnemar_test(x, "a", "b").statistic)


@query(f"""with {REG}, g as (select treat, count(*)::double as n, count(*) filter (x2 > 0.05)::double as x from reg group by 1), p as (select sum(x) / sum(n) as p from g)
select round(sum(pow(abs(x - n * p) - 0.5 * 0, 2) / (n * p * (1 - p))), 5) as stat from g, p""")
def test_prop(spark, d):
    r = reg(spark, d).groupBy("treat").agg(F.count("*").alias("n"), F.count_if(F.col("x2") > 0.05).alias("x")).collect()
    return _one(spark, stat=tests.prop_test([(x["x"], x["n"]) for x in r], correct=False).statistic)


@query("""with p as (select c_custkey, (c_custkey * 7919 % 10007) / 10007.0::double as p from customer), r as (select *, row_number() over (order by p) as i, count(*) over () as n from p)
select c_custkey, round(least(max((n - i + 1) * p) over (order by p), 1), 6) as holm, round(least(min(n / i::double * p) over (order by p desc), 1), 6) as bh, round(least(n * p, 1), 6) as bonferroni, round(least(min((n - i + 1) * p) over (order by p desc), 1), 6) as hochberg from r""")
def p_adjust(spark, d):
    x = read(spark, d, "customer").select("c_custkey", ((F.col("c_custkey") * 7919 % 10007) / F.lit(10007.0)).alias("p"))
    for name, method in (("holm", "holm"), ("bh", "BH"), ("bonferroni", "bonferroni"), ("hochberg", "hochberg")):
        x = tests.p_adjust(x, "p", method, name)
    return rounded(x.drop("p"))


# survival

_RISK = "c as (select grp, time as t, sum(event)::double as d, count(*)::double as m from surv group by all), r as (select *, sum(m) over (partition by grp order by t desc) as n from c)"


@query(f"""with {SURV}, {_RISK}, s as (select *, product(1 - d / n) over (partition by grp order by t) as s, sum(case when n > d then d / (n * (n - d)) else 0 end) over (partition by grp order by t) as gw, max((d > 0 and d >= n)::int) over (partition by grp order by t) as z from r)
select grp, t, n, d, round(s, 6) as surv, round(case when z = 0 then s * sqrt(gw) end, 6) as std_error, round(case when z = 0 then s * exp(-1.959963984540054 * sqrt(gw)) end, 6) as lower, round(case when z = 0 then least(s * exp(1.959963984540054 * sqrt(gw)), 1) end, 6) as upper from s""")
def km(spark, d):
    return rounded(survival.survival_curve(surv(spark, d), "time", "event", "grp"))


@query(f"""with {SURV}, c as (select grp, time as t, sum(event * w) as d, sum(w) as m from surv group by all), r as (select *, sum(m) over (partition by grp order by t desc) as n from c)
select grp, t, round(product(1 - d / n) over (partition by grp order by t), 6) as surv from r""")
def km_weighted(spark, d):
    return rounded(survival.survival_curve(surv(spark, d), "time", "event", "grp", weight="w").select("grp", "t", "surv"))


@query(f"""with {SURV}, e as (select * from surv where entry < time), c as (select grp, time as t, sum(event)::double as d from e group by all), r as (select c.*, (select count(*) from e where e.grp = c.grp and e.entry < c.t and e.time >= c.t)::double as n from c)
select grp, t, n, d, round(product(1 - d / n) over (partition by grp order by t), 6) as surv from r""")
def km_delayed_entry(spark, d):
    return rounded(survival.survival_curve(surv(spark, d).where("entry < time"), "time", "event", "grp", entry="entry").select("grp", "t", "n", "d", "surv"))


@query(f"""with {SURV}, {_RISK}, h as (select *, sum(d / n) over (partition by grp order by t) as h, sqrt(sum(d / (n * n)) over (partition by grp order by t)) as se from r)
select grp, t, n, d, round(h, 6) as cumhaz, round(se, 6) as std_error, round(greatest(h - 1.959963984540054 * se, 0), 6) as lower, round(h + 1.959963984540054 * se, 6) as upper from h""")
def nelson_aalen(spark, d):
    return rounded(survival.survival_curve(surv(spark, d), "time", "event", "grp", kind="nelson_aalen"))


_KM = f"{SURV}, {_RISK}, s as (select *, product(1 - d / n) over (partition by grp order by t) as s from r)"


@query(f"with {_KM}, a as (select unnest([5.5, 10.0, 30.0])::double as \"at\") select g.grp, \"at\", round(coalesce((select arg_max(s.s, s.t) from s where s.grp = g.grp and s.t <= a.\"at\"), 1), 6) as surv from (select distinct grp from s) g, a")
def km_at(spark, d):
    return rounded(survival.curve_at(survival.survival_curve(surv(spark, d), "time", "event", "grp"), [5.5, 10.0, 30.0]))


@query(f"""with {_KM}, cb as (select *, sum(case when n > d then d / (n * (n - d)) else 0 end) over (partition by grp order by t) as gw, max((d > 0 and d >= n)::int) over (partition by grp order by t) as z from s),
b as (select grp, t, unnest(['time', 'lower', 'upper']) as curve, unnest([s, case when z = 0 then s * exp(-1.959963984540054 * sqrt(gw)) end, case when z = 0 then least(s * exp(1.959963984540054 * sqrt(gw)), 1) end]) as v from cb),
q as (select grp, curve, min(t) filter (v <= 0.5 + 1e-8) as first_t, min(t) filter (v < 0.5 - 1e-8) as below_t from b group by all),
m as (select grp, curve, case when below_t > first_t then (first_t + below_t) / 2 else first_t end as x from q)
select grp, max(x) filter (curve = 'time') as time, max(x) filter (curve = 'lower') as lower, max(x) filter (curve = 'upper') as upper from m group by 1""")
def km_median(spark, d):
    return rounded(survival.curve_quantile(survival.survival_curve(surv(spark, d), "time", "event", "grp")))


@query(f"""with {_KM}, u as (select *, coalesce(lead(t) over (partition by grp order by t), 40) - t as width from s where t <= 40), v as (select *, sum(width * s) over (partition by grp order by t desc) as tail from u)
select grp, round(min(t) + sum(width * s), 6) as rmst, round(sum(case when n > d then tail * tail * d / (n * (n - d)) else 0 end), 6) as variance from v group by 1""")
def rmst(spark, d):
    return rounded(survival.rmst(surv(spark, d), "time", "event", 40.0, "grp"))


def _logrank_sql(rho: float, strata: str) -> str:
    return f"""with {SURV}, e as (select {strata} as s, grp, time as t, sum(event)::double as d, count(*)::double as m from surv group by all), a as (select s, t, sum(d) as d, sum(m) as m from e group by all),
n as (select *, sum(m) over (partition by s order by t desc) as n from a), w as (select *, pow(coalesce(product(1 - d / n) over (partition by s order by t rows between unbounded preceding and 1 preceding), 1), {rho}) as w from n),
h as (select s, t, w, sum(w * d / n) over (partition by s order by t) as h from w) select grp, sum(m)::bigint as n, round(sum(w * d), 5) as observed, round(sum(m * h), 5) as expected from e join h using (s, t) group by 1"""


@query(_logrank_sql(0, "0"))
def log_rank(spark, d):
    return rounded(survival.log_rank_table(surv(spark, d), "time", "event", "grp"), 5)


@query(_logrank_sql(1, "stratum"))
def log_rank_stratified_rho1(spark, d):
    return rounded(survival.log_rank_table(surv(spark, d), "time", "event", "grp", strata="stratum", rho=1.0), 5)


@query(f"""with {SURV}, e as (select stratum as grp, time as t, count(*) filter (cause > 0)::double as d, count(*)::double as m from surv group by all), n as (select *, sum(m) over (partition by grp order by t desc) as n from e),
b as (select *, coalesce(product(1 - d / n) over (partition by grp order by t rows between unbounded preceding and 1 preceding), 1) as b from n), k as (select stratum as grp, time as t, cause, count(*)::double as dk from surv where cause > 0 group by all)
select grp::bigint as grp, t, cause::bigint as cause, round(sum(b * dk / n) over (partition by grp, cause order by t), 6) as cif from k join b using (grp, t)""")
def aalen_johansen(spark, d):
    return rounded(survival.cumulative_incidence(surv(spark, d), "time", "cause", "stratum"))


@query(f"""with {SURV}, e as (select *, unnest([0.0, 10.0, 25.0])::double as tstart from surv), s as (select *, least(time, case tstart when 0 then 10 when 10 then 25 else time end) as tstop from e where tstart < time)
select tstart, count(*) as n, sum(case when tstop = time then event else 0 end)::bigint as events, round(sum(tstop - tstart), 4) as exposure from s group by 1""")
def split_follow_up(spark, d):
    x = survival.split_follow_up(surv(spark, d), "time", "event", [10.0, 25.0])
    return rounded(x.groupBy("tstart").agg(F.count("*").alias("n"), F.sum("event").alias("events"), F.sum(F.col("tstop") - F.col("tstart")).alias("exposure")), 4)


@query(f"with {SURV} select grp, \"at\", count(*) filter (time >= \"at\") as n from surv, (select unnest([1.0, 10.0, 40.0])::double as \"at\") group by all")
def at_risk(spark, d):
    return rounded(survival.at_risk(surv(spark, d), "time", [1.0, 10.0, 40.0], "grp"))


@query()
def cox_efron(spark, d):
    x = surv(spark, d).withColumn("a", (F.col("grp") == "A").cast("int"))
    names, beta, cov, _ = survival.cox_ph(x, "time", "event", ["a", "w"])
    return spark.createDataFrame([(n, float(b), float(v) ** 0.5) for n, b, v in zip(names, beta, cov.diagonal(), strict=True)], "term string, estimate double, std_error double")


# prediction


@query(f"with {PRED} select round(avg(pow(prob - truth, 2)), 6) as brier from pred")
def brier(spark, d):
    return rounded(prediction.brier_score(pred(spark, d), "truth", "prob"))


@query(f"with {PRED}, b as (select *, (prob >= 0.1)::int + (prob >= 0.2)::int + (prob >= 0.3)::int + (prob >= 0.4)::int + (prob >= 0.5)::int + (prob >= 0.6)::int + (prob >= 0.7)::int + (prob >= 0.8)::int + (prob >= 0.9)::int as bin from pred) select bin::bigint as bin, count(*) as n, round(avg(prob), 6) as mean_prob, round(avg(truth), 6) as observed from b group by 1")
def calibration(spark, d):
    return rounded(prediction.calibration_table(pred(spark, d), "truth", "prob"))


_GRID = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9]


@query(f"""with {PRED}, t as (select unnest({_GRID})::double as threshold) select threshold, count(*) filter (truth = 1 and prob >= threshold) as tp, count(*) filter (truth = 0 and prob >= threshold) as fp, count(*) filter (truth = 1 and prob < threshold) as fn, count(*) filter (truth = 0 and prob < threshold) as tn from pred, t group by 1""")
def threshold_tradeoff(spark, d):
    return rounded(prediction.threshold_tradeoff(pred(spark, d), "truth", "prob", _GRID))


@query(f"""with {PRED}, t as (select unnest({_GRID})::double as threshold) select threshold, round(count(*) filter (truth = 1 and prob >= threshold) / count(*) - count(*) filter (truth = 0 and prob >= threshold) / count(*) * threshold / (1 - threshold), 6) as net_benefit,
round(avg(truth) - (1 - avg(truth)) * threshold / (1 - threshold), 6) as treat_all, 0.0::double as treat_none from pred, t group by 1""")
def decision_curve(spark, d):
    return rounded(prediction.decision_curve(pred(spark, d), "truth", "prob", _GRID))


@query(f"""with {PRED}, s as (select prob as score, sum(truth)::double as p, count(*) - sum(truth)::double as n from pred group by 1)
select round(score, 6) as score, round(sum(p) over (order by score desc) / sum(p) over (), 6) as sensitivity, round(1 - sum(n) over (order by score desc) / sum(n) over (), 6) as specificity from s""")
def roc_points(spark, d):
    return rounded(prediction.roc_points(pred(spark, d), "truth", "prob"))


_AUC = """s as (select prob as x, sum(truth)::double as p, count(*) - sum(truth)::double as n from pred group by 1), v as (select *, (sum(n) over (order by x) - n / 2) / sum(n) over () as v10, (sum(p) over () - sum(p) over (order by x) + p / 2) / sum(p) over () as v01 from s),
a as (select sum(p) as np, sum(n) as nn, sum(p * v10) as a, sum(p * v10 * v10) as aa, sum(n * v01) as b, sum(n * v01 * v01) as bb from v)"""


@query(f"with {PRED}, {_AUC} select round(a / np, 6) as auc, round((aa - a * a / np) / (np - 1) / np + (bb - b * b / nn) / (nn - 1) / nn, 9) as variance from a")
def auc_delong(spark, d):
    return rounded(prediction.auc(pred(spark, d), "truth", "prob"), 9).withColumn("auc", F.round("auc", 6))


@query(f"with {PRED}, {_AUC} select round(a / np, 6) as c, round(2 * (a / np - 0.5), 6) as dxy from a")
def somers_dxy(spark, d):
    return rounded(prediction.somers_dxy(pred(spark, d), "truth", "prob"))


@query(f"with {REG}, r as (select x1, row_number() over (order by x1) as i, count(*) over () as n from reg) select round(2 * sum((2 * i - n - 1) * x1) / (any_value(n) * (any_value(n) - 1.0::double)), 6) as gini from r")
def gini_mean_difference(spark, d):
    return rounded(prediction.gini_mean_difference(reg(spark, d), "x1"))


# regression

_CRAMER = """m as (select count(*)::double as n, avg(x1) as a, avg(x2) as b, avg(y) as c from reg), s as (select sum((x1 - a) * (x1 - a)) as saa, sum((x2 - b) * (x2 - b)) as sbb, sum((x1 - a) * (x2 - b)) as sab, sum((x1 - a) * (y - c)) as sac, sum((x2 - b) * (y - c)) as sbc from reg, m),
f as (select (sac * sbb - sbc * sab) / (saa * sbb - sab * sab) as b1, (sbc * saa - sac * sab) / (saa * sbb - sab * sab) as b2 from s), k as (select c - b1 * a - b2 * b as b0, b1, b2 from f, m)"""


@query(f"with {REG}, {_CRAMER} select '(Intercept)' as term, round(b0, 5) as estimate from k union all select 'x1', round(b1, 5) from k union all select 'x2', round(b2, 5) from k")
def ols(spark, d):
    return rounded(regression.fit_ols(reg(spark, d), "y ~ x1 + x2").tidy().select("term", "estimate"), 5)


def _hc_sql(kind: str) -> str:
    factor = {"HC0": "1", "HC1": "n / (n - 2)", "HC3": "1 / pow(1 - h, 2)"}[kind]
    return f"""(select sqrt(sum({factor} * pow(e * (x1 - a), 2))) / any_value(saa) from (select r.*, y - (c + sac / saa * (x1 - a)) as e, 1 / n + pow(x1 - a, 2) / saa as h, a, n, saa from reg r, m, s))"""


@query(f"with {REG}, {_CRAMER} select round({_hc_sql('HC0')}, 7) as hc0, round({_hc_sql('HC1')}, 7) as hc1, round({_hc_sql('HC3')}, 7) as hc3")
def ols_robust(spark, d):
    fit = regression.fit_ols(reg(spark, d), "y ~ x1")
    return rounded(spark.createDataFrame([tuple(float(regression.hc_covariance(fit, k)[1, 1] ** 0.5) for k in ("HC0", "HC1", "HC3"))], "hc0 double, hc1 double, hc3 double"), 7)


@query(f"""with {REG}, {_CRAMER}, e as (select supp, sum((y - (c + sac / saa * (x1 - a))) * (x1 - a)) as u, any_value(saa) as saa, any_value(n) as n from reg, m, s group by 1)
select round(sqrt(count(*) / (count(*) - 1.0::double) * (any_value(n) - 1) / (any_value(n) - 2) * sum(u * u)) / any_value(saa), 7) as se from e""")
def ols_cluster(spark, d):
    x = reg(spark, d)
    fit = regression.fit_ols(x, "y ~ x1")
    return rounded(spark.createDataFrame([(float(regression.cluster_covariance(fit, x, "y ~ x1", ["supp"])[1, 1] ** 0.5),)], "se double"), 7)


@query(f"""with {REG}, {_CRAMER}, e as (select ord, y, x1, x2, x3, y - (c + sac / saa * (x1 - a)) as e from reg, m, s), l as (select e, lag(e) over (order by ord, y, x1, x2, x3) as b from e) select round(sum(pow(e - b, 2)) / sum(e * e), 6) as dw from l""")
def durbin_watson(spark, d):
    return rounded(regression.durbin_watson(reg(spark, d), "y ~ x1", ["ord", "y", "x1", "x2", "x3"]))


@query(f"""with {REG}, {_CRAMER}, e as (select ord, y, x1, x2, x3, (y - (c + sac / saa * (x1 - a))) * (x1 - a) as u, saa from reg, m, s), l as (select u, saa, lag(u, 1) over w as u1, lag(u, 2) over w as u2 from e window w as (order by ord, y, x1, x2, x3))
select round(sqrt(sum(u * u) + 2 * (2.0 / 3 * sum(u * u1) + 1.0 / 3 * sum(u * u2))) / any_value(saa), 7) as se from l""")
def newey_west(spark, d):
    v = regression.newey_west(reg(spark, d), "y ~ x1", ["ord", "y", "x1", "x2", "x3"], 2)
    return rounded(spark.createDataFrame([(float(v[1, 1] ** 0.5),)], "se double"), 7)


@query(f"""with {REG}, g as (select flag, ln(avg(treat) / (1 - avg(treat))) as l from reg group by 1), r as (select min_by(l, flag) as base from g)
select case when flag = (select min(flag) from g) then '(Intercept)' else 'flag' || flag end as term, round(case when flag = (select min(flag) from g) then l else l - base end, 5) as estimate from g, r""")
def glm_binomial(spark, d):
    return rounded(regression.fit_glm(reg(spark, d), "treat ~ flag", "binomial").tidy().select("term", "estimate"), 5)


@query(f"""with {REG}, g as (select flag, ln(avg(x1)) as l from reg group by 1), r as (select min_by(l, flag) as base from g)
select case when flag = (select min(flag) from g) then '(Intercept)' else 'flag' || flag end as term, round(case when flag = (select min(flag) from g) then l else l - base end, 5) as estimate from g, r""")
def glm_poisson(spark, d):
    return rounded(regression.fit_glm(reg(spark, d), "x1 ~ flag", "poisson").tidy().select("term", "estimate"), 5)


@query()
def glm_gamma(spark, d):
    return regression.fit_glm(reg(spark, d), "y ~ x1 + flag", "gamma").tidy()


# causal


@query(f"""with {REG}, c as (select flag, mode, count(*) filter (treat = 1) as treated, count(*) filter (treat = 0) as controls from reg group by all having treated > 0 and controls > 0)
select flag, mode, treated, controls, 1.0::double as w_treated, round(treated / controls * sum(controls) over () / sum(treated) over (), 6) as w_control from c""")
def exact_match(spark, d):
    return rounded(causal.exact_match(reg(spark, d), "treat", ["flag", "mode"]))


@query(f"""with {REG}, c as (select (x1 >= 10)::int + (x1 >= 25)::int as x1_bin, (x2 >= 0.05)::int as x2_bin, count(*) filter (treat = 1) as treated, count(*) filter (treat = 0) as controls from reg group by all having treated > 0 and controls > 0)
select x1_bin::bigint as x1_bin, x2_bin::bigint as x2_bin, treated, controls, 1.0::double as w_treated, round(treated / controls * sum(controls) over () / sum(treated) over (), 6) as w_control from c""")
def cem(spark, d):
    return rounded(causal.cem(reg(spark, d), "treat", {"x1": [10.0, 25.0], "x2": [0.05]}))


def _weights_sql(estimand: str) -> str:
    w = {"ATE": "case when treat = 1 then 1 / ps else 1 / (1 - ps) end", "ATT": "case when treat = 1 then 1 else ps / (1 - ps) end", "ATC": "case when treat = 1 then (1 - ps) / ps else 1 end", "ATO": "case when treat = 1 then 1 - ps else ps end"}[estimand]
    return f"with {REG}, p as (select *, avg(treat) over (partition by flag, mode) as ps from reg), w as (select *, {w} as w from p) select treat::bigint as arm, count(*) as n, round(avg(w), 6) as mean_w, round(max(w), 6) as max_w, round(pow(sum(w), 2) / sum(w * w), 4) as ess from w group by 1"


def _weights(estimand: str):
    def run(spark, d):
        x = causal.saturated_propensity(reg(spark, d), "treat", ["flag", "mode"])
        x = causal.weight_summary(causal.propensity_weights(x, "treat", "ps", estimand), "treat", "weight")
        return rounded(x).withColumn("ess", F.round("ess", 4))

    run.__name__ = f"iptw_{estimand.lower()}"
    return run


for _e in ("ATE", "ATT", "ATC", "ATO"):
    query(_weights_sql(_e))(_weights(_e))


@query(f"""with {REG}, g as (select treat, avg(x1) as m1, var_samp(x1) as v1, avg(x2) as m2, var_samp(x2) as v2 from reg group by 1), p as (select a.m1 as t1, b.m1 as c1, a.v1 + b.v1 as s1, a.m2 as t2, b.m2 as c2, a.v2 + b.v2 as s2 from g a, g b where a.treat = 1 and b.treat = 0)
select 'x1' as covariate, round(t1, 6) as mean_treated, round(c1, 6) as mean_control, round((t1 - c1) / sqrt(s1 / 2), 6) as smd from p union all select 'x2', round(t2, 6), round(c2, 6), round((t2 - c2) / sqrt(s2 / 2), 6) from p""")
def balance(spark, d):
    return rounded(causal.balance(reg(spark, d), "treat", ["x1", "x2"]))


@query(f"""with {REG}, c as (select mode, count(*) as n, avg(y) filter (treat = 1) as m1, avg(y) filter (treat = 0) as m0 from reg group by 1), s as (select sum(n * m1) / sum(n) as m1, sum(n * m0) / sum(n) as m0, round(sum(n) / (select sum(n) from c), 6)::double as share from c where m1 is not null and m0 is not null)
select 1::bigint as arm, round(m1, 6) as mean, share from s union all select 0, round(m0, 6), share from s""")
def standardize(spark, d):
    return rounded(causal.standardize(reg(spark, d), "treat", "y", ["mode"]))


@query(f"""with {REG}, f as (select flag as term, supp % 5 as i, avg(y) as e, stddev_samp(y) / sqrt(count(*)) as s from reg group by all), g as (select term, avg(e) as e, avg(s * s) as w, var_samp(e) as b from f group by 1)
select term, round(e, 6) as estimate, round(sqrt(w + 1.2 * b), 6) as std_error, round(1.2 * b / (w + 1.2 * b), 6) as lambda from g""")
def pool_rubin(spark, d):
    fits = reg(spark, d).groupBy(F.col("flag").alias("term"), F.col("supp") % 5).agg(F.avg("y").alias("estimate"), (F.stddev_samp("y") / F.sqrt(F.count("*"))).alias("std_error"))
    return rounded(causal.pool_rubin(fits, 5))


# economics

_PSA = "psa as (select l_orderkey as draw, l_returnflag as strategy, sum(l_extendedprice::double) as cost, sum(l_quantity::double) as effect from lineitem group by all)"
_WTP = [500.0, 1500.0, 3000.0]


def _psa(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("draw"), F.col("l_returnflag").alias("strategy")).agg(F.sum(F.col("l_extendedprice").cast("double")).alias("cost"), F.sum(F.col("l_quantity").cast("double")).alias("effect"))


@query(f"""with {_PSA}, e as (select *, unnest({_WTP})::double as wtp from psa), r as (select *, row_number() over (partition by wtp, draw order by wtp * effect - cost desc, strategy) as i from e), w as (select wtp, strategy, count(*) as k from r where i = 1 group by all)
select wtp, strategy, round(k / sum(k) over (partition by wtp), 6) as probability from w""")
def ceac(spark, d):
    return rounded(economics.ceac(_psa(spark, d), "draw", "strategy", "cost", "effect", _WTP))


@query(f"""with {_PSA}, e as (select *, unnest({_WTP})::double as wtp from psa), n as (select *, wtp * effect - cost as nmb from e), p as (select wtp, avg(m) as p from (select wtp, draw, max(nmb) as m from n group by all) group by 1), c as (select wtp, max(m) as c from (select wtp, strategy, avg(nmb) as m from n group by all) group by 1)
select wtp, round(p - c, 4) as evpi from p join c using (wtp)""")
def evpi(spark, d):
    return rounded(economics.evpi(_psa(spark, d), "draw", "strategy", "cost", "effect", _WTP), 4)


@query("""with m as (select 'm' || (l_suppkey % 5) as strategy, avg(l_extendedprice::double) as cost, avg(l_quantity::double) as effect from lineitem group by 1) select strategy from m where exists (select 1 from m o where o.cost <= m.cost and o.effect >= m.effect and (o.cost < m.cost or o.effect > m.effect))""")
def strong_dominance(spark, d):
    m = read(spark, d, "lineitem").groupBy(mode().alias("strategy")).agg(F.avg(F.col("l_extendedprice").cast("double")).alias("cost"), F.avg(F.col("l_quantity").cast("double")).alias("effect"))
    return economics.strongly_dominated(m, "strategy", "cost", "effect").select("strategy")


@query("""with c as (select l_returnflag as grp, l_quantity::double as x from lineitem), n as (select x, log(x) as l, sqrt(x) as s from c) select round(sum(l), 4) as log10_sum, round(sum(s), 4) as sqrt_sum from n""")
def formula_columns(spark, d):
    des = regression.design("~ log10(x1) + sqrt(x1) - 1", reg(spark, d))
    return rounded(reg(spark, d).select(*(c.alias(n) for n, c in zip(("l", "s"), des.columns, strict=True))).agg(F.sum("l").alias("log10_sum"), F.sum("s").alias("sqrt_sum")), 4)


# text aggregates of Table One

_FIXED = "printf('%.1f', round_even(({}) * 10, 0) / 10)"


def _fixed(x: str) -> str:
    return _FIXED.format(x)


@query(f"""with x as (select l_returnflag as grp, l_quantity::double as q, (l_discount > 0.05)::int as b, nullif(l_tax::double, 0) as tax from lineitem), a as (select grp, avg(q) as m, stddev_samp(q) as sd, quantile_cont(q, 0.25) as q1, median(q) as med, quantile_cont(q, 0.75) as q3, min(q) as lo, max(q) as hi, count(*) as n, sum(b) as k, 100.0::double * sum(b) / count(*) as p, count(tax) / count(*) as filled from x group by 1)
select grp, round_even(m * 10, 0) / 10 as mean, {_fixed('m')} || ' (' || {_fixed('sd')} || ')' as mean_sd, round_even(med * 10, 0) / 10 as median, {_fixed('med')} || ' [' || {_fixed('q1')} || ', ' || {_fixed('q3')} || ']' as median_iqr, {_fixed('med')} || ' (' || {_fixed('lo')} || '-' || {_fixed('hi')} || ')' as median_range,
{_fixed('lo')} || '-' || {_fixed('hi')} as range, k || ' (' || {_fixed('p')} || '%)' as np, {_fixed('p')} || '% (' || k || '/' || n || ')' as pnn, k::bigint as ratio_n, round_even(p * 10, 0) / 10 as ratio, round(filled, 6) as filled from a""")
def t1_text(spark, d):
    x = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_quantity").cast("double").alias("q"), (F.col("l_discount") > 0.05).alias("b"), F.expr("nullif(cast(l_tax as double), 0)").alias("tax"))
    return rounded(
        x.groupBy("grp").agg(
            C.agg_mean("q").alias("mean"), C.agg_mean_sd("q").alias("mean_sd"), C.agg_median("q").alias("median"), C.agg_median_iqr("q").alias("median_iqr"), C.agg_median_range("q").alias("median_range"), C.agg_range("q").alias("range"),
            C.agg_bool_np("b").alias("np"), C.agg_ratio_pnn("b").alias("pnn"), C.agg_ratio_n("b").alias("ratio_n"), C.agg_ratio("b").alias("ratio"), C.notnull_mean("tax").alias("filled"),
        )
    )


@query("""with x as (select 'm' || (l_suppkey % 5) as level, l_returnflag as grp from lineitem), c as (select grp, level, count(*) as n from x group by all), t as (select *, sum(n) over (partition by grp)::bigint as total from c)
select grp, level, n || ' (' || printf('%.1f', round_even(1000.0::double * n / total, 0) / 10) || '%)' as np, printf('%.1f', round_even(1000.0::double * n / total, 0) / 10) || '% (' || n || '/' || total || ')' as pnn, n::varchar as n, printf('%.1f', round_even(1000.0::double * n / total, 0) / 10) as p from t""")
def t1_category_text(spark, d):
    x = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), mode().alias("mode"))
    out = None
    for style in ("np", "pnn", "n", "p"):
        own = tableone.category_text(x, "mode", "grp", style=style).withColumnRenamed("text", style)
        out = own if out is None else out.join(own, ["grp", "level"])
    return out


@query(f"""with {REG}, g as (select flag, avg((x2 > 0.05)::int) as p from reg group by 1), e as (select flag, p, p / (select p from g where flag = 'A') as rr from g)
select flag, round(p / (1 - p), 6) as odds, round((p / (1 - p)) / (select p / (1 - p) from g where flag = 'A'), 6) as oddsratio, round(greatest(rr, 1 / rr) + sqrt(greatest(rr, 1 / rr) * (greatest(rr, 1 / rr) - 1)), 6) as e_value from e""")
def t1_odds(spark, d):
    g = reg(spark, d).groupBy("flag").agg(F.avg((F.col("x2") > 0.05).cast("double")).alias("p"))
    base = g.where("flag = 'A'").select(F.col("p").alias("base"))
    return rounded(g.crossJoin(F.broadcast(base)).select("flag", C.odds(F.col("p")).alias("odds"), C.oddsratio(F.col("p"), F.col("base")).alias("oddsratio"), C.e_value(F.col("p") / F.col("base")).alias("e_value")))


@query(f"with {REG} select flag, round((avg(y) - avg(x1)) / sqrt((var_samp(y) + var_samp(x1)) / 2), 6) as d from reg group by 1")
def t1_cohen_d(spark, d):
    return rounded(reg(spark, d).groupBy("flag").agg(C.cohen_d("y", "x1").alias("d")))


@query(f"""with {REG}, m as (select flag, sum(x1 * (1 + x2)) / sum(1 + x2) as a, sum(y * (1 + x2)) / sum(1 + x2) as b from reg group by 1), e as (select flag, 1 + x2 as w, x1 - a as u, y - b as v, a, b from reg join m using (flag))
select flag, round(any_value(a), 6) as mean_x, round(any_value(b), 6) as mean_y, round(sum(w * u * v) / sum(w), 5) as cov, round(sum(w * u * v) / sqrt(sum(w * u * u) * sum(w * v * v)), 6) as corr from e group by 1""")
def t1_weighted_moments(spark, d):
    out = tableone.weighted_moments(reg(spark, d).withColumn("w", 1 + F.col("x2")), "x1", "y", "w", "flag")
    return rounded(out.withColumn("cov", F.round("cov", 5)))


# more tests

_NATION = "c as (select count(*) filter (n_regionkey < 2 and n_nationkey % 3 = 0) as a, count(*) filter (n_regionkey < 2 and n_nationkey % 3 > 0) as b, count(*) filter (n_regionkey >= 2 and n_nationkey % 3 = 0) as c, count(*) filter (n_regionkey >= 2 and n_nationkey % 3 > 0) as d from nation)"


def _nation(spark, d):
    at = lambda x: F.count_if(F.expr(x))
    return read(spark, d, "nation").agg(at("n_regionkey < 2 and n_nationkey % 3 = 0").alias("a"), at("n_regionkey < 2 and n_nationkey % 3 > 0").alias("b"), at("n_regionkey >= 2 and n_nationkey % 3 = 0").alias("c"), at("n_regionkey >= 2 and n_nationkey % 3 > 0").alias("d")).first()


@query(f"""with {_NATION}, k as (select unnest(range(0, 26)) as k, a + c as x, a + b + c + d as n from c), p as (select k, x, n, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.4) + (n - k) * ln(0.6)) as p from k where k <= n)
select round(sum(p) filter (p <= (select p from p where k = x) * (1 + 1e-7)), 5) as two_sided, round(sum(p) filter (k <= x), 5) as less, round(sum(p) filter (k >= x), 5) as greater from p""")
def test_binom(spark, d):
    r = _nation(spark, d)
    x, n = r["a"] + r["c"], sum(r)
    return _one(spark, two_sided=tests.binom_test(x, n, 0.4).p_value, less=tests.binom_test(x, n, 0.4, alternative="less").p_value, greater=tests.binom_test(x, n, 0.4, alternative="greater").p_value)


@query(f"""with {_NATION}, k as (select unnest(range(0, 26)) as k, * from c), p as (select k, a, exp(lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) + lgamma(c + d + 1) - lgamma(a + c - k + 1) - lgamma(c + d - a - c + k + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1)) as p from k where k <= a + b and k <= a + c and k >= a + c - c - d)
select round(least(sum(p) filter (p <= (select p from p where k = a) * (1 + 1e-7)), 1), 5) as p from p""")
def test_fisher(spark, d):
    return _one(spark, p=tests.fisher_exact(*_nation(spark, d)))


@query(f"""with {REG}, r as (select treat, rank() over (order by x1) + (count(*) over (partition by x1) - 1) / 2.0 as rk from reg) select round(sum(rk)::double - count(*) * (count(*) + 1.0::double) / 2, 5) as w from r where treat = 0""")
def test_wilcoxon(spark, d):
    return _one(spark, w=tests.wilcox_test(reg(spark, d), "x1", "treat").statistic)


@query("""with p as (select c_custkey, (c_custkey * 7919 % 10007) / 10007.0::double as p from customer), r as (select *, row_number() over (order by p) as i, count(*) over () as n from p), h as (select sum(1.0::double / i) as h from r)
select c_custkey, round(least(min(h * n / i::double * p) over (order by p desc), 1), 6) as adjusted from r, h""")
def p_adjust_by(spark, d):
    x = read(spark, d, "customer").select("c_custkey", ((F.col("c_custkey") * 7919 % 10007) / F.lit(10007.0)).alias("p"))
    return rounded(tests.p_adjust(x, "p", "BY").drop("p"))


# tests of regressions

_RSS = f"""{_CRAMER}, e as (select n, pow(y - (c + sac / saa * (x1 - a)), 2) as e0, pow(y - b0 - b1 * x1 - b2 * x2, 2) as e1 from reg, m, s, k), q as (select any_value(n) as n, sum(e0) as r0, sum(e1) as r1 from e)"""


@query(f"with {REG}, {_RSS} select round((r0 - r1) / (r1 / (n - 3)), 4) as f, round(n * ln(r0 / r1), 4) as lr from q")
def wald_lr(spark, d):
    x = reg(spark, d)
    full, less = regression.fit_ols(x, "y ~ x1 + x2"), regression.fit_ols(x, "y ~ x1")
    return rounded(spark.createDataFrame([(float(regression.wald_test(full, less)[0]), float(regression.likelihood_ratio_test(full, less)[0]))], "f double, lr double"), 4)


@query(f"with {REG}, {_CRAMER}, e as (select x1, pow(y - (c + sac / saa * (x1 - a)), 2) as e2 from reg, m, s) select round(count(*) * pow(corr(e2, x1), 2), 4) as lm from e")
def breusch_pagan(spark, d):
    return rounded(spark.createDataFrame([(float(regression.breusch_pagan(reg(spark, d), "y ~ x1")[0]),)], "lm double"), 4)


@query(f"with {REG}, v as (select corr(x1, x2) as r from reg) select 'x1' as term, round(1 / (1 - r * r), 6) as vif from v union all select 'x2', round(1 / (1 - r * r), 6) from v")
def vif(spark, d):
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in regression.vif(regression.fit_ols(reg(spark, d), "y ~ x1 + x2")).items()], "term string, vif double"))


@query(f"""with {REG}, {_CRAMER}, ff as (select y, x1 - a as f, x1 from reg, m), z as (select *, f * f as f2 from ff),
t as (select count(*)::double as n, avg(x1) as a, avg(f2) as b, avg(y) as c from z), u as (select sum((x1 - a) * (x1 - a)) as saa, sum((f2 - b) * (f2 - b)) as sbb, sum((x1 - a) * (f2 - b)) as sab, sum((x1 - a) * (y - c)) as sac, sum((f2 - b) * (y - c)) as sbc, sum((y - c) * (y - c)) as syy, any_value(n) as n from z, t),
r as (select n, syy - sac * sac / saa as r0, syy - (sac * (sac * sbb - sbc * sab) + sbc * (sbc * saa - sac * sab)) / (saa * sbb - sab * sab) as r1 from u) select round((r0 - r1) / (r1 / (n - 3)), 3) as f from r""")
def reset_test(spark, d):
    return rounded(spark.createDataFrame([(float(regression.ramsey_reset(reg(spark, d), "y ~ x1", powers=(2,))[0]),)], "f double"), 3)


@query(f"""with {REG}, {_CRAMER}, e as (select x1, y - (c + sac / saa * (x1 - a)) as e, coalesce(lag(y - (c + sac / saa * (x1 - a))) over (order by ord, y, x1, x2, x3), 0) as l from reg, m, s),
t as (select count(*)::double as n, avg(x1) as a, avg(l) as b, avg(e) as c from e), u as (select sum((x1 - a) * (x1 - a)) as saa, sum((l - b) * (l - b)) as sbb, sum((x1 - a) * (l - b)) as sab, sum((x1 - a) * (e - c)) as sac, sum((l - b) * (e - c)) as sbc, sum((e - c) * (e - c)) as syy, any_value(n) as n from e, t)
select round(n * (sac * (sac * sbb - sbc * sab) + sbc * (sbc * saa - sac * sab)) / (saa * sbb - sab * sab) / syy, 4) as lm from u""")
def breusch_godfrey(spark, d):
    return rounded(spark.createDataFrame([(float(regression.breusch_godfrey(reg(spark, d), "y ~ x1", ["ord", "y", "x1", "x2", "x3"], 1)[0]),)], "lm double"), 4)


@query(f"""with {REG}, m as (select avg(x1) as a, stddev_pop(x1) as sa, avg(x2) as b, stddev_pop(x2) as sb, avg(y) as c from reg), r as (select avg((x1 - a) / sa * (x2 - b) / sb) as r, avg((x1 - a) / sa * (y - c)) as p, avg((x2 - b) / sb * (y - c)) as q from reg, m)
select lam, round(((1 + lam) * p - r * q) / (pow(1 + lam, 2) - r * r) / sa, 5) as x1, round(((1 + lam) * q - r * p) / (pow(1 + lam, 2) - r * r) / sb, 5) as x2 from m, r, (select unnest([0.1, 1.0])::double as lam)""")
def ridge(spark, d):
    out = regression.ridge(reg(spark, d), "y ~ x1 + x2", [0.1, 1.0])
    return rounded(spark.createDataFrame([(k, float(v[1]), float(v[2])) for k, v in out.items()], "lam double, x1 double, x2 double"), 5)


@query(f"""with {REG}, m as (select avg(x1) as a, stddev_pop(x1) as sa, avg(y) as c from reg), r as (select avg((x1 - a) / sa * (y - c)) as p from reg, m)
select lam, round(greatest(abs(p) - 0.5 * lam, 0) * sign(p) / (1 + 0.5 * lam) / sa, 5) + 0.0 as x1 from m, r, (select unnest([0.1, 1.0])::double as lam)""")
def elastic_net(spark, d):
    out = models.elastic_net(reg(spark, d), "y ~ x1", [0.1, 1.0], alpha=0.5)
    return rounded(spark.createDataFrame([(k, float(v[1]) + 0.0) for k, v in out.items()], "lam double, x1 double"), 5)


@query(f"""with {REG}, g as (select flag, ln(avg(treat)) as l from reg group by 1), r as (select min_by(l, flag) as base from g)
select case when flag = (select min(flag) from g) then '(Intercept)' else 'flag' || flag end as term, round(exp(case when flag = (select min(flag) from g) then l else l - base end), 5) as ratio from g, r""")
def risk_ratio(spark, d):
    fit, _ = models.fit_risk_ratio(reg(spark, d), "treat ~ flag")
    return rounded(fit.tidy(exponentiate=True).select("term", F.col("estimate").alias("ratio")), 5)


@query(f"""with {REG}, g as (select (x2 > 0.05)::int as h, ln((sum(treat) + 0.5) / (count(*) - sum(treat) + 0.5)) as l from reg group by 1)
select '(Intercept)' as term, round(l, 4) as estimate from g where h = 0 union all select 'h', round((select l from g where h = 1) - l, 4) from g where h = 0""")
def firth(spark, d):
    x = reg(spark, d).withColumn("h", (F.col("x2") > 0.05).cast("int"))
    return rounded(models.fit_firth(x, "treat ~ h").tidy(spark).select("term", "estimate"), 4)


@query(f"""with {REG}, c as (select flag, treat, count(*)::double as n from reg where x1 <= 25 group by all), g as (select flag, ln(sum(n) filter (treat = 0) + 0) as a from c group by 1), b as (select min_by(a, flag) as base from g)
select flag || ':(Intercept)' as term, round(a - base, 4) as estimate from g, b where flag > (select min(flag) from g)""")
def multinomial(spark, d):
    x = reg(spark, d).where("x1 <= 25 and treat = 0")
    return rounded(models.multinomial_regression(x, "flag ~ 1").tidy(spark).select("term", "estimate"), 4)


@query(f"""with {REG}, c as (select mode, count(*)::double as n from reg group by 1), o as (select mode, lead(mode) over (order by mode) as next, sum(n) over (order by mode) / sum(n) over () as p from c)
select mode || '|' || next as term, round(ln(p / (1 - p)), 4) as estimate from o where next is not null""")
def ordinal(spark, d):
    return rounded(models.ordinal_regression(reg(spark, d), "mode ~ 1").tidy(spark).select("term", "estimate"), 4)


@query(f"""with {SURV}, g as (select grp, ln(sum(time) / sum(event)) as l from surv where time > 0 and grp <> 'N' group by 1), r as (select min_by(l, grp) as base from g)
select case when grp = (select min(grp) from g) then '(Intercept)' else 'grp' || grp end as term, round(case when grp = (select min(grp) from g) then l else l - base end, 4) as estimate from g, r""")
def aft_exponential(spark, d):
    x = surv(spark, d).where("time > 0 and grp <> 'N'")
    return rounded(models.accelerated_failure(x, "time", "event", "grp", "exponential").tidy(spark).select("term", "estimate"), 4)


@query(f"""with {REG}, g as (select flag, 1 / avg(y) as l from reg group by 1), r as (select min_by(l, flag) as base from g)
select case when flag = (select min(flag) from g) then '(Intercept)' else 'flag' || flag end as term, round(case when flag = (select min(flag) from g) then l else l - base end, 7) as estimate from g, r""")
def glm_gamma_saturated(spark, d):
    return rounded(regression.fit_glm(reg(spark, d), "y ~ flag", "gamma").tidy().select("term", "estimate"), 7)


# more of predictions


@query(f"""with {PRED}, c as (select count(*) filter (truth = 1 and prob >= 0.5)::double as tp, count(*) filter (truth = 0 and prob >= 0.5)::double as fp, count(*) filter (truth = 1 and prob < 0.5)::double as fn, count(*) filter (truth = 0 and prob < 0.5)::double as tn from pred)
select round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round(tp / (tp + fn), 6) as sensitivity, round(tn / (tn + fp), 6) as specificity, round(tp / (tp + fp), 6) as ppv, round(tn / (tn + fn), 6) as npv, round(2 * tp / (2 * tp + fp + fn), 6) as f1, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) as mcc from c""")
def binary_metrics(spark, d):
    m = prediction.binary_metrics(pred(spark, d).withColumn("p", (F.col("prob") >= 0.5).cast("int")), "truth", "p")
    names = ["accuracy", "sensitivity", "specificity", "ppv", "npv", "f1", "mcc"]
    return rounded(spark.createDataFrame([tuple(float(m[n]) for n in names)], ", ".join(f"{n} double" for n in names)))


@query(f"""with {PRED}, s as (select prob as score, sum(truth)::double as p, count(*) - sum(truth)::double as n from pred group by 1), r as (select score, sum(p) over (order by score desc) / sum(p) over () as sensitivity, 1 - sum(n) over (order by score desc) / sum(n) over () as specificity from s)
select round(score, 6) as score, round(sensitivity, 6) as sensitivity, round(specificity, 6) as specificity, round(sensitivity + specificity - 1, 6) as youden from r where round(sensitivity + specificity - 1, 12) = (select max(round(sensitivity + specificity - 1, 12)) from r)""")
def youden(spark, d):
    return rounded(prediction.youden(pred(spark, d), "truth", "prob"))


def _placed(x: str) -> str:
    return f"(select {x} as x, sum(truth)::double as p, count(*) - sum(truth)::double as n from pred group by 1)"


def _place(x: str) -> str:
    return f"(select x, (sum(n) over (order by x) - n / 2) / sum(n) over () as v10, (sum(p) over () - sum(p) over (order by x) + p / 2) / sum(p) over () as v01 from {_placed(x)})"


@query(f"""with {PRED}, v as (select truth, a.v10 as a10, a.v01 as a01, b.v10 as b10, b.v01 as b01 from pred join {_place('prob')} a on pred.prob = a.x join {_place('score2')} b on pred.score2 = b.x),
t as (select avg(a10) filter (truth = 1) as auc1, avg(b10) filter (truth = 1) as auc2, var_samp(a10 - b10) filter (truth = 1) / count(*) filter (truth = 1) + var_samp(a01 - b01) filter (truth = 0) / count(*) filter (truth = 0) as v from v)
select round(auc1, 6) as auc1, round(auc2, 6) as auc2, round((auc1 - auc2) / sqrt(v), 4) as z from t""")
def roc_test(spark, d):
    r = prediction.roc_test(pred(spark, d), "truth", "prob", "score2")
    return spark.createDataFrame([(round(r["auc1"], 6), round(r["auc2"], 6), round(r["z"], 4))], "auc1 double, auc2 double, z double")


@query(f"""with {REG}, u0 as (select supp, flag, mode, avg(x1) as score, (sum(treat) * 2 > count(*))::int as treat from reg group by all), u as (select *, supp || flag || mode as id from u0), k as (select stddev_samp(score) * 0.2 as k from u),
t as (select * from u where treat = 1), c as (select * from u where treat = 0), p as (select t.supp || t.flag || t.mode as treated, t.score as ts, c.supp || c.flag || c.mode as control, c.score as cs, row_number() over (partition by t.id order by abs(t.score - c.score), c.score, c.supp || c.flag || c.mode) as i from t join c on t.flag = c.flag)
select treated, control, round(abs(ts - cs), 6) as distance from p, k where i = 1 and abs(ts - cs) <= k + 1e-12""")
def nearest_match(spark, d):
    x = reg(spark, d).groupBy("supp", "flag", "mode").agg(F.avg("x1").alias("score"), (F.sum("treat") * 2 > F.count("*")).cast("int").alias("treat")).withColumn("id", F.concat("supp", "flag", "mode"))
    return rounded(causal.nearest_match(x, "id", "treat", "score", exact=["flag"], caliper=0.2).select("treated", "control", "distance"))


COX = "cx as (select l_quantity::double as t, (l_linestatus = 'F')::int as e, l_returnflag as s, (l_linenumber - 1)::double as u, 1 + l_discount::double * 10 as w, l_tax::double * 10 as x, l_discount::double * 30 - l_tax::double * 20 as y from lineitem)"


def cox_rows(spark: SparkSession, d: str) -> DataFrame:
    q = lambda c: F.col(c).cast("double")
    return read(spark, d, "lineitem").select(
        q("l_quantity").alias("t"), (F.col("l_linestatus") == "F").cast("int").alias("e"), F.col("l_returnflag").alias("s"), (q("l_linenumber") - 1).alias("u"),
        (1 + q("l_discount") * 10).alias("w"), (q("l_tax") * 10).alias("x"), (q("l_discount") * 30 - q("l_tax") * 20).alias("y"),
    )


@query(f"""with {COX}, c as (select s, t, e, u, round(y, 6) as y, sum(w) as w, sum(w * w) as ww from cx where u < t group by all),
p as (select a.s, a.t, a.e, a.u, a.y, b.t as bt, b.e as be, b.u as bu, b.y as yb, a.w, b.w as bw from c a join c b on a.s = b.s and (b.t > a.t or (b.t = a.t and b.e = 0)) and b.u < a.t where a.e = 1),
q as (select s, t, e, u, y, sum(bw) filter (y > yb) as c, sum(bw) filter (y < yb) as d, sum(bw) filter (y = yb) as k from p group by all union all select s, bt, be, bu, yb, sum(w) filter (y > yb), sum(w) filter (y < yb), sum(w) filter (y = yb) from p group by all),
i as (select s, t, e, u, y, coalesce(sum(c), 0) as c, coalesce(sum(d), 0) as d, coalesce(sum(k), 0) as k from q group by all),
z as (select sum(w * bw) filter (y > yb) as c, sum(w * bw) filter (y < yb) as d, coalesce(sum(w * bw) filter (y = yb), 0) as k from p)
select round((z.c + z.k / 2) / (z.c + z.d + z.k), 6) as concordance, (select round(sqrt(sum(c.ww * pow((i.c - i.d - (i.c + i.d + i.k) * (z.c - z.d) / (z.c + z.d + z.k)) / (2 * (z.c + z.d + z.k)), 2))), 8) from i join c using (s, t, e, u, y)) as std_error,
round(z.c / 1e6, 4) as concordant, round(z.d / 1e6, 4) as discordant, round(z.k / 1e6, 4) as tied from z""")
def concordance(spark, d):
    x = cox_rows(spark, d).withColumn("y", F.round("y", 6))
    r = cox.concordance(x, "t", "e", "y", weight="w", entry="u", stratum="s")
    return spark.createDataFrame([(round(r["concordance"], 6), round(r["std_error"], 8), *(round(r[k] / 1e6, 4) for k in ("concordant", "discordant", "tied")))], "concordance double, std_error double, concordant double, discordant double, tied double")


@query(f"""with recursive {COX}, c as (select s, t, u, x, sum(w) as w from cx where u < t group by all), d as (select s, t, sum(w) as dw, sum(w * x) as dx from cx where u < t and e = 1 group by all),
j as (select d.s, d.t, d.dw, d.dx, c.x, sum(c.w) as w from d join c on c.s = d.s and c.t >= d.t and c.u < d.t group by all),
r(k, b, h) as (select 0, 0.0::double, 0.0::double union all
  select k + 1, b + u / h, h from (select k, b, sum(dx - dw * a / r) as u, sum(dw * (q / r - a * a / (r * r))) as h from (
    select k, b, s, t, dw, dx, sum(w * exp(b * x)) as r, sum(w * x * exp(b * x)) as a, sum(w * x * x * exp(b * x)) as q from r, j where k < 8 group by all) group by k, b))
select round(b, 6) as coefficient, round(1 / sqrt(h), 6) as std_error from r where k = 8""")
def cox_weighted(spark, d):
    fit = cox.fit_cox(cox_rows(spark, d), "t", "e", ["x"], ties="breslow", entry="u", weight="w", stratum="s")
    return spark.createDataFrame([(round(float(fit.coefficients[0]), 6), round(float(np.sqrt(fit.covariance[0, 0])), 6))], "coefficient double, std_error double")


CAUSE = """cr as (select l_quantity::double as t, case l_returnflag when 'A' then 1 when 'R' then 2 else 0 end as e, l_tax::double * 10 as x from lineitem),
gt as (select t, count(*) filter (e = 0) as c, count(*) as m from cr group by t), gn as (select t, c, sum(m) over (order by t desc) as n from gt),
g as (select t, coalesce(exp(sum(ln(nullif(1 - c / n, 0))) over (order by t rows between unbounded preceding and 1 preceding)), 1.0) as g from gn)"""


def cause_rows(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("t"), F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(0).alias("e"), (F.col("l_tax").cast("double") * 10).alias("x"))


@query(f"""with recursive {CAUSE}, c as (select t, e, x, count(*) as w from cr group by all), d as (select t, sum(w) as d, sum(w * x) as dx from c where e = 1 group by t),
j as (select d.t as u, d.d, d.dx, c.x, sum(c.w * case when c.t >= d.t then 1.0 else gu.g / gt.g end) as w from d join g gu on gu.t = d.t join c on c.t >= d.t or c.e = 2 join g gt on gt.t = c.t group by all),
r(k, b, h) as (select 0, 0.0::double, 0.0::double union all
  select k + 1, b + u / h, h from (select k, b, sum(dx - d * a / r) as u, sum(d * (q / r - a * a / (r * r))) as h from (
    select k, b, u, d, dx, sum(w * exp(b * x)) as r, sum(w * x * exp(b * x)) as a, sum(w * x * x * exp(b * x)) as q from r, j where k < 8 group by all) group by k, b))
select round(b, 6) as coefficient from r where k = 8""")
def fine_gray(spark, d):
    fit = competing.fine_gray_regression(cause_rows(spark, d), "t", "e", ["x"])
    return spark.createDataFrame([(round(float(fit.coefficients[0]), 6),)], "coefficient double")


@query("""with cr as (select l_quantity::double as t, case l_returnflag when 'A' then 1 when 'R' then 2 else 0 end as e from lineitem),
n as (select t, count(*) filter (e = 0) as c, count(*) filter (e <> 0) as f, max((e = 1)::int) as hit, count(*) as m from cr group by t),
s as (select t, c, hit, sum(m) over (order by t desc) - f as n from n),
g as (select t, hit, c, coalesce(exp(sum(ln(nullif(1 - c / nullif(n, 0), 0))) over (order by t)), 1.0) as after, coalesce(exp(sum(ln(nullif(1 - c / nullif(n, 0), 0))) over (order by t rows between unbounded preceding and 1 preceding)), 1.0) as before from s),
l as (select max(t) as last from g), e as (select t as hi from g where c > 0 union select last from l), b as (select hi, lag(hi) over (order by hi) as lo from e),
p as (select b.lo, b.hi, g.after as w from b join g on g.t = b.lo where exists (select 1 from g h where h.hit = 1 and h.t > b.lo and h.t <= b.hi)),
z as (select t, (select min(hi) from e where hi >= t) as stop, (select before from g where g.t = cr.t) as own, count(*) as m from cr where e = 2 group by t),
o as (select 0.0 as fgstart, t as fgstop, (e = 1)::int::double as fgstatus, count(*)::double as n, count(*)::double as weight from cr where e < 2 group by all
union all select 0.0, stop, 0.0, m, m from z union all select p.lo, p.hi, 0.0, z.m, z.m * p.w / z.own from z join p on p.lo >= z.stop)
select fgstart, fgstop, fgstatus, sum(n)::bigint as n, round(sum(weight), 4) as weight from o group by 1, 2, 3""")
def fine_gray_expanded(spark, d):
    x = competing.fine_gray_rows(cause_rows(spark, d), "t", "e", cause=1)
    return rounded(x.groupBy("fgstart", "fgstop", "fgstatus").agg(F.count("*").alias("n"), F.sum("fgwt").alias("weight")), 4)


@query()
def gray_test(spark, d):
    x = cause_rows(spark, d).withColumn("arm", F.floor(F.col("x") * 10 / 3).cast("string"))
    rows = [(r["cause"], round(r["statistic"], 6), r["df"], round(r["p_value"], 6)) for r in competing.gray_test(x, "t", "e", "arm")]
    return spark.createDataFrame(rows, "cause long, statistic double, df long, p_value double")


@query("""with x as (select o_orderkey as id, o_totalprice::double as price, case when o_orderkey % 5 = 1 then null else o_orderpriority end as priority, case when o_orderkey % 4 = 2 then null else o_custkey::double end as cust from orders)
select k as imputation, count(*) as n, count(*) filter (cust is null) as n_numbers, count(*) filter (priority is null) as n_levels, 0::bigint as n_unknown, 0::bigint as n_changed, 0::bigint as n_missing from x, (values (1::bigint), (2::bigint)) v(k) group by k""")
def impute_orders(spark, d):
    """What chained imputation must keep: every missing value filled from those observed, all others as they were."""
    key = F.col("o_orderkey")
    x = read(spark, d, "orders").select(
        key.alias("id"), F.col("o_totalprice").cast("double").alias("price"), F.when(key % 5 != 1, F.col("o_orderpriority")).alias("priority"), F.when(key % 4 != 2, F.col("o_custkey").cast("double")).alias("cust"),
    )
    done = impute.impute_chained(x, "id", m=2, n_iter=1, seed=5).data.withColumnsRenamed({"priority": "priority2", "cust": "cust2", "price": "price2"})
    seen = x.select(F.col("cust").alias("cust2")).where("cust2 is not null").distinct().withColumn("known", F.lit(True))
    levels = x.select(F.col("priority").alias("priority2")).where("priority2 is not null").distinct().withColumn("level", F.lit(True))
    # what a row shows beside its own values is found before it moves again; a factor has few levels
    both = done.join(x, "id").select(
        "imputation", "cust2", "priority2", F.col("cust").isNull().alias("number"), F.col("priority").isNull().alias("factor"),
        ((F.col("cust") != F.col("cust2")) | (F.col("priority") != F.col("priority2")) | (F.col("price") != F.col("price2"))).alias("changed"),
    ).join(F.broadcast(levels), "priority2", "left").join(seen, "cust2", "left")
    return both.groupBy(F.col("imputation").cast("long").alias("imputation")).agg(
        F.count("*").alias("n"), F.count_if("number").alias("n_numbers"), F.count_if("factor").alias("n_levels"), F.count_if(F.col("known").isNull() | F.col("level").isNull()).alias("n_unknown"),
        F.count_if("changed").alias("n_changed"), F.count_if(F.col("cust2").isNull() | F.col("priority2").isNull()).alias("n_missing"),
    )


@query("""with f as (select l_returnflag as term, l_linenumber as k, avg(l_quantity::double) as q, var_samp(l_quantity::double) / count(*) as v from lineitem group by all),
g as (select term, avg(q) as estimate, avg(v) as w, var_samp(q) as b, count(*) as m from f group by term), t as (select *, w + (1 + 1.0 / m) * b as total, (1 + 1.0 / m) * b / (w + (1 + 1.0 / m) * b) as share from g),
o as (select *, (m - 1) / (share * share) as old, 101.0 / 103.0 * 100 * (1 - share) as seen from t)
select term, round(estimate, 6) as estimate, round(sqrt(total), 6) as std_error, round(old * seen / (old + seen), 4) as df, round(share, 6) as lambda, round(((1 + 1.0 / m) * b / w + 2 / (old * seen / (old + seen) + 3)) / ((1 + 1.0 / m) * b / w + 1), 6) as fmi from o""")
def pool_barnard_rubin(spark, d):
    x = read(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("double"))
    fits: dict[int, list[dict]] = {}
    for r in x.groupBy("l_linenumber", "l_returnflag").agg(F.avg("q").alias("q"), (F.var_samp("q") / F.count("*")).alias("v")).orderBy("l_linenumber", "l_returnflag").collect():
        fits.setdefault(r["l_linenumber"], []).append({"term": r["l_returnflag"], "estimate": r["q"], "std_error": r["v"] ** 0.5})
    rows = [(r["term"], round(r["estimate"], 6), round(r["std_error"], 6), round(r["df"], 4), round(r["lambda"], 6), round(r["fmi"], 6)) for r in impute.pool(list(fits.values()), df_complete=100)]
    return spark.createDataFrame(rows, "term string, estimate double, std_error double, df double, lambda double, fmi double")


@query()
def glmm_laplace(spark, d):
    x = read(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("y"), (F.col("l_tax").cast("double") * 10).alias("x"), F.col("l_suppkey").alias("g"))
    fit = glmm.fit_glmm(x, "y", ["x"], "g", family="poisson")
    rows = [(r["term"], round(r["estimate"], 4), round(r["std_error"], 4)) for r in fit.tidy()]
    return spark.createDataFrame([*rows, ("sd", round(fit.sd, 3), None)], "term string, estimate double, std_error double")


@query("""with x as (select l_extendedprice::double / 1000 as x, l_returnflag as grp from lineitem), k as (select quantile_cont(x, 0.05) as a, quantile_cont(x, 0.35) as b, quantile_cont(x, 0.65) as c, quantile_cont(x, 0.95) as d from x),
p as (select grp, x, a, b, c, d, pow(d - a, 2) as s, pow(greatest(x - a, 0), 3) as xa, pow(greatest(x - b, 0), 3) as xb, pow(greatest(x - c, 0), 3) as xc, pow(greatest(x - d, 0), 3) as xd from x, k)
select grp, count(*) as n, round(avg(x), 6) as x, round(avg((xa - xc * (d - a) / (d - c) + xd * (c - a) / (d - c)) / s), 6) as x1, round(avg((xb - xc * (d - b) / (d - c) + xd * (c - b) / (d - c)) / s), 6) as x2,
round(any_value(a), 6) as k1, round(any_value(d), 6) as k4 from p group by grp""")
def spline_restricted(spark, d):
    x = read(spark, d, "lineitem").select((F.col("l_extendedprice").cast("double") / 1000).alias("x"), F.col("l_returnflag").alias("grp"))
    s = splines.resolve(x, "x", "rcs", n_knots=4)
    c = s.columns(F.col("x"))
    return rounded(x.groupBy("grp").agg(F.count("*").alias("n"), *(F.avg(v).alias(n) for v, n in zip(c, ("x", "x1", "x2"), strict=True))).withColumns({"k1": F.lit(s.knots[0]), "k4": F.lit(s.knots[-1])}))


@query("""with x as (select l_quantity::double as x, l_returnflag as grp from lineitem), k as (select min(x) as a, quantile_cont(x, 0.5) as m, max(x) as b from x),
p as (select grp, case when x < m or (m = b and x = b) then (x - a) / (m - a) else (b - x) / (b - m) end as one, case when x < m then 0.0 else (x - m) / (b - m) end as two from x, k)
select grp, round(avg(one), 6) as one, round(avg(two), 6) as two, round(avg(one * two), 6) as cross_product from p group by grp""")
def spline_linear(spark, d):
    x = read(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_returnflag").alias("grp"))
    one, two = splines.resolve(x, "x", "bs", df_columns=2, degree=1).columns(F.col("x"))
    return rounded(x.groupBy("grp").agg(F.avg(one).alias("one"), F.avg(two).alias("two"), F.avg(one * two).alias("cross_product")))


@query(f"""with recursive {COX}, o as (select l_orderkey as g, (l_linestatus = 'F')::int as e, l_tax::double * 10 as x from lineitem),
s as (select g, list(x) as xs, sum(e) as k, count(*) as n, sum(e * x) as dx from o group by g having sum(e) > 0 and sum(e) < count(*)),
m as (select g, k, dx, list_sum(list_transform(range(1, n + 1), lambda i: case when (mask >> (i - 1)::int) & 1 = 1 then xs[i] else 0.0 end)) as sx from (select *, unnest(range((1 << n::int)::bigint)) as mask from s) where bit_count(mask) = k),
j as (select g, dx, round(sx, 6) as sx, count(*) as w from m group by all),
r(i, b, h) as (select 0, 0.0::double, 0.0::double union all
  select i + 1, b + u / h, h from (select i, b, sum(dx - a / r) as u, sum(q / r - a * a / (r * r)) as h from (
    select i, b, g, dx, sum(w * exp(b * sx)) as r, sum(w * sx * exp(b * sx)) as a, sum(w * sx * sx * exp(b * sx)) as q from r, j where i < 7 group by all) group by i, b))
select round(b, 6) as coefficient, round(1 / sqrt(h), 6) as std_error, (select count(*) from s) as n_sets from r where i = 7""")
def conditional_logit(spark, d):
    x = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), (F.col("l_linestatus") == "F").cast("int").alias("e"), (F.col("l_tax").cast("double") * 10).alias("x"))
    fit = clogit.conditional_logit(x, "e", ["x"], "g")
    return spark.createDataFrame([(round(float(fit.coefficients[0]), 6), round(float(np.sqrt(fit.covariance[0, 0])), 6), fit.n_sets)], "coefficient double, std_error double, n_sets long")


@query("""with x as (select l_extendedprice::double / 1000 * (1 - l_discount::double) as y, l_quantity::double as q, l_discount::double * 100 as z, l_returnflag as g from lineitem), a as (select count(*) as n, avg(y) as m, var_pop(y) * count(*) as ss from x),
b as (select sum(k * (my - m) * (my - m)) as between_ss from (select g, count(*) as k, avg(y) as my from x group by g), a),
c as (select z, sum(count(*)) over w as nl, sum(sum(y - (select m from a))) over w as yl from x group by z window w as (order by z)), e as (select z, yl * yl / (nl * (n - nl)) as stat from c, a where nl >= greatest(7, ceil(0.01 * n)) and n - nl >= greatest(7, ceil(0.01 * n)))
select 'x' as term, round((n - 1) * pow((select corr(y, q) from x), 2), 4) as statistic, null as split_at from a
union all select 'z', round((n - 1) * pow((select corr(y, z) from x), 2), 4), (select z from e order by round(ln(stat), 9) desc, z limit 1) from a union all select 'g', round((n - 1) * between_ss / ss, 4), null from a, b""")
def conditional_tree(spark, d):
    x = reg(spark, d).select((F.col("y") * (1 - F.col("x2"))).alias("y"), F.col("x1").alias("x"), (F.col("x2") * 100).alias("z"), F.col("flag").alias("g"))
    fit = tree.conditional_tree(x, "y", ["x", "z", "g"], max_depth=3)
    rows = [(r["term"], round(r["statistic"], 4), fit.root.at if fit.root.column == r["term"] else None) for r in fit.tests()]
    return spark.createDataFrame(rows, "term string, statistic double, split_at double")


@query()
def additive_model(spark, d):
    x = reg(spark, d).select("y", "x1", "x2", F.col("x3").alias("tax"))
    fit = gam.fit_gam(x, "y", {"x1": 10, "x2": 6}, ["tax"])
    rows = [(k, round(v, 3)) for k, v in (("linear", float(fit.coefficients[1])), ("edf_x1", fit.edf["x1"]), ("edf_x2", fit.edf["x2"]), ("scale", fit.scale))]
    return spark.createDataFrame(rows, "term string, value double")


@query()
def bootstrap_optimism(spark, d):
    x = reg(spark, d).select("treat", "x1", (F.col("x2") * 10).alias("x2"), "ord")
    rows = [(r["index"], round(r["original"], 5), round(r["optimism"], 5), round(r["corrected"], 5)) for r in validation.validate(x, "treat ~ x1 + x2", "ord", family="binomial", b=20, seed=1)]
    return spark.createDataFrame(rows, "index string, original double, optimism double, corrected double")


@query("""with x as (select l_extendedprice::double / 1000 * (1 - l_discount::double) as y, l_discount::double as d, l_tax::double as t from lineitem), m as (select avg(y) as my, avg(d) as md, stddev_pop(d) as sd, avg(t) as mt, stddev_pop(t) as st, covar_pop(y, d) / stddev_pop(d) as cd, covar_pop(y, t) / stddev_pop(t) as ct, corr(d, t) as r from x),
l as (select i, greatest(abs(cd), abs(ct)) * f as penalty from m, (values (0, 1.0), (1, 0.5), (2, 0.1)) v(i, f)),
b as (select i, penalty, m.*, sign(cd) * greatest(abs(cd) - penalty, 0) as d1, sign(ct) * greatest(abs(ct) - penalty, 0) as t1, (cd - r * ct - penalty * (sign(cd) - r * sign(ct))) / (1 - r * r) as d2, (ct - r * cd - penalty * (sign(ct) - r * sign(cd))) / (1 - r * r) as t2 from l, m),
c as (select *, case when t1 = 0 or abs(ct - r * d1) <= penalty then d1 when abs(cd - r * t1) <= penalty then 0 else d2 end as bd, case when t1 = 0 or abs(ct - r * d1) <= penalty then 0 when abs(cd - r * t1) <= penalty then t1 else t2 end as bt from b)
select i::bigint as step, round(penalty, 6) as penalty, round(bd / sd, 5) + 0.0 as discount, round(bt / st, 5) + 0.0 as tax, round(my - bd / sd * md - bt / st * mt, 5) as intercept from c""")
def lasso_path(spark, d):
    x = reg(spark, d).select((F.col("y") * (1 - F.col("x2"))).alias("y"), "x2", "x3", "ord")
    top = penalized.penalized_path(x, "y", ["x2", "x3"], "ord", n_lambda=1, folds=0).lambdas[0]
    fit = penalized.penalized_path(x, "y", ["x2", "x3"], "ord", lambdas=[float(top * f) for f in (1.0, 0.5, 0.1)], folds=5)
    rows = [(i, round(float(fit.lambdas[i]), 6), round(float(b[1]), 5), round(float(b[2]), 5), round(float(b[0]), 5)) for i, b in enumerate(fit.coefficients)]
    return spark.createDataFrame(rows, "step long, penalty double, discount double, tax double, intercept double")


@query()
def test_fisher_rxc(spark, d):
    """Region by the last digit of a nation's key, in four classes."""
    x = read(spark, d, "nation").select(F.col("n_regionkey").alias("r"), F.floor(F.col("n_nationkey") % 10 / 3).alias("c"))
    got = fisher.fisher_test(x, "r", "c")
    return spark.createDataFrame([(got["n"], round(got["p_value"], 6))], "n long, p_value double")


CUST = "cust as (select c_custkey as id, c_nationkey as nation, (c_mktsegment = 'BUILDING') as treat, c_acctbal::double as score from customer)"


def cust(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), (F.col("c_mktsegment") == "BUILDING").alias("treat"), F.col("c_acctbal").cast("double").alias("score"))


def _greedy_sql(order: str, limit: str) -> str:
    """Treated customers of a nation one after the other, each with the nearest control that is not taken."""
    return f"""with recursive {CUST}, t as (select *, row_number() over (partition by nation order by score {order}, id) as i from cust where treat), c as (select nation, list(struct_pack(s := score, id := id)) as cs from cust where not treat group by nation),
r(nation, i, used, treated, control, distance) as (
  select c.nation, 0::bigint, []::bigint[], null::bigint, null::bigint, null::double from c
  union all
  select nation, i, case when ok then list_append(used, best.id) else used end, treated, case when ok then best.id end, case when ok then best.d end from (
    select *, best is not null and best.d <= {limit} + 1e-12 as ok from (
      select r.nation, t.i, r.used, t.id as treated, list_min(list_transform(list_filter(c.cs, lambda x: not list_contains(r.used, x.id)), lambda x: struct_pack(d := abs(x.s - t.score), s := x.s, id := x.id::bigint))) as best
      from r join t on t.nation = r.nation and t.i = r.i + 1 join c on c.nation = r.nation)))
select nation, treated, control, round(distance, 6) as distance from r where control is not null"""


@query(_greedy_sql("desc", "400"))
def greedy_match(spark, d):
    return rounded(matching.greedy_match(cust(spark, d), "id", "treat", "score", exact=["nation"], caliper=400.0, std_caliper=False).select(F.col("nation").cast("long").alias("nation"), "treated", "control", "distance"))


@query(f"""with recursive {CUST}, o as (select nation, treat, score, row_number() over w as i, lag(treat) over w as before from cust window w as (partition by nation order by score, treat)),
g as (select *, sum((before is distinct from treat)::int) over (partition by nation order by i) as run from o), runs as (select nation, run, list(score order by i) as p from g group by all),
r(nation, run, p, f) as (
  select nation, run, p, list_prepend(0.0::double, list_transform(p, lambda x: 1e18::double)) from runs where run = 1
  union all
  select b.nation, b.run, b.p, list_prepend(r.f[len(r.f)], list_transform(range(1, (len(b.p) + 1)::bigint), lambda q: list_sum(list_transform(b.p[1:q], lambda x: x - b.p[1])) + list_min(list_transform(range(1, (len(r.p) + 1)::bigint), lambda k:
    list_sum(list_transform(r.p[(len(r.p) - k + 1):len(r.p)], lambda x: r.p[len(r.p)] - x)) + (b.p[1] - r.p[len(r.p)]) * greatest(k, q) + case when k = 1 then least(r.f[len(r.f)], r.f[len(r.f) - 1]) else r.f[len(r.f) - k] end))))
  from r join runs b on b.nation = r.nation and b.run = r.run + 1)
select nation, round(max_by(f[len(f)], run), 4) as total_distance, (select count(*) from cust where cust.nation = r.nation) as units from r group by nation having max(run) > 1""")
def full_match(spark, d):
    pairs = matching.full_match(cust(spark, d), "id", "treat", "score", exact=["nation"])
    units = F.count_distinct("treated") + F.count_distinct("control")
    return rounded(pairs.groupBy(F.col("nation").cast("long").alias("nation")).agg(F.sum("distance").alias("total_distance"), units.alias("units")), 4)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Table One of line items by return flag."""
    x = read(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("l_quantity"), F.col("l_extendedprice").cast("double").alias("l_extendedprice"), "l_linestatus")
    params = [("l_quantity", C.agg_mean_sd), ("l_extendedprice", C.agg_median_iqr), ("l_linestatus", "category")]
    return tableone.tableone_raw(x, params, "l_returnflag", add_all=True, add_pvalue=True, add_smd=True)


QUERIES["tableone"] = flagship
