"""Performance of predictions: two-by-two metrics, calibration, decision curves, ROC and DeLong."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.functions.dist import norm_cdf, norm_ppf
from quillstat.plans.ordered import mid_ranks, running_sums


def binary_metrics(df: DataFrame, truth: str, pred: str) -> dict[str, float]:
    y, p = F.col(truth).cast("double") > 0, F.col(pred).cast("double") > 0
    r = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn")).first()
    return rates(r["tp"], r["fp"], r["fn"], r["tn"])


def rates(tp: int, fp: int, fn: int, tn: int) -> dict[str, float]:
    div = lambda a, b: a / b if b else math.nan
    root = math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return {
        "tp": tp, "fp": fp, "fn": fn, "tn": tn, "accuracy": div(tp + tn, tp + fp + fn + tn), "sensitivity": div(tp, tp + fn), "specificity": div(tn, tn + fp),
        "ppv": div(tp, tp + fp), "npv": div(tn, tn + fn), "f1": div(2 * tp, 2 * tp + fp + fn), "mcc": div(tp * tn - fp * fn, root),
    }


def threshold_tradeoff(df: DataFrame, truth: str, prob: str, thresholds: list[float]) -> DataFrame:
    """(threshold, tp, fp, fn, tn) with prob >= threshold as positive; one pass over the rows.

    Rows are counted by the number of thresholds they reach, so the table grows
    with the thresholds alone.
    """
    ts = sorted({float(t) for t in thresholds})
    y, p = F.col(truth).cast("double") > 0, F.col(prob).cast("double")
    reached = sum((F.when(p >= t, 1).otherwise(0) for t in ts), F.lit(0))
    cells = df.where(p.isNotNull() & y.isNotNull()).groupBy(reached.alias("k")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    grid = df.sparkSession.createDataFrame(list(enumerate(ts)), "i int, threshold double")
    return grid.join(F.broadcast(cells)).groupBy("threshold").agg(
        F.sum(F.when(F.col("k") > F.col("i"), F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("k") > F.col("i"), F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("k") <= F.col("i"), F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(F.col("k") <= F.col("i"), F.col("neg")).otherwise(0)).alias("tn"),
    )


def brier_score(df: DataFrame, truth: str, prob: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(prob) - F.col(truth).cast("double"), 2)).alias("brier"))


def calibration_table(df: DataFrame, truth: str, prob: str, n_bins: int = 10) -> DataFrame:
    """(bin, n, mean_prob, observed) of equal-width bins on [0, 1], the last closed; empty bins left out."""
    p = F.col(prob).cast("double")
    number = sum((F.when(p >= i / n_bins, 1).otherwise(0) for i in range(1, n_bins)), F.lit(0))
    return df.where(p.isNotNull()).groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_prob"), F.avg(F.col(truth).cast("double")).alias("observed"))


def decision_curve(df: DataFrame, truth: str, prob: str, thresholds: list[float]) -> DataFrame:
    """(threshold, net_benefit, treat_all, treat_none)."""
    t, n = F.col("threshold"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    odds = t / (1 - t)
    pos = F.col("tp") + F.col("fn")
    return threshold_tradeoff(df, truth, prob, thresholds).select("threshold", (F.col("tp") / n - F.col("fp") / n * odds).alias("net_benefit"), (pos / n - (n - pos) / n * odds).alias("treat_all"), F.lit(0.0).alias("treat_none"))


def roc_points(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(score, sensitivity, specificity) with score >= the row's score as positive."""
    y = F.col(truth).cast("double") > 0
    each = df.groupBy(F.col(score).cast("double").alias("score")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    total = each.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    run = running_sums(each, "score", {"tp": "pos", "fp": "neg"}, descending=True)
    return run.select("score", (F.col("tp") / F.lit(total["p"])).alias("sensitivity"), (1 - F.col("fp") / F.lit(total["n"])).alias("specificity"))


def _placements(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(x, pos, neg, v10, v01): placements of each distinct score among the other class."""
    y = F.col(truth).cast("double") > 0
    each = df.groupBy(F.col(score).cast("double").alias("x")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    total = each.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    run = running_sums(each, "x", {"cp": "pos", "cn": "neg"})
    return run.withColumn("v10", (F.col("cn") - F.col("neg") / 2) / total["n"]).withColumn("v01", (total["p"] - F.col("cp") + F.col("pos") / 2) / total["p"])


def auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """One row (auc, variance): the Mann-Whitney area and its DeLong variance."""
    v = _placements(df, truth, score)
    s = v.agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n"),
        F.sum(F.col("pos") * F.col("v10")).alias("a"), F.sum(F.col("pos") * F.pow("v10", 2)).alias("aa"),
        F.sum(F.col("neg") * F.col("v01")).alias("b"), F.sum(F.col("neg") * F.pow("v01", 2)).alias("bb"),
    )
    p, n = F.col("p"), F.col("n")
    var = lambda sq, su, k: (F.col(sq) - F.pow(F.col(su), 2) / k) / (k - 1)
    return s.select((F.col("a") / p).alias("auc"), (var("aa", "a", p) / p + var("bb", "b", n) / n).alias("variance"))


def roc_test(df: DataFrame, truth: str, score1: str, score2: str, level: float = 0.95) -> dict[str, float]:
    """Paired DeLong test of two scores of the same rows."""
    y = F.col(truth).cast("double") > 0
    x = df.select(y.alias("y"), F.col(score1).cast("double").alias("a"), F.col(score2).cast("double").alias("b")).na.drop()
    for name in ("a", "b"):
        v = _placements(x.select(F.col("y").cast("int").alias("y"), name), "y", name)
        x = x.join(v.select(F.col("x").alias(name), F.col("v10").alias(f"{name}10"), F.col("v01").alias(f"{name}01")), name)
    pos, neg = x.where("y"), x.where("not y")
    s10 = pos.agg(F.count("*").alias("n"), F.avg("a10").alias("a"), F.avg("b10").alias("b"), F.var_samp(F.col("a10") - F.col("b10")).alias("v")).first()
    s01 = neg.agg(F.count("*").alias("n"), F.var_samp(F.col("a01") - F.col("b01")).alias("v")).first()
    d, se = s10["a"] - s10["b"], math.sqrt(s10["v"] / s10["n"] + s01["v"] / s01["n"])
    z = d / se if se else math.nan
    q = norm_ppf(1 - (1 - level) / 2)
    return {"auc1": s10["a"], "auc2": s10["b"], "z": z, "p_value": 2 * norm_cdf(-abs(z)), "lower": d - q * se, "upper": d + q * se}


def youden(df: DataFrame, truth: str, score: str) -> DataFrame:
    """The points of the ROC curve with the greatest sensitivity + specificity, all ties."""
    points = roc_points(df, truth, score).withColumn("youden", F.round(F.col("sensitivity") + F.col("specificity") - 1, 12))
    return points.join(F.broadcast(points.agg(F.max("youden").alias("youden"))), "youden")


def gini_mean_difference(df: DataFrame, x: str) -> DataFrame:
    """Mean absolute difference of two different rows, from mid-ranks."""
    ranks = mid_ranks(df.where(F.col(x).isNotNull()), x)
    n = F.sum("ties")
    return ranks.agg((2 * F.sum(F.col("ties") * F.col(x) * (2 * F.col("rank"))) / (n * (n - 1)) - 2 * (n + 1) * F.sum(F.col("ties") * F.col(x)) / (n * (n - 1))).alias("gini"))


def somers_dxy(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(c, dxy) of a binary outcome."""
    return auc(df, truth, score).select(F.col("auc").alias("c"), (2 * (F.col("auc") - 0.5)).alias("dxy"))
