"""Cost-effectiveness: net benefit, acceptability, value of information, frontiers and Markov cohorts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstat.plans.ordered import cut


def net_monetary_benefit(df: DataFrame, cost: str, effect: str, wtp: float, out: str = "nmb") -> DataFrame:
    return df.withColumn(out, wtp * F.col(effect) - F.col(cost))


def _nmb(cost: str, effect: str, wtp: list[float]) -> list[Column]:
    """Net benefits at each willingness to pay side by side, so that rows of draws are not multiplied."""
    return [float(w) * F.col(effect) - F.col(cost) for w in wtp]


def _by_wtp(values: list[Column], wtp: list[float], name: str) -> Column:
    """(wtp, ``name``) rows of values that stand side by side."""
    return F.inline(F.array(*(F.struct(F.lit(float(w)).alias("wtp"), v.alias(name)) for w, v in zip(wtp, values, strict=True))))


def ceac(psa: DataFrame, draw: str, strategy: str, cost: str, effect: str, wtp: list[float]) -> DataFrame:
    """(wtp, strategy, probability): how often each strategy has the greatest net benefit; ties to the least name."""
    own = [F.col(f"__{i}") for i in range(len(wtp))]
    best = psa.groupBy(draw).agg(*(F.min_by(F.col(strategy), F.struct(-v, F.col(strategy))).alias(f"__{i}") for i, v in enumerate(_nmb(cost, effect, wtp))))
    won = best.select(_by_wtp(own, wtp, "strategy")).groupBy("wtp", "strategy").agg(F.count("*").alias("k"))
    return won.withColumn("probability", F.col("k") / F.sum("k").over(Window.partitionBy("wtp"))).drop("k")


def evpi(psa: DataFrame, draw: str, strategy: str, cost: str, effect: str, wtp: list[float]) -> DataFrame:
    """(wtp, evpi): mean of the best net benefit in each draw, less the best mean."""
    own, nmb = [F.col(f"__{i}") for i in range(len(wtp))], _nmb(cost, effect, wtp)
    perfect = psa.groupBy(draw).agg(*(F.max(v).alias(f"__{i}") for i, v in enumerate(nmb))).agg(F.count("*").alias("__n"), *(F.avg(v).alias(f"__{i}") for i, v in enumerate(own))).where("__n > 0")
    current = psa.groupBy(strategy).agg(*(F.avg(v).alias(f"__{i}") for i, v in enumerate(nmb))).agg(*(F.max(v).alias(f"__{i}") for i, v in enumerate(own)))
    return perfect.select(_by_wtp(own, wtp, "perfect")).join(current.select(_by_wtp(own, wtp, "current")), "wtp").select("wtp", (F.col("perfect") - F.col("current")).alias("evpi"))


def frontier(rows: list[tuple[str, float, float]]) -> list[tuple[str, float, float, float | None]]:
    """(strategy, cost, effect, icer) of strategies that are not dominated, strongly or by extension."""
    left: list[tuple[str, float, float]] = []
    for row in sorted(rows, key=lambda r: (r[1], -r[2])):
        if left and row[2] <= left[-1][2]:
            continue
        while len(left) > 1 and (row[1] - left[-1][1]) / (row[2] - left[-1][2]) <= (left[-1][1] - left[-2][1]) / (left[-1][2] - left[-2][2]):
            left.pop()
        left.append(row)
    return [(s, c, e, None if i == 0 else (c - left[i - 1][1]) / (e - left[i - 1][2])) for i, (s, c, e) in enumerate(left)]


def strongly_dominated(means: DataFrame, strategy: str, cost: str, effect: str) -> DataFrame:
    """Strategies that another one beats on cost and effect; ``means`` has a row for each strategy."""
    # both sides must read the same digits: means computed twice may differ by the order of their sums, and a strategy would beat itself
    means = cut(means)
    other = means.select(F.col(cost).alias("__c"), F.col(effect).alias("__e"))
    worse = (F.col("__c") <= F.col(cost)) & (F.col("__e") >= F.col(effect)) & ((F.col("__c") < F.col(cost)) | (F.col("__e") > F.col(effect)))
    return means.join(other, worse, "left_semi")


def markov_cohort(spark: SparkSession, transition: list[list[float]], start: list[float], cycles: int) -> DataFrame:
    """(cycle, state, share) of a cohort under a constant transition matrix."""
    p, now, rows = np.array(transition), np.array(start, float), []
    for c in range(cycles + 1):
        rows += [(c, i, float(x)) for i, x in enumerate(now)]
        now = now @ p
    return spark.createDataFrame(rows, "cycle int, state int, share double")
