"""Operators that need an order over all rows, without one task that holds them.

Rows are first summed by the ordering key; the running sums over the keys then
go through range partitions: a window inside each partition, and the totals of
the partitions before it, of which there is one row each.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Distinct keys above which running sums go through range partitions.
ONE_TASK = 200_000


def cut(df: DataFrame) -> DataFrame:
    """``df`` by a reliable checkpoint in ``spark.checkpoint.dir``; a temporary folder where it is unset and Spark runs on one machine."""
    spark: SparkSession = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillstat-checkpoint-"))
    return df.checkpoint(eager=True)


_HOW = {
    "sum": (F.sum, lambda a, b: a + b),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "product": (F.product, lambda a, b: a * b),
}


def running(df: DataFrame, key: str, out: dict[str, tuple[str, str]], by: tuple[str, ...] = (), descending: bool = False, before: bool = False, one_task: int = ONE_TASK, rows: int | None = None, fixed: bool = False) -> DataFrame:
    """``df`` (one row for each ``by`` and ``key``) with running aggregates up to each key, or before it.

    ``out`` maps result names to (sum, max, min or product, column); nulls do not
    count, and where there is nothing yet the result is null.  Up to ``one_task`` rows are
    one window a group; more are range-partitioned by group and key, so that
    neither a large group nor the only one is a task.  A caller that knows how many
    ``rows`` there are at most saves their materialisation where they are few; one whose
    ``df`` is ``fixed``, rows of a ``cut`` by columns without chance, and has just so many, where they are many.
    """
    order = F.col(key).desc() if descending else F.col(key).asc()
    few = rows is not None and rows <= one_task
    held = df if few or fixed else cut(df)
    end = -1 if before else 0
    if few or not (fixed and rows) and held.count() <= one_task:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, end)
        return (held if by else held.coalesce(1)).withColumns({name: _HOW[how][0](c).over(w) for name, (how, c) in out.items()})
    ranged = cut(held.repartitionByRange(*by, order).withColumn("__part", F.spark_partition_id()))
    w = Window.partitionBy("__part", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    inside = ranged.withColumns({name: _HOW[how][0](c).over(w) for name, (how, c) in out.items()})
    # a row for each partition, and for each group that ends in it
    former = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__part", *by).agg(*(_HOW[how][0](c).alias(f"__{name}") for name, (how, c) in out.items()))
    totals = cut(totals.select("__part", *by, *(_HOW[how][0](f"__{name}").over(former).alias(f"__{name}") for name, (how, _) in out.items())))
    totals = F.broadcast(totals) if totals.count() <= one_task else totals
    joined = inside.join(totals, ["__part", *by])
    whole = {name: F.coalesce(_HOW[how][1](F.col(name), F.col(f"__{name}")), F.col(name), F.col(f"__{name}")) for name, (how, _) in out.items()}
    return joined.withColumns(whole).drop("__part", *(f"__{name}" for name in out))


def running_sums(df: DataFrame, key: str, sums: dict[str, str], by: tuple[str, ...] = (), descending: bool = False, one_task: int = ONE_TASK) -> DataFrame:
    """``df`` with running sums up to and with each key; ``sums`` maps result names to summed columns."""
    return running(df, key, {name: ("sum", c) for name, c in sums.items()}, by, descending, one_task=one_task)


def mid_ranks(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, value, ties, rank): the average rank of each distinct value."""
    ties = df.groupBy(*by, value).agg(F.count("*").alias("ties"))
    return running_sums(ties, value, {"__upto": "ties"}, by).withColumn("rank", F.col("__upto") - (F.col("ties") - 1) / 2).drop("__upto")


def quantiles(df: DataFrame, value: str, probs: list[float], by: tuple[str, ...] = (), one_task: int = ONE_TASK) -> DataFrame:
    """(by, q0, q1, ...): exact quantiles of the values that are not null, interpolated as ``percentile`` does, without one task that holds a group's values.

    Values are counted, the counts summed in their order, and only the values at
    the wanted positions are kept.  Groups without values have no row, and null groups are left out.
    """
    each = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    upto = cut(running(each, value, {"__upto": ("sum", "__n")}, by, one_task=one_task))
    total = F.broadcast(upto.groupBy(*by).agg(F.max("__upto").alias("__total")))
    rows = upto.join(total, list(by)) if by else upto.crossJoin(total)
    at = lambda place: F.max(F.when((F.col("__upto") - F.col("__n") <= place) & (place < F.col("__upto")), F.col(value)))
    places = [p * (F.col("__total") - 1) for p in probs]
    ends = [at(f(place)).alias(f"__{name}{i}") for i, place in enumerate(places) for name, f in (("low", F.floor), ("high", F.ceil))]
    found = rows.groupBy(*by, "__total").agg(*ends)
    out = []
    for i, place in enumerate(places):
        low, high = F.col(f"__low{i}"), F.col(f"__high{i}")
        out.append(F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high).alias(f"q{i}"))
    return found.select(*by, *out)


def lagged(df: DataFrame, order: list[str], columns: list[str], lags: int) -> DataFrame:
    """``df`` with ``c_k``, the value of ``c`` that is k rows before in the order, for k up to ``lags``.

    Rows are range-partitioned; windows run inside the partitions, and the few
    first rows of each look up the last rows of those before it, which are
    broadcast: at most ``lags`` for each partition.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part").orderBy(*order)
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # the order may have ties, so positions are kept before they are used twice
    rows = ranged.join(F.broadcast(sizes), "__part").withColumn("__row", F.row_number().over(inside))
    rows = cut(rows.withColumn("__at", F.col("__before") + F.col("__row")))
    inside = Window.partitionBy("__part").orderBy("__row")
    tails = rows.where(F.col("__row") > F.col("__n") - lags).select(F.col("__at").alias("__tail"), *(F.col(c).alias(f"__{c}") for c in columns))
    for k in range(1, lags + 1):
        rows = rows.withColumns({f"{c}_{k}": F.lag(c, k).over(inside) for c in columns})
        rows = rows.join(F.broadcast(tails), (F.col("__row") <= k) & (F.col("__tail") == F.col("__at") - k), "left")
        rows = rows.withColumns({f"{c}_{k}": F.when(F.col("__row") <= k, F.col(f"__{c}")).otherwise(F.col(f"{c}_{k}")) for c in columns}).drop("__tail", *(f"__{c}" for c in columns))
    return rows.drop("__part", "__n", "__before", "__row", "__at")
