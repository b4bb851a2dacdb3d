"""Fisher's exact test of tables of any size.

The counts are one aggregation; the test is a walk over the columns of the small table.  A
node is what is left of the row totals, in any order; the ways to a node are kept by
the probability they have used up.  A way is settled as a whole once its most probable end is no
likelier than the table seen, and given up once its least probable one is likelier.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most cells of a table, and most ways that are kept at a column.
MOST_CELLS, MOST_WAYS = 400, 2_000_000


def _fills(left: tuple[int, ...], total: int) -> Iterator[tuple[int, ...]]:
    """The ways to take ``total`` from the row totals that are ``left``."""
    if len(left) == 1:
        if total <= left[0]:
            yield (total,)
        return
    rest = sum(left[1:])
    for k in range(max(0, total - rest), min(left[0], total) + 1):
        for more in _fills(left[1:], total - k):
            yield (k, *more)


def exact_p(table: list[list[int]]) -> float:
    """The probability, given its margins, of tables that are no likelier than ``table``."""
    rows = [r for r in ([int(v) for v in r] for r in table) if sum(r)]
    if not rows or min(v for r in rows for v in r) < 0:
        raise ValueError("the table needs counts of at least 0, not all of them 0")
    columns = [c for c in zip(*rows, strict=True) if sum(c)]
    if len(rows) < 2 or len(columns) < 2:
        return 1.0
    if len(columns) > len(rows):  # the walk goes over the fewer of both, large ones first
        columns = list(zip(*columns, strict=True))
    totals = sorted((sum(c) for c in columns), reverse=True)
    start = tuple(sorted(sum(c[i] for c in columns) for i in range(len(columns[0]))))
    log = [math.lgamma(k + 1) for k in range(sum(start) + 1)]
    seen = -sum(log[v] for c in columns for v in c)
    limit = seen + 1e-7

    def children(stage: int, node: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], float]]:
        for fill in _fills(node, totals[stage]):
            yield tuple(sorted(a - b for a, b in zip(node, fill, strict=True))), -sum(log[v] for v in fill)

    @lru_cache(maxsize=None)
    def ends(stage: int, node: tuple[int, ...]) -> tuple[float, float]:
        """Least and greatest sum to the end."""
        if stage == len(totals) - 1:
            last = -sum(log[v] for v in node)
            return last, last
        low, high = math.inf, -math.inf
        for child, step in children(stage, node):
            a, b = ends(stage + 1, child)
            low, high = min(low, step + a), max(high, step + b)
        return low, high

    def whole(stage: int, node: tuple[int, ...]) -> float:
        """Logarithm of the sum over all ends."""
        return log[sum(node)] - sum(log[v] for v in node) - sum(log[v] for v in totals[stage:])

    everything, p = whole(0, start), 0.0
    now = {start: {0.0: 1.0}}
    for stage in range(len(totals)):
        after: dict[tuple[int, ...], dict[float, float]] = {}
        ways = 0
        for node, pasts in now.items():
            low, high = ends(stage, node)
            total = whole(stage, node)
            going = {}
            for past, count in pasts.items():
                if past + high <= limit:
                    p += count * math.exp(past + total - everything)
                elif past + low <= limit:
                    going[past] = count
            if going:
                for child, step in children(stage, node):
                    into = after.setdefault(child, {})
                    for past, count in going.items():
                        key = round(past + step, 9)
                        ways += key not in into
                        into[key] = into.get(key, 0.0) + count
        if ways > MOST_WAYS:
            raise ValueError(f"the table has more than {MOST_WAYS} ways; use the chi-square test")
        now = after
    return min(1.0, p)


def fisher_test(df: DataFrame, row: str, column: str) -> dict[str, float]:
    """n and the exact p value of two factors; rows that lack one are left out."""
    have = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(row).alias("r"), F.col(column).alias("c")).count()
    cells = have.limit(MOST_CELLS + 1).collect()
    if len(cells) > MOST_CELLS:
        raise ValueError(f"the table has more than {MOST_CELLS} cells")
    if not cells:
        raise ValueError("there are no complete rows")
    names = sorted({x["r"] for x in cells}, key=str), sorted({x["c"] for x in cells}, key=str)
    table = [[0] * len(names[1]) for _ in names[0]]
    for x in cells:
        table[names[0].index(x["r"])][names[1].index(x["c"])] = x["count"]
    return {"n": sum(map(sum, table)), "p_value": exact_p(table)}
