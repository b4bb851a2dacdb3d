"""Near-duplicates among embeddings: exact links by cosine, from cover trees.

Equal vectors are one class, compared as 128-bit hashes.  The top of the tree is a net
of pivots, each the farthest of a bounded sample from those before it; every class
joins the cell of its nearest pivot.  A dual traversal of the tree over the pivots, with
the cells' covering radii, leaves the pairs of cells that can hold links, and finds
those whose rows all link, which are counted without looking at rows.  Cells are packed
into blocks of bounded size, or split over several, and a block gets a cover tree of
levels with halving radii once.  Each pair of blocks with a pair of cells that can hold
links is one small group: a dual traversal prunes pairs of nodes by their covering radii,
counts pairs of nodes within the threshold as wholes, and compares what remains, those
within rounding of the threshold in extended precision.

Groups of links never become pairs of rows: a block pair gives for each row its number of
links and one edge to a row it is joined with.  The work is that of the tree: it falls
with the structure of the data, and is all pairs of blocks, as matrix products, where
vectors have none, or in a group of near copies that are as far from each other as the
threshold.

Defined results: vectors that are null, empty, zero or hold null or non-finite values
link with nothing, nor do vectors of different lengths with each other; repeated rows
link with each other; a component without ids has a null id and its rows are kept; an
empty table gives an empty result; input columns of other names, also those of the
result, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.llm.common import cut, if_small
from quillstat.llm.components import components
from quillstat.llm.cover_tree import SLACK, CoverTree, distance, dual, first_radius, joined, spread_points, unit

#: Rows from which pivots are chosen, about, and their bytes; most pivots, and their bytes, of one vector length.
SAMPLE, SAMPLE_BYTES, PIVOTS, PIVOT_BYTES = 8192, 1 << 25, 2048, 1 << 23
#: Classes in a block, and its bytes in double precision, at most; rows of a key that are joined in one task, about.
BLOCK, BLOCK_BYTES, TOGETHER = 4096, 1 << 23, 20_000
#: Rows of tables that are broadcast.
SMALL = 200_000


def _valid(v):
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def spread_join(rows: DataFrame, other: DataFrame, keys: list[str], together: int = TOGETHER) -> DataFrame:
    """``rows`` joined with ``other``, which has a key once; keys with many rows are dealt out over several tasks."""
    hot = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > together)
    hot = if_small(cut(hot.select(*keys, F.ceil(F.col("__n") / together).cast("int").alias("__n"))), SMALL)
    salt = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)), F.coalesce(F.col("__n"), F.lit(1)))
    rows = rows.join(hot, keys, "left").withColumn("__salt", salt.cast("int")).drop("__n")
    other = other.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__n"), F.lit(1)) - 1))).drop("__n")
    return rows.join(other, [*keys, "__salt"]).drop("__salt")


def _matrix(column) -> np.ndarray:
    """An Arrow column of lists of one length as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Pivots:
    """The tops of the trees: one set of pivots for each vector length, numbered through."""

    def __init__(self, sets: dict[int, np.ndarray]) -> None:
        self.sets, self.first, self.count = sets, {}, 0
        for size, x in sets.items():
            self.first[size] = self.count
            self.count += len(x)

    @classmethod
    def chosen(cls, classes: DataFrame, sizes: dict[int, int], block: int) -> Pivots:
        """From a sample, by hash, of each vector length in ``sizes``, bounded in rows and bytes."""
        sets = {}
        for size, n in sizes.items():
            share = min(1.0, min(SAMPLE, SAMPLE_BYTES // (8 * size)) / n)
            drawn = classes.where((F.size("v") == size) & (F.pmod(F.xxhash64("node"), F.lit(1 << 20)) <= F.lit(int(share * (1 << 20)))))
            found = drawn.select("v").toArrow().column("v").combine_chunks()
            most = max(1, min(PIVOTS, PIVOT_BYTES // (8 * size), -(-4 * n // block)))
            x = unit(_matrix(found)) if len(found) else np.eye(1, size)
            sets[size] = x[spread_points(x, most)]
        return cls(sets)

    def nearest(self, classes: DataFrame) -> DataFrame:
        """``classes`` (node, n, v) with the cell of each and its distance from the pivot."""
        import pyarrow as pa

        sets, first = self.sets, self.first

        def run(batches: Iterator) -> Iterator:
            for batch in batches:
                v = batch.column("v")
                sizes = np.diff(v.offsets.to_numpy())
                for size in np.unique(sizes):
                    some = pa.array(np.flatnonzero(sizes == size))
                    own = batch.take(some)
                    dots = unit(_matrix(own.column("v"))) @ sets[int(size)].T
                    cell = dots.argmax(1)
                    away = distance(dots[np.arange(len(cell)), cell])
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cell + first[int(size)]), pa.array(away)], names=[*own.schema.names, "cell", "away"])

        return classes.mapInArrow(run, f"node long, n long, v {classes.schema['v'].dataType.simpleString()}, cell long, away double")

    def pairs(self, radius: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(near, whole): which pairs of cells can hold links that must be looked for, and which link as wholes."""
        near, whole = np.zeros((self.count,) * 2, bool), np.zeros((self.count,) * 2, bool)
        for size, x in self.sets.items():
            cells = np.flatnonzero(radius[self.first[size] : self.first[size] + len(x)] >= 0)
            if not len(cells):
                continue
            tree = CoverTree(x[cells], np.zeros(len(cells), np.int64), x[cells[:1]], own=radius[self.first[size] + cells], first=first_radius(reach))
            place = self.first[size] + cells[tree.order]

            def inside(level, i, j, tree=tree, place=place):
                s = tree.starts[level]
                for p, q in zip(i, j, strict=True):
                    whole[np.ix_(place[s[p] : s[p + 1]], place[s[q] : s[q + 1]])] = True

            def undecided(i, j, place=place):
                near[place[i], place[j]] = True

            dual(tree, tree, reach, np.array([0]), np.array([0]), inside, undecided)
        # rounding may differ by direction
        return (near | near.T) & ~(whole & whole.T), whole & whole.T


def _packed(pivots: Pivots, counts: np.ndarray, block: dict[int, int]) -> list[tuple[int, int, int]]:
    """(cell, first block, blocks): small cells share a block with those before them, large ones are split."""
    out, number = [], 0
    for size, x in pivots.sets.items():
        order = CoverTree(x, np.zeros(len(x), np.int64), x[:1]).order  # near cells together
        filled = 0
        for cell in (pivots.first[size] + order).tolist():
            n = int(counts[cell])
            if not n:
                continue
            if n > block[size]:
                split = -(-n // block[size])
                number += 1 if filled else 0
                out.append((cell, number, split))
                number, filled = number + split, 0
                continue
            if filled + n > block[size]:
                number, filled = number + 1, 0
            out.append((cell, number, 1))
            filled += n
        number += 1 if filled else 0
    return out


def _trees(assigned: DataFrame, pivots: Pivots, kind: str, radius: float) -> DataFrame:
    """(block, size, nodes, weights, vectors, tree) of each block of ``assigned``."""
    import pyarrow as pa

    sets, first = pivots.sets, pivots.first

    def build(table):
        table = table.combine_chunks()
        raw = _matrix(table.column("v").chunk(0))
        size = raw.shape[1]
        tree = CoverTree(unit(raw), table.column("cell").to_numpy() - first[size], sets[size], first=radius)
        own = [table.column(c).to_numpy()[tree.order].tobytes() for c in ("node", "n")]
        return pa.table({"block": [table.column("block")[0].as_py()], "size": pa.array([size], pa.int32()), "nodes": [own[0]], "weights": [own[1]], "vectors": [np.ascontiguousarray(raw[tree.order], kind).tobytes()], "tree": [tree.to_bytes()]})

    return assigned.groupBy("block").applyInArrow(build, "block long, size int, nodes binary, weights binary, vectors binary, tree binary")


class Side:
    """One block of a pair."""

    def __init__(self, row: dict, kind: str, sets: dict[int, np.ndarray]) -> None:
        self.raw = np.frombuffer(row["vectors"], kind).reshape(-1, row["size"])
        self.node, self.weight = np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["weights"], np.int64)
        self.tree = CoverTree.from_bytes(row["tree"], unit(self.raw), sets[row["size"]])
        self.total = np.concatenate([[0], np.cumsum(self.weight)])


def exact(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` have at least that cosine, rounded from extended to double precision."""
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 13):
        x, y = (v[at : at + (1 << 13)].astype(np.longdouble) for v in (a, b))
        x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
        cos = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
        out[at : at + (1 << 13)] = cos.astype(np.float64) >= cosine
    return out


def compared(a: Side, b: Side, near: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, label) of the rows of both sides, those of ``b`` after those of ``a``; of ``a`` alone if they are the same.

    Links are sums of the other side's weights; rows with one label are joined by links.
    """
    same = a is b
    shift = 0 if same else len(a.node)
    n = len(a.node) + (0 if same else len(b.node))
    gained, chained = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    label, edges, held = np.arange(n), [], 0

    def link(i0, i1, j0, j1) -> None:
        nonlocal label, held
        weight = b.total[j1] - b.total[j0]
        np.add.at(gained, i0, weight)
        np.add.at(gained, i1, -weight)
        if not same:
            weight = a.total[i1] - a.total[i0]
            np.add.at(gained, shift + j0, weight)
            np.add.at(gained, shift + j1, -weight)
        for s, e in ((i0, i1), (shift + j0, shift + j1)):  # all rows of a range are joined through the other side
            np.add.at(chained, s, 1)
            np.add.at(chained, e - 1, -1)
        edges.append((i0, shift + j0))
        held += len(i0)
        if held > 1 << 20:
            label = joined(n, *(np.concatenate(x) for x in zip(*edges, strict=True)), label)
            edges.clear()
            held = 0

    def inside(level, i, j) -> None:
        s, t = a.tree.starts[level], b.tree.starts[level]
        link(s[i], s[i + 1], t[j], t[j + 1])

    def undecided(i, j) -> None:
        yes = exact(a.raw[i], b.raw[j], cosine)
        link(i[yes], i[yes] + 1, j[yes], j[yes] + 1)

    i, j = np.nonzero(near[np.ix_(_cells(a), _cells(b))])
    dual(a.tree, b.tree, float(distance(np.float64(cosine))), i, j, inside, undecided)
    chain = np.flatnonzero(np.cumsum(chained)[:-1] > 0)
    edges.append((chain, chain + 1))
    label = joined(n, *(np.concatenate(x) for x in zip(*edges, strict=True)), label)
    links = np.cumsum(gained)[:-1]
    if same:
        own = near[_cells(a), _cells(a)]  # a row links with itself where its cell is compared with itself
        links = links - a.weight * np.repeat(own, np.diff(a.tree.starts[0]))
    return links, label


def _cells(side: Side) -> np.ndarray:
    return side.tree.top + side.first


def _compare(shipped: DataFrame, pivots: Pivots, near: np.ndarray, cosine: float, kind: str) -> DataFrame:
    """(node, links, to) from groups of the one or two blocks of a pair."""
    import pyarrow as pa

    sets, first, count, bits = pivots.sets, pivots.first, pivots.count, np.packbits(near)

    def run(table):
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        sides = [Side(r, kind, sets) for r in rows]
        for s, r in zip(sides, rows, strict=True):
            s.first = first[r["size"]]
        near = np.unpackbits(bits, count=count * count).reshape(count, count).astype(bool)
        links, label = compared(sides[0], sides[-1], near, cosine)
        node = np.concatenate([s.node for s in sides])
        some = np.flatnonzero(links > 0)
        return pa.table({"node": node[some], "links": links[some], "to": node[label[some]]})

    return shipped.groupBy("a", "b").applyInArrow(run, "node long, links long, to long")


def link(vectors: DataFrame, cosine: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", block_rows: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: how many other rows have at least that cosine with it, and the least id that it reaches by such links.

    A component keeps the rows of its least id.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be over 0 and at most 1")
    spark = vectors.sparkSession
    v = F.col(f"`{embedding}`")
    kind = "<f4" if vectors.schema[embedding].dataType.elementType.simpleString() == "float" else "<f8"
    if kind == "<f8":
        v = v.cast("array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.when(_valid(v), v).alias("v")).withColumns({"h1": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "h2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v"))})
    classes = rows.where(F.col("v").isNotNull()).groupBy("h1", "h2").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    sizes = dict(sorted((r[0], r[1]) for r in classes.groupBy(F.size("v")).count().collect()))
    found = _links(classes, sizes, cosine, kind, block_rows) if sizes else None
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    reached = components(found.where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b")))
    ids = classes.select("node", "least")
    reached = cut(reached.join(ids, "node"))
    reached = spread_join(reached.select("node", "comp"), reached.groupBy("comp").agg(F.min("least").alias("component_id")), ["comp"]).drop("comp")
    of_class = classes.drop("v").join(links, "node", "left").join(reached, "node", "left")
    of_class = of_class.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    lone, rest = rows.where(F.col("v").isNull()), rows.where(F.col("v").isNotNull()).drop("v")
    out = spread_join(rest, of_class, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(lone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(classes: DataFrame, sizes: dict[int, int], cosine: float, kind: str, block_rows: int) -> DataFrame:
    """(node, links, to): parts of the number of links of a class, and a class that it is joined with."""
    spark = classes.sparkSession
    reach = float(distance(np.float64(cosine)))
    block = {size: max(1, min(block_rows, BLOCK_BYTES // (8 * size))) for size in sizes}
    pivots = Pivots.chosen(classes, sizes, min(block.values()))
    assigned = cut(pivots.nearest(classes.select("node", "n", "v")))
    cells = assigned.groupBy("cell").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.max("away").alias("away"), F.min("node").alias("least")).collect()
    counts, weight, least, radius = np.zeros(pivots.count, np.int64), np.zeros(pivots.count, np.int64), np.zeros(pivots.count, np.int64), np.full(pivots.count, -1.0)
    for r in cells:
        counts[r["cell"]], weight[r["cell"]], least[r["cell"]], radius[r["cell"]] = r["rows"], r["n"], r["least"], r["away"] + SLACK
    near, whole = pivots.pairs(radius, reach)
    packed = _packed(pivots, counts, block)
    place = spark.createDataFrame(packed, "cell long, first long, split long")
    blocks = F.col("first") + F.pmod(F.xxhash64("node"), F.col("split"))
    trees = cut(_trees(assigned.join(F.broadcast(place), "cell").select(blocks.alias("block"), "node", "n", "v", "cell"), pivots, kind, first_radius(reach)))

    count, bits = pivots.count, np.packbits(near)

    def partners(batches):
        import pyarrow as pa

        near = np.unpackbits(bits, count=count * count).reshape(count, count)
        for batch in batches:
            i = batch.column("id").to_numpy()
            x, j = np.nonzero(near[i])
            yield pa.RecordBatch.from_arrays([pa.array(i[x]), pa.array(j)], names=["i", "j"])

    of_cell = place.select("cell", F.explode(F.sequence("first", F.col("first") + F.col("split") - 1)).alias("block"))
    pairs = spark.range(count).mapInArrow(partners, "i long, j long").where("i <= j")
    pairs = pairs.join(of_cell.select(F.col("cell").alias("i"), F.col("block").alias("x")), "i").join(of_cell.select(F.col("cell").alias("j"), F.col("block").alias("y")), "j")
    pairs = cut(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    shipped = pairs.withColumn("block", F.explode(F.array_distinct(F.array("a", "b"))))
    found = _compare(spread_join(shipped, trees, ["block"], together=64), pivots, near, cosine, kind)
    if whole.any():
        # cells that link as wholes: rows gain what their cell's partners weigh, and join one of them
        with_self = whole.diagonal()
        label = joined(count, *np.nonzero(whole))
        table = [(int(c), int((whole[c] * weight).sum()), bool(with_self[c]), int(least[np.flatnonzero(whole[c])[0]]), int(least[label[c]])) for c in np.flatnonzero(whole.any(1))]
        extra = spark.createDataFrame(table, "cell long, gain long, own boolean, partner long, root long")
        joined_rows = assigned.join(F.broadcast(extra), "cell")
        found = found.unionByName(joined_rows.select("node", (F.col("gain") - F.when(F.col("own"), F.col("n")).otherwise(0)).alias("links"), F.col("partner").alias("to")))
        found = found.unionByName(extra.select(F.col("partner").alias("node"), F.lit(0).cast("long").alias("links"), F.col("root").alias("to")))
    return cut(found)
