"""How the sources of a language differ in their use of terms.

Terms are counted by length: of up to eight bytes one uint64, of up to sixteen two,
which numpy sorts by radix (stable passes over 16-bit digits, least significant
first) and counts as runs; longer terms lie in separate buckets of fixed width that
are sorted as bytes.  A task keeps counts by group and term over the texts it reads
and hands them on when they are many, so what is shuffled is close to one row for
each task, group and term.

Counts then meet by language and term once.  With p a smoothed share in units of a
billionth, whole numbers throughout, the divergence of a group p from another q is
the sum of floor((p - q)^2 / q) over the kept terms.  Tasks sum it for all pairs of
sources of a language over their part of the terms; the pairs themselves are the
result, so the groups (one row each) are few enough to be known to every task.

Defined results: null text, language and source are empty strings; repeated rows are
documents of their own; groups without terms and languages that keep none have their
pairs with value 0; ties are ranked by item; an empty table gives an empty result; a
very long text is counted in pieces between terms and still is one document; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstat.llm.byte_spans import buffer_of, eight, padded, piece_end, runs, text_heads
from quillstat.llm.common import cut, cuts, if_small

#: Bytes of text that are counted at a time.
PIECE = 1 << 22
#: Counts by group and term that a task keeps before it hands them on.
MOST = 1 << 20
#: Groups that are broadcast.
SMALL = 100_000
#: Sources whose divergences from all others a task sums at a time.
ROWS = 1024

#: Bytes of terms, A-Z as a-z; 0 for all other bytes.
_LOWER = np.zeros(256, np.uint8)
_LOWER[0x80:] = np.arange(0x80, 256)
_LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
_OUTSIDE = _LOWER == 0


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by unsigned ``columns``, the last one first: passes over 16-bit digits, for which numpy's stable sort is a radix sort."""
    order = None
    for column in columns:
        digits = column.view(np.uint16).reshape(len(column), -1)
        for k in range(digits.shape[1]):
            digit = digits[:, k]
            if len(digit) and (digit != digit[0]).any():
                order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return np.arange(len(columns[0])) if order is None else order


class Counts:
    """Counts of one bucket of terms: keys (one or two uint64 columns, or one of bytes), group, occurrences, documents."""

    def __init__(self, keys, group, n, docs) -> None:
        self.keys, self.group, self.n, self.docs = keys, group, n, docs

    def __len__(self) -> int:
        return len(self.n)

    @classmethod
    def summed(cls, keys: list[np.ndarray], group: np.ndarray, n: np.ndarray | None, docs: np.ndarray) -> Counts:
        """Runs of equal key and group.  Without ``n``, rows are occurrences in the order of their documents, numbered by ``docs``."""
        if keys[0].dtype.kind == "S":
            order = np.argsort(group, kind="stable")
            order = order[np.argsort(keys[0][order], kind="stable")]
        else:
            order = radix_order([group, *keys])
        keys, group, docs = [k[order] for k in keys], group[order], docs[order]
        new = np.ones(len(group), bool)
        new[1:] = group[1:] != group[:-1]
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        first = np.flatnonzero(new)
        if n is None:
            fresh = new.copy()
            fresh[1:] |= docs[1:] != docs[:-1]
            sums = np.diff(np.append(first, len(group))), np.add.reduceat(fresh, first, dtype=np.int64)
        else:
            sums = np.add.reduceat(n[order], first), np.add.reduceat(docs, first)
        return cls([k[first] for k in keys], group[first], *sums)

    @classmethod
    def merged(cls, parts: list[Counts]) -> Counts:
        keys = [np.concatenate(k) for k in zip(*(p.keys for p in parts), strict=True)]
        return cls.summed(keys, *(np.concatenate([getattr(p, c) for p in parts]) for c in ("group", "n", "docs")))

    def terms(self):
        """The terms as an Arrow column; they have no zero bytes, the padding is nothing else."""
        import pyarrow as pa

        raw = (self.keys[0].view(np.uint8) if len(self.keys) == 1 else np.stack(self.keys, 1).view(np.uint8)).reshape(len(self), -1)
        full = raw != 0
        ends = np.concatenate([[0], np.cumsum(full.sum(1))])
        return pa.LargeStringArray.from_buffers(len(self), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw[full]))


def counted(data: np.ndarray, ends: np.ndarray, group: np.ndarray) -> dict[int, Counts]:
    """Counts of the terms of texts that end at ``ends`` in ``data``, by bucket: 1 and 2 for so many uint64, else the width in bytes."""
    lower = padded(_LOWER[data])
    heads, doc = text_heads(ends, 0, len(data))
    start, size = runs(lower[: len(data)] != 0, heads)
    owner = doc[np.searchsorted(heads, start, "right") - 1]
    blocks, of = lower.view(np.uint64), group[owner]
    out = {}
    for k, some in ((1, size <= 8), (2, (size > 8) & (size <= 16))):
        if some.any():
            s, z = start[some], size[some]
            out[k] = Counts.summed([eight(blocks, s + 8 * i, z - 8 * i) for i in range(k)], of[some], None, owner[some])
    long = np.flatnonzero(size > 16)
    widths = 1 << np.ceil(np.log2(size[long])).astype(np.int64)
    for w in np.unique(widths):
        which = long[widths == w]
        cells = np.zeros((len(which), w), np.uint8)
        if w <= 256:
            row = np.repeat(np.arange(len(which)), size[which])
            place = np.arange(len(row)) - np.repeat(np.cumsum(size[which]) - size[which], size[which])
            cells[row, place] = lower[np.repeat(start[which], size[which]) + place]
        else:
            for i, k in enumerate(which):
                cells[i, : size[k]] = lower[start[k] : start[k] + size[k]]
        out[int(w)] = Counts.summed([cells.view(f"S{w}").ravel()], of[which], None, owner[which])
    return out


def counted_long(data: np.ndarray, group: np.ndarray) -> dict[int, Counts]:
    """The same of one text of any length, in pieces; ``group`` has its group."""
    parts: dict[int, Counts] = {}
    at = 0
    while at < len(data):
        to = piece_end(_OUTSIDE, data, at, PIECE)
        for k, c in counted(data[at:to], np.array([to - at]), group).items():
            parts[k] = Counts.merged([parts[k], c]) if k in parts else c
        at = to
    for c in parts.values():
        c.docs = np.minimum(c.docs, 1)
    return parts


def term_counts(docs: DataFrame, groups: dict[tuple[str, str], int], text: str, lang: str, source: str) -> DataFrame:
    """(l, g, term, n, docs): partial counts by group; ``groups`` numbers the groups, of which ``l`` is the language."""
    import pyarrow as pa

    langs = {x: k for k, x in enumerate(dict.fromkeys(x for x, _ in groups))}
    language = np.array([langs[x] for x, _ in groups], np.int32)
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("text"))

    def hand_on(kept: dict[int, list[Counts]]) -> Iterator[pa.RecordBatch]:
        for c in (Counts.merged(parts) for parts in kept.values()):
            g = c.group.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(language[g]), pa.array(g), c.terms().cast(pa.string()), pa.array(c.n), pa.array(c.docs)], names=["l", "g", "term", "n", "docs"])

    def run(batches):
        kept: dict[int, list[Counts]] = {}
        held, floor = 0, 0
        for batch in batches:
            names = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
            of = np.array([groups[x] for x in names], np.uint32)
            column = batch.column("text")
            for at, n in cuts(column, 1 << 16, PIECE):
                data, ends = buffer_of(column.slice(at, n))
                own = of[at : at + n]
                for k, c in (counted(data, ends, own) if n > 1 or len(data) <= PIECE else counted_long(data, own)).items() if len(data) else ():
                    kept.setdefault(k, []).append(c)
                    held += len(c)
                if held - floor > MOST:
                    kept = {k: [Counts.merged(parts)] for k, parts in kept.items()}
                    held = floor = sum(len(c) for (c,) in kept.values())
                    if held > MOST:
                        yield from hand_on(kept)
                        kept, held, floor = {}, 0, 0
        yield from hand_on(kept)

    return rows.mapInArrow(run, "l int, g int, term string, n long, docs long")


def _share(count: Column, total: Column, scale: int) -> Column:
    """1 + floor(scale * (count + 1) / total), exactly."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.expr("1").cast("long") + F.call_function("div", whole(count + 1) * F.lit(scale).cast("decimal(19,0)"), whole(total))


def shares(counts: np.ndarray, totals: np.ndarray, scale: int) -> np.ndarray:
    """The same of arrays: a long division in steps of a thousand, as the product may be too large for an integer."""
    part, rest = np.divmod(counts + 1, totals)
    for step in _steps(scale):
        more, rest = np.divmod(rest * step, totals)
        part = part * step + more
    return part + 1


def _steps(scale: int) -> list[int]:
    out = []
    while scale > 1000 and scale % 1000 == 0:
        out.append(1000)
        scale //= 1000
    return [*out, scale]


def pair_sums(kept: DataFrame, groups: list[tuple[int, int, int]], scale: int) -> DataFrame:
    """(g, h, value): sums over the kept terms of floor((p - q)^2 / q), p of group g and q of group h of a language.

    ``kept`` has l and uses, an array of (g, n); ``groups`` the language, number and total (N + V) of each group.
    """
    import pyarrow as pa

    most = ROWS
    members: dict[int, np.ndarray] = {}
    for language in {x for x, _, _ in groups}:
        members[language] = np.array([(g, total) for x, g, total in groups if x == language], np.int64)
    blocks = max([1, *(-(-len(m) // most) for m in members.values())])
    rows = kept.select("l", "uses")
    if blocks > 1:
        number = F.element_at(F.create_map(*(F.lit(int(v)) for x, m in members.items() for v in (x, -(-len(m) // most)))), F.col("l"))
        rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), number - 1)))
    else:
        rows = rows.withColumn("block", F.lit(0))
    rows = rows.sortWithinPartitions("l", "block").select("l", "block", F.col("uses.g").alias("g"), F.col("uses.n").alias("n"))

    def run(batches):
        at, sums = None, None

        def found():
            own = members[at[0]][:, 0]
            some = own[at[1] * most : (at[1] + 1) * most]
            for i in range(len(some)):
                others = own != some[i]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(others.sum(), some[i]), pa.int32()), pa.array(own[others], pa.int32()), pa.array(sums[i][others])], names=["g", "h", "value"])

        for batch in batches:
            key = np.stack([batch.column("l").to_numpy(), batch.column("block").to_numpy()], 1)
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
            for a, b in zip(first, np.append(first[1:], len(key)), strict=True):
                if at != tuple(key[a]):
                    if at is not None:
                        yield from found()
                    at = tuple(map(int, key[a]))
                    sums = np.zeros((len(members[at[0]][at[1] * most : (at[1] + 1) * most]), len(members[at[0]])), np.int64)
                own = members[at[0]]
                few = max(1, (1 << 20) // len(own))
                for c in range(a, b, few):
                    g, n = (batch.column(x).slice(c, min(few, b - c)) for x in ("g", "n"))
                    row = np.repeat(np.arange(len(g)), np.diff(g.offsets.to_numpy()))
                    counts = np.zeros((len(g), len(own)), np.int64)
                    counts[row, np.searchsorted(own[:, 0], g.flatten().to_numpy())] = n.flatten().to_numpy()
                    p = shares(counts, own[:, 1], scale)
                    for i in range(len(sums)):
                        away = p[:, [at[1] * most + i]] - p
                        sums[i] += (away * away // p).sum(0)
        if at is not None:
            yield from found()

    return rows.mapInArrow(run, "g int, h int, value long").groupBy("g", "h").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, min_docs: int = 3, top: int = 200, scale: int = 10**9, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of ``docs``.

    Part ``pair`` has each other source of the language with the divergence from it, part
    ``term`` the ``top`` kept terms that the group uses more than its language, with their
    share of the divergence from it.  Terms are kept that ``min_docs`` documents of the
    language hold.
    """
    spark = docs.sparkSession
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    named = sorted((r["lang"], r["source"]) for r in docs.select(empty(lang).alias("lang"), empty(source).alias("source")).distinct().collect())
    number = {x: k for k, x in enumerate(named)}
    langs = {x: k for k, x in enumerate(dict.fromkeys(x for x, _ in named))}
    names = spark.createDataFrame([(k, langs[x], x, s) for k, (x, s) in enumerate(named)], "g int, l int, lang string, source string")
    # one shuffle by language and term; both sums are made where their rows lie
    by_group = term_counts(docs, number, text, lang, source).repartition("l", "term").groupBy("l", "term", "g").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = by_group.groupBy("l", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("whole"), F.collect_list(F.struct("g", "n")).alias("uses"))
    kept = cut(kept.where(F.col("docs") >= min_docs).drop("docs"))
    used = kept.select("l", "term", "whole", F.inline("uses"))
    of_group = dict(used.groupBy("g").agg(F.sum("n")).collect())
    of_lang = {r["l"]: (r["v"], r["n"]) for r in kept.groupBy("l").agg(F.count("*").alias("v"), F.sum("whole").alias("n")).collect()}
    totals = [(langs[x], k, of_group.get(k, 0) + of_lang.get(langs[x], (0, 0))[0]) for k, (x, _) in enumerate(named)]

    sums = pair_sums(kept, [t for t in totals if t[2]], scale)
    pairs = names.alias("a").join(names.alias("b"), F.expr("a.l = b.l and a.g <> b.g")).select(F.col("a.g"), F.col("b.g").alias("h"), F.col("a.lang"), F.col("a.source"), F.col("b.source").alias("item"))
    pairs = pairs.join(sums, ["g", "h"], "left").select("g", "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    known = spark.createDataFrame([(k, total, sum(of_lang.get(x, (0, 0)))) for x, k, total in totals], "g int, own long, all long")
    terms = used.join(if_small(known.join(names, "g"), SMALL).drop("l"), "g")
    terms = terms.withColumns({"p": _share(F.col("n"), F.col("own"), scale), "q": _share(F.col("whole"), F.col("all"), scale)}).where(F.col("p") > F.col("q"))
    terms = terms.select("g", "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("value"), "item")))

    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top)).drop("g")
