"""Exact similarity self-join of texts by the Jaccard index of their word shingles.

A text's set is its distinct five-word shingles, as 64-bit hashes.  Texts with
the same set are one class, and everything else works on classes:

1. *Partition.*  Every class lists its least tokens in a common order, as many
   as any set similar enough must share one of (the prefix of a prefix-filtered
   join).  Classes are linked to the class with which they share the most of
   such tokens through a token's least class, these links are checked on the
   whole sets, and their components are the groups of similar documents.
2. *Matrix.*  Each group stores the union of its members' listed tokens.
3. *Bound.*  Every class whose group is the smaller one is a query against each
   other group with a token of it: the tokens of the query that the union holds
   bound its overlap with any member, and groups that stay below what the
   threshold asks for are not opened.
4. *Open.*  The members of the remaining groups are compared with the query on
   their whole sets.

A pair left out has its two classes in one group, shares no listed token, or is
excluded by the bound, so the components of all links found are exact.  Tokens
whose hash bucket is crowded come last in the order; the order decides only how
many candidates there are, never what is found.

No token and no group meets in one task: rows of tokens that may be crowded are
summed before they are shuffled, all other tokens have few rows by the very count
that did not mark them; groups of many members are joined by broadcast, and the
blocks in which members are compared are dealt to several tasks for each group.

Defined results: null texts and texts without words have the empty set and link
with nothing; shorter texts than a shingle are one shingle; repeated rows and
equal texts fall into one class; null ids never name a component that has other
ids; ids that tie for the least are one; an empty table gives an empty result; input
columns other than id and text are ignored; a very long text takes memory of some
times its size in one task.  Hashes of 64 bits stand for shingles and sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstat.llm.common import Scratch, cut, if_small, map_batches, portions, release
from quillstat.llm.components import components
from quillstat.llm.word_hashes import word_hashes

ROWS = 128
BUCKETS = 1 << 16
CACHE = 300_000
#: Most rows (of a few numbers, about 80 bytes each) that are broadcast: 32 MB.
BROADCAST = 400_000
#: Most bits that tell which texts are wanted: 16 MB.
MOST_MARKS = 1 << 27
#: Members from which a group counts as large; there are few of those.
LARGE = 5_000
#: Tasks among which the blocks of one group are dealt.
SPREAD = 32
CHARS = 1 << 20
#: Tokens in a block of sets that are compared together.
BLOCK = 32_768


class Shingles:
    """Sets of 64-bit shingle hashes, for use inside a task."""

    def __init__(self, size: int) -> None:
        self.size = size

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """The sorted distinct hashes of each text's shingles."""
        h, n = word_hashes(texts)
        k = self.size
        every = self._mix(h, k) if len(h) >= k else h[:0]
        out, at = [], 0
        for m in n.tolist():
            if m >= k:
                own = np.sort(every[at : at + m - k + 1])
                out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            else:
                out.append(self._mix(h[at : at + m], m) if m else h[:0])
            at += m
        return out

    @staticmethod
    def _mix(h: np.ndarray, k: int) -> np.ndarray:
        """A hash of every ``k`` neighbours of ``h``."""
        out = np.full(len(h) - k + 1, 0x9E3779B97F4A7C15 + k, np.uint64)
        for j in range(k):
            out = (out ^ h[j : len(h) - k + 1 + j]) * np.uint64(0xFF51AFD7ED558CCD)
            out ^= out >> np.uint64(32)
        return out


def set_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_overlap(percent: int, a, b):
    """How many tokens sets of sizes ``a`` and ``b`` must share: 100 * o >= percent * (a + b - o)."""
    return F.ceil(percent * (a + b) / F.lit(100.0 + percent) - 1e-9)


def listed(n, percent: int):
    """How many least tokens a set of ``n`` lists."""
    return n + 1 - -(-percent * n // 100)


class Join:
    """The steps over one table; ``docs`` has ``id`` and ``text`` and is read several times."""

    def __init__(self, docs: DataFrame, shingle: int = 5, percent: int = 75, turns: int = 1) -> None:
        self.docs, self.shingle, self.percent, self.turns = docs, shingle, percent, turns
        self.spark = docs.sparkSession

    def rows(self) -> tuple[DataFrame, np.ndarray]:
        """(id, key, n, cls) of each row, key a hash of its text, and which token buckets are crowded."""
        shingle = self.shingle
        id_type = self.docs.schema["id"].dataType

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            sets, counts, seen = Shingles(shingle), np.zeros(BUCKETS, np.int64), set()
            names = ["id", "key", "n", "cls", "bucket", "many"]
            kind = None
            for batch in batches:
                kind = batch.schema.field(0).type
                n, cls = [], []
                for _, texts in portions(batch.column(2), ROWS, CHARS):
                    for s in sets.sets(texts):
                        n.append(len(s))
                        cls.append(set_id(s) if len(s) else None)
                        if len(s) and cls[-1] not in seen:
                            if len(seen) < CACHE:
                                seen.add(cls[-1])
                            np.add.at(counts, (s & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
                none = pa.nulls(len(n), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), none, none], names=names)
            if kind is not None:
                (b,) = np.nonzero(counts)
                none = pa.nulls(len(b), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.nulls(len(b), kind), none, none, none, pa.array(b.astype(np.int64)), pa.array(counts[b])], names=names)

        both = cut(self.docs.select("id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, f"id {id_type.simpleString()}, key bigint, n bigint, cls bigint, bucket bigint, many bigint"))
        loads = np.zeros(BUCKETS)
        for r in both.where("bucket is not null").groupBy("bucket").agg(F.sum("many").alias("many")).collect():
            loads[r["bucket"]] = r["many"]
        usual = float(np.median(loads))
        return both.where("bucket is null").select("id", "key", "n", "cls"), loads > usual + 10 * np.sqrt(usual) + 50

    def index(self, crowded: np.ndarray) -> DataFrame:
        """(token, cls, n, hot): the least tokens of each class, those of crowded buckets (hot) last."""
        held = self.spark.sparkContext.broadcast(crowded)
        shingle, percent = self.shingle, self.percent

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            sets, seen = Shingles(shingle), set()
            for batch in batches:
                for _, texts in portions(batch.column(0), ROWS * 2, CHARS):
                    token, cls, size = [], [], []
                    for s in sets.sets(texts):
                        if not len(s) or (c := set_id(s)) in seen:
                            continue
                        if len(seen) < CACHE:
                            seen.add(c)
                        last = held.value[(s & np.uint64(BUCKETS - 1)).astype(np.int64)]
                        t = np.concatenate([s[~last], s[last]])[: listed(len(s), percent)]
                        token.append(t)
                        cls.append(np.full(len(t), c))
                        size.append(np.full(len(t), len(s), np.int32))
                    if token:
                        every = np.concatenate(token)
                        hot = held.value[(every & np.uint64(BUCKETS - 1)).astype(np.int64)]
                        yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), pa.array(np.concatenate(cls)), pa.array(np.concatenate(size)), pa.array(hot)], names=["token", "cls", "n", "hot"])

        return self.docs.select("text").mapInArrow(run, "token bigint, cls bigint, n int, hot boolean")

    def sets_of(self, wanted: DataFrame) -> DataFrame:
        """(cls, tokens) of the classes in ``wanted`` (column cls, distinct).

        Only texts whose key may be that of one of them are read by Python and
        shuffled, however many there are: their bits are all a task is sent.
        """
        shingle = self.shingle
        held = self.spark.sparkContext.broadcast(_marks(cut(wanted.join(self.classes.select("cls", "key"), "cls").select("key"))))

        def make():
            sets, seen, marks = Shingles(shingle), set(), held.value

            def step(batch):
                at = batch.column(0).to_numpy().view(np.uint64) & np.uint64(8 * len(marks) - 1)
                texts_of = batch.column(1).filter((marks[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool))
                cls, tokens = [], []
                for _, texts in portions(texts_of, ROWS, CHARS):
                    for s in sets.sets(texts):
                        if not len(s) or (c := set_id(s)) in seen:
                            continue
                        if len(seen) < CACHE:
                            seen.add(c)
                        cls.append(c)
                        tokens.append(s.view(np.int64))
                return {"cls": cls, "tokens": tokens}

            return step

        found = map_batches(self.docs.select(F.xxhash64("text").alias("key"), "text"), "cls bigint, tokens array<bigint>", make)
        return found.join(if_small(wanted, BROADCAST), "cls", "left_semi").dropDuplicates(["cls"])

    def check(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs (a, b: classes) that link, by their whole sets."""
        pairs = cut(pairs)
        release(self.spark)
        wanted = cut(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct())
        sets = self.sets_of(wanted)
        two = pairs.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("y")), "b")
        both = F.size(F.array_intersect("x", "y"))
        union = F.size("x") + F.size("y") - both
        release(self.spark)
        return cut(two.where(100 * both >= self.percent * union).select("a", "b"))

    def links(self, crowded: np.ndarray) -> DataFrame:
        """(a, b): checked links that connect all classes of each component."""
        p, scratch = self.percent, Scratch(self.spark)
        try:
            return self._links(crowded, p, scratch)
        finally:
            scratch.close()

    def _links(self, crowded: np.ndarray, p: int, scratch: Scratch) -> DataFrame:
        index = self.index(crowded)
        hot = scratch.keep(index.where("hot"))
        shared = _over_token(index.where("not hot"), hot, one=F.min("cls"), other=F.max("cls")).where("one <> other").select("token", "cls", "n", "hot")
        shared = scratch.keep(shared)
        scratch.drop(hot)
        release(self.spark)
        # 1. groups: a class whose listed tokens are more widely shared is likelier to be near its copies
        score = if_small(cut(shared.groupBy("cls").agg((F.count("*") / F.first(_listed(F.col("n"), p))).alias("score"))), BROADCAST)
        group = first = None
        for turn in range(self.turns):
            at = shared.join(score, "cls")
            at = at if group is None else at.join(group.withColumnRenamed("node", "cls"), "cls", "left")
            at = at.withColumn("comp", F.col("cls") if group is None else F.coalesce("comp", "cls"))
            at = _over_token(at.where("not hot"), at.where("hot"), best=F.max(F.struct("score", "cls", "n", "comp"))).where("comp <> best.comp")
            stars = at.groupBy("cls", "n", F.col("best.cls").alias("centre"), F.col("best.n").alias("m")).count()
            rest = F.greatest(*(F.col(c) - _listed(F.col(c), p) for c in ("n", "m")))
            stars = stars.where(F.col("count") + rest >= least_overlap(p, F.col("n"), F.col("m"))).where((100 * F.col("n") >= p * F.col("m")) & (100 * F.col("m") >= p * F.col("n")))
            best = stars.groupBy("cls").agg(F.max(F.struct("count", F.col("centre"))).alias("best")).select(F.col("cls").alias("a"), F.col("best.centre").alias("b"))
            found = self.check(best)
            release(self.spark)
            first = found if first is None else cut(first.unionByName(found))
            group = components(first)
            release(self.spark)
        # 2. the matrix: (token, group) with the range of its members' sizes
        listed_by = shared.join(if_small(group.select(F.col("node").alias("cls"), "comp"), BROADCAST), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        spread = cut(listed_by.groupBy("comp", "cls").agg(F.first("n").alias("n")).groupBy("comp").agg(F.count("*").alias("members"), F.min("n").alias("low"), F.max("n").alias("high")))
        both = _over_token(listed_by.where("not hot"), listed_by.where("hot"), one=F.min("comp"), two=F.max("comp")).where("one <> two").select("token", "cls", "n", "comp")
        listed_by = scratch.keep(both)
        release(self.spark)
        matrix = _by_group(scratch.keep(listed_by.select("token", "comp").distinct()), spread).withColumnRenamed("comp", "other")
        queries = _by_group(listed_by, spread.select("comp", "members")).withColumnRenamed("members", "own")
        # 3. the smaller group asks the larger one
        met = queries.join(matrix, "token").where("comp <> other and (own < members or own = members and comp < other)")
        met = met.where((100 * F.col("n") >= p * F.col("low")) & (100 * F.col("high") >= p * F.col("n")))
        counted = met.groupBy("cls", "n", "other", "low", "high").count()
        n, low, high = F.col("n"), F.col("low"), F.col("high")
        # over the sizes m that a member may have, the most that is not listed and the least that is asked for
        m_low = F.greatest(low.cast("double"), F.ceil(p * n / 100.0 - 1e-9))
        m_high = F.least(high.cast("double"), F.floor(100.0 * n / p + 1e-9))
        bound = lambda m: F.col("count") + 1 + F.greatest(n - _listed(n, p), m - _listed(m, p)) >= least_overlap(p, n, m)
        # but for rounding, which the 1 allows for, the slack is greatest at an end of the sizes
        open_ = counted.where((m_low <= m_high) & (bound(m_low) | bound(m_high)))
        # 4. members of opened groups
        opened = cut(open_.select("cls", "n", "other"))
        release(self.spark)
        others = if_small(opened.select("other").distinct(), BROADCAST)
        sizes = shared.groupBy("cls").agg(F.first("n").alias("n"))
        member = sizes.join(group.select(F.col("node").alias("cls"), "comp"), "cls", "left").select("cls", "n", F.coalesce("comp", "cls").alias("other"))
        member = cut(member.join(others, "other", "left_semi").select("cls", "n", "other"))
        scratch.drop(shared, listed_by)
        release(self.spark)
        return first.unionByName(self.open(opened, member))

    def open(self, queries: DataFrame, members: DataFrame) -> DataFrame:
        """(a, b): a link of each query class into each group, where it has any.

        ``queries`` and ``members`` are (cls, n, other), ``other`` naming the
        group.  Both are dealt into blocks of about BLOCK tokens, by hash, and
        each block of a group's queries meets each block of its members, in one of
        SPREAD tasks by the number of the former.
        """
        percent = self.percent
        sets = self.sets_of(cut(queries.select("cls").unionByName(members.select("cls")).distinct()))

        def dealt(side: DataFrame) -> DataFrame:
            many = side.groupBy("other").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
            return side.join(if_small(cut(many), BROADCAST), "other").select("cls", "other", F.pmod(F.xxhash64("cls"), F.col("blocks")).alias("block"))

        def blocks(side: DataFrame, name: str) -> DataFrame:
            # sets move once to where their blocks are made and also compared
            rows = side.join(sets, "cls").select("other", "task", "block", F.struct("cls", "tokens").alias("own")).repartition("other", "task")
            return rows.groupBy("other", "task", "block").agg(F.collect_list("own").alias("all")).select(
                "other", "task", F.col("all.cls").alias(f"{name}_cls"), F.transform("all", lambda r: F.size(r["tokens"])).alias(f"{name}_n"), F.flatten("all.tokens").alias(f"{name}_tokens")
            )

        asking = queries.groupBy("other").agg(F.ceil(F.sum("n") / BLOCK).alias("asking"))
        asking = if_small(cut(asking), BROADCAST)
        asked = cut(dealt(members).join(asking, "other").withColumn("task", F.explode(F.sequence(F.lit(0), F.least(F.col("asking"), F.lit(SPREAD)).cast("int") - 1))).drop("asking"))
        asks = cut(dealt(queries).withColumn("task", F.pmod("block", F.lit(SPREAD)).cast("int")))
        release(self.spark)
        two = blocks(asks, "q").join(blocks(asked, "m"), ["other", "task"]).select("q_cls", "q_n", "q_tokens", "m_cls", "m_n", "m_tokens")

        def make():
            def step(batch):
                out = {"a": [], "b": []}
                for i in range(batch.num_rows):
                    q_cls, q_n, q_tokens, m_cls, m_n, m_tokens = (c[i].values.to_numpy(zero_copy_only=False) for c in batch.columns)
                    starts = np.concatenate([[0], np.cumsum(m_n)[:-1]])
                    at = 0
                    for cls, n in zip(q_cls.tolist(), q_n.tolist(), strict=True):
                        own = np.sort(q_tokens[at : at + n])
                        at += n
                        hit = own[np.minimum(np.searchsorted(own, m_tokens), n - 1)] == m_tokens
                        both = np.add.reduceat(hit.astype(np.int64), starts)
                        (found,) = np.nonzero(100 * both >= percent * (n + m_n - both))
                        if len(found):
                            out["a"].append(cls)
                            out["b"].append(int(m_cls[found[0]]))
                return out

            return step

        return cut(map_batches(two, "a bigint, b bigint", make))

    def run(self) -> DataFrame:
        """(id, n_shingles, component_id) of each row."""
        rows, crowded = self.rows()
        self.classes = classes = cut(rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("id"), F.min("key").alias("key")))
        group = components(self.links(crowded)).withColumnRenamed("node", "cls")
        named = classes.join(group, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        least = named.groupBy("comp").agg(F.count("*").alias("members"), F.min("id").alias("component_id"))
        names = cut(_by_group(cut(named.select("cls", "comp")), cut(least)).select("cls", "component_id"))
        return rows.join(names, "cls", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def _marks(keys: DataFrame) -> np.ndarray:
    """Bits, 16 or more a key, at most MOST_MARKS, in bytes: that of ``key`` modulo their number is set for every key (64-bit hashes); few others find theirs set."""
    bits = min(1 << max(math.ceil(math.log2(16 * max(keys.count(), 1))), 15), MOST_MARKS)
    at = F.pmod("key", F.lit(bits)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():
        start = (r["part"] - 1) * 4096
        out[start : start + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _over_token(few: DataFrame, hot: DataFrame, **aggregates) -> DataFrame:
    """Rows (token, ...) with aggregates over all rows of each token, those of tokens that may be in very many (``hot``) being summed before they meet and joined back."""
    by = Window.partitionBy("token")
    few = few.withColumns({k: a.over(by) for k, a in aggregates.items()})
    summed = hot.groupBy("token").agg(*(a.alias(k) for k, a in aggregates.items()))
    return few.unionByName(hot.join(summed, "token").select(*few.columns))


def _by_group(df: DataFrame, groups: DataFrame) -> DataFrame:
    """``df`` with the columns of ``groups`` (comp, members, ...), a row for each group; the few large ones are broadcast.

    Large is a group of over LARGE members and one in 100,000 of all, so there are at most 100,000.
    """
    every = groups.agg(F.sum("members")).first()[0] or 0
    large = F.col("members") > max(LARGE, every // 100_000)
    few = F.broadcast(groups.where(large))
    return df.join(few, "comp").unionByName(df.join(few, "comp", "left_anti").join(groups.where(~large), "comp"))


def _listed(n, percent: int):
    """The same as :func:`listed` for Columns."""
    return n + 1 - F.ceil(percent * n / 100.0 - 1e-9)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(``doc_id``, n_shingles, component_id) of each row of ``docs``."""
    return Join(docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")), **how).run().withColumnRenamed("id", doc_id)


def _row(docs: DataFrame, doc_id: str):
    """A key of each row, ordered by id with nulls last; only rows with the same values share one."""
    return F.struct(F.col(f"`{doc_id}`").isNull().alias("no_id"), F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns)))).alias("hash"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of each component, that of the least id; nulls are last, and rows of one id go by a hash of their values.

    Of rows with the same values in all columns any one stays.  Rows without words
    are in no component, so all of them stay.
    """
    row = _row(docs, doc_id)
    found = cut(near_duplicates(docs.select(row.alias("__row"), F.col(f"`{text}`").alias("text")), "__row", "text", **how))
    others = cut(found.where(F.col("__row") != F.col("component_id")).select("__row").distinct())
    again = cut(found.where((F.col("n_shingles") > 0) & (F.col("__row") == F.col("component_id"))).groupBy("__row").count().where("count > 1").select("__row"))
    docs = docs.withColumn("__row", row).join(if_small(others, BROADCAST), "__row", "left_anti")
    if again.isEmpty():
        return docs.drop("__row")
    again = if_small(again, BROADCAST)
    single = docs.join(again, "__row", "left_semi").dropDuplicates(["__row"])
    return docs.join(again, "__row", "left_anti").unionByName(single).drop("__row")
