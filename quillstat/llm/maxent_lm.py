"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

The probability of a word is that of its class times that of the word in its
class.  The most frequent words are classes of their own, all others are classed
by their last two bytes.  Both factors are log-linear in features of the context:
the class by the last word, the second and the third last (skips), each in hashed
rows of weights, and by the classes of the last two; the word in its class by
the last word and the second last, in hashed rows of that class.  Within a class
the most frequent words and a rest have weights; words of the rest share its
probability by their counts, as (c + 0.5), one place being kept for words never
seen.

Everything learned is a sum over all training rows, so it neither depends on how
they are partitioned nor stops to sharpen as they grow:

1. counts of words, of which at most ``head`` are broadcast, the others being
   joined to the words they are needed for;
2. how often each feature meets each class or word: the weights start from
   these, shrunk towards what is usual without the feature;
3. gradient updates: what the features meet, less what the model expects of them
   over all contexts of the rows, divided by the latter (a Newton step by the
   diagonal), under a prior that keeps rare features small.

Rows of weights grow with the vocabulary, see :class:`Sizes`.  A task sends its
sums by blocks of weights, which are added up by block, so no task holds the sums of
many others; tasks are at most ``SHARDS`` for each core, however many partitions
the rows have, so what they send stays small beside what they read.

Words are told apart by 64-bit hashes.  Defined results: null and empty texts
have one token, the end; repeated rows are scored alike; with no training rows
all counts are zero; ties of counts go by hash; a very long text takes memory of
some times its size, all else is bounded; an empty table gives an empty result; input
columns named as a result column are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.llm.common import cut, portions
from quillstat.llm.word_hashes import word_hashes

END = 0  # stands for the hash of the end
SINGLE, SHAPES = 32, 32  # words that are classes, classes by ending
CLASSES = SINGLE + SHAPES
ROWS, CHARS = 128, 1 << 20  # of a portion of texts
TOKENS = 4096
CACHE = 1_000_000
SHARDS = 4
BLOCK = 1 << 15  # weights in a block
OFTEN = 24  # uses of a row in a minibatch from which they are summed on their own
LARGEST = 12.0  # of a weight, so that no sum of weights overflows
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (np.asarray(x).astype(np.uint64) + np.uint64(1)) * _MULT
    x ^= x >> np.uint64(32)
    return x * _MULT >> np.uint64(32)


def shape(endings: np.ndarray) -> np.ndarray:
    """The class, from 0, of words by their last two bytes."""
    return (_mixed(endings) % np.uint64(SHAPES)).astype(np.int32)


def _sum_by(r: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ``r``, and for each the sum of its rows of ``g``.

    Rare values are summed all at once, first rows, then second rows and so on.
    """
    order = np.argsort(r.astype(np.uint16), kind="stable")  # fits, see Sizes
    row = r[order]
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    sizes = np.diff(np.append(starts, len(row)))
    by_size = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[by_size], sizes[by_size]
    often = int(np.searchsorted(-sizes, -OFTEN, side="right"))
    total = g[order[starts]]
    for k in range(1, int(sizes[often]) if often < len(sizes) else 0):
        end = int(np.searchsorted(-sizes, -k, side="left"))
        total[often:end] += g[order[starts[often:end] + k]]
    for i in range(often):
        total[i] = g[order[starts[i] : starts[i] + sizes[i]]].sum(0)
    return row[starts], total


@dataclass(frozen=True)
class Sizes:
    """``hashed``: rows of weights for each of the three words of context; ``inner``: in each class, for each of two; ``slots``: weights in a class, the last is the rest's."""

    hashed: int
    inner: int
    slots: int

    @staticmethod
    def of(types: int) -> Sizes:
        """About one hashed row for 32 distinct words and one weight in a class for 2**14, within what every task can hold."""
        bits = math.ceil(math.log2(max(types, 2)))
        hashed = 1 << min(max(bits - 5, 8), 14)
        return Sizes(hashed, max(hashed // 16, 16), 1 << min(max(bits - 14, 4), 5))

    @property
    def first(self) -> tuple[int, int]:
        return 3 * self.hashed + CLASSES * CLASSES, CLASSES

    @property
    def second(self) -> tuple[int, int]:
        return 2 * SHAPES * self.inner, self.slots


def word_counts(train: DataFrame, text: str = "text") -> DataFrame:
    """(word, shape, n) over all rows: hashes of the tokens of their texts and one END each."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list = []

        def merged(parts):
            word, kind, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(word, kind="stable")
            word = word[order]
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            return word[starts], kind[order][starts], np.add.reduceat(n[order], starts)

        def batch_of(part):
            return pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), pa.array(part[1], pa.int32()), pa.array(part[2], pa.int64())], names=["word", "shape", "n"])

        size = 0
        for batch in batches:
            for _, texts in portions(batch.column(0), ROWS, CHARS):
                h, _, endings = word_hashes(texts, endings=True)
                word, first, n = np.unique(h, return_index=True, return_counts=True)
                held.append((np.append(word, np.uint64(END)), np.append(shape(endings[first]), np.int32(0)), np.append(n, len(texts))))
                size += len(word)
                if size > CACHE:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > CACHE // 2:
                        yield batch_of(held.pop())
                        size = 0
        if held:
            yield batch_of(merged(held))

    found = train.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "word bigint, shape int, n bigint")
    return found.groupBy("word").agg(F.first("shape").alias("shape"), F.sum("n").alias("n"))


class Vocabulary:
    """Classes, places and counts of the frequent words; sums over all others."""

    def __init__(self, counts: DataFrame, head: int) -> None:
        total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
        self.tokens, self.types = int(total["n"] or 0), int(total["v"])
        self.base = math.log10(self.tokens + 0.5 * (self.types + 1))
        self.sizes = Sizes.of(self.types)
        slots = self.sizes.slots
        # words above a count so that there are at most ``head`` of them
        sizes = counts.groupBy(F.floor(F.log2("n") * 8).alias("size")).count().collect()
        least, room = 10**9, head
        for r in sorted(sizes, key=lambda r: -r["size"]):
            room -= r["count"]
            if room < 0:
                break
            least = r["size"]
        rows = counts.where(F.floor(F.log2("n") * 8) >= least).select("word", "shape", "n").toArrow()
        word, kind, n = (rows.column(i).to_numpy() for i in range(3))
        order = np.lexsort((word, -n))
        self.words = word[order].view(np.uint64) if len(word) else np.zeros(0, np.uint64)
        self.count = n[order].astype(float)
        at = np.arange(len(order))
        kind = kind[order].astype(np.int32)
        self.cls = np.where(at < SINGLE, at, SINGLE + kind).astype(np.int32)
        sums = {r["shape"]: r["z"] for r in counts.groupBy("shape").agg((F.sum("n") + 0.5 * F.count("*")).alias("z")).collect()}
        rest = np.array([float(sums.get(s, 0.0)) for s in range(SHAPES)]) + 0.5
        np.subtract.at(rest, kind[:SINGLE], self.count[:SINGLE] + 0.5)
        of_class = np.concatenate([np.full(SINGLE, 1e-30), np.maximum(rest, 0.5)])
        of_class[: min(SINGLE, len(order))] = self.count[:SINGLE] + 0.5
        # places in a class: the number of more frequent words of it, if there is one for them
        self.slot = np.full(len(order), slots - 1, np.int32)
        by_class = SINGLE + np.argsort(kind[SINGLE:], kind="stable")
        if len(by_class):
            own = kind[by_class]
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            self.slot[by_class] = np.minimum(np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own)))), slots - 1)
        placed = (at >= SINGLE) & (self.slot < slots - 1)
        np.subtract.at(rest, kind[placed], self.count[placed] + 0.5)
        self.log_rest = np.log10(np.maximum(rest, 0.5))
        in_class = np.full((SHAPES, slots), 1e-30)
        in_class[kind[placed], self.slot[placed]] = self.count[placed] + 0.5
        in_class[:, -1] = np.maximum(rest, 0.5)
        #: Logarithms of the probabilities without any context, of classes and of places in a class; below -60 there is no word.
        self.of_class = np.log(of_class / of_class.sum()).astype(np.float32)
        self.in_class = np.log(in_class / in_class.sum(1, keepdims=True)).astype(np.float32)


class Reader:
    """Texts to ids, for use inside a task: the frequent words, then one id for each ending, then the start."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        v = self.v = vocabulary
        self.head = len(v.words)
        self.start = self.head + SHAPES
        self.place = np.argsort(v.words, kind="stable").astype(np.int32)
        self.sorted = v.words[self.place]
        self.cls = np.concatenate([v.cls, SINGLE + np.arange(SHAPES), [0]]).astype(np.int32)
        self.slot = np.concatenate([v.slot, np.full(SHAPES, v.sizes.slots - 1), [0]]).astype(np.int32)
        h = _mixed(np.arange(self.start + 1))
        self.row = (h % np.uint64(v.sizes.hashed)).astype(np.int32)
        self.inner = (h % np.uint64(v.sizes.inner)).astype(np.int32)

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, three starts before each text; where tokens are among them; their hashes; and how many each text has."""
        h, n, endings = word_hashes(texts, endings=True)
        word, first, back = np.unique(h, return_index=True, return_inverse=True)
        own = self.head + shape(endings[first])
        if self.head:
            near = np.minimum(np.searchsorted(self.sorted, word), self.head - 1)
            own = np.where(self.sorted[near] == word, self.place[near], own)
        ids = np.full(len(h) + 4 * len(n), self.start, np.int32)
        hashes = np.full(len(ids), END, np.uint64)
        at = np.arange(len(h)) + 4 * np.repeat(np.arange(len(n)), n) + 3
        ids[at], hashes[at] = own[back], h
        ids[np.cumsum(n + 4) - 1] = self._end()
        at = np.flatnonzero(ids != self.start)
        return ids, at, hashes[at], n + 1

    def _end(self) -> int:
        near = int(np.searchsorted(self.sorted, np.uint64(END)))
        return int(self.place[near]) if near < self.head and self.sorted[near] == END else self.head


class Weights:
    def __init__(self, sizes: Sizes, first: np.ndarray | None = None, second: np.ndarray | None = None) -> None:
        self.sizes = sizes
        self.first = np.zeros(sizes.first, np.float32) if first is None else first
        self.second = np.zeros(sizes.second, np.float32) if second is None else second

    def rows(self, reader: Reader, ids: np.ndarray, at: np.ndarray):
        """Class and place of the tokens at ``at``, rows of the first table, which tokens are not their own class, and their rows of the second."""
        a, b, c = ids[at - 1], ids[at - 2], ids[at - 3]
        hashed, inner = self.sizes.hashed, self.sizes.inner
        w = ids[at]
        k, s = reader.cls[w], reader.slot[w]
        one = [reader.row[a], reader.row[b] + hashed, reader.row[c] + 2 * hashed, reader.cls[a] * CLASSES + reader.cls[b] + 3 * hashed]
        (in_class,) = np.nonzero(k >= SINGLE)
        first = (k[in_class] - SINGLE) * (2 * inner)
        return w, k, s, one, in_class, [first + reader.inner[a[in_class]], first + inner + reader.inner[b[in_class]]]

    @staticmethod
    def _exp(table: np.ndarray, rows: list[np.ndarray], start: np.ndarray) -> np.ndarray:
        """exp of the sum of the rows and ``start``; weights are bounded, so it neither overflows nor vanishes."""
        z = np.take(table, rows[0], 0, mode="clip")
        more = np.empty_like(z)
        for r in rows[1:]:
            np.take(table, r, 0, out=more, mode="clip")
            z += more
        z += start
        return np.exp(z, out=z)

    def score(self, reader: Reader, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probability of each token, but for counts of words outside the frequent ones."""
        out = np.empty(len(at))
        v, slots = reader.v, self.sizes.slots
        for i in range(0, len(at), TOKENS):
            w, k, s, one, in_class, two = self.rows(reader, ids, at[i : i + TOKENS])
            e = self._exp(self.first, one, v.of_class)
            p = np.log10(e[np.arange(len(w)), k]) - np.log10(e.sum(1))
            e = self._exp(self.second, two, v.in_class[k[in_class] - SINGLE])
            p[in_class] += np.log10(e[np.arange(len(in_class)), s[in_class]]) - np.log10(e.sum(1))
            p = p.astype(float)
            (rest,) = np.nonzero((k >= SINGLE) & (s == slots - 1))
            p[rest] -= v.log_rest[k[rest] - SINGLE]
            counted = rest[w[rest] < reader.head]
            p[counted] += np.log10(v.count[w[counted]] + 0.5)
            out[i : i + TOKENS] = p
        return out

    def met(self, reader: Reader, ids: np.ndarray, at: np.ndarray, sums: np.ndarray) -> None:
        """Adds how often each feature meets each class, and each place in a class."""
        first, second = self.split(sums)
        for i in range(0, len(at), 64 * TOKENS):
            _, k, s, one, in_class, two = self.rows(reader, ids, at[i : i + 64 * TOKENS])
            for table, rows, column in [*((first, r, k) for r in one), *((second, r, s[in_class]) for r in two)]:
                np.add.at(table.reshape(-1), rows.astype(np.int64) * table.shape[1] + column, 1.0)

    def expected(self, reader: Reader, ids: np.ndarray, at: np.ndarray, sums: np.ndarray) -> None:
        """Adds what the model expects of the same, given the contexts."""
        first, second = self.split(sums)
        for i in range(0, len(at), TOKENS):
            _, k, _, one, in_class, two = self.rows(reader, ids, at[i : i + TOKENS])
            for table, sum_, rows, start in ((self.first, first, one, reader.v.of_class), (self.second, second, two, reader.v.in_class[k[in_class] - SINGLE])):
                if not len(rows[0]):
                    continue
                e = self._exp(table, rows, start)
                e /= e.sum(1, keepdims=True)
                for r in rows:
                    row, total = _sum_by(r, e)
                    sum_[row] += total

    def split(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.first.size
        return flat[:n].reshape(self.first.shape), flat[n:].reshape(self.second.shape)


def _gathered(rows: DataFrame, held, weights: Weights, what: str) -> np.ndarray:
    """Sums of ``what`` (met or expected) over all rows, of the size of the weights."""
    sc = rows.sparkSession.sparkContext
    size = weights.first.size + weights.second.size
    now = sc.broadcast(weights)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        reader = sums = None
        for batch in batches:
            for _, texts in portions(batch.column(0), ROWS, CHARS):
                if reader is None:
                    reader = Reader(held.value)
                    # counts are exact; what is expected is added by many tokens at a time
                    sums = np.zeros(size, np.float64 if what == "met" else np.float32)
                ids, at, _, _ = reader.read(texts)
                getattr(now.value, what)(reader, ids, at, sums)
        if sums is not None:
            starts = [i for i in range(0, size, BLOCK) if sums[i : i + BLOCK].any()]
            for i in range(0, len(starts), 16):
                part = starts[i : i + 16]
                yield pa.RecordBatch.from_arrays([pa.array([s // BLOCK for s in part], pa.int64()), pa.array([sums[s : s + BLOCK].astype(np.float32).tobytes() for s in part], pa.binary())], names=["block", "sums"])

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(sums.as_buffer(), np.float32)
                if block in total:
                    total[block] += own
                else:
                    total[block] = own.astype(float)
        for block, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sums.astype(np.float32).tobytes()], pa.binary())], names=["block", "sums"])

    shards = rows.coalesce(max(1, min(rows.rdd.getNumPartitions(), SHARDS * sc.defaultParallelism)))
    made = shards.mapInArrow(run, "block bigint, sums binary").repartition("block").mapInArrow(add, "block bigint, sums binary")
    out = np.zeros(size)
    for batch in made.toArrow().to_batches():  # of the fixed size of the weights
        for block, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(sums.as_buffer(), np.float32)
            out[block * BLOCK : block * BLOCK + len(own)] = own
    now.unpersist()
    return out


def started(vocabulary: Vocabulary, met: np.ndarray, shrink: float = 20.0, share: float = 0.5) -> Weights:
    """Weights from what the features meet: ``share`` of the logarithm of its ratio to what is usual, after ``shrink`` usual meetings of each."""
    weights = Weights(vocabulary.sizes)
    usual_first = np.exp(vocabulary.of_class.astype(float))[None, :]
    usual_second = np.repeat(np.exp(vocabulary.in_class.astype(float)), 2 * vocabulary.sizes.inner, axis=0)
    made = []
    for table, usual in zip(weights.split(met), (usual_first, usual_second), strict=True):
        n = table.sum(1, keepdims=True)
        made.append((share * np.log((table + shrink * usual) / (n + shrink) / usual)).clip(-LARGEST, LARGEST).astype(np.float32))
    return Weights(vocabulary.sizes, *made)


def updated(weights: Weights, met: np.ndarray, expected: np.ndarray, prior: float) -> Weights:
    """One step up the likelihood under a normal prior, by the gradient ``met - expected - prior * weight``.

    Each weight moves by its gradient over its curvature, the former growing as a
    logarithm where it is large, and divided among the features of a token, so that
    their steps together do not go too far.
    """
    made = []
    for w, m, e, features in zip((weights.first, weights.second), weights.split(met), weights.split(expected), (4, 2), strict=True):
        made.append((w + (np.log((m + prior) / (e + prior)) - prior * w / (e + prior)) / features).clip(-LARGEST, LARGEST).astype(np.float32))
    return Weights(weights.sizes, *made)


def train(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", updates: int = 1, prior: float = 2.0) -> Weights:
    """Weights from all training rows: their start from one pass over them, and one pass for each of ``updates``."""
    rows = docs.select(F.col(f"`{text}`").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    met = _gathered(rows, held, Weights(vocabulary.sizes), "met")
    weights = started(vocabulary, met)
    for _ in range(updates):
        weights = updated(weights, met, _gathered(rows, held, weights, "expected"), prior)
    held.unpersist()
    return weights


def score(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, weights: Weights, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with n_tokens, n_known, train_tokens, base_score and score.

    A row of ``docs`` becomes a row of its sums over frequent words and one for
    each distinct other word of it, to which counts are joined.  The former have no
    word to look up, so they get a key of their own, which spreads them, and count
    for nothing whatever it meets.
    """
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    keep = [c for c in docs.columns if c.lower() not in new and c != text]
    source = docs.select(F.monotonically_increasing_id().alias("__row"), F.struct(F.lit(1).alias("__one"), *(F.col(f"`{c}`") for c in keep)).alias("__kept"), F.col(f"`{text}`").alias("__text"))
    held = docs.sparkSession.sparkContext.broadcast((vocabulary, weights))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        v, w = held.value
        reader = Reader(v)
        log_count = np.concatenate([np.log10(v.count + 0.5), np.zeros(SHAPES)])
        for batch in batches:
            names = batch.column(0).to_numpy()
            for start, texts in portions(batch.column(2), ROWS, CHARS):
                ids, at, hashes, sizes = reader.read(texts)
                firsts = np.cumsum(sizes) - sizes
                frequent = ids[at] < reader.head
                base, model, known = (np.add.reduceat(x, firsts) for x in (log_count[ids[at]], w.score(reader, ids, at), frequent.astype(np.int64)))
                # the distinct other words of each text
                doc, word = np.repeat(np.arange(len(sizes)), sizes)[~frequent], hashes[~frequent]
                order = np.lexsort((word, doc))
                doc, word = doc[order], word[order]
                begins = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])])[: len(doc)])
                often = np.diff(np.append(begins, len(doc)))
                own = names[start : start + len(sizes)]
                n, m = len(sizes), len(begins)
                kept = batch.column(1).slice(start, n)
                zeros = np.zeros(m, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([own, own[doc[begins]]])),
                        pa.concat_arrays([kept, pa.nulls(m, kept.type)]),
                        pa.array(np.concatenate([_mixed(own) * _MULT, word[begins]]).view(np.int64)),
                        pa.array(np.concatenate([np.zeros(n, np.int64), often])),
                        pa.array(np.concatenate([sizes, zeros])),
                        pa.array(np.concatenate([known, zeros])),
                        pa.array(np.concatenate([base, zeros.astype(float)])),
                        pa.array(np.concatenate([model, zeros.astype(float)])),
                    ],
                    names=["__row", "__kept", "word", "often", "n_tokens", "known", "base", "model"],
                )

    kept = source.schema["__kept"].dataType.simpleString()
    found = source.mapInArrow(run, f"__row bigint, __kept {kept}, word bigint, often bigint, n_tokens bigint, known bigint, base double, model double")
    joined = found.join(counts.select("word", F.col("n").alias("c")), "word", "left")
    tail = F.col("often") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    rows = joined.groupBy("__row").agg(
        F.first("__kept", ignorenulls=True).alias("__kept"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(F.col("c") > 0, F.col("often")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + tail).alias("base"),
        F.sum(F.col("model") + tail).alias("score"),
    )
    return rows.select(*(F.col(f"__kept.`{c}`") for c in keep), "n_tokens", "n_known", F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(vocabulary.base)).alias("base_score"), "score")


def model(train_docs: DataFrame, head: int = 100_000, **how) -> tuple[DataFrame, Vocabulary, Weights]:
    """Counts over all training rows, the vocabulary, and trained weights."""
    counts = cut(word_counts(train_docs))
    vocabulary = Vocabulary(counts, head)
    return counts, vocabulary, train(train_docs, vocabulary, **how)
