"""How document filters interact: what each removes in every order of applying them.

Texts are measured in one pass of a table-driven finite-state transducer over
their UTF-8 bytes.  A byte's class and the state before it give the next state and
what is put out: a word begins, a capital, a code point, a symbol.  The next state
depends on the class alone (the machine is between words after white space, in one
after anything else), so the state before each byte is that of the byte before it
and the pass is two table look-ups over whole arrays.  Word spans go into an open
hash table in which every hit is verified by comparing document, length and bytes;
a long text is taken in pieces between words, its table keeping distinct words only.

What filters decide is then counted: texts become rows of an id, a digest and the
filters they fail, and all orders are evaluated on the counts by part and failed
filters, which are few whatever the number of documents.

Defined results: a null text is empty and a null language the empty part; rows with
the same id and text are rows of their own, none a copy of the other; a row without
an id is no copy and has no copies; of several labels of one id any that is 1 counts,
a null label is none; an empty table gives an empty result; of a very long text a
piece and the distinct words are held at a time beside the text; other columns of the
input, whatever their names, are not read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstat.llm.byte_spans import buffer_of, eight, padded, piece_end, runs, text_heads
from quillstat.llm.common import map_batches

#: Bytes of one text that are searched for words at a time.
PIECE = 1 << 22
#: Bytes of a word that are hashed and compared side by side with other words; longer words are taken alone.
_SHORT = 64

_SPACE, _CAPITAL, _SYMBOL, _CONTINUED, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x80:0xC0] = _CONTINUED
_CLASS[ord("A") : ord("Z") + 1] = _CAPITAL
_CLASS[list(b"#$%&*|")] = _SYMBOL
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE

#: States, what the transducer moves to and what it puts out, by state and class.
_BETWEEN, _WITHIN = 0, 1
_BEGINS, _IS_CAPITAL, _IS_SYMBOL, _IS_POINT = 1, 2, 4, 8
_NEXT = np.array([[_BETWEEN, _WITHIN, _WITHIN, _WITHIN, _WITHIN]] * 2, np.uint8)
_OUT = np.zeros((2, 5), np.uint8)
_OUT[_BETWEEN, 1:] |= _BEGINS
_OUT[:, _CAPITAL] |= _IS_CAPITAL
_OUT[:, _SYMBOL] |= _IS_SYMBOL
_OUT[:, [_SPACE, _CAPITAL, _SYMBOL, _OTHER]] |= _IS_POINT

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Spans:
    """Byte spans of words in one padded buffer, with the document of each."""

    def __init__(self, data: np.ndarray) -> None:
        self.data, self.blocks = data, data.view(np.uint64)
        self.start = self.size = self.doc = np.zeros(0, np.int64)
        self.head = self.hash = np.zeros(0, np.uint64)

    def add(self, start: np.ndarray, size: np.ndarray, doc: np.ndarray) -> None:
        head = eight(self.blocks, start, size)
        h = (head ^ (doc.astype(np.uint64) << np.uint64(32)) ^ size.astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
        more, done = np.flatnonzero((size > 8) & (size <= _SHORT)), 8
        while len(more):
            h[more] = (h[more] ^ eight(self.blocks, start[more] + done, size[more] - done)) * _MIX
            h[more] ^= h[more] >> np.uint64(29)
            done += 8
            more = more[size[more] > done]
        if size.max(initial=0) > _SHORT:
            import xxhash

            for i in np.flatnonzero(size > _SHORT):
                h[i] ^= np.uint64(xxhash.xxh64_intdigest(self.data[start[i] : start[i] + size[i]].data))
        self.start, self.size, self.doc = np.concatenate([self.start, start]), np.concatenate([self.size, size]), np.concatenate([self.doc, doc])
        self.head, self.hash = np.concatenate([self.head, head]), np.concatenate([self.hash, h * _MIX])

    def same(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which spans i are the same words of the same documents as spans j, byte by byte."""
        size = self.size[i]
        equal = (self.head[i] == self.head[j]) & (size == self.size[j]) & (self.doc[i] == self.doc[j])
        more, done = np.flatnonzero(equal & (size > 8) & (size <= _SHORT) & (i != j)), 8
        while len(more):
            a, b, left = self.start[i[more]] + done, self.start[j[more]] + done, size[more] - done
            alike = eight(self.blocks, a, left) == eight(self.blocks, b, left)
            equal[more[~alike]] = False
            done += 8
            more = more[alike & (left > 8)]
        for k in np.flatnonzero(equal & (size > _SHORT) & (i != j)):
            a, b = self.start[i[k]], self.start[j[k]]
            equal[k] = np.array_equal(self.data[a : a + size[k]], self.data[b : b + size[k]])
        return equal

    def keep_distinct(self) -> None:
        """Keeps one span of each word of each document, found by insertion into an open hash table."""
        n = len(self.start)
        bits = max(4, int(2 * n).bit_length())
        table, mask = np.full(1 << bits, -1, np.int32), (1 << bits) - 1
        pending, slot = np.arange(n, dtype=np.int32), (self.hash >> np.uint64(64 - bits)).astype(np.int64)
        first = np.zeros(n, bool)
        while len(pending):
            free = table[slot] < 0
            table[slot[free]] = pending[free]  # of several that claim a place one gets it
            holder = table[slot]
            first[pending[holder == pending]] = True
            other = ~self.same(pending, holder)
            pending, slot = pending[other], (slot[other] + 1) & mask
        for name in ("start", "size", "doc", "head", "hash"):
            setattr(self, name, getattr(self, name)[first])


def measured(data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, symbols and code points of texts that end at ``ends`` in ``data``."""
    docs = len(ends)
    out = {k: np.zeros(docs, np.int64) for k in ("n_words", "n_distinct", "n_capitals", "n_symbols", "n_points")}
    spans = Spans(padded(data))
    at = 0
    while at < len(data):
        to = piece_end(_CLASS == _SPACE, data, at, PIECE)
        kind = _CLASS[data[at:to]]
        heads, doc = text_heads(ends, at, to)
        after = _NEXT[_BETWEEN][kind]
        before = np.empty_like(after)
        before[1:] = after[:-1]
        before[heads] = _BETWEEN  # pieces too begin between words
        put = _OUT.ravel()[before * np.uint8(5) + kind]
        for name, bit in (("n_capitals", _IS_CAPITAL), ("n_symbols", _IS_SYMBOL), ("n_points", _IS_POINT)):
            out[name][doc] += np.add.reduceat((put & bit) != 0, heads, dtype=np.int64)
        start = np.flatnonzero(put & _BEGINS)
        _, size = runs(after != _BETWEEN, heads)
        owner = doc[np.searchsorted(heads, start, "right") - 1]
        out["n_words"] += np.bincount(owner, minlength=docs)
        spans.add(start + at, size, owner)
        spans.keep_distinct()
        last = spans.doc == doc[-1]  # only the last text can go on in the next piece
        out["n_distinct"] += np.bincount(spans.doc[~last], minlength=docs)
        for name in ("start", "size", "doc", "head", "hash"):
            setattr(spans, name, getattr(spans, name)[last])
        at = to
    out["n_distinct"] += np.bincount(spans.doc, minlength=docs)
    return out


def measure(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """(doc_id, part, digest, place, n_words, n_distinct, n_capitals, n_symbols, n_points) of each row.

    ``place`` counts the rows of a task; it only serves to deal out rows without an id.
    """
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, part string, digest binary, place long, n_words long, n_distinct long, n_capitals long, n_symbols long, n_points long"
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"), body.alias("text"))

    def make():
        seen = 0

        def step(batch):
            nonlocal seen
            texts = batch.column("text")
            data, ends = buffer_of(texts)
            place = np.arange(seen, seen + len(texts))
            seen += len(texts)
            return {c: batch.column(c) for c in ("doc_id", "part", "digest")} | {"place": place} | measured(data, ends)

        return step

    return map_batches(rows, schema, make, rows=4096, by="text")


def rules() -> dict[str, Column | None]:
    """The failure conditions by letter, over the columns of :func:`measure`; None stands for a text equal to that of a smaller id."""
    return {
        "A": F.col("n_words") < 200,
        "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"),
        "C": 100 * F.col("n_capitals") > 3 * F.col("n_points"),
        "D": F.col("n_symbols") > 0,
        "E": None,
    }


def failing(rows: DataFrame, labels: DataFrame, conditions: dict[str, Column | None]) -> DataFrame:
    """(part, fails, n, good, toxic): rows, good ones and toxic ones by part and the letters of the filters that they fail.

    ``labels`` has doc_id, quality and toxic.
    """
    own = [F.when(c, k) for k, c in conditions.items() if c is not None]
    rows = rows.select("doc_id", "part", "digest", F.when(F.col("doc_id").isNull(), F.col("place")).otherwise(0).alias("salt"), F.concat_ws("", *own).alias("fails"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).withColumn("salt", F.lit(0).cast("long"))
    no = F.lit(False)
    rows = rows.join(known, ["doc_id", "salt"], "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    kinds = ["part", "fails", "good", "toxic"]
    copies = [k for k, c in conditions.items() if c is None]
    if copies:
        by_id = rows.groupBy("doc_id", "salt", "digest", *kinds).agg(F.count("*").alias("n"))
        lead = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
        by_text = by_id.groupBy("digest", *kinds).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n"))).alias("named"), lead.alias("lead"))
        # rows of a text here: one for each part, label and (the same for all) failed filters
        least = F.min("lead.doc_id").over(Window.partitionBy("digest"))
        repeats = F.coalesce(F.col("named") - F.when(F.col("lead.doc_id") == least, F.col("lead.n")).otherwise(0), F.lit(0))
        both = F.array(F.struct(F.lit("").alias("more"), (F.col("n") - F.col("repeats")).alias("n")), F.struct(F.lit("".join(copies)).alias("more"), F.col("repeats").alias("n")))
        rows = by_text.withColumn("repeats", repeats).select("part", "good", "toxic", "fails", F.inline(both)).select("part", F.concat("fails", "more").alias("fails"), "good", "toxic", "n")
    else:
        rows = rows.withColumn("n", F.lit(1).cast("long"))
    given = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return rows.groupBy("part", "fails").agg(F.sum("n").alias("n"), given("good").alias("good"), given("toxic").alias("toxic"))


def audit(counted: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order of the filters and step, from the rows of :func:`failing`.

    kept and removed are after and at the step, redundant rows fail its filter but were
    removed before, unique_fails fail no other filter; good_lost and toxic_lost are of the
    removed; shapley is what the filter removes, summed over all orders (divided by
    their number, its Shapley value).
    """
    orders = F.array(*(F.lit("".join(p)) for p in permutations(letters)))
    steps = counted.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    steps = steps.withColumns({"filter": F.expr("substring(filter_order, step, 1)"), "before": F.expr("substring(filter_order, 1, step - 1)")})
    alive, fails = F.expr("translate(before, fails, '') = before"), F.contains("fails", "filter")
    number = lambda when, c: F.sum(F.when(when, F.col(c)).otherwise(0)).alias
    out = steps.groupBy("part", "filter_order", "step", "filter").agg(
        number(alive & ~fails, "n")("kept"),
        number(alive & fails, "n")("removed"),
        number(~alive & fails, "n")("redundant"),
        number(F.col("fails") == F.col("filter"), "n")("unique_fails"),
        number(alive & fails, "good")("good_lost"),
        number(alive & fails, "toxic")("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")
