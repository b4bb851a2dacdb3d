"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is logistic in the words
it holds, the document's score is the noisy-or of its sentences' scores,
``1 - prod(1 - p)``, and the weights are trained from document labels alone, by
gradient steps on the noisy-or likelihood.  The sentence scores then locate the
offending sentences.

What has weights are words and the first three, four and five letters of words
(insults are inflected): the ``size`` of them (1,000) whose document frequencies
differ most between the labels (by the G statistic), ties in their order, of those in
``min_docs`` (5) documents at least.  Training takes a bounded sample of labelled rows,
of each label about ``max_train`` (10,000) and ``max_chars`` characters (50 million),
chosen by a hash of the row; what of it reaches the driver are the numbers of the
known marks of each sentence.  Every document is scored over all its sentences.

Defined results: null and empty texts have no sentence and score 0; repeated
rows repeat their score; rows with a null label or text teach nothing; without
rows of both labels every score is the share of label 1 (0 with no labels); an empty
table gives an empty result; a very long text is scored sentence by sentence; input
columns named as a result column are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.llm.common import bounded, map_batches

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"[^\W\d_]+")


#: Lengths of word beginnings that are marks of a sentence besides its words.
STEMS = (3, 4, 5)
CACHE = 200_000


def marks(word: str) -> list[str]:
    return [word, *(word[:n] + "~" for n in STEMS if len(word) > n)]


class Marks:
    """The known marks of words by number, remembered for use inside a task."""

    def __init__(self, index: dict[str, int]) -> None:
        self.index, self.known = index, {}

    def of(self, sentence: str) -> set[int]:
        """The known marks of a lower-cased sentence."""
        out: set[int] = set()
        known = self.known
        for w in WORD.findall(sentence):
            own = known.get(w)
            if own is None:
                if len(known) > CACHE:
                    known.clear()
                own = known[w] = tuple(self.index[m] for m in marks(w) if m in self.index)
            if own:
                out.update(own)
        return out


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    share: float | None = None


def sample(labelled: DataFrame, label: str, text: str, max_train: int, max_chars: int) -> DataFrame:
    others = [F.col(f"`{c}`").cast("string") for c in labelled.columns if c not in (text, label)]
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{label}`").cast("int").alias("label"), F.xxhash64(F.lit(0), *others).alias("row")).where("text is not null and label in (0, 1)")
    return bounded(rows.withColumn("chars", F.length("text")), "label", max_train, "chars", max_chars).select("text", "label")


def vocabulary(rows: DataFrame, size: int, min_docs: int) -> DataFrame:
    """(word, g) of the ``size`` marks whose share of documents differs most between the labels."""

    def make():
        def step(batch):
            counts: dict[str, list[int]] = {}
            for body, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for m in {m for w in set(WORD.findall(body.lower())) for m in marks(w)}:
                    counts.setdefault(m, [0, 0])[y] += 1
            return {"word": [*counts], "n0": [c[0] for c in counts.values()], "n1": [c[1] for c in counts.values()]}

        return step

    totals = rows.agg(F.sum(1 - F.col("label")).alias("t0"), F.sum("label").alias("t1")).first()
    t0, t1 = float(totals["t0"] or 0), float(totals["t1"] or 0)
    counts = map_batches(rows.select("text", "label"), "word string, n0 bigint, n1 bigint", make).groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n = F.col("n0") + F.col("n1")

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    g = F.lit(0.0)
    for own, total in (("n0", t0), ("n1", t1)):
        expected = n * total / (t0 + t1)
        g = g + part(F.col(own).cast("double"), expected) + part(total - F.col(own), total - expected)
    return counts.where(n >= min_docs).select("word", (2 * g).alias("g")).orderBy(F.desc("g"), "word").limit(size)


def train(labelled: DataFrame, label: str, text: str = "text", size: int = 1000, min_docs: int = 5, max_train: int = 10_000, max_chars: int = 50_000_000, steps: int = 300, rate: float = 0.1, ridge: float = 2e-5) -> Model:
    rows = sample(labelled, label, text, max_train, max_chars)
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(n) < 2:
        return Model({}, 0.0, float(next(iter(n), 0)))
    words = sorted(r["word"] for r in vocabulary(rows, size, min_docs).collect())
    index = {w: i for i, w in enumerate(words)}

    def make():
        known = Marks(index)

        def step(batch):
            out = {"label": batch.column(1), "sentences": [], "lengths": [], "ids": []}
            for body in batch.column(0).to_pylist():
                bags = [sorted(known.of(s)) for s in SENTENCE.findall(body.lower())]
                out["sentences"].append(len(bags))
                out["lengths"].append([len(b) for b in bags if b])
                out["ids"].append([i for b in bags for i in b])
            return out

        return step

    bags = map_batches(rows.select("text", "label"), "label int, sentences int, lengths array<int>, ids array<int>", make).collect()
    bags.sort(key=lambda r: (r["label"], r["sentences"], r["ids"]))  # the same sums however the rows came in
    y = np.array([r["label"] for r in bags], float)
    lengths = np.concatenate([np.array(r["lengths"], np.int64) for r in bags])
    ids = np.concatenate([np.array(r["ids"], np.int64) for r in bags])
    doc = np.repeat(np.arange(len(bags)), [len(r["lengths"]) for r in bags])
    sentence = np.repeat(np.arange(len(lengths)), lengths)
    plain = np.array([r["sentences"] - len(r["lengths"]) for r in bags], float)  # sentences with none of the words
    w, b = np.zeros(len(words)), -4.0
    m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for t in range(1, steps + 1):
        z = np.bincount(sentence, w[ids], len(lengths)) + b
        # -log(1 - p) of a sentence is softplus(z); a document's is the sum
        s = np.bincount(doc, np.logaddexp(0, z), len(bags)) + plain * np.logaddexp(0, b)
        # the slope of the log-likelihood in s: -1 for label 0, exp(-s) / (1 - exp(-s)) for label 1
        slope = np.where(y == 1, 1 / np.expm1(np.maximum(s, 1e-9)), -1.0) / len(bags)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        each = slope[doc] * p
        grad = np.r_[np.bincount(ids, each[sentence], len(words)) - ridge * w, each.sum() + (slope * plain).sum() / (1 + np.exp(-b))]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w + move[:-1], b + move[-1]
    return Model({x: float(k) for x, k in zip(words, w, strict=True)}, float(b))


def score(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``score``, ``predicted`` and ``offending``.

    ``offending`` holds the begin and end (code points) and the score of each
    sentence that reaches ``threshold``.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c.lower() not in ("score", "predicted", "offending") and c != text]
    source = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("__text"))

    def make():
        m = held.value
        names = sorted(m.weights)
        weight = [m.weights[n] for n in names]
        known = Marks({n: i for i, n in enumerate(names)})
        plain = float(np.logaddexp(0, m.bias))

        def one(body):
            total, found = 0.0, []
            for hit in SENTENCE.finditer(body):
                own = sorted(known.of(hit[0].lower()))
                s = float(np.logaddexp(0, m.bias + sum(weight[i] for i in own))) if own else plain
                total += s
                if 1 - np.exp(-s) >= threshold:
                    found.append({"begin": hit.start(), "end": hit.end(), "score": float(1 - np.exp(-s))})
            return float(-np.expm1(-total)), found

        def step(batch):
            rows = [(m.share, []) if m.share is not None else one(b.as_py() or "") for b in batch.column(len(keep))]
            return {c: batch.column(i) for i, c in enumerate(keep)} | {"score": [r[0] for r in rows], "predicted": [int(r[0] >= threshold) for r in rows], "offending": [r[1] for r in rows]}

        return step

    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text"]
    return map_batches(source, ", ".join([*ddl, "score double, predicted int, offending array<struct<begin:int,end:int,score:double>>"]), make)
