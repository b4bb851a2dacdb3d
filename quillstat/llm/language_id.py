"""Language identification by rank-order profiles of character n-grams.

A language's profile is its most frequent letter n-grams (one to three
characters, a blank standing for whatever separates words) in order of
frequency.  A document's most frequent n-grams are ranked the same way, and the
language with the least out-of-place distance is predicted: the sum over the
document's n-grams of the difference between the two ranks, or the profile
length where the profile lacks the n-gram.  N-grams that no profile has add the
same to every language, so documents are ranked over those that some profile
has.

Profiles are learned from at most about ``max_train`` labelled rows of each
language, chosen by a hash of the row so that the choice does not depend on the
partitioning and copies of a text are not chosen together; every document is
scored over its whole text.

Defined results: null texts and texts without a letter are ``und`` with score 0;
letters of no profile give the most frequent language of the profiles with score 0;
equal distances go to the more frequent language; rows with a null language teach
nothing; with nothing to learn from every text is ``und``; repeated rows repeat
their result; an empty table gives an empty result; a very long text takes memory
of some times its size; input columns named as a result column are replaced.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstat.llm.common import bounded, map_batches, portions

ROWS, CHARS = 128, 1 << 20
BITS = 21  # of a code point


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter; found once by each worker."""
    table = np.zeros(0x110000, bool)
    table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return table


def grams(texts: list[str], letter: np.ndarray):
    """(document, code) of each n-gram, one array pair for each length; and whether each text has a letter.

    A code packs up to three code points, 32 for a separator.
    """
    low = [f" {t.lower()} " if t else "  " for t in texts]
    sizes = np.array([len(t) for t in low])
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter[points]
    c = np.where(is_letter, points, 32).astype(np.uint64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    b = np.uint64(BITS)
    two = c[:-1] | c[1:] << b
    three = two[:-1] | c[2:] << (b + b)
    some = np.zeros(len(texts), bool)
    some[doc[is_letter]] = True
    ok2, ok3 = is_letter[:-1] | is_letter[1:], is_letter[1:-1]
    return [(doc[is_letter], c[is_letter]), (doc[:-1][ok2], two[ok2]), (doc[:-2][ok3], three[ok3])], some


def spell(code: int) -> str:
    mask = (1 << BITS) - 1
    return "".join(chr(p) for p in (code & mask, code >> BITS & mask, code >> 2 * BITS & mask) if p)


def pack(gram: str) -> int:
    return sum(ord(ch) << BITS * i for i, ch in enumerate(gram))


def profiles(train: DataFrame, size: int = 300, max_train: int = 5_000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n, rank) of each language, ranks from 0, ties in the order of the n-grams."""
    others = [F.col(f"`{c}`").cast("string") for c in train.columns if c not in (text, lang)]
    rows = train.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"), F.xxhash64(F.lit(0), *others).alias("row")).where("text is not null and lang is not null")
    rows = bounded(rows, "lang", max_train).select("text", "lang")

    def make():
        letter = letters()

        def step(batch):
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = {"lang": [], "gram": [], "n": []}
            for name in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == name]
                seen: dict[int, int] = {}
                for at in range(0, len(own), ROWS):
                    for _, codes in grams(own[at : at + ROWS], letter)[0]:
                        for code, n in zip(*(x.tolist() for x in np.unique(codes, return_counts=True)), strict=True):
                            seen[code] = seen.get(code, 0) + n
                out["lang"] += [name] * len(seen)
                out["gram"] += map(spell, seen)
                out["n"] += seen.values()
            return out

        return step

    counts = map_batches(rows, "lang string, gram string, n bigint", make).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < size)


class Ranks:
    """Profiles as arrays, for use inside a task."""

    def __init__(self, rows: list[tuple[str, str, int, int]], size: int) -> None:
        weight: dict[str, int] = {}
        joint: dict[int, int] = {}
        for lang, gram, n, _ in rows:
            weight[lang] = weight.get(lang, 0) + n
            joint[pack(gram)] = joint.get(pack(gram), 0) + n
        self.size = size
        self.langs = sorted(weight, key=lambda x: (-weight[x], x))
        #: All n-grams of the profiles, the most frequent first.
        self.codes = np.array(sorted(joint, key=lambda x: (-joint[x], x)), np.uint64)
        place = {int(c): i for i, c in enumerate(self.codes)}
        self.rank = np.full((len(self.codes) + 1, len(self.langs)), size, np.int32)
        column = {x: i for i, x in enumerate(self.langs)}
        for lang, gram, _, rank in rows:
            self.rank[place[pack(gram)], column[lang]] = rank
        self.absent = self.rank >= size
        self.order = np.argsort(self.codes)
        self.sorted = self.codes[self.order]
        # a table by hash that tells most other n-grams apart without a search
        self.shift = np.uint64(44)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.slot(self.codes)] = True

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def predict(self, texts: list[str], letter: np.ndarray) -> list[tuple[str, float]]:
        found, some = grams(texts, letter)
        k = len(self.codes)
        if not k:
            return [("und", 0.0)] * len(texts)
        counts = np.zeros(len(texts) * k, np.int64)
        for doc, codes in found:
            keep = self.maybe[self.slot(codes)]
            doc, codes = doc[keep], codes[keep]
            at = np.minimum(np.searchsorted(self.sorted, codes), k - 1)
            hit = self.sorted[at] == codes
            counts += np.bincount(doc[hit] * k + self.order[at[hit]], minlength=len(counts))
        counts = counts.reshape(len(texts), k)
        top = np.argsort(-counts, axis=1, kind="stable")[:, : self.size]
        live = np.take_along_axis(counts, top, 1) > 0
        away = np.abs(self.rank[top] - np.arange(top.shape[1])[None, :, None])
        away[self.absent[top]] = self.size
        away[~live] = 0
        n = live.sum(1)
        distance = away.sum(1)
        best = distance.argmin(1)
        out = []
        for d in range(len(texts)):
            if not some[d]:
                out.append(("und", 0.0))
            else:
                score = 1 - distance[d, best[d]] / (self.size * n[d]) if n[d] else 0.0
                out.append((self.langs[best[d]], float(min(1.0, max(0.0, score)))))
        return out


def identify(docs: DataFrame, learned: DataFrame, size: int = 300, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``lang_pred`` and ``score``.

    ``learned`` is the result of :func:`profiles`; its size is the number of
    languages times ``size`` and does not grow with the documents.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(Ranks([tuple(r) for r in learned.select("lang", "gram", "n", "rank").collect()], size))
    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "score") and c != text]
    source = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("__text"))

    def make():
        letter = letters()

        def step(batch):
            texts = batch.column(len(keep))
            rows = []
            for _, own in portions(texts, ROWS, CHARS):
                rows += ranks.value.predict([t or "" for t in own], letter)
            return {c: batch.column(i) for i, c in enumerate(keep)} | {"lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows]}

        return step

    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text"]
    return map_batches(source, ", ".join([*ddl, "lang_pred string, score double"]), make)
