"""Benchmark decontamination by a broadcast set of normalised n-grams.

Texts are lower-cased (A-Z only) and cut into words of ASCII letters, digits
and characters beyond ASCII.  A window is ``n`` consecutive words of a
benchmark item; an item with fewer words is one window.  The windows' hashes
are broadcast, every document's word windows are looked up in them, hits are
verified word by word, and all words inside an occurring window count as hit.

What is broadcast grows with the benchmark, so its size is checked first: a
benchmark of more than ``block_chars`` characters is dealt into blocks by hash
and the documents are scanned against one block after another, each scan adding
to the hits of the former ones.  The result is the same for any block size.

Defined results: null texts have no words; null item ids count as the empty id;
rows of one item id are one item; repeated documents repeat their result; an
empty benchmark hits nothing; no documents give an empty result; a very long text is
scanned whole, in memory of some times its size; input columns named as a result
column of a scan are replaced, those of what is left after removals all stay.
"""

from __future__ import annotations

import math
import re
from itertools import chain, repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.llm.common import lowered, map_batches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ROWS = 128
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    if not text:
        return []
    return WORD.findall(lowered(text))


class Windows:
    """The windows of one block of items: a vocabulary, and hashes by window length."""

    def __init__(self, items: list[tuple[str, str]], n: int) -> None:
        vocabulary: dict[str, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
            size = min(n, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                windows.setdefault(tuple(ids[i : i + size]), set()).add(item)
        self.vocabulary = vocabulary
        self.by_size = {}
        for size in sorted({len(w) for w in windows}):
            own = [w for w in windows if len(w) == size]
            rows = np.array(own, np.int32)
            hashes = self.hash(rows)
            order = np.argsort(hashes, kind="stable")
            self.by_size[size] = hashes[order], rows[order], [sorted(windows[own[i]]) for i in order]

    @staticmethod
    def hash(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for j in range(rows.shape[1]):
            h = (h ^ rows[:, j].astype(np.uint64)) * _STEP
            h ^= h >> np.uint64(29)
        return h

    def find(self, ids: np.ndarray):
        """(position, size, items) of every window that occurs; 0 in ``ids`` is a word of no window."""
        zeros = np.concatenate([[0], np.cumsum(ids == 0)])
        for size, (hashes, rows, items) in self.by_size.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(zeros[size:] == zeros[:-size])
            for part in range(0, len(at), 1 << 16):
                pos = at[part : part + (1 << 16)]
                seen = ids[pos[:, None] + np.arange(size)]
                h = self.hash(seen)
                first, last = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
                for k in np.flatnonzero(first < last):
                    for j in range(first[k], last[k]):
                        if np.array_equal(rows[j], seen[k]):
                            yield int(pos[k]), size, items[j]


def _merge(spans: list[tuple[int, int]]) -> list[int]:
    """Disjoint intervals [a, b) as a flat list."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 13, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = 2_000_000, within: str | None = None) -> DataFrame:
    """``docs`` with what of the benchmark occurs in ``text``, with ``within`` a field of that struct.

    Adds ``n_words``, ``n_hit`` (words inside occurring windows), ``items``
    (ids of the items with occurring windows, sorted as strings) and ``spans``
    (flat array of begins and ends, in code points, of the runs of hit words).
    """
    added = ["n_words", "n_hit", "items", "spans"]
    keep = [c for c in docs.columns if c.lower() not in added]
    out = docs.select(*(F.col(f"`{c}`") for c in keep))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    schema += ", n_words bigint, n_hit bigint, items array<string>, spans array<int>"
    source = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("words"))
    size = source.agg(F.sum(F.length("words"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_chars))
    where = keep.index(within or text)
    field = docs.schema[within].dataType.names.index(text) if within else None
    for k in range(blocks):
        rows = source if blocks == 1 else source.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k)
        held = docs.sparkSession.sparkContext.broadcast(Windows([tuple(r) for r in rows.collect()], n))

        def make(held=held, later=k > 0):
            windows: Windows = held.value
            get = windows.vocabulary.get

            def step(batch):
                texts = batch.column(where) if field is None else batch.column(where).field(field)
                before = [batch.column(len(keep) + j).to_pylist() for j in (2, 3)] if later else None
                result = {a: [] for a in added}
                for at in range(0, batch.num_rows, ROWS):
                    block = texts.slice(at, ROWS).to_pylist()
                    found = [words(t) for t in block]
                    # one word of no window between documents
                    ids = np.array([*chain.from_iterable(chain(map(get, ws, repeat(0)), (0,)) for ws in found)], np.int32)
                    starts = np.concatenate([[0], np.cumsum([len(ws) + 1 for ws in found])])
                    hits: dict[int, list] = {}
                    for pos, width, items in windows.find(ids):
                        d = int(np.searchsorted(starts, pos, "right")) - 1
                        hits.setdefault(d, []).append((pos - int(starts[d]), width, items))
                    for d, ws in enumerate(found):
                        own = hits.get(d, [])
                        items = {i for _, _, x in own for i in x}
                        spans, places = [(a, a + w) for a, w, _ in own], None
                        if own or (later and before[1][at + d]):
                            places = [m.span() for m in WORD.finditer(lowered(block[d]))]
                        if later and before[1][at + d]:
                            old = before[1][at + d]
                            items.update(before[0][at + d])
                            begins, ends = [p[0] for p in places], [p[1] for p in places]
                            spans += [(int(np.searchsorted(begins, a)), int(np.searchsorted(ends, b)) + 1) for a, b in zip(old[::2], old[1::2], strict=True)]
                        flat = _merge(spans)
                        result["n_words"].append(len(ws))
                        result["n_hit"].append(sum(flat[1::2]) - sum(flat[::2]))
                        result["items"].append(sorted(items))
                        result["spans"].append([places[x][0] if j % 2 == 0 else places[x - 1][1] for j, x in enumerate(flat)])
                return {c: batch.column(i) for i, c in enumerate(keep)} | result

            return step

        out = map_batches(out, schema, make)
    return out


def contaminated(n_hit: Column, n_words: Column, share: int = 20) -> Column:
    """At least one word in ``share`` is hit."""
    return (n_hit > 0) & (n_hit * share >= n_words)


def _whole(docs: DataFrame) -> DataFrame:
    """``docs`` as a struct ``row``: no column of it can clash with what a scan adds, and its text goes to the workers once."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, share: int = 20, text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    found = scan(_whole(docs), benchmark, text=text, within="row", **how)
    return found.where(~contaminated(F.col("n_hit"), F.col("n_words"), share)).select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """All rows of ``docs``, the runs of hit words cut out of ``text``."""
    found = scan(_whole(docs), benchmark, text=text, within="row", **how)
    t, s = F.col("row")[text], F.col("spans")
    gaps = F.sequence(F.lit(0), F.size(s), F.lit(2))
    part = F.transform(gaps, lambda i: F.substring(t, F.when(i == 0, 0).otherwise(F.get(s, i - 1)) + 1, F.coalesce(F.get(s, i), F.length(t)) - F.when(i == 0, 0).otherwise(F.get(s, i - 1))))
    new = F.when(F.size(s) > 0, F.array_join(part, "")).otherwise(t)
    return found.select(*(new.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns))
