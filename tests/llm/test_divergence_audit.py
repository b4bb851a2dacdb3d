"""The source divergence audit against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from quillstat.llm import divergence_audit
from quillstat.llm.divergence_audit import Counts, counted, counted_long, divergence, radix_order, shares

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " 12 _ ", "a", "Ünï cödé É", "x" * 5000, "日本語　テスト", "abcdefgh abcdefghi ABCDEFGHIJKLMNOP abcdefghijklmnopq", "z" * 300 + "-" + "z" * 300 + "1" + "z" * 299, "\x00\x1c\x85"]


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def arrays(texts):
    parts = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])


def found(parts):
    return {(int(g), t): (int(n), int(d)) for c in parts.values() for g, t, n, d in zip(c.group, c.terms().to_pylist(), c.n, c.docs, strict=True)}


def want(texts, groups):
    n, docs = Counter(), Counter()
    for t, g in zip(texts, groups, strict=True):
        own = Counter(terms(t))
        n.update({(g, x): k for x, k in own.items()})
        docs.update((g, x) for x in own)
    return {k: (n[k], docs[k]) for k in n}


def test_radix_order_is_stable():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 500).astype(np.uint64) & np.uint64(0xF000F0000000000F)
    assert (radix_order([keys]) == np.argsort(keys, kind="stable")).all()
    second = rng.integers(0, 3, 500).astype(np.uint32)
    assert (radix_order([second, keys]) == np.lexsort([second, keys])).all()


def test_counts_are_those_of_regular_expressions():
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("aB  1éc語") for _ in range(rng.randrange(150))) for _ in range(80)] + ["same words", "same words"]
    groups = [rng.randrange(5) for _ in texts]
    data, ends = arrays(texts)
    parts = counted(data, ends, np.array(groups, np.uint32))
    assert found(parts) == want(texts, groups)
    twice = {k: Counts.merged([c, c]) for k, c in parts.items()}
    assert found(twice) == {k: (2 * n, 2 * d) for k, (n, d) in want(texts, groups).items()}


@pytest.mark.parametrize("piece", [5, 50, 1 << 22])
def test_a_long_text_is_one_document(monkeypatch, piece):
    monkeypatch.setattr(divergence_audit, "PIECE", piece)
    rng = random.Random(3)
    text = " ".join(rng.choice(["alpha", "a", "é" * 9, "q" * 40, "longer" * 3]) for _ in range(300))
    assert found(counted_long(arrays([text])[0], np.array([7], np.uint32))) == want([text], [7])


def test_shares_are_exact():
    counts = np.array([0, 5, 10**13, 9 * 10**14])
    total = 9 * 10**15
    assert list(shares(counts, np.array(total), 10**9)) == [1 + 10**9 * (int(c) + 1) // total for c in counts]
    assert list(shares(np.array([9]), np.array(10), 10**9)) == [10**9 + 1]
    assert list(shares(np.array([3]), np.array(7), 50)) == [1 + 50 * 4 // 7]


def brute(rows, min_docs=3, top=200, scale=10**9):
    rows = [(t, lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [(Counter(terms(t)), s) for t, x, s in rows if x == lang]
        docs = Counter(w for c, _ in own for w in c)
        kept = [w for w in docs if docs[w] >= min_docs]
        by = {s: sum((c for c, x in own if x == s), Counter()) for s in {s for _, s in own}}
        whole = sum(by.values(), Counter())

        def share(c):
            total = sum(c[w] for w in kept) + len(kept)
            return {w: 1 + scale * (c[w] + 1) // total for w in kept}

        p, q = {s: share(c) for s, c in by.items()}, share(whole)
        for s in by:
            pairs = sorted((-sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o) for o in by if o != s)
            own_terms = sorted((-((p[s][w] - q[w]) ** 2 // q[w]), w.encode(), w) for w in kept if by[s][w] and p[s][w] > q[w])[:top]
            out += [(lang, s, "pair", o, -v, k) for k, (v, o) in enumerate(pairs, 1)] + [(lang, s, "term", w, -v, k) for k, (v, _, w) in enumerate(own_terms, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def test_divergence_is_that_of_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    words = ["alpha", "beta", "Gamma", "é", "语言", "b" * 12, "c" * 20, "d" * 70, *(f"w{chr(97 + k)}" for k in range(20))]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None, ""])) for _ in range(60)]
    rows += [(t, "odd", f"o{k % 3}") for k, t in enumerate(ODD)] + [(None, "none", "x"), ("only one", "none", "y")] + rows[:5]
    docs = spark.createDataFrame([(*r, 1, 2.0, "clash") for r in rows], "text string, lang string, source string, l int, n double, term string").repartition(3)
    assert rows_of(divergence(docs)) == brute(rows)
    monkeypatch.setattr(divergence_audit, "ROWS", 2)  # the sources of a language in several blocks
    assert rows_of(divergence(docs, min_docs=1, top=3)) == brute(rows, 1, 3)
    assert divergence(docs.where("false")).count() == 0
