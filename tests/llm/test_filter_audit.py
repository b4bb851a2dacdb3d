"""The filter interaction audit against brute force."""

import random
import re
from itertools import permutations

import numpy as np
import pytest

from quillstat.llm import filter_audit
from quillstat.llm.filter_audit import audit, failing, measure, measured, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "a", "Ünï cödé É", "x" * 5000, "日本語　テスト", "y" * 70 + " " + "y" * 70 + " " + "y" * 69 + "z", "\x00\x1c\x85 A#|", "abcdefgh abcdefgi abcdefgh", "abcdefghijkl abcdefghijkm abcdefghijkl", "word " * 300, "w1 w2"]


def arrays(texts):
    parts = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])


@pytest.mark.parametrize("piece", [7, 64, 1 << 22])
def test_measured_is_that_of_regular_expressions(monkeypatch, piece):
    monkeypatch.setattr(filter_audit, "PIECE", piece)
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab  \nC#é語") for _ in range(rng.randrange(200))) for _ in range(60)]
    got = measured(*arrays(texts))
    for k, t in enumerate(texts):
        t = t or ""
        words = WORD.findall(t)
        want = [len(words), len(set(words)), len(re.findall("[A-Z]", t)), len(re.findall(r"[#$%&*|]", t)), len(t)]
        assert [got[c][k] for c in ("n_words", "n_distinct", "n_capitals", "n_symbols", "n_points")] == want


def test_colliding_hashes_are_told_apart(monkeypatch):
    add = filter_audit.Spans.add

    def flat(self, *args):
        add(self, *args)
        self.hash[:] = self.hash & np.uint64(3 << 62)

    monkeypatch.setattr(filter_audit.Spans, "add", flat)
    got = measured(*arrays(["a b c a d e f a", "a a b", " ".join(f"longer-word-number-{i % 50}" for i in range(200))]))
    assert list(got["n_distinct"]) == [6, 2, 50]


def brute(rows, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    out = {}
    facts = []
    for i, t, lang in rows:
        t = t or ""
        words = WORD.findall(t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        facts.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                shapley[x] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(x in f[1] for f in own) - len(gone), sum(f[1] == {x} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                out[part, order, step].append(shapley[x])
    return out


def test_audit_is_that_of_every_order(spark):
    rng = random.Random(5)
    clean = " ".join(f"w{i}" for i in range(250))
    texts = ODD + [clean, clean, clean + " #", "A" * 50 + " " + clean, " ".join(["w", "v"] * 150), clean, None, ""]
    rows = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    rows += [(3, "a", "en"), (3, "a", "de"), (None, clean, "en"), (None, "a", None), (-1, "word " * 300, "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(len(texts))] + [(3, 1, 0), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, lang string, part string, n_words int").repartition(3)
    labels_df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = audit(failing(measure(docs), labels_df, rules()), "ABCDE").collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in found} == brute(rows, labels)
    nothing = docs.where("false")
    assert audit(failing(measure(nothing), labels_df, rules()), "ABCDE").count() == 0
    fewer = {k: v for k, v in rules().items() if k in "AC"}
    assert audit(failing(measure(docs), labels_df, fewer), "AC").count() == 4 * len({r[2] or "" for r in rows})


def test_a_very_long_text(spark):
    rng = random.Random(6)
    text = " ".join(f"w{rng.randrange(40_000)}" for _ in range(2_000_000)) + " B"
    got = measured(*arrays(["", text, "a b"]))
    words = text.split(" ")
    assert (got["n_words"][1], got["n_distinct"][1], got["n_points"][1], got["n_words"][2]) == (len(words), len(set(words)), len(text), 2)
