"""Quality classifier by compression.

Pairs of zstandard dictionaries are built, from pieces of good and of bad labelled
texts; what a dictionary holds varies with the order of its pieces, so there are
``PAIRS`` of them, in as many orders, and differences are their means.  A text is compressed piece by piece with either, so that the dictionaries
count for all of a long text: what compresses better with the good dictionary looks
good.  The difference of the two sizes, normalised by their sum and by the length of
the text, is calibrated to a probability by a logistic regression on labelled rows
that the dictionaries have not seen.  Nothing else enters a score.

Training takes bounded samples of the labelled rows, chosen by hashes: about
``dict_bytes`` bytes of pieces for each dictionary and about ``max_calibration``
rows of each label for the calibration.  Every document is scored whole.

Defined results: null and empty texts are scored as the empty text; repeated
rows repeat their score, and so do texts with the same sizes; rows with a null label
or text teach nothing; without rows of both labels every score is the share of label
1, or 0.5 with no labels; an empty table gives an empty result; a very long text is
compressed piece by piece; input columns named as a result column are replaced.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.llm.common import bounded, map_batches

PIECE, SCORED = 2048, 512  # bytes of a piece to learn from, and of one to score
LEVEL = 3
PAIRS = 4


@dataclass
class Model:
    pairs: list[tuple[bytes, bytes]]  # of the good and of the bad
    raw: bool
    weights: np.ndarray | None
    mean: np.ndarray | None
    scale: np.ndarray | None
    share: float


class Sizes:
    """Features of texts from their compressed sizes, for use inside a task."""

    def __init__(self, model: Model) -> None:
        import zstandard as z

        kind = z.DICT_TYPE_RAWCONTENT if model.raw else z.DICT_TYPE_AUTO
        self.pairs = [[z.ZstdCompressor(level=LEVEL, dict_data=z.ZstdCompressionDict(d, dict_type=kind), write_content_size=False, write_dict_id=False) for d in pair] for pair in model.pairs]

    def features(self, text: str | None) -> tuple[float, float]:
        """The difference of the sizes over their sum, and over the length."""
        data = (text or "").encode("utf-8", "surrogatepass")
        pieces = [data[at : at + SCORED] for at in range(0, len(data), SCORED)] or [b""]
        sizes = [[sum(len(c.compress(p)) for p in pieces) for c in pair] for pair in self.pairs]
        n = len(sizes)
        return sum((g - b) / (g + b) for g, b in sizes) / n, sum(g - b for g, b in sizes) / n / (len(data) + 1)


FEATURES = 2


def _dictionary(pieces: list[bytes], size: int) -> tuple[bytes, bool]:
    """A trained dictionary, or the pieces themselves where they are too few to train on."""
    import zstandard as z

    try:
        return z.train_dictionary(size, pieces).as_bytes(), False
    except z.ZstdError:
        return b"".join(pieces)[-size:] or b"\0" * 8, True


def train(labelled: DataFrame, label: str, text: str = "text", dict_size: int = 65_536, dict_bytes: int = 4_000_000, max_calibration: int = 20_000) -> Model:
    """The model of rows with ``text`` and a 0/1 ``label``."""
    t = F.col(f"`{text}`")
    others = [F.col(f"`{c}`").cast("string") for c in labelled.columns if c not in (text, label)]
    rows = labelled.select(t.alias("text"), F.col(f"`{label}`").cast("int").alias("label"), F.xxhash64(F.lit(0), *others).alias("row")).where("text is not null and label in (0, 1)")
    # half of the texts, by hash, build dictionaries; the others, none of them a copy, calibrate
    rows = rows.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)))
    have = {(r["label"], r["half"]): (r["n"], r["bytes"]) for r in rows.groupBy("label", "half").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()}
    n = [sum(v[0] for k, v in have.items() if k[0] == y) for y in (0, 1)]
    share = n[1] / sum(n) if sum(n) else 0.5
    if not all(n) or not all((y, h) in have for y in (0, 1) for h in (0, 1)):
        return Model([], False, None, None, None, share)
    part = {y: min(1.0, dict_bytes / max(1, have[y, 0][1])) for y in (0, 1)}

    def cut_pieces():
        def step(batch):
            out = {"label": [], "piece": []}
            for body, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = body.encode("utf-8", "surrogatepass")
                for at in range(0, len(data), PIECE):
                    piece = data[at : at + PIECE]
                    if zlib.crc32(piece) < part[y] * 2**32:
                        out["label"].append(y)
                        out["piece"].append(piece)
            return out

        return step

    sample = map_batches(rows.where("half = 0").select("text", "label"), "label int, piece binary", cut_pieces).collect()
    pieces = {y: [bytes(r["piece"]) for r in sample if r["label"] == y] for y in (0, 1)}
    pairs, raw = [], False
    for k in range(PAIRS):
        # orders that mix texts: a dictionary is chosen from one stretch of the pieces after another
        own = [sorted(pieces[y], key=lambda p: (zlib.crc32(p, k), p)) for y in (1, 0)]
        (good, raw1), (bad, raw0) = (_dictionary(p, dict_size) for p in own)
        raw = raw or raw1 or raw0
        pairs.append((good, bad))
        if raw:  # all of one kind
            pairs = [tuple(b"".join(p)[-dict_size:] or b"\0" * 8 for p in own)]
            break
    model = Model(pairs, raw, None, None, None, share)
    held = labelled.sparkSession.sparkContext.broadcast(model)
    fit = bounded(rows.where("half = 1"), "label", max_calibration)

    def measure():
        sizes = Sizes(held.value)

        def step(batch):
            return {"label": batch.column(1), "x": [sizes.features(b) for b in batch.column(0).to_pylist()]}

        return step

    seen = map_batches(fit.select("text", "label"), "label int, x array<double>", measure).collect()
    x, y = np.array([r["x"] for r in seen]).reshape(-1, FEATURES), np.array([r["label"] for r in seen], float)
    order = np.lexsort(x.T)  # the same sums however the rows came in
    x, y = x[order], y[order]
    if not len(y) or y.min() == y.max():
        return Model([], False, None, None, None, share)
    model.mean, model.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    model.weights = _logistic(np.c_[np.ones(len(x)), (x - model.mean) / model.scale], y)
    return model


def _logistic(a: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 100) -> np.ndarray:
    """Newton's method, steps being halved while they lose."""
    loss = lambda w: np.logaddexp(0, a @ w).sum() - y @ (a @ w) + 0.5 * ridge * w @ w
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a.T * (p * (1 - p) + 1e-6)) @ a + ridge * np.eye(len(w))
        move = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        while loss(w + move) > loss(w) and np.abs(move).max() > 1e-9:
            move /= 2
        w += move
        if np.abs(move).max() < 1e-9:
            break
    return w


def score(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``score`` (the probability of label 1) and ``predicted``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c.lower() not in ("score", "predicted") and c != text]
    source = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("__text"))

    def make():
        m = held.value
        sizes = Sizes(m) if m.weights is not None else None

        def step(batch):
            bodies = batch.column(len(keep))
            if sizes is None:
                p = np.full(len(bodies), m.share)
            else:
                x = np.array([sizes.features(b.as_py()) for b in bodies]).reshape(-1, FEATURES)
                p = 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(x)), (x - m.mean) / m.scale] @ m.weights, -30, 30)))
            return {c: batch.column(i) for i, c in enumerate(keep)} | {"score": p, "predicted": (p >= threshold).astype(np.int32)}

        return step

    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text"]
    return map_batches(source, ", ".join([*ddl, "score double, predicted int"]), make)
