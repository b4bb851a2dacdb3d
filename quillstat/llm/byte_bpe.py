"""Byte-level BPE encoding and decoding through a sentencepiece model.

A rank file of a byte-level BPE vocabulary is turned into a sentencepiece BPE
model without training: each byte becomes one printable character, each
vocabulary entry a piece of such characters whose score is its negative rank,
and the normaliser is the identity.  sentencepiece merges the best-scored
neighbours first, leftmost on ties, which is the merge order of the ranks.
Texts are split by the pre-tokenizer pattern and every pre-token is encoded on
its own.

Defined results: a null text encodes as the empty text (no tokens); rows are
independent, so repeated rows repeat their result; an empty table gives an
empty result; input columns are passed on unless their name is one of the
result's.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.llm.common import map_batches

#: Pre-tokens remembered by a task, and their characters, before it starts afresh.
CACHE, CACHE_CHARS = 100_000, 4_000_000
BATCH, ITEMS = 256, 1 << 18  # rows, and bytes or ids of them, that a task holds as Python objects


def byte_characters() -> list[str]:
    """One printable character for each byte value, itself where it is printable."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a file of ``base64 rank`` lines."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    """A protobuf field: varint for an int, else length-delimited."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(tokens: list[bytes]) -> bytes:
    """The serialised sentencepiece model of a vocabulary.

    The piece of rank ``r`` has id ``r``; one unknown piece follows, which no
    text reaches, for every byte is a piece.
    """
    char = byte_characters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(char[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)))
    out += _field(1, _field(1, "⁇".encode()) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + _field(45, "⁇".encode())
    trainer += b"".join(_varint(n << 3) + _varint((1 << 64) - 1) for n in (41, 42, 43))  # no <s>, </s>, <pad>
    normal = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normal))


class Codec:
    """Encoder and decoder of one vocabulary, for use inside a task."""

    def __init__(self, model: bytes, pattern: str, digest: bool = False) -> None:
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        self.table = {b: c for b, c in enumerate(byte_characters())}
        back = {c: b for b, c in self.table.items()}
        n = self.model.get_piece_size() - 1
        self.bytes_of = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(n)]
        #: Of each remembered pre-token: its ids and, for digests, their decimals joined by spaces and the bytes they decode to.
        self.digest, self.chars = digest, 0
        self.ids: dict[str, list[int]] = {}
        self.text: dict[str, str] = {}
        self.back: dict[str, bytes] = {}

    def split(self, texts: list[str]) -> list[list[str]]:
        """The pre-tokens of each text, all of them encoded and remembered."""
        parts = [self.find(t) for t in texts]
        if len(self.ids) > CACHE or self.chars > CACHE_CHARS:
            for known in (self.ids, self.text, self.back):
                known.clear()
            self.chars = 0
        new = [*set(chain.from_iterable(parts)).difference(self.ids)]
        # latin-1 reads each byte as the code point that the table maps
        mapped = [p.encode("utf-8").decode("latin-1").translate(self.table) for p in new]
        for p, ids in zip(new, self.model.encode(mapped, out_type=int, num_threads=1), strict=True):
            self.ids[p] = ids
            self.chars += len(p)
            if self.digest:
                self.text[p], self.back[p] = " ".join(map(str, ids)), self.decode(ids)
        return parts

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text; special-token strings are ordinary text."""
        get = self.ids.__getitem__
        return [[*chain.from_iterable(map(get, p))] for p in self.split(texts)]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text: the number of tokens, and the hashes of its ids and of what they decode to.

        Decoding goes id by id, so joining what each pre-token's ids decode to
        is decoding the joined ids.
        """
        text, back = self.text.__getitem__, self.back.__getitem__
        out = []
        for parts in self.split(texts):
            ids = " ".join(map(text, parts))
            n = ids.count(" ") + bool(ids)
            out.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(b"".join(map(back, parts))).hexdigest()))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", digest: bool = False, decoded: str | None = None) -> DataFrame:
    """``docs`` with the token ids of ``text`` in ``out``, an array of ints.

    With ``decoded``, also the bytes that the ids decode to, in a column of that
    name, and ``text`` is left out: the same as :func:`decode` of the result, but
    in the same tasks, where a second pass has a second Python worker for each.

    With ``digest``, instead of the ids: ``n_tokens``, ``ids_sha256`` (of the
    decimal ids joined by one space) and ``decoded_sha256`` (of the bytes that
    the ids decode to), and ``text`` is left out.
    """
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(read_ranks(path)))
    extra = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else f"`{out}` array<int>" + (f", `{decoded}` binary" if decoded else "")
    new = {"n_tokens", "ids_sha256", "decoded_sha256"} if digest else {x.lower() for x in (out, decoded) if x}
    keep = [c for c in docs.columns if c.lower() not in new and not ((digest or decoded) and c == text)]
    # a text that is kept goes to the workers once
    where = keep.index(text) if text in keep else len(keep)
    source = docs.select(*(F.col(f"`{c}`") for c in keep), *([F.col(f"`{text}`").alias("__text")] if where == len(keep) else []))

    def make():
        codec = Codec(model.value, pattern, digest)

        def step(batch):
            block = [t or "" for t in batch.column(where).to_pylist()]
            rows = codec.digests(block) if digest else codec.encode(block)
            columns = {c: batch.column(i) for i, c in enumerate(keep)}
            if digest:
                return columns | {name: [r[i] for r in rows] for i, name in enumerate(("n_tokens", "ids_sha256", "decoded_sha256"))}
            return columns | {out: rows} | ({decoded: [codec.decode(ids) for ids in rows]} if decoded else {})

        return step

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[: len(keep)])
    return map_batches(source, ", ".join(x for x in (ddl, extra) if x), make, rows=BATCH, by=where, most=ITEMS)


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that ``ids`` stand for in ``out``; null ids give null."""
    tokens = rows.sparkSession.sparkContext.broadcast(read_ranks(path))
    keep = [c for c in rows.columns if c.lower() != out.lower()]
    source = rows.select(*(F.col(f"`{c}`") for c in keep))

    def make():
        get = tokens.value.__getitem__

        def step(batch):
            lists = batch.column(keep.index(ids)).to_pylist()
            return {c: batch.column(i) for i, c in enumerate(keep)} | {out: [None if x is None else b"".join(map(get, x)) for x in lists]}

        return step

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return map_batches(source, f"{ddl}, `{out}` binary", make, rows=BATCH, by=keep.index(ids), most=ITEMS)
