"""Byte-level BPE through a sentencepiece model made from a vocabulary of ranks.

Each byte is mapped to one printable character, so every piece of the vocabulary becomes a string; a piece's score
is its negative rank, and no normalisation takes place.  Merging the neighbours with the best score is then merging
those of the lowest rank, leftmost first.  The model is serialised here, field by field, and nothing is trained.
Texts are cut into pre-tokens first, and each is encoded on its own; decoding maps pieces back to bytes.

Defined cases: a null text is empty: no ids, no bytes.  Ids, order and other columns don't matter: rows are
independent of each other.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Byte b is this character plus b: all of them letters or marks of one block, none of them white space.
_FIRST = 0x4E00
_BYTES = [chr(_FIRST + b) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The pieces by rank; ranks have to run from 0 without a gap."""
    with open(path, "rb") as f:
        ranks = dict(sorted((int(n), base64.b64decode(p)) for p, n in (line.split() for line in f if line.strip())))
    if list(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without a gap")
    return list(ranks.values())


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n & (1 << 64) - 1)


def _blob(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def mapped(data: bytes) -> str:
    return "".join(map(_BYTES.__getitem__, data))


def model(pieces: list[bytes]) -> bytes:
    """A serialised sentencepiece model: piece i has id i and score -i; one more is the unknown piece."""
    def piece(text: str, score: float, kind: int) -> bytes:
        return _blob(1, _blob(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))

    normal, unknown = 1, 2
    none = -1
    trainer = (_number(3, 2) + _number(4, len(pieces) + 1) + _number(40, len(pieces))
               + _number(41, none) + _number(42, none) + _number(43, none))
    plain = _blob(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join([*(piece(mapped(p), -float(i), normal) for i, p in enumerate(pieces)),
                     piece("<unk>", -float(len(pieces)), unknown), _blob(2, trainer), _blob(3, plain)])


class Codec:
    """Encodes and decodes texts; pre-tokens seen before are looked up, at most ``memory`` of them."""

    def __init__(self, path: str, pattern: str, memory: int = 200_000) -> None:
        import sentencepiece

        self.pieces = read_ranks(path)
        self.ids = {p: i for i, p in enumerate(self.pieces)}
        self.engine = sentencepiece.SentencePieceProcessor(model_proto=model(self.pieces))
        self.split = regex.compile(pattern).findall
        self.names = [str(i) for i in range(len(self.pieces))]
        self.seen: dict[str, tuple[int, ...]] = {}
        self.memory = memory

    def encode(self, text: str) -> list[int]:
        tokens = self.split(text)
        seen = self.seen
        if len(seen) > self.memory:
            seen.clear()
        missing = list({t for t in tokens if t not in seen})
        if missing:
            whole = [t.encode() for t in missing]
            parts = iter(self.engine.encode([mapped(w) for w in whole if w not in self.ids], num_threads=1))
            for t, w in zip(missing, whole):
                known = self.ids.get(w)
                seen[t] = (known,) if known is not None else tuple(next(parts))
        return list(chain.from_iterable(map(seen.__getitem__, tokens)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker and vocabulary."""
    return Codec(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
            with_ids: bool = True) -> DataFrame:
    """(id, ids, n_tokens, ids_sha256, decoded_sha256); ``ids`` only if asked for.  ``path`` must be readable on
    every executor, as the installed file of a package is."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + "ids array<int>, " * with_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                if with_ids:
                    rows[0].append(ids)
                rows[1].append(len(ids))
                rows[2].append(hashlib.sha256(",".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest())
                rows[3].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            columns = [pa.array(rows[0], pa.list_(pa.int32()))] * with_ids + [
                pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.string())]
            names = ["id", *["ids"] * with_ids, "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decoded(rows: DataFrame, path: str, pattern: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, content): the bytes of each row's ids; null ids are empty."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            content = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], names=["id", "content"])

    return rows.select(id_col, ids_col).mapInArrow(run, f"id {kind}, content binary")
