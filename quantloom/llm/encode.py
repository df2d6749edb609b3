"""Encoding of a corpus with a byte-level BPE vocabulary through sentencepiece.

The vocabulary (token bytes and ranks, as published) is written directly as a
sentencepiece model: every token becomes a piece of printable characters, one
for each byte, scored by its negative rank, so that merging by best score is
merging by lowest rank. Normalisation is the identity. A text is cut into
pre-tokens, their bytes are mapped, and the pieces' places are the ids.
Decoding is the inverse mapping. No model is trained.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.session import spread

TOKENIZERS = os.environ.get("QUANTLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: how texts are cut into pre-tokens; white space as Unicode has it.
W = r"\p{White_Space}"
PRETOKENS = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{W}\p{{L}}\p{{N}}]+|{W}+(?![^{W}])|{W}+"
#: Pre-tokens kept by a worker with their ids; beyond that the store is emptied.
KEPT = 200_000


@lru_cache
def byte_characters() -> str:
    """A printable character for each byte: its own where it has one, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, more = [], 0x100
    for b in range(256):
        if b in own:
            table.append(chr(b))
        else:
            table.append(chr(more))
            more += 1
    return "".join(table)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: bytes are length-delimited, floats fixed32, ints varint."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> list[bytes]:
    """Token bytes in order of their ids."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model of these tokens; the piece at place i is token i."""
    normal, unknown, bpe = 1, 2, 2
    table = byte_characters()
    pieces = [_field(1, _field(1, "".join(table[b] for b in t).encode()) + _field(2, float(-i)) + _field(3, normal)) for i, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens))
    identity = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, identity)


class Encoder:
    """Texts to ids and back, for one vocabulary."""

    def __init__(self, path: str) -> None:
        self.tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.tokens))
        self.cut = regex.compile(PRETOKENS)
        self.map = dict(enumerate(byte_characters()))
        self.ids: dict[str, list[int]] = {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text without special tokens; null and empty texts have none."""
        cut = [self.cut.findall(t) if t else [] for t in texts]
        if len(self.ids) > KEPT:
            self.ids.clear()
        new = list({p for c in cut for p in c if p not in self.ids})
        mapped = [p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.map) for p in new]
        self.ids.update(zip(new, self.model.encode(mapped, num_threads=1)))
        ids = self.ids
        return [[i for p in c for i in ids[p]] for c in cut]

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids."""
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, built once in each worker."""
    return Encoder(path)


def _batches(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many characters of text each (one text at least)."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, most: int = 4_000_000) -> DataFrame:
    """(doc_id, ids): one row per row of docs; null and empty texts give an empty list.

    Whole texts are encoded, however long. Blank texts are text and have ids.
    Repeated rows stay repeated, an empty table stays empty, other columns are
    dropped. path: the vocabulary file, readable on every executor.
    """
    path = path or f"{TOKENIZERS}/{VOCABULARY}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for part in _batches(batch, most):
                ids = e.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return spread(rows).mapInArrow(run, f"doc_id {kind}, ids array<int>").withColumnRenamed("doc_id", doc_id)


def decode(df: DataFrame, doc_id: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, text): the inverse of encode(); no ids, or null, give an empty text."""
    path = path or f"{TOKENIZERS}/{VOCABULARY}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text string").withColumnRenamed("doc_id", doc_id)


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None, most: int = 4_000_000) -> DataFrame:
    """The columns keep and n_tokens, the number of ids of each row's text."""
    path = path or f"{TOKENIZERS}/{VOCABULARY}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for part in _batches(batch.select([batch.num_columns - 1, batch.num_columns - 1, *range(batch.num_columns - 1)]), most):
                n = pa.array([len(x) for x in e.encode(part.column(1).to_pylist())], pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(i + 2) for i in range(len(keep))], n], names=[*keep, "n_tokens"])

    rows = docs.select(*keep, F.col(text).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return spread(rows).mapInArrow(run, f"{kinds}, n_tokens bigint")
