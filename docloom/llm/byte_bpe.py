"""Byte-level BPE through a sentencepiece model written directly from a rank file.

Every byte is mapped to one printable character; a token of rank r becomes the piece of its mapped bytes
with score -r, and the model is BPE with identity normalisation. sentencepiece then merges by rank, as
byte-level BPE does. Pre-tokens are encoded separately (one that is a token itself takes that token);
decoding maps ids back to pieces and pieces to bytes.

Null text counts as empty and has no ids. Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.pretokens import PieceCache, chunks, flat_ids, split


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_characters() -> str:
    """Character for each byte: itself where it prints in Latin-1, else the next one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in prints else chr(next(others)) for b in range(256))


def mapped(token: bytes, characters: str) -> str:
    return "".join([characters[b] for b in token])


# --- the model file, in protocol buffer wire format ------------------------------------------------


def _varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, content: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(content)) + content


# Field numbers and types of the sentencepiece model format.
_PIECE, _TRAINER, _NORMALIZER = 1, 2, 3
_NORMAL, _UNKNOWN, _BPE = 1, 2, 2


def _piece(text: str, score: float, kind: int) -> bytes:
    body = _block(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind)
    return _block(_PIECE, body)


def model(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model; piece 0 is the unknown piece, rank r is piece r + 1."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0..n-1, each once")
    characters = byte_characters()
    pieces = [_piece("<unk>", 0.0, _UNKNOWN)]
    pieces += [
        _piece(mapped(token, characters), -float(rank), _NORMAL)
        for token, rank in sorted(ranks.items(), key=lambda x: x[1])
    ]
    trainer = _number(3, _BPE) + _number(4, len(pieces)) + _number(40, 0)
    trainer += b"".join(_number(field, -1) for field in (41, 42, 43))
    normalizer = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _block(_TRAINER, trainer) + _block(_NORMALIZER, normalizer)


class Codec:
    """Encoder and decoder over one serialised model."""

    def __init__(self, serialised: bytes):
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_proto=serialised)
        characters = byte_characters()
        self.to_char = {b: c for b, c in enumerate(characters)}
        byte_of = {c: b for b, c in enumerate(characters)}
        size = self.processor.get_piece_size()
        self.bytes_of = [
            bytes([byte_of[c] for c in self.processor.id_to_piece(i)]) for i in range(1, size)
        ]
        self.whole = {token: rank for rank, token in enumerate(self.bytes_of)}
        self.cache = PieceCache(self.encode_pieces)

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pre-tokens, each encoded on its own."""
        raw = [p.encode() for p in pieces]
        out = [[self.whole[r]] if r in self.whole else [] for r in raw]
        rest = [i for i, ids in enumerate(out) if not ids]
        texts = [raw[i].decode("latin-1").translate(self.to_char) for i in rest]
        for i, ids in zip(rest, self.processor.encode(texts, out_type=int, num_threads=1) if texts else []):
            out[i] = [x - 1 for x in ids]
        return out

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        for some in chunks(texts):
            ids, bounds = flat_ids(split(some), self.cache)
            for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
                yield ids[a:b].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encoded(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids, decoded (bytes) of every document; the model travels as one broadcast of fixed size."""
    return _mapped(docs, ranks_path, "ids array<int>, decoded binary", _rows)


def digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the same, reduced where it is made."""
    return _mapped(docs, ranks_path, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", _digest_rows)


def _rows(ids: list[int], decoded: bytes) -> tuple:
    return ids, decoded


def _digest_rows(ids: list[int], decoded: bytes) -> tuple:
    written = str(ids)[1:-1].replace(" ", "").encode()
    return len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(decoded).hexdigest()


def _mapped(docs: DataFrame, ranks_path: str, columns: str, row) -> DataFrame:
    serialised = docs.sparkSession.sparkContext.broadcast(model(read_ranks(ranks_path)))
    kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.binary()}
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(serialised.value)
        for b in batches:
            rows = [row(ids, codec.decode(ids)) for ids in codec.encode(b.column("text").to_pylist())]
            values = list(zip(*rows)) or [()] * len(names)
            arrays = [pa.array(v, kinds.get(c, pa.string())) for c, v in zip(names, values)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays], ["doc_id", *names])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id bigint, {columns}")
