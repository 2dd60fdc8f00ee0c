"""Byte-level BPE encoding and decoding through a SentencePiece model written from the vocabulary.

The rank file becomes a SentencePiece BPE model: every token's bytes are mapped to one printable
character each, a piece's score is its negative rank, normalisation is the identity.  Merging the
adjacent pair of highest score is then merging the pair of lowest rank.  Each match of the
pre-token pattern is encoded on its own; ids are decoded by the inverse mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Cache, table_path, text_of, units

#: Bytes are shown by the characters of these code points on: none is a blank, a control or the piece mark.
FIRST_CHAR = 0x4E00


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def shown(data: bytes) -> str:
    return "".join(chr(FIRST_CHAR + b) for b in data)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: bytes by length, integers as varints, floats as 32 bits."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """The serialised model.  Piece 0 is the unknown one, piece r + 1 the token of rank r.

    Field numbers are those of the public SentencePiece model format: pieces 1 (piece 1, score 2,
    type 3 with 2 for unknown), trainer 2 (model_type 3 with 2 for BPE, vocab_size 4, begin, end and
    padding ids 41 to 43 absent), normaliser 3 (name 1, dummy prefix 3, extra blanks 4, escaping 5).
    """
    absent = (1 << 64) - 1
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    pieces += [_field(1, _field(1, shown(token).encode()) + _field(2, -float(rank))) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, 0) + b"".join(_field(i, absent) for i in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes texts to ids and back; built once per worker process from the rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError("ranks must be 0, 1, 2, ...")
        self.bytes_of = [token for token, _ in sorted(ranks.items(), key=lambda x: x[1])]
        model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        match = regex.compile(pattern).findall

        def pre_token(text: str) -> bytes:
            return array("I", [i - 1 for i in model.encode(shown(text.encode()))]).tobytes()

        known = Cache(pre_token)
        self.first = Cache(lambda u: b"".join(map(known.__getitem__, match(u))), room=20_000)
        self.later = Cache(lambda u: b"".join(map(known.__getitem__, match(" " + u))))

    def encode(self, text: str) -> bytes:
        """Ids as unsigned 32-bit little-endian integers."""
        head, *rest = units(text)
        return self.first[head] + b"".join(map(self.later.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids)))


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encoded(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (array of int) for every row; nulls and empty texts have no ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(table_path(ranks), _pattern())
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [list(array("I", codec.encode(t))) for t in batch["text"]]})

    return _rows(docs, id_col, text_col).mapInPandas(run, f"doc_id {_kind(docs, id_col)}, ids array<int>")


def decoded(rows: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, data`` (binary) from arrays of ids; null is an empty array.  An id outside the vocabulary is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = [token for token, _ in sorted(read_ranks(table_path(ranks)).items(), key=lambda x: x[1])]
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "data": [b"".join(map(table.__getitem__, ids)) for ids in batch["ids"]]})

    plain = rows.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    return plain.mapInPandas(run, f"doc_id {_kind(rows, id_col)}, data binary")


def round_trip(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: every whole text encoded, and its ids decoded again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(table_path(ranks), _pattern())
        for batch in batches:
            out = []
            for text in batch["text"]:
                ids = codec.encode(text)
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
            yield pd.concat([batch[["doc_id"]], pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"], index=batch.index)], axis=1)

    return _rows(docs, id_col, text_col).mapInPandas(run, f"doc_id {_kind(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
