"""Byte-level BPE through a sentencepiece model that is serialised from a rank file.

Every byte is written as one printable character; a token of the rank file becomes the piece of
its bytes' characters, scored by its negative rank, so that the library's best-score merges are
the lowest-rank merges. Normalisation is the identity. Pre-tokens are encoded one by one; a
pre-token that is itself a token is that token. Decoding maps ids back to the tokens' bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from farsight.llm.common import arrow_map, sha256_hex, strings_of
from farsight.llm.pretokens import CachedEncoder
from farsight.llm.registry import query, table

# A rank file is sent to the executors whole, so its size is checked.
MAX_RANKS_BYTES = 64 << 20


def read_ranks(path: str) -> bytes:
    """The rank file, checked to be small enough to send to every executor."""
    data = Path(path).read_bytes()
    if len(data) > MAX_RANKS_BYTES:
        raise ValueError(f"rank file of {len(data)} bytes; at most {MAX_RANKS_BYTES} are broadcast")
    return data


def parse_ranks(data: bytes) -> list[bytes]:
    """Tokens by rank. Ranks have to be 0, 1, 2, ... without gaps."""
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, data.splitlines()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks are not consecutive")
    return [token for _, token in pairs]


def byte_characters() -> list[str]:
    """One printable, non-space character per byte: U+0100 and up, in byte order."""
    return [chr(0x100 + b) for b in range(256)]


# --- serialising the model (protocol-buffer wire format) ---------------------------


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, kind: int, payload: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(payload)) + payload if kind == 2 else payload)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece model whose piece ids are the ranks; the unknown piece comes last."""
    chars = byte_characters()
    # Field numbers and enum values of the public model format (fixed values):
    # model: pieces 1, trainer_spec 2, normalizer_spec 3; piece: piece 1, score 2, type 3
    # type: NORMAL 1, UNKNOWN 2; trainer: model_type 3 (BPE 2), vocab_size 4, unk_id 40, bos_id 41, eos_id 42, pad_id 43
    # normalizer: name 1, add_dummy_prefix 3, remove_extra_whitespaces 4, escape_whitespaces 5
    parts = []
    for rank, token in enumerate(tokens):
        piece = "".join([chars[b] for b in token]).encode()
        parts.append(_field(1, 2, _field(1, 2, piece) + _field(2, 5, struct.pack("<f", -float(rank)))))
    parts.append(_field(1, 2, _field(1, 2, b"<unk>") + _field(2, 5, struct.pack("<f", 0.0)) + _field(3, 0, _varint(2))))
    minus_one = _varint((1 << 64) - 1)
    trainer = _field(3, 0, _varint(2)) + _field(4, 0, _varint(len(tokens) + 1)) + _field(40, 0, _varint(len(tokens)))
    trainer += _field(41, 0, minus_one) + _field(42, 0, minus_one) + _field(43, 0, minus_one)
    normalizer = _field(1, 2, b"identity") + _field(3, 0, b"\0") + _field(4, 0, b"\0") + _field(5, 0, b"\0")
    return b"".join(parts) + _field(2, 2, trainer) + _field(3, 2, normalizer)


class ByteBpe:
    """Encoder and decoder of one rank file; ``pattern`` cuts texts into pre-tokens."""

    def __init__(self, data: bytes, pattern: str) -> None:
        import regex
        import sentencepiece

        self.tokens = parse_ranks(data)
        self.rank_of = {token: rank for rank, token in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.tokens))
        self.chars = byte_characters()
        self.pattern = regex.compile(pattern)
        self.encoder = CachedEncoder(self.encode_piece, letters=lambda piece: self.encode_pretoken(piece.encode()))

    def encode_pretoken(self, data: bytes) -> list[int]:
        rank = self.rank_of.get(data)
        if rank is not None:
            return [rank]
        chars = self.chars
        return self.model.encode("".join([chars[b] for b in data]))

    def encode_piece(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.pattern.findall(text):
            out += self.encode_pretoken(part.encode())
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encoder.packed(text), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids.tolist()])


@lru_cache(maxsize=4)
def codec(data: bytes, pattern: str) -> ByteBpe:
    """One codec per Python worker and rank file."""
    return ByteBpe(data, pattern)


def encode_documents(
    docs: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN, id_column: str = "doc_id", text_column: str = "text",
    token_column: str = "token_ids",
) -> DataFrame:
    """All columns of ``docs`` with the ids of its whole texts.

    Adds ``token_column`` (binary: ids as little-endian unsigned 32-bit integers) and
    ``n_tokens`` (long), replacing columns of those names. A null text counts as empty: no ids.
    Repeated rows and ids give a row each; no row is dropped.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    kept = [c for c in docs.columns if c not in (token_column, "n_tokens")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(shared.value, pattern)
        for batch in batches:
            ids = [bpe.encoder.packed(t) for t in strings_of(batch, text_column)]
            columns = [batch.column(i) for i in range(batch.num_columns)]
            columns += [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, token_column, "n_tokens"])
        # The worker goes on to other stages, which need the room.
        bpe.encoder.forget()

    return docs.select(*kept).mapInArrow(encode, f"{schema}, `{token_column}` binary, n_tokens long")


def decode_tokens(
    tokens: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN, token_column: str = "token_ids", out: str = "decoded",
) -> DataFrame:
    """All columns of ``tokens`` with ``out`` (binary): the bytes that the ids stand for."""
    shared = tokens.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    kept = [c for c in tokens.columns if c != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.select(*kept).schema.fields)

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = codec(shared.value, pattern)
        ids = batch.column(batch.schema.get_field_index(token_column)).to_pylist()
        columns = [batch.column(i) for i in range(batch.num_columns)]
        columns.append(pa.array([bpe.decode(np.frombuffer(x or b"", "<u4")) for x in ids], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, out])

    return arrow_map(tokens.select(*kept), decode, f"{schema}, `{out}` binary")


@query("op1_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, encoded and decoded again."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = encode_documents(docs, ranks).select("doc_id", "token_ids", "n_tokens")
    both = decode_tokens(ids, ranks)
    return both.select(
        "doc_id", "n_tokens", sha256_hex("token_ids").alias("ids_sha256"), sha256_hex("decoded").alias("decoded_sha256"),
        F.length("decoded").cast("long").alias("n_bytes"),
    )
