"""Token-id files: canonical length-limited Huffman codes, decoded by table in independent blocks.

A file set is a folder with two Parquet tables, so any store that Spark writes will hold it:

* ``codebook`` (id, length): code lengths by the package-merge rule from the counts of all ids.
  Codes are canonical, in order of (length, id), so the lengths say everything.
* ``blocks`` (part, block, first, doc_ids, counts, n_bits, payload, checkpoints): consecutive
  whole documents in ascending id order. ``payload`` holds the codes, most significant bit first;
  ``checkpoints`` the bit offset of every ``CHECKPOINT``-th id, from which decoding can start.
  ``first`` is the number of ids before the block within its part; parts follow each other.
"""

from __future__ import annotations

import os
import string
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from farsight.llm.common import arrow_map, shuffle_parts, stage, strings_of
from farsight.llm.pretokens import LATIN_END, CachedEncoder
from farsight.llm.registry import query, table
from farsight.session import stage_dir

MAX_TOKENIZER_BYTES = 64 << 20
# Longest code: the decoding table has 2 ** MAX_LENGTH entries, and as many distinct ids at most.
MAX_LENGTH = 20
# Ids between two checkpoints, and ids after which a block is closed (at a document's end).
CHECKPOINT = 256
BLOCK_IDS = 1 << 18


# --- tokens -----------------------------------------------------------------------


@lru_cache(maxsize=2)
def _encoder(data: bytes, dtype: str) -> CachedEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(data.decode())
    # Strings that the library cuts out of a text before anything else. None holds white space, so that
    # they lie within the pieces that texts are cut into.
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    if any(c.isspace() for token in added for c in token):
        raise ValueError("an added token holds white space")
    cut = regex.compile(public_tokenizers.PATTERN).findall
    merge, written = tokenizer.model.tokenize, _byte_characters(tokenizer)

    if any(token.rstrip(string.punctuation).isalpha() or not token.strip(string.punctuation) for token in added):
        raise ValueError("an added token may lie in letters and the marks after them")
    blank = written[32]

    def letters(piece: str) -> list[int]:
        # Latin text is cut here and merged by the library's model, which spares the steps around it.
        if piece.isascii():
            return [t.id for t in merge(blank + piece[1:] if piece[0] == " " else piece)]
        return [t.id for t in merge(piece.encode().decode("latin-1").translate(written))]

    def encode(piece: str) -> list[int]:
        if max(piece) < LATIN_END and not any(token in piece for token in added):
            return [t.id for part in cut(piece) for t in merge(part.encode().decode("latin-1").translate(written))]
        return tokenizer.encode(piece, add_special_tokens=False).ids

    return CachedEncoder(encode, dtype, letters=letters)


def _byte_characters(tokenizer) -> dict[int, str]:
    """The character that the tokenizer's own splitter writes for each byte of Latin text."""
    split = tokenizer.pre_tokenizer.pre_tokenize_str
    out = {}
    for code in (*range(0x80), *range(0x80, 0x250)):
        data = chr(code).encode()
        out.update(zip(data, "".join(part for part, _ in split(chr(code)))))
    return out


def id_type(tokenizer: str) -> str:
    """The narrowest unsigned type that holds the ids of a tokenizer file."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each whole text and ``end_id``, as little-endian integers of two
    bytes where the vocabulary has at most 65,536 ids, else of four (``id_type``).

    A null text counts as empty. ``tokenizer`` is a file of the tokenizers library whose splits are
    those of the byte-level pattern; it is sent to the executors after a check of its size.
    """
    data = Path(tokenizer).read_bytes()
    if len(data) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"tokenizer of {len(data)} bytes; at most {MAX_TOKENIZER_BYTES} are broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(data)
    kind = docs.schema[id_column].dataType.simpleString()
    dtype = id_type(tokenizer)
    tail = np.array([end_id], dtype).tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _encoder(shared.value, dtype)
        ids = [encoder.packed(t) + tail for t in strings_of(batch)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return arrow_map(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), run, f"doc_id {kind}, ids binary")


def id_counts(tokens: DataFrame, dtype: str = "<u4") -> DataFrame:
    """(id, n) over all documents; each task sends one row per id that it has seen."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype))
            if len(found) > len(total):
                total = np.concatenate((total, np.zeros(len(found) - len(total), np.int64)))
            total[: len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    return tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


# --- codes ------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` for positive counts (package-merge)."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.int64)[order]
    packages = np.zeros(0, np.int64)
    levels = []
    for _ in range(limit):
        weights = np.concatenate((leaves, packages))
        by = np.argsort(weights, kind="stable")
        levels.append(by < n)
        weights = weights[by]
        packages = weights[0 : len(weights) // 2 * 2 : 2] + weights[1::2]
    sorted_lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        sorted_lengths[:own] += 1
        take = 2 * (take - own)
    lengths = np.zeros(n, np.int64)
    lengths[order] = sorted_lengths
    return lengths


class Codebook:
    """Canonical codes from ids and lengths; encodes and decodes runs of ids."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        codes = np.zeros(len(ids), np.uint64)
        code = last = 0
        for k, length in enumerate(lengths.tolist()):
            code = (code + 1) << (length - last) if k else 0
            last = length
            codes[k] = code
        size = int(ids.max()) + 1 if len(ids) else 0
        self.code, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[ids], self.length[ids] = codes, lengths
        # Decoding table: every value of the next ``bits`` bits gives an id and its code's length.
        self.bits = int(lengths.max()) if len(ids) else 1
        spread = 1 << (self.bits - lengths)
        self.table_id = np.zeros(1 << self.bits, np.uint32)
        self.table_length = np.zeros(1 << self.bits, np.int64)
        filled = int(spread.sum())
        self.table_id[:filled] = np.repeat(ids, spread)
        self.table_length[:filled] = np.repeat(lengths, spread)

    def encode(self, ids: np.ndarray) -> tuple[bytes, int, np.ndarray]:
        """(payload, bits, checkpoints) of a run of ids."""
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ids) else 0
        starts = ends - lengths
        word, bit = starts >> 6, starts & 63
        left = self.code[ids] << (64 - lengths).astype(np.uint64)
        words = np.zeros((total >> 6) + 2, np.uint64)
        if len(ids):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            words[word[first]] = np.bitwise_or.reduceat(left >> bit.astype(np.uint64), first)
            over = np.flatnonzero(bit + lengths > 64)
            words[word[over] + 1] |= left[over] << (64 - bit[over]).astype(np.uint64)
        return words.astype(">u8").tobytes()[: (total + 7) // 8], total, starts[::CHECKPOINT]

    def decode(self, payload: bytes, n: int, checkpoints: np.ndarray) -> np.ndarray:
        """The ``n`` ids of a payload; all stretches between checkpoints advance together."""
        out = np.zeros(len(checkpoints) * CHECKPOINT, np.uint32)
        if not n:
            return out[:0]
        data = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
        window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        at = checkpoints.astype(np.int64).copy()
        base = np.arange(len(at)) * CHECKPOINT
        end = len(payload) * 8
        mask = (1 << self.bits) - 1
        for k in range(min(CHECKPOINT, n)):
            at = np.minimum(at, end)
            seen = (window[at >> 3] >> (32 - self.bits - (at & 7)).astype(np.uint32)) & mask
            out[base + k] = self.table_id[seen]
            at += self.table_length[seen]
        return out[:n]


@lru_cache(maxsize=2)
def _codebook(ids: bytes, lengths: bytes) -> Codebook:
    return Codebook(np.frombuffer(ids, np.int64), np.frombuffer(lengths, np.int64))


# --- files ------------------------------------------------------------------------

_BLOCK_FIELDS = "part int, block int, first long, doc_ids array<{kind}>, counts array<long>, n_bits long, payload binary, checkpoints array<long>"


def write_token_files(tokens: DataFrame, path: str, dtype: str = "<u4", parts: int | None = None, max_length: int = MAX_LENGTH) -> None:
    """Writes ``tokens`` (doc_id, ids as integers of ``dtype``) as a file set below ``path``, in ascending doc_id order.

    The codebook is made of the counts of all ids; the driver holds at most one count per distinct
    id, of which there may be 2 ** ``max_length``. Null ids come first, repeated ones together. An
    empty table gives an empty codebook and no block.
    """
    if not 1 <= max_length <= 24:
        raise ValueError("codes have 1 to 24 bits")
    spark = tokens.sparkSession
    counts = id_counts(tokens, dtype).limit((1 << max_length) + 1).collect()
    ids, n = (np.array([r[k] for r in counts], np.int64) for k in (0, 1))
    lengths = code_lengths(n, max_length)
    book = spark.createDataFrame(pa.table({"id": ids, "length": lengths}))
    book.coalesce(1).write.mode("overwrite").parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast((ids.tobytes(), lengths.tobytes()))
    kind = tokens.schema["doc_id"].dataType
    names = ["part", "block", "first", "doc_ids", "counts", "n_bits", "payload", "checkpoints"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        coder, part = _codebook(*shared.value), TaskContext.get().partitionId()
        docs, runs, held, block, first = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            every = np.concatenate(runs)
            payload, bits, marks = coder.encode(every)
            values = [part, block, first, docs, [len(r) for r in runs], bits, payload, marks.tolist()]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(to_arrow_type(kind)), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                run = np.frombuffer(data, dtype).astype(np.int64)
                docs.append(doc)
                runs.append(run)
                held += len(run)
                if held >= BLOCK_IDS:
                    yield close()
                    docs, runs, held, block, first = [], [], 0, block + 1, first + held
        if runs:
            yield close()

    # Numbered parts follow the ranges, so part order is document order.
    ordered = tokens.select("doc_id", "ids").repartitionByRange(parts or shuffle_parts(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(blocks, _BLOCK_FIELDS.format(kind=kind.simpleString())).write.mode("overwrite").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of a file set.

    ``ids`` holds little-endian 32-bit integers. ``start`` is the number of ids of all documents before it.
    """
    book = spark.read.parquet(f"{path}/codebook").orderBy("id").toPandas()
    shared = spark.sparkContext.broadcast((book["id"].to_numpy(np.int64).tobytes(), book["length"].to_numpy(np.int64).tobytes()))
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = _codebook(*shared.value)
        part, doc, start, count, out = [], [], [], [], []
        for row in batch.to_pylist():
            sizes = np.array(row["counts"], np.int64)
            every = coder.decode(row["payload"], int(sizes.sum()), np.array(row["checkpoints"], np.int64)).astype("<u4")
            ends = np.cumsum(sizes)
            for d, a, b in zip(row["doc_ids"], (ends - sizes).tolist(), ends.tolist()):
                part.append(row["part"])
                doc.append(d)
                start.append(row["first"] + a)
                count.append(b - a)
                out.append(every[a:b].tobytes())
        types = [pa.int32(), batch.column(batch.schema.get_field_index("doc_ids")).type.value_type, pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((part, doc, start, count, out), types)],
                                          names=["part", "doc_id", "start", "n_tokens", "ids"])

    rows = arrow_map(blocks, decode, f"part int, doc_id {kind}, start long, n_tokens long, ids binary")
    # One row per part: the ids of all parts before it.
    totals = blocks.select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    # As many rows as the writer had partitions, so they are broadcast and no ids move.
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


@query("op6_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written as Huffman-coded files and read back from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    tokens = stage(tokenize(docs, tokenizer, 2), "tokens")
    path = stage_dir(spark, "token-files")
    write_token_files(tokens, path, id_type(tokenizer))
    back = read_token_files(spark, path)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
