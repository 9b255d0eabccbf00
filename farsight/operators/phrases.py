"""Dictionary phrases in texts, by a join on hashes of word windows.

Windows of 1, 2, 4, ... words are hashed by doubling: the hash of a window comes from those of its halves. A phrase is
known by the first and the last window of the greatest such size that it holds, which together cover it. Only hashes and
places are joined and grouped, never a text. Words come from Catalyst; their windows are hashed with NumPy, a batch of texts at
a time, and every distinct word of a batch once.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from farsight.session import stage_dir, staged
from farsight.sources.corpus import tokens

# Windows in a row on their way to the join, and multipliers of the two hashes.
WINDOW_ROWS = 1 << 16
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9))

# Send these functions to executors by value, so that they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _D
    return x ^ (x >> np.uint64(29))


def _pair(a: tuple[np.ndarray, np.ndarray], step: int) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of the windows of twice ``step`` words from their halves'; one finds, the other verifies."""
    (h, c), n = a, max(len(a[0]) - step, 0)
    return _mix(h[:n] * _A + h[step:] * _B + _C), _mix(c[:n] * _B + c[step:] * _C + h[:n] * _D + _A)


class Words:
    """The words of a batch of texts, one text after another, with the hashes of their windows by level."""

    def __init__(self, lists: pa.Array) -> None:
        flat = lists.flatten()
        coded = flat.dictionary_encode()
        pairs = b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=16).digest() for w in coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy(zero_copy_only=False)
        known = np.frombuffer(pairs, "<u8").reshape(-1, 2)
        self.size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.text = np.repeat(np.arange(len(self.size)), self.size)
        self.place = np.arange(len(codes)) - self.start[self.text]
        self.left = self.size[self.text] - self.place  # words from here to the text's end
        lengths = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        ends = np.cumsum(lengths) - lengths
        self.at = ends - (ends[self.start[self.text]] if len(ends) else ends) + 1  # counted from 1, in the words joined by spaces
        self.hashes = [(known[codes, 0], known[codes, 1])]

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of 2^k words from each word on; such as leave their text mean nothing."""
        while len(self.hashes) <= k:
            self.hashes.append(_pair(self.hashes[-1], 1 << (len(self.hashes) - 1)))
        return self.hashes[k]


def _with(df: DataFrame, columns: list[str], more: str) -> T.StructType:
    return T.StructType([df.schema[c] for c in columns] + T.StructType.fromDDL(more).fields)


def _anchors(terms: DataFrame, name: str) -> DataFrame:
    """(columns of ``terms``, _level, _need, _offset, _bit, _h, _c): one or two windows per phrase. Blank phrases have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(batch.num_columns - 1))
            top = np.array([n.bit_length() - 1 for n in words.size.tolist()], np.int64)
            for k in np.unique(top[top >= 0]).tolist():
                h, c = words.level(k)
                own = np.flatnonzero(top == k)
                rest = words.size[own] - (1 << k)
                need = np.where(rest > 0, 3, 1)
                for bit, chosen, offset in ((1, own, np.zeros_like(rest)), (2, own[rest > 0], rest[rest > 0])):
                    at = words.start[chosen] + offset
                    if len(at):
                        values = [np.full(len(at), k), need[rest > 0] if bit == 2 else need, offset, np.full(len(at), bit), h[at].view(np.int64), c[at].view(np.int64)]
                        kept = [x.take(pa.array(chosen)) for x in batch.columns[:-1]]
                        yield pa.RecordBatch.from_arrays(
                            [*kept, *map(pa.array, values[4:]), *(pa.array(v, pa.int32()) for v in values[:4])],
                            names=[*batch.schema.names[:-1], "_h", "_c", "_level", "_need", "_offset", "_bit"])

    worded = terms.select("*", tokens(F.col(name)).alias("_words")).where(F.size("_words") > 0)
    return worded.mapInArrow(run, _with(terms, terms.columns, "_h long, _c long, _level int, _need int, _offset int, _bit int"))


def _windows(items: DataFrame, keys: list[str], text: str, levels: list[int]) -> DataFrame:
    """(keys, _pos, _at, _level, _h, _c): the windows of the ``levels`` at every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(batch.num_columns - 1))
            for k in levels:
                h, c = words.level(k)
                places = np.flatnonzero(words.left >= 1 << k)
                for a in range(0, len(places), WINDOW_ROWS):
                    at = places[a : a + WINDOW_ROWS]
                    head = np.flatnonzero(np.diff(words.text[at], prepend=-1))
                    spots = pa.StructArray.from_arrays([
                        pa.array(words.place[at], pa.int32()), pa.array(words.at[at], pa.int32()),
                        pa.array(h[at].view(np.int64)), pa.array(c[at].view(np.int64))], names=["pos", "at", "h", "c"])
                    lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(at)), pa.int32()), spots)
                    kept = [x.take(pa.array(words.text[at[head]])) for x in batch.columns[:-1]]
                    yield pa.RecordBatch.from_arrays(
                        [*kept, pa.array(np.full(len(head), k), pa.int32()), lists], names=[*batch.schema.names[:-1], "_level", "_spots"])

    worded = items.select(*keys, tokens(F.col(text)).alias("_words")).where(F.size("_words") > 0)
    hashed = worded.mapInArrow(run, _with(items, keys, "_level int, _spots array<struct<pos:int,at:int,h:long,c:long>>"))
    spots = hashed.select(*keys, "_level", F.explode("_spots").alias("_s"))
    return spots.select(*keys, "_level", *[F.col(f"_s.{x}").alias(f"_{x}") for x in ("pos", "at", "h", "c")])


def find_phrases(items: DataFrame, keys: list[str], text: str, terms: DataFrame, name: str = "name") -> DataFrame:
    """Phrases that occur word by word in a text: keys, the columns of ``terms``, at.

    ``at`` is the first occurrence's place, counted from 1 in the text's words joined by single spaces. Windows of two
    texts are taken as equal when 128 bits of two hashes are. Null and blank texts and phrases have no matches.
    """
    columns = terms.columns
    # Written, so that its size is known: a small dictionary is then broadcast and the windows stay where they are.
    anchors = staged(_anchors(terms, name), stage_dir(items.sparkSession, "phrases"))
    # At most as many as bits in a text's length.
    levels = sorted(r[0] for r in anchors.select("_level").distinct().collect())
    windows = _windows(items, keys, text, levels)
    met = windows.join(anchors, ["_level", "_h", "_c"]).withColumn("_start", F.col("_pos") - F.col("_offset"))
    whole = (
        met.groupBy(*keys, *columns, "_start", "_need")
        .agg(F.bit_or("_bit").alias("_bits"), F.min(F.when(F.col("_bit") == 1, F.col("_at"))).alias("_at"))
        .where(F.col("_bits") == F.col("_need"))
    )
    return whole.groupBy(*keys, *columns).agg(F.min("_at").alias("at"))
