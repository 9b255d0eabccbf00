"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

A text is lower-cased (A-Z) and cut into words of ASCII letters, digits and all characters beyond
ASCII. The windows of the test items are hashed into a small sorted array that every task holds;
documents are scanned with a rolling hash, and hits are verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from farsight.llm.common import arrow_map, chunks, sha256_hex, spans_of, stage, texts_of
from farsight.llm.registry import query, table

WINDOW = 10
# Test items are broadcast in blocks of at most this many bytes of text, one scan per block. A block has at
# most one window per two bytes; a window takes 20 bytes of numbers, a distinct word about 150.
BLOCK_BYTES = 2 << 20

# Letters and digits stay (capitals made small), bytes beyond ASCII stay, all else is a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(data: bytes) -> list[bytes]:
    return data.translate(NORMAL).split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of every window of ``size`` consecutive ids."""
    n = len(ids) - size + 1
    x = _mix(ids.astype(np.uint64) + np.uint64(1))
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        out = out * _MULTIPLIER + x[k : k + n]
    return _mix(out)


@dataclass
class Windows:
    """The distinct windows of one length: sorted hashes, first words in the set's text, and the items that hold them."""

    size: int
    hashes: np.ndarray
    starts: np.ndarray
    item_bounds: np.ndarray
    items: np.ndarray
    mask: np.ndarray

    def items_of(self, row: int) -> list[int]:
        return self.items[self.item_bounds[row] : self.item_bounds[row + 1]].tolist()


class TestSet:
    """Vocabulary and windows of a block of test items, whose words lie one after another in ``text``."""

    __test__ = False

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        self.names = [item for item, _ in items]
        runs = []
        for _, text in items:
            words = words_of((text or "").encode())
            runs.append(np.fromiter((number(w, len(self.vocabulary) + 1) for w in words), np.int32, len(words)))
        self.text = np.concatenate([*runs, np.zeros(0, np.int32)])
        lengths = np.array([len(r) for r in runs], np.int64)
        begins = np.cumsum(lengths) - lengths
        sizes = np.minimum(lengths, window)
        self.windows = [self._windows(int(size), np.flatnonzero(sizes == size), begins, lengths) for size in np.unique(sizes[sizes > 0])]

    def _windows(self, size: int, of: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> Windows:
        count = lengths[of] - size + 1
        item = np.repeat(of, count)
        start = np.repeat(begins[of] - (np.cumsum(count) - count), count) + np.arange(len(item))
        hashes = window_hashes(self.text, size)[start]
        order = np.lexsort((item, hashes))
        item, start, hashes = item[order], start[order], hashes[order]
        # Equal windows follow each other, by item; windows of one hash that differ stay apart.
        same = hashes[1:] == hashes[:-1]
        for k in range(size):
            same &= self.text[start[1:] + k] == self.text[start[:-1] + k]
        fresh = np.concatenate(([True], ~same))
        own = fresh | np.concatenate(([True], item[1:] != item[:-1]))
        first = np.flatnonzero(fresh)
        bounds = np.concatenate((np.cumsum(own)[first] - 1, [own.sum()]))
        mask = np.zeros(1 << 20, bool)
        mask[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return Windows(size, hashes[first], start[first], bounds, item[own].astype(np.int32), mask)

    def ids(self, words: list[bytes]) -> list[int]:
        get = self.vocabulary.get
        return [get(w, 0) for w in words]

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, set]]:
        """(number of words, hit flag per word, items) of each text."""
        words = [words_of(t) for t in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        ids = np.fromiter((i for w in words for i in self.ids(w)), np.int64, int(ends[-1]) if len(ends) else 0)
        hit = np.zeros(len(ids) + 1, np.int64)
        items: dict[int, set] = {}
        for w in self.windows:
            for at, row in self._matches(ids, w):
                # Windows that run over the end of their text are no windows.
                doc = np.searchsorted(ends, at, side="right")
                inside = at + w.size <= ends[doc]
                at, row, doc = at[inside], row[inside], doc[inside]
                np.add.at(hit, at, 1)
                np.add.at(hit, at + w.size, -1)
                for k, d in set(zip(row.tolist(), doc.tolist())):
                    items.setdefault(d, set()).update(w.items_of(k))
        flags = np.cumsum(hit[:-1]) > 0
        for k in range(len(texts)):
            yield int(lengths[k]), flags[starts[k] : ends[k]], {self.names[i] for i in items.get(k, ())}

    def _matches(self, ids: np.ndarray, w: Windows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places whose window equals a test window, with the row of that window."""
        if len(ids) < w.size:
            return
        # A word outside the vocabulary breaks every window over it.
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        at = np.flatnonzero(known[w.size :] - known[: -w.size] == w.size)
        if not len(at):
            return
        hashes = window_hashes(ids, w.size)[at]
        near = w.mask[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)]
        at, hashes = at[near], hashes[near]
        left = np.searchsorted(w.hashes, hashes, side="left")
        # Rows of equal hash are few (one, but for collisions); each is compared in full.
        while len(at):
            same = (left < len(w.hashes)) & (w.hashes[np.minimum(left, len(w.hashes) - 1)] == hashes)
            at, hashes, left = at[same], hashes[same], left[same]
            if not len(at):
                return
            equal = np.ones(len(at), bool)
            for k in range(w.size):
                equal &= ids[at + k] == self.text[w.starts[left] + k]
            yield at[equal], left[equal]
            left = left + 1


@lru_cache(maxsize=2)
def _test_set(key: bytes, window: int) -> TestSet:
    import pickle

    return TestSet(pickle.loads(key), window)


def pieces_of(words: list[bytes], limit: int, window: int) -> Iterator[list[bytes]]:
    """Words in runs of about ``limit`` bytes that share ``window - 1`` words, so that each window lies in one of them."""
    piece, size = [], 0
    for word in words:
        if size > limit and len(piece) >= window:
            yield piece
            piece = piece[len(piece) - window + 1 :]
            size = sum(map(len, piece)) + len(piece)
        piece.append(word)
        size += len(word) + 1
    yield piece


def item_blocks(items: DataFrame, id_column: str, text_column: str, limit: int, window: int) -> Iterator[list[tuple]]:
    """The test items in blocks of about ``limit`` text bytes; a larger item is dealt over several in pieces."""
    block, size = [], 0
    for item, text in items.select(id_column, text_column).toLocalIterator():
        parts = [text]
        if len(text or "") * 4 > limit:
            parts = [b" ".join(p).decode() for p in pieces_of(words_of(text.encode()), limit, window)]
        for part in parts:
            n = len((part or "").encode())
            if block and size + n > limit:
                yield block
                block, size = [], 0
            block.append((item, part))
            size += n
    yield block


def scan_documents(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
    item_id: str = "item_id", item_text: str = "text", text_column: str = "text",
) -> DataFrame:
    """All columns of ``docs`` with ``n_words``, ``hit_words`` and ``item_ids``.

    ``hit_words`` holds start and end (exclusive) of each run of hit words in turn; ``item_ids``
    the items with a window in the text, without order. Null and empty texts have no words and
    no hits; null and empty items have no windows; an item of fewer words than ``window`` is one
    window; repeated items count by their id. Columns of the added names are replaced. A test set
    beyond ``block_bytes`` is scanned block by block, each over the written result of the one before, so that what
    is broadcast and what a worker holds stay bounded; an item beyond it is dealt over several blocks.
    """
    import pickle

    added = ("n_words", "hit_words", "item_ids")
    out = docs.select(*[c for c in docs.columns if c not in added])
    base = out.columns
    item_type = items.schema[item_id].dataType.simpleString()
    for k, block in enumerate(item_blocks(items, item_id, item_text, block_bytes, window)):
        if k:
            out = stage(out, "scanned")
        out = _scan_block(out, docs.sparkSession.sparkContext.broadcast(pickle.dumps(block)), window, text_column, item_type, k)
    return out.select(*base, *added)


def _scan_block(docs: DataFrame, shared, window: int, text_column: str, item_type: str, k: int) -> DataFrame:
    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        tests = _test_set(shared.value, window)
        texts = texts_of(batch, text_column)
        n, runs, names = [], [], []
        for a, b in chunks(texts, 4 << 20):
            for count, flags, items in tests.scan(texts[a:b]):
                start, end = spans_of(flags) if items else ((), ())
                n.append(count)
                runs.append([int(x) for pair in zip(start, end) for x in pair])
                names.append(list(items))
        item_array = pa.array(names, type=pa.list_(batch_type))
        columns = [batch.column(i) for i in range(batch.num_columns)]
        if k == 0:
            columns += [pa.array(n, pa.int64()), pa.array(runs, pa.list_(pa.int64())), item_array]
            return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "n_words", "hit_words", "item_ids"])
        at = batch.schema.get_field_index("hit_words")
        old_runs, old_items = batch.column(at).to_pylist(), batch.column(at + 1).to_pylist()
        columns[at] = pa.array([merge_runs(x, y) for x, y in zip(old_runs, runs)], pa.list_(pa.int64()))
        columns[at + 1] = pa.array([list({*x, *y}) for x, y in zip(old_items, names)], pa.list_(batch_type))
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    batch_type = to_arrow_type(_parse_datatype_string(item_type))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    if k == 0:
        schema += f", n_words long, hit_words array<long>, item_ids array<{item_type}>"
    return arrow_map(docs, scan, schema)


def merge_runs(x: list[int], y: list[int]) -> list[int]:
    """The union of two lists of runs (start, end, start, end, ...)."""
    out: list[int] = []
    for a, b in sorted([*zip(x[::2], x[1::2]), *zip(y[::2], y[1::2])]):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def n_hit():
    """Hit words, from ``hit_words``: the ends less the starts."""
    return F.aggregate("hit_words", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("s")),
                       lambda acc, x: F.struct((acc["n"] + acc["s"] * x).alias("n"), (-acc["s"]).alias("s")), lambda acc: acc["n"])


def drop_contaminated(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
    item_id: str = "item_id", item_text: str = "text", text_column: str = "text",
) -> DataFrame:
    """The rows of ``docs`` in which no window of a test item occurs, with their columns as they are.

    Null and empty texts stay. Test items are taken as ``scan_documents`` takes them.
    """
    import pickle

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    for k, block in enumerate(item_blocks(items, item_id, item_text, block_bytes, window)):
        if k:
            docs = stage(docs, "clean")
        shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(block))

        def clean(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            tests, texts = _test_set(shared.value, window), texts_of(batch, text_column)
            flags = [not found for a, b in chunks(texts, 4 << 20) for _, _, found in tests.scan(texts[a:b])]
            return batch.filter(pa.array(flags, pa.bool_()))

        docs = arrow_map(docs, clean, schema)
    return docs


_W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_W}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_W}') AS w FROM benchmark),
iw AS (SELECT item_id, least({WINDOW}, len(w)) AS k, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS p, w FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, k, list_slice(w, p, p + k - 1) AS a FROM iw),
dw AS (SELECT r, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k),
dg AS (SELECT r, k, p, list_slice(w, p, p + k - 1) AS a FROM dw),
m AS (SELECT r, p, k, item_id FROM dg JOIN g USING (k, a)),
hits AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(range(p, p + k)) AS x FROM m) GROUP BY r),
its AS (SELECT r, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(its.s, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN its USING (r)
"""


@query("op8_decontaminate", SQL)
def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_documents(docs, table(spark, sf_dir, "benchmark")).drop("text")
    items = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        sha256_hex(F.array_join(items, ",").cast("binary")).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"),
    )
