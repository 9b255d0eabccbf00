"""Removal of repeated byte strings by suffix arrays over content-defined shards.

Every window of ``length`` bytes is filed under its anchor: the 32-byte string in it with the least
hash, leftmost on ties. Equal windows have equal anchors, so windows can only be equal within an
anchor. Neighbouring windows of one anchor form a segment, 69 windows at most at 100 bytes.

1. Each task finds the segments of its documents. Equal segments are gathered at once, as all but
   the earliest only repeat it.
2. Segments are sorted by anchor. Equal ones are gathered again over all documents; anchors that
   still have two different segments or more are packed into shards of bounded size.
3. Each shard gets a suffix array and common prefixes, which put equal windows into classes; every
   window but the earliest of its class repeats. An anchor with more segments than a shard holds
   lies in several; the shards' sorted windows are then merged by binary search.
4. The repeated runs of a document are joined to its text and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType

from farsight.llm.common import arrow_map, plan_bytes, sha256_hex, shuffle_parts, stage, texts_of
from farsight.llm.registry import query, table
from farsight.llm.suffix_arrays import MAX_SYMBOLS, merge_runs, window_classes

LENGTH = 100
GRAM = 32
# Bytes of text that a task looks at together; positions take 24 bits.
SLICE = 2 << 20
_POSITION = (1 << 24) - 1
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C[3]
    return (x ^ (x >> np.uint64(27))) * _C[4]


def _gram_hashes(data: bytes) -> np.ndarray:
    """A hash of the 32 bytes from each position on."""
    n = len(data)
    padded = data + b"\0" * 40
    words = np.empty(n, np.uint64)
    for k in range(min(8, n)):
        words[k::8] = np.frombuffer(padded, "<u8", (n - k + 7) // 8, k)
    if n < GRAM:
        return words[:0]
    h8 = _mix(words * _C[0])
    h16 = _mix(h8[:-8] * _C[1] + h8[8:])
    return _mix(h16[:-16] * _C[2] + h16[16:])[: n - GRAM + 1]


def _window_minimum(key: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    return np.minimum(key[: len(key) - (width - have)], key[width - have :]) if width > have else key


def segments_of(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor hash, content hash) of the segments of some texts.

    The texts together have fewer than 2 ** 24 bytes.
    """
    data = b"".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    grams = _gram_hashes(data)
    windows = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if windows < 1:
        return none, none, none, none, none
    low = _window_minimum((grams & ~np.uint64(_POSITION)) | np.arange(len(grams), dtype=np.uint64), length - GRAM + 1)
    anchor = (low & np.uint64(_POSITION)).astype(np.int64)[:windows]
    valid = np.zeros(windows, bool)
    for a, b in zip((ends - sizes).tolist(), (ends - length + 1).tolist()):
        valid[a : max(a, b)] = True
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, none, none, none
    cut = np.flatnonzero((anchor[at][1:] != anchor[at][:-1]) | (at[1:] != at[:-1] + 1)) + 1
    first = np.concatenate(([0], cut))
    last = np.concatenate((cut, [len(at)])) - 1
    start, end, mark = at[first], at[last], anchor[at[first]]
    content = _mix((mark - start).astype(np.uint64) * _C[0] + (end - start).astype(np.uint64))
    for k in range(0, 2 * length - GRAM, GRAM):
        content = _mix(content * _C[1] + grams[np.minimum(start + k, end + length - GRAM)])
    doc = np.searchsorted(ends, start, side="right")
    return doc, start - (ends - sizes)[doc], end - start + 1, grams[mark].view(np.int64), content.view(np.int64)


def _slices(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts in lots of about ``SLICE`` bytes: (text number, offset, piece). Pieces of one text share
    the ``length - 1`` bytes that the windows of the earlier one run on."""
    who, base, lot, size = [], [], [], 0
    for k, text in enumerate(texts):
        for a in range(0, max(len(text) - length + 1, 1), SLICE):
            piece = text[a : a + SLICE + length - 1]
            if lot and size + len(piece) > SLICE + length:
                yield who, base, lot
                who, base, lot, size = [], [], [], 0
            who.append(k)
            base.append(a)
            lot.append(piece)
            size += len(piece)
    if lot:
        yield who, base, lot


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (document, start, end) with those that touch or overlap united."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = np.concatenate(([True], doc[1:] != doc[:-1]))
    group = np.cumsum(new)
    # Running maximum of the ends within a document: offsets keep documents apart.
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * far) - group * far
    head = new | np.concatenate(([True], start[1:] > reach[:-1]))
    first = np.flatnonzero(head)
    return doc[first], start[first], reach[np.concatenate((first[1:], [len(doc)])) - 1]


_SEGMENT = "part long, kind byte, anchor long, content long, uid long, start long, windows int"
_SEGMENT_TYPES = [pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
_NAMES = ["part", "kind", "anchor", "content", "uid", "start", "windows"]


def _segment_rows(kind: int, part, anchor, content, uid, start, windows) -> pa.RecordBatch:
    values = (part, np.full(len(uid), kind), anchor, content, uid, start, windows)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, _SEGMENT_TYPES)], names=_NAMES)


def find_segments(docs: DataFrame, length: int) -> DataFrame:
    """Segments (kind 0) of ``docs`` (uid, text), and repeated runs (kind 1: uid, start, bytes in ``windows``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column(0).to_numpy(zero_copy_only=False)
            for who, base, lot in _slices(texts_of(batch), length):
                doc, start, windows, anchor, content = segments_of(lot, length)
                if not len(doc):
                    continue
                uid, start = uids[np.array(who)][doc], start + np.array(base, np.int64)[doc]
                order = np.lexsort((start, uid, content, anchor))
                a, c = anchor[order], content[order]
                again = np.zeros(len(order), bool)
                again[order[1:]] = (a[1:] == a[:-1]) & (c[1:] == c[:-1])
                own = ~again
                yield _segment_rows(0, anchor[own], anchor[own], content[own], uid[own], start[own], windows[own])
                if again.any():
                    d, s, e = merged(uid[again], start[again], start[again] + windows[again] + length - 1)
                    # Dealt over all partitions, by document and place.
                    yield _segment_rows(1, _mix((d + s).astype(np.uint64)).view(np.int64), np.zeros_like(d), np.zeros_like(d), d, s, e - s)

    return docs.mapInArrow(run, _SEGMENT)


_PACKED = "kind byte, shard long, wide boolean, uid long, start long, windows int"


def _packed(kind: int, shard, wide, uid, start, windows) -> pa.RecordBatch:
    values = (np.full(len(uid), kind), shard, wide, uid, start, windows)
    types = [pa.int8(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=["kind", "shard", "wide", "uid", "start", "windows"])


def pack_shards(segments: DataFrame, length: int) -> DataFrame:
    """Runs that repeat (kind 1) and segments to compare, by shard (kind 0).

    Rows come sorted by anchor and content, and are handled as a stream: what is held is one
    shard's worth of rows of the open anchor. ``wide`` marks anchors that span shards.
    """
    # A shard holds what is left of one anchor and another's beginning, of this many rows each.
    rows = MAX_SYMBOLS // (2 * length - GRAM + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        last = None  # (anchor, content) of the last row
        # Different segments of the open anchor; two at least make it a matter for a shard.
        held: list[np.ndarray] = [np.zeros((0, 4), np.int64)]
        open_wide, done = False, 0

        def shards_of(table: np.ndarray, wide_last: bool):
            """Shard numbers of complete anchors; of the last one row by row if it is wide."""
            nonlocal done
            head = np.concatenate(([True], table[1:, 0] != table[:-1, 0]))
            group = np.cumsum(head) - 1
            size = np.bincount(group)
            wide = np.zeros(len(size), bool)
            wide[size > rows] = True
            if wide_last:
                wide[-1] = True
            use = (size[group] > 1) | wide[group]
            table, group = table[use], group[use]
            place = done + np.arange(len(table))
            first = np.concatenate(([True], group[1:] != group[:-1]))[: len(group)]
            by = np.where(wide[group], place, np.maximum.accumulate(np.where(first, place, 0)))
            done += len(table)
            return _packed(0, base + by // rows, wide[group], table[:, 1], table[:, 2], table[:, 3])

        for batch in batches:
            kind, anchor, content, uid, start, windows = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 7))
            run_ = kind == 1
            if run_.any():
                yield _packed(1, np.zeros(run_.sum(), np.int64), np.zeros(run_.sum(), bool), uid[run_], start[run_], windows[run_])
            anchor, content, uid, start, windows = (x[~run_] for x in (anchor, content, uid, start, windows.astype(np.int64)))
            if not len(anchor):
                continue
            before = (anchor[0], content[0]) == last if last is not None else False
            again = np.concatenate(([before], (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])))
            last = (anchor[-1], content[-1])
            if again.any():
                d, s, e = merged(uid[again], start[again], start[again] + windows[again] + length - 1)
                yield _packed(1, np.zeros_like(d), np.zeros(len(d), bool), d, s, e - s)
            table = np.concatenate([*held, np.stack((anchor, uid, start, windows), 1)[~again]])
            if open_wide and len(table):
                # The open anchor is known to be wide: its further rows go on at once.
                own = int(np.searchsorted(table[:, 0] != table[0, 0], True)) if table[0, 0] == wide_anchor else 0
                if own:
                    yield shards_of(table[:own], True)
                    table = table[own:]
                if len(table) or anchor[-1] != wide_anchor:
                    open_wide = False
            if not len(table):
                held = [table]
                continue
            tail = int(np.flatnonzero(np.concatenate(([True], table[1:, 0] != table[:-1, 0])))[-1])
            if len(table) - tail > rows:
                yield shards_of(table, True)
                open_wide, wide_anchor, held = True, table[-1, 0], [table[:0]]
            else:
                if tail:
                    yield shards_of(table[:tail], False)
                held = [table[tail:]]
        table = np.concatenate(held)
        if len(table):
            yield shards_of(table, False)

    parts = shuffle_parts(segments.sparkSession)
    ordered = segments.repartition(parts, "part").sortWithinPartitions("kind", "anchor", "content", "uid", "start")
    return ordered.mapInArrow(run, _PACKED)


def fetch_segments(packed: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The bytes of the segments to compare: (shard, wide, uid, start, windows, bytes)."""
    wanted = packed.where("kind = 0").groupBy("uid").agg(F.collect_list(F.struct("shard", "wide", "start", "windows")).alias("wanted"))
    names = ["shard", "wide", "uid", "start", "windows", "bytes"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, data, lists in zip(batch.column(0).to_pylist(), texts_of(batch), batch.column(2)):
                flat = lists.values.flatten()
                shard, wide, start, windows = (x.to_numpy(zero_copy_only=False) for x in flat)
                out = [data[a : a + n + length - 1] for a, n in zip(start.tolist(), windows.tolist())]
                values = (shard, wide, np.full(len(out), uid), start, windows, out)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=names)

    return texts.join(wanted, "uid").select("uid", "text", "wanted").mapInArrow(cut, "shard long, wide boolean, uid long, start long, windows int, bytes binary")


_FOUND = "kind byte, uid long, start long, end long, bucket long, shard long, uids binary, starts binary, strings binary"


def compare_shards(segments: DataFrame, length: int, buckets: int) -> DataFrame:
    """Repeated runs (kind 1) of each shard, and the windows of wide anchors that other shards may hold (kind 2).

    A row of kind 2 is a sorted run: all windows of one shard and bucket, in the order of their strings.
    """

    def compare(shard: pa.Table) -> pa.Table:
        wide, uid, start, windows = (shard.column(k).to_numpy() for k in ("wide", "uid", "start", "windows"))
        pieces = shard.column("bytes").to_pylist()
        segment, offset, classes, slot = window_classes(pieces, windows.astype(np.int64), length)
        doc, at = uid[segment], start[segment] + offset
        order = np.lexsort((at, doc, classes))
        again = np.zeros(len(order), bool)
        again[order[1:]] = classes[order][1:] == classes[order][:-1]
        d, s, e = merged(doc[again], at[again], at[again] + length)
        names = ["kind", "uid", "start", "end", "bucket", "shard", "uids", "starts", "strings"]
        types = [pa.int8(), *[pa.int64()] * 5, *[pa.binary()] * 3]
        columns = [pa.array(v, t) for v, t in zip((np.ones(len(d)), d, s, e), types)]
        columns += [pa.nulls(len(d), t) for t in types[4:]]
        ask = np.flatnonzero(~again & wide[segment])
        if len(ask):
            ask = ask[np.argsort(slot[ask])]
            strings = [pieces[k][o : o + length] for k, o in zip(segment[ask].tolist(), offset[ask].tolist())]
            bucket = np.array([hash_of(x) % buckets for x in strings], np.int64)
            strings, number, rows = np.array(strings, f"V{length}"), shard.column("shard")[0].as_py(), []
            order = np.argsort(bucket, kind="stable")
            for of in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                rows.append((2, None, None, None, bucket[of[0]], number, doc[ask[of]].tobytes(), at[ask[of]].tobytes(), strings[of].tobytes()))
            columns = [pa.concat_arrays([c, pa.array(v, t)]) for c, v, t in zip(columns, zip(*rows), types)]
        return pa.Table.from_arrays(columns, names=names)

    return segments.groupBy("shard").applyInArrow(compare, _FOUND)


def hash_of(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data)


def merge_shards(found: DataFrame, length: int) -> DataFrame:
    """Runs (uid, start, end) of windows that occur earlier in another shard, by binary search per bucket of strings."""

    def merge(rows: pa.Table) -> pa.Table:
        runs = []
        for uids, starts, strings in zip(*(rows.column(k).to_pylist() for k in ("uids", "starts", "strings"))):
            runs.append((np.frombuffer(strings, f"S{length}"), np.frombuffer(uids, np.int64), np.frombuffer(starts, np.int64)))
        again = merge_runs(runs)
        uid, start = (np.concatenate([run[k][flag] for run, flag in zip(runs, again)]) for k in (1, 2))
        d, s, e = merged(uid, start, start + length)
        return pa.table({"uid": pa.array(d, pa.int64()), "start": pa.array(s, pa.int64()), "end": pa.array(e, pa.int64())})

    return found.where("kind = 2").groupBy("bucket").applyInArrow(merge, "uid long, start long, end long")


def _numbered(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, bool]:
    """(uid, doc_id, text), whether uid is doc_id: uid is unique and in document order.

    Unique integer ids number themselves; else the rows are sorted by id and text, written, and
    numbered in that order, nulls first.
    """
    plain = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = plain.schema["doc_id"].dataType
    if isinstance(kind, (IntegerType, LongType)):
        clash = plain.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
        if clash.isEmpty():
            return plain.select(F.col("doc_id").cast("long").alias("uid"), "doc_id", "text"), True
    return stage(plain.sort("doc_id", "text").select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text"), "numbered"), False


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text", buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, spans, kept.

    A byte goes if a string of ``length`` bytes over it also starts earlier: in a document that
    comes before, or further left. ``spans`` holds start and end (exclusive) of the removed runs in
    turn, ``kept`` the other bytes. Documents come in the order of their ids, null ids first, rows
    of one id by their text. Null and empty texts have no bytes; texts below ``length`` lose none.
    """
    if length <= GRAM:
        raise ValueError(f"strings have more than {GRAM} bytes")
    spark = docs.sparkSession
    rows, own = _numbered(docs, id_column, text_column)
    texts = rows.select("uid", "text")
    packed = stage(pack_shards(find_segments(texts, length), length), "shards")
    # At most one window starts at a byte, so a bucket of strings has about 2 ** 20 rows at worst.
    found = compare_shards(fetch_segments(packed, texts, length), length, buckets or max(16, plan_bytes(rows) >> 20))
    runs = packed.where("kind = 1").select("uid", "start", (F.col("start") + F.col("windows")).alias("end"))
    if not packed.where("wide").isEmpty():
        found = stage(found, "found")
        runs = runs.union(merge_shards(found, length))
    runs = runs.union(found.where("kind = 1").select("uid", "start", "end"))
    runs = runs.groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, removed, count, spans, kept = [], [], [], [], []
        for data, found_ in zip(texts_of(batch), batch.column(2)):
            start = end = np.zeros(0, np.int64)
            if found_.is_valid:
                start, end = (x.to_numpy(zero_copy_only=False) for x in found_.values.flatten())
                _, start, end = merged(np.zeros(len(start), np.int64), start, end)
            edges = [0, *np.stack((start, end), 1).ravel().tolist(), len(data)]
            n.append(len(data))
            removed.append(int((end - start).sum()))
            count.append(len(start))
            spans.append(edges[1:-1])
            kept.append(b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2])]))
        columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    joined = texts.join(runs, "uid", "left")
    if own:
        joined = joined.select(F.col("uid").cast(kind).alias("doc_id"), "text", "runs")
    else:
        joined = joined.join(rows.select("uid", "doc_id"), "uid").select("doc_id", "text", "runs")
    return arrow_map(joined, apply, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary")


@query("op2_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 100-byte strings that occur earlier."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", sha256_hex("kept").alias("kept_sha256"))
