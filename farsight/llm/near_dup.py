"""Near duplicates by b-bit MinHash, confirmed on the full shingle sets.

Documents of one shingle set form a class; only classes go on. Bands of minima give buckets. In a
bucket the class with the least key leads; the others are compared with it by their packed b-bit
signatures, whose share of equal values is corrected for chance, and what may reach the threshold is
confirmed on the sets. What a bucket holds of likely links between components that no confirmed
link joins yet makes groups for a second round, in which the sets of a group meet and are compared
by matrix products. Links give components, so copies and groups never expand into rows of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType

from farsight.llm.common import arrow_map, shuffle_parts, stage, texts_of
from farsight.llm.components import connected_components
from farsight.llm.registry import query, table
from farsight.llm.toxicity import WordHashes

BANDS, ROWS, BITS = 24, 4, 2
HASHES = BANDS * ROWS
# Standard deviations below the threshold at which a signature still makes a pair a candidate.
MARGIN = 4.0
# Members of a centre that are confirmed in one task.
PER_TASK = 256
# Classes of a second-round group whose sets meet in one task.
GROUP = 1024

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SEED = np.random.default_rng(20240229)
_A = (_SEED.integers(0, 1 << 63, HASHES, np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _SEED.integers(0, 1 << 63, HASHES, np.uint64)
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9)]
_words = WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _P[3]
    return x ^ (x >> np.uint64(29))


def shingle_set(data: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; a shorter text is one shingle."""
    get = _words.__getitem__
    words = data.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter((get(w) for w in words), np.uint64, len(words))
    size = min(size, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = _mix(out * _P[0] + h[k : k + n])
    return np.unique(out)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of the set under each hash function."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        low = np.minimum(low, (shingles[None, i : i + 1024] * _A[:, None] + _B[:, None]).min(axis=1))
    return _mix(low)


def pack(low: np.ndarray) -> bytes:
    """The low ``BITS`` bits of each minimum, packed."""
    bits = (low[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def band_keys(low: np.ndarray) -> list[int]:
    rows = low.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * _P[1] + rows[:, k])
    return key.view(np.int64).tolist()


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures: the share of equal values less the share of chance."""
    different = one[None, :] ^ many
    different |= different >> np.uint8(1)
    unequal = np.bitwise_count(different & np.uint8(0x55)).sum(axis=1)
    chance = 1.0 / (1 << BITS)
    return ((HASHES - unequal) / HASHES - chance) / (1.0 - chance)


def candidate_floor(threshold: float) -> float:
    chance = 1.0 / (1 << BITS)
    equal = threshold + (1 - threshold) * chance
    return threshold - MARGIN * float(np.sqrt(equal * (1 - equal) / HASHES)) / (1 - chance)


# --- stages of the operator -------------------------------------------------------


def signatures(docs: DataFrame, size: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, key, sig, bands); ``key`` digests the whole set and is null where it is empty."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, key, sig, bands = [], [], [], []
        for data in texts_of(batch):
            shingles = shingle_set(data, size)
            n.append(len(shingles))
            low = minima(shingles) if len(shingles) else None
            key.append(None if low is None else blake2b(shingles.tobytes(), digest_size=16).digest())
            sig.append(None if low is None else pack(low))
            bands.append(None if low is None else band_keys(low))
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "key", "sig", "bands"])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return arrow_map(rows, run, f"doc_id {kind}, n_shingles long, key binary, sig binary, bands array<long>")


def _groups(batches: Iterator[pa.RecordBatch], column: str = "band") -> Iterator[tuple[int, list[bytes], np.ndarray, list]]:
    """Runs of one ``column`` value in rows sorted by it, cut at batch ends: (value, keys, signatures, roots)."""
    for batch in batches:
        value = batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)
        keys = batch.column(batch.schema.get_field_index("key")).to_pylist()
        sig = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("sig")).to_pylist()), np.uint8).reshape(len(keys), -1)
        root = batch.schema.get_field_index("root")
        roots = batch.column(root).to_pylist() if root >= 0 else [None] * len(keys)
        edges = np.concatenate(([0], np.flatnonzero(value[1:] != value[:-1]) + 1, [len(value)]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield int(value[a]), keys[a:b], sig[a:b], roots[a:b]


def _pairs_batch(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    a, b = zip(*pairs)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _lead(batches: Iterator[pa.RecordBatch], floor: float) -> Iterator[pa.RecordBatch]:
    """Round 1: each member of a bucket with the first leader that it resembles.

    A member that resembles no leader leads from then on. Leaders of the open bucket are kept from
    batch to batch; members are not.
    """
    current, leaders, lead_sig = None, [], np.zeros((0, HASHES * BITS // 8), np.uint8)
    for value, keys, sig, _ in _groups(batches):
        if value != current:
            current, leaders, lead_sig = value, [], sig[:0]
        pairs, rest = [], np.arange(len(keys))
        for k in range(len(leaders)):
            if not len(rest):
                break
            near = estimate(lead_sig[k], sig[rest]) >= floor
            pairs += [(leaders[k], keys[i]) for i in rest[near].tolist()]
            rest = rest[~near]
        fresh = []
        while len(rest):
            first, rest = rest[0], rest[1:]
            fresh.append(int(first))
            if len(rest):
                near = estimate(sig[first], sig[rest]) >= floor
                pairs += [(keys[first], keys[i]) for i in rest[near].tolist()]
                rest = rest[~near]
        leaders += [keys[i] for i in fresh]
        lead_sig = np.concatenate((lead_sig, sig[fresh]))
        if pairs:
            yield _pairs_batch(pairs)


def _across(batches: Iterator[pa.RecordBatch], floor: float) -> Iterator[pa.RecordBatch]:
    """Round 2: what joins the classes of a bucket that may be links and are in different components.

    Of all such pairs of a bucket only those are given that join two parts of it, at most one a
    class. Earlier blocks of the open bucket are kept packed, at 40 bytes a class and its root.
    """
    current, keys0, roots0, sig0, part = None, [], np.zeros(0, object), None, np.zeros(0, np.int64)
    for value, keys, sig, roots in _groups(batches):
        roots = np.array(roots, object)
        if value != current:
            current, keys0, roots0, sig0, part = value, [], roots[:0], sig[:0], part[:0]
        start = len(keys0)
        keys0, roots0, sig0 = keys0 + keys, np.concatenate((roots0, roots)), np.concatenate((sig0, sig))
        part = np.concatenate((part, np.arange(start, len(keys0))))
        if len(set(roots0.tolist())) < 2:
            continue
        pairs = []
        for i in range(max(1, start), len(keys0)):
            other = np.flatnonzero((roots0[:i] != roots0[i]) & (part[:i] != part[i]))
            if len(other):
                near = other[estimate(sig0[i], sig0[other]) >= floor]
                for j in near[np.unique(part[near], return_index=True)[1]].tolist():
                    pairs.append((keys0[j], keys0[i]))
                    part[part == part[j]] = part[i]
        if pairs:
            yield _pairs_batch(pairs)


def _set_rows(wanted: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(centre, task, role, key, shingles): the set of each class for all it is wanted for.

    ``wanted`` has a row per class: key and ``to``, an array of (centre, task, role). Sets are made
    anew from one text of the class. Rows come dealt and sorted by centre and task, then role.
    """
    wanted = wanted.join(classes.select("key", "doc_id"), "key")
    texts = docs.select(F.col("doc_id").alias("_id"), "text")
    found = texts.join(wanted, F.col("_id").eqNullSafe(F.col("doc_id"))).select("key", "to", "text")

    names, types = ["centre", "task", "role", "key", "shingles"], [pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for key, targets, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch)):
                shingles = shingle_set(data, size).tobytes()
                # Rows that repeat an id with another text are no member of the class.
                if blake2b(shingles, digest_size=16).digest() != key:
                    continue
                for t in targets:
                    rows.append((t["centre"], t["task"], t["role"], key, shingles))
                    held += len(shingles)
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)

    dealt = found.mapInArrow(sets, "centre binary, task int, role int, key binary, shingles binary")
    return dealt.repartition(shuffle_parts(docs.sparkSession), "centre", "task").sortWithinPartitions("centre", "task", "role", "key")


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of class keys whose full sets reach the threshold.

    Every set goes to the centre ``a``; the members of a centre are dealt over as many tasks as they
    need, each with a copy of the centre's set.
    """
    members = pairs.groupBy("a").agg(F.count("*").alias("members")).withColumn("tasks", F.ceil(F.col("members") / PER_TASK).cast("int"))
    as_member = pairs.join(members, "a").select(
        F.col("b").alias("key"), F.col("a").alias("centre"), F.pmod(F.xxhash64("b"), "tasks").cast("int").alias("task"), F.lit(1).alias("role"))
    as_centre = members.select(F.col("a").alias("key"), F.col("a").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("role"))
    wanted = as_member.union(as_centre).groupBy("key").agg(F.collect_list(F.struct("centre", "task", "role")).alias("to"))
    dealt = _set_rows(wanted, classes, docs, size)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, None
        for batch in batches:
            links = []
            for a, task, role, b, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if role == 0:
                    at, centre = (a, task), np.frombuffer(data, np.uint64)
                elif at == (a, task):
                    other = np.frombuffer(data, np.uint64)
                    both = len(centre) + len(other)
                    common = both - len(np.union1d(centre, other))
                    if 100 * common >= percent * (both - common):
                        links.append((a, b))
            if links:
                yield _pairs_batch(links)

    return dealt.mapInArrow(check, "a binary, b binary").distinct()


def shared_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many elements each two sets share, by products of membership matrices."""
    sizes = [len(x) for x in sets]
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    # An element of one set only is shared by nobody.
    renamed = np.cumsum(count > 1) - 1
    used = count[column] > 1
    row, column = row[used], renamed[column[used]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for a in range(0, int((count > 1).sum()), columns):
        i, j = np.searchsorted(column, (a, a + columns))
        member = np.zeros((len(sets), columns), np.float32)
        member[row[i:j], column[i:j] - a] = 1
        out += member @ member.T
    return out


def _joined(sets: list[np.ndarray], keys: list[bytes], block: np.ndarray, percent: int) -> list[tuple[bytes, bytes]]:
    """Links that join what the sets' similarity joins: a spanning forest, in different blocks if there are two."""
    size = np.array([len(x) for x in sets], np.float64)
    common = shared_counts(sets)
    linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    if block.min() != block.max():
        linked &= block[:, None] != block[None, :]
    links, seen = [], np.zeros(len(sets), bool)
    for k in range(len(sets)):
        if seen[k]:
            continue
        seen[k], open_ = True, [k]
        while open_:
            i = open_.pop()
            fresh = np.flatnonzero(linked[i] & ~seen)
            seen[fresh] = True
            links += [(keys[i], keys[j]) for j in fresh.tolist()]
            open_ += fresh.tolist()
    return links


def join_groups(members: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between the classes of each group of ``members`` (node, root), enough to join all that are linked.

    A group's sets meet in one task. A group of more than ``GROUP`` classes is cut into blocks, and
    each two blocks meet in one task, so that no pair is left out and no task grows.
    """
    count = members.groupBy("root").agg(F.count("*").alias("n"))
    blocks = members.join(count, "root").withColumn("blocks", F.when(F.col("n") <= GROUP, 1).otherwise(F.ceil(F.col("n") * 2 / GROUP)).cast("int"))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    to = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(F.col("root").alias("centre"), (F.least("block", j) * F.col("blocks") + F.greatest("block", j)).cast("int").alias("task"), F.col("block").alias("role")))
    dealt = _set_rows(blocks.select(F.col("node").alias("key"), to.alias("to")), classes, docs, size)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets, keys, block = None, [], [], []
        for batch in batches:
            for centre, task, role, key, data in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (centre, task):
                    if len(sets) > 1 and (links := _joined(sets, keys, np.array(block), percent)):
                        yield _pairs_batch(links)
                    at, sets, keys, block = (centre, task), [], [], []
                if not keys or keys[-1] != key:
                    sets.append(np.frombuffer(data, np.uint64))
                    keys.append(key)
                    block.append(role)
        if len(sets) > 1 and (links := _joined(sets, keys, np.array(block), percent)):
            yield _pairs_batch(links)

    return dealt.mapInArrow(link, "a binary, b binary")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 times the shingles they share reach ``percent`` times those of
    their union. ``component_id`` is the least id that links reach; ``kept`` holds for that document.
    Null and empty texts have no shingles and no links; their component is their own id. A null
    id is never the least; a component of null ids alone has a null ``component_id``, and rows
    with a null id are kept only there. Repeated rows are copies of each other like any others.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    marks = stage(signatures(plain, size), "minhash")
    classes = stage(
        marks.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "classes")
    banded = classes.select(F.explode("bands").alias("band"), "key", "sig")
    floor = candidate_floor(percent / 100)
    parts = shuffle_parts(spark)

    def multiple(batches):
        """Rows whose band another row of the partition shares; the last row of a batch is held back."""
        last, alone = None, True
        for batch in batches:
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            value = batch.column(0).to_numpy(zero_copy_only=False)
            same = value[1:] == value[:-1]
            shared = np.concatenate(([not alone], same)) | np.concatenate((same, [False]))
            last, alone = batch.slice(len(value) - 1), not shared[-1]
            if out := batch.slice(0, len(value) - 1).filter(pa.array(shared[:-1])):
                yield out
        if last is not None and not alone:
            yield last

    buckets = banded.repartition(parts, "band").sortWithinPartitions("band", "key")
    shared = stage(buckets.mapInArrow(multiple, "band long, key binary, sig binary"), "buckets")
    ordered = shared.repartition(parts, "band").sortWithinPartitions("band", "key")
    first = stage(ordered.mapInArrow(lambda b: _lead(b, floor), "a binary, b binary").distinct(), "pairs")
    links = stage(confirm(first, classes, plain, size, percent), "confirmed")
    roots = connected_components(links)
    labelled = shared.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    ordered = labelled.repartition(parts, "band").sortWithinPartitions("band", "key")
    near = stage(ordered.mapInArrow(lambda b: _across(b, floor), "a binary, b binary").distinct(), "near")
    if not near.isEmpty():
        more = stage(join_groups(connected_components(near), classes, plain, size, percent), "joined")
        roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    of_class = classes.select("key", "doc_id").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = of_class.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    components = of_class.join(least, "root").select("key", "component_id")
    rows = marks.select("doc_id", "n_shingles", "key").join(components, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one of the least id, of rows with one id the first by text.

    Unlinked rows all stay, those without words too. Ids that repeat or are null are told apart by a
    number in a written copy of the rows.
    """
    uid = "_row_of_" + "_".join(docs.columns)
    clash = docs.groupBy(id_column).agg(F.count("*").alias("n")).where(F.col(id_column).isNull() | (F.col("n") > 1))
    if isinstance(docs.schema[id_column].dataType, (IntegerType, LongType)) and clash.isEmpty():
        rows = docs.withColumn(uid, F.col(id_column).cast("long"))
    else:
        rows = stage(docs.sort(id_column, text_column).withColumn(uid, F.monotonically_increasing_id()), "rows")
    # Far fewer rows go than stay, so the ones that go are joined.
    gone = near_duplicates(rows, size, percent, uid, text_column).where("NOT kept").select(F.col("doc_id").alias(uid))
    return rows.join(gone, uid, "left_anti").select(*docs.columns)


_W = r"[^\x20\x09-\x0D]+"
SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS w FROM documents),
e AS (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 2))) AS p FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT r, list_slice(w, p, p + 2) AS g FROM e),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
x AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
l AS (SELECT x.a, x.b FROM x JOIN n na ON na.r = x.a JOIN n nb ON nb.r = x.b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
c AS (SELECT r AS a, r AS b FROM d UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
m AS (SELECT c.a AS r, min(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.b GROUP BY c.a)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN m USING (r) LEFT JOIN n USING (r)
"""


@query("op7_near_duplicates", SQL)
def near_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at three words and 85 %."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, percent=85)
