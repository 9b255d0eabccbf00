"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters.

Blocked Bloom filters over the vocabulary, one or more per word length, are broadcast. Every word
generates its edits as hashes only, by the change that an edit makes to a polynomial hash, and probes
them. Only the edits that a filter holds become strings and go to an exact join with the vocabulary,
which removes the false positives.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from farsight.llm.common import shuffle_parts, stage, strings_of
from farsight.llm.registry import query, table

# Least code points and occurrences of a word, and how much more frequent its form is.
MIN_CHARS, MIN_COUNT, TIMES = 7, 2, 10
# Every so many-th (document, run) loses a code point.
DAMAGE = 31
# Words per filter; bits per word and set bits per probe; words per broadcast (3 bytes each).
SEGMENT, BITS, PROBES, ROUND = 1 << 18, 24, 5, 1 << 23
# Words of this length and longer share filters.
LONGEST = 64
# Distinct words that a task remembers before it hands their counts on.
REMEMBERED = 100_000
# Letters of the edits (a word holds no others); A-Z never occur in a lower-cased run.
LETTERS = np.array([*range(97, 123), *range(0xC0, 0x100)], dtype=np.uint64)

RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{MIN_CHARS},}}")
LOWER = {upper: upper + 32 for upper in range(65, 91)}
# An odd multiplier, so that it can be divided by, and the mixing constants of splitmix64 (fixed values).
BASE = 0x9E3779B97F4A7C15
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


# --- words --------------------------------------------------------------------------


def words_of(doc_id: int | None, text: str) -> Iterator[tuple[str, int]]:
    """Words of a document with their counts, possibly in several parts; shorter runs give none."""
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text)).items():
        word = run.lower() if run.isascii() else run.translate(LOWER)
        h = zlib.crc32(word.encode(), prefix)
        if h % DAMAGE == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < MIN_CHARS:
                continue
        yield word, n


def vocabulary(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n) of all words that occur often enough; counted in each task before they move."""

    def run(batches):
        counts: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), strings_of(batch), strict=True):
                for word, n in words_of(doc_id, text):
                    counts[word] += n
                if len(counts) >= REMEMBERED:
                    yield pa.record_batch({"word": list(counts), "n": pa.array(counts.values(), pa.int64())})
                    counts.clear()
        if counts:
            yield pa.record_batch({"word": list(counts), "n": pa.array(counts.values(), pa.int64())})

    counts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


# --- hashes and filters ---------------------------------------------------------------


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


def _powers(length: int) -> np.ndarray:
    powers = np.full(length, BASE, np.uint64)
    powers[:1] = 1
    return np.cumprod(powers, dtype=np.uint64)


def _codes(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of code points, all of which fit a byte."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1).astype(np.uint64)


def hashes(words: list[str]) -> np.ndarray:
    """Polynomial hashes of words of one length."""
    codes = _codes(words)
    return (codes * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def _bits(mixed: np.ndarray) -> np.ndarray:
    """The bits of a block that a key sets: one per six bits of its hash."""
    bits = np.zeros(len(mixed), np.uint64)
    for k in range(PROBES):
        bits |= np.uint64(1) << ((mixed >> np.uint64(6 * k)) & np.uint64(63))
    return bits


def _block(mixed: np.ndarray, blocks: int) -> np.ndarray:
    return ((mixed >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def _segment(h: np.ndarray, segments: int) -> np.ndarray:
    return _mixed(h ^ np.uint64(BASE)) % np.uint64(segments)


def make_filter(h: np.ndarray) -> np.ndarray:
    """A blocked Bloom filter: every key sets its bits in one 64-bit block."""
    mixed = _mixed(h)
    blocks = np.zeros(max(1, len(h) * BITS // 64 + 1), np.uint64)
    np.bitwise_or.at(blocks, _block(mixed, len(blocks)).astype(np.int64), _bits(mixed))
    return blocks


def _by_length(words: list[str]) -> Iterator[tuple[int, list[int]]]:
    places: dict[int, list[int]] = {}
    for k, word in enumerate(words):
        places.setdefault(len(word), []).append(k)
    yield from places.items()


class Filters:
    """Filters by (length class, segment) and the number of segments per class."""

    def __init__(self, segments: dict[int, int], filters: dict[tuple[int, int], np.ndarray]) -> None:
        self.segments, self.filters = segments, filters

    def holds(self, length: int, h: np.ndarray) -> np.ndarray:
        """Places in ``h`` of the hashes of words of ``length`` that a filter of this round holds."""
        cls = min(length, LONGEST)
        count = self.segments.get(cls, 0)
        if not count:
            return np.zeros(0, np.int64)
        segment = _segment(h, count) if count > 1 else None
        found = []
        for s in range(count):
            blocks = self.filters.get((cls, s))
            if blocks is None:
                continue
            at = np.arange(len(h)) if segment is None else np.flatnonzero(segment == s)
            mixed = _mixed(h[at])
            bits = _bits(mixed)
            found.append(at[(blocks[_block(mixed, len(blocks)).astype(np.int64)] & bits) == bits])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def edits(words: list[str], filters: Filters) -> Iterator[tuple[int, str]]:
    """(place, edit) for words of one length: their deletions, and replacements by a later letter, that a filter holds.

    Insertions are the deletions of the longer word and replacements by an earlier letter those of the other
    word by a later one, so that every pair is generated once, from one of its words.
    """
    codes = _codes(words)
    n, length = codes.shape
    powers = _powers(length)
    terms = codes * powers
    total = terms.sum(axis=1, dtype=np.uint64)
    upto = np.cumsum(terms, axis=1, dtype=np.uint64)
    # Without a letter, all later ones count one power less; in a run of one letter only the first goes.
    inverse = np.uint64(pow(BASE, -1, 1 << 64))
    shorter = (upto - terms) + (total[:, None] - upto) * inverse
    first = np.ones((n, length), bool)
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    rows, places = np.nonzero(first)
    for k in filters.holds(length - 1, shorter[rows, places]).tolist():
        word, at = words[rows[k]], places[k]
        yield rows[k], word[:at] + word[at + 1 :]
    for letter in LETTERS:
        rows, places = np.nonzero(codes < letter)
        changed = total[rows] + (letter - codes[rows, places]) * powers[places]
        for k in filters.holds(length, changed).tolist():
            word, at = words[rows[k]], places[k]
            yield rows[k], word[:at] + chr(int(letter)) + word[at + 1 :]


def build_filters(words: DataFrame, segments: dict[int, int], classes: list[tuple[int, int]]) -> Filters:
    """The filters of the (length class, segment) pairs ``classes``, each built by one task from at most about ``SEGMENT`` hashes."""
    wanted = set(classes)

    def hashed(batches):
        for batch in batches:
            found = batch.column(0).to_pylist()
            for length, places in _by_length(found):
                h = hashes([found[k] for k in places])
                cls = min(length, LONGEST)
                segment = _segment(h, segments[cls]).astype(np.int32)
                keep = np.isin(segment, [s for c, s in wanted if c == cls])
                if keep.any():
                    yield pa.record_batch({"cls": np.full(keep.sum(), cls, np.int32), "segment": segment[keep], "h": h[keep].view(np.int64)})

    def build(rows: pa.Table) -> pa.Table:
        blocks = make_filter(rows["h"].to_numpy().view(np.uint64))
        return pa.table({"cls": rows["cls"].slice(0, 1), "segment": rows["segment"].slice(0, 1), "blocks": [blocks.tobytes()]})

    lengths = F.least(F.length("word"), F.lit(LONGEST)).isin(sorted({c for c, _ in classes}))
    built = words.where(lengths).select("word").mapInArrow(hashed, "cls int, segment int, h long").groupBy("cls", "segment").applyInArrow(build, "cls int, segment int, blocks binary")
    return Filters(segments, {(r.cls, r.segment): np.frombuffer(r.blocks, np.uint64) for r in built.collect()})


def rounds_of(sizes: dict[int, int], segment: int = SEGMENT, limit: int = ROUND) -> tuple[dict[int, int], list[list[tuple[int, int]]]]:
    """Segments per length class, and the filters of each round, whose words are about ``limit`` at most."""
    segments = {cls: -(-n // segment) for cls, n in sizes.items()}
    rounds: list[list[tuple[int, int]]] = []
    room = 0
    for cls in sorted(sizes):
        for s in range(segments[cls]):
            size = -(-sizes[cls] // segments[cls])
            if not rounds or size > room:
                rounds.append([])
                room = limit
            rounds[-1].append((cls, s))
            room -= size
    return segments, rounds


# --- neighbours and forms -------------------------------------------------------------


def near_pairs(words: DataFrame, segment: int = SEGMENT, limit: int = ROUND) -> DataFrame:
    """(word, n, other, other_n), each pair of words one edit apart once, of a written vocabulary (word, n).

    The filters are broadcast in rounds of bounded size; a vocabulary beyond one round is probed once per
    round, by the words of the lengths in question.
    """
    spark = words.sparkSession
    sizes = {r.cls: r.n for r in words.groupBy(F.least(F.length("word"), F.lit(LONGEST)).alias("cls")).agg(F.count("*").alias("n")).collect()}
    segments, rounds = rounds_of(sizes, segment, limit)
    found = None
    for classes in rounds:
        shared = spark.sparkContext.broadcast(build_filters(words, segments, classes))

        def probe(batches, shared=shared):
            for batch in batches:
                texts, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                for length, places in _by_length(texts):
                    # Matrices of about a quarter of a million letters.
                    step = max(1, (1 << 18) // length)
                    for k in range(0, len(places), step):
                        part = places[k : k + step]
                        hits = list(edits([texts[p] for p in part], shared.value))
                        if hits:
                            at = [part[row] for row, _ in hits]
                            yield pa.record_batch({"word": [texts[p] for p in at], "n": counts[at], "other": [edit for _, edit in hits]})

        reach = sorted({c for cls, _ in classes for c in (cls, cls + 1)} - {LONGEST + 1})
        # A word takes far longer to probe than to move.
        asked = words.where(F.least(F.length("word"), F.lit(LONGEST)).isin(reach)).select("word", "n").repartition(shuffle_parts(spark), "word")
        edited = asked.mapInArrow(probe, "word string, n long, other string")
        found = edited if found is None else found.unionAll(edited)
    if found is None:
        found = words.select("word", "n", F.col("word").alias("other")).where(F.lit(False))
    exact = words.select(F.col("word").alias("_word"), F.col("n").alias("other_n"))
    return found.join(exact, F.col("other") == F.col("_word")).select("word", "n", "other", "other_n")


def forms(words: DataFrame, pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """Each word (word, n) with ``n_near``, ``form`` and ``form_n``."""
    either = pairs.select(F.explode(F.array(
        F.struct(F.col("word"), F.col("other_n").alias("n"), F.col("other")), F.struct(F.col("other").alias("word"), F.col("n"), F.col("word").alias("other")))).alias("p"))
    best = either.groupBy(F.col("p.word").alias("_word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("p.n")).alias("n"), F.col("p.other").alias("word"))).alias("best"))
    joined = words.join(best, F.col("word") == F.col("_word"), "left")
    taken = -F.col("best.n") >= F.col("n") * times
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("best.word")).alias("form"), F.when(taken, -F.col("best.n")).alias("form_n"))


def roots(formed: DataFrame, times: int = TIMES) -> DataFrame:
    """``formed`` with ``root``, the last word that following forms leads to.

    Every form is ``times`` as frequent as its word, which bounds the way; each round doubles it.
    """
    top = formed.agg(F.max("n")).head()[0] or MIN_COUNT
    steps = max(1, math.floor(math.log(max(top / MIN_COUNT, 1), times)) + 1)
    chain = formed.where("form is not null").select("word", F.col("form").alias("root"))
    for k in range(math.ceil(math.log2(steps))):
        chain = stage(chain, f"spelling-chain-{k}")
        further = chain.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        chain = chain.join(further, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"))
    last = chain.select(F.col("word").alias("_word"), "root")
    return formed.join(last, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the corpus.

    Null and empty texts have no words, and a null id counts as an empty one. Repeated rows count each. The ids
    matter as the contract of the operator damages one in ``DAMAGE`` (document, run) pairs by them. A run of any length is one word;
    an empty table gives no rows; other columns are not read.
    """
    words = stage(vocabulary(docs, id_column, text_column), "spelling-words")
    formed = stage(forms(words, near_pairs(words)), "spelling-forms")
    return roots(formed)


# The same in SQL: words that share what is left of them without the code point of one place, or one of which is that.
_SQL = f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
  runs AS (SELECT doc_id, run, count(*) AS n FROM (
      SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
    WHERE len(run) >= {MIN_CHARS} GROUP BY ALL),
  hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id || ':' || run, ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))),
      lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) AS h FROM runs, crc),
  words AS (SELECT word, sum(n)::BIGINT AS n FROM (
      SELECT CASE WHEN h % {DAMAGE} = 0 THEN left(run, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, n FROM hashed)
    WHERE len(word) >= {MIN_CHARS} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
  less AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, len(word) + 1)) AS i FROM words)),
  pairs AS (SELECT a.word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT l.word, w.word FROM less l JOIN words w ON l.rest = w.word UNION SELECT w.word, l.word FROM less l JOIN words w ON l.rest = w.word),
  ranked AS (SELECT p.word, other, w.n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, other) AS rk
    FROM pairs p JOIN words w ON w.word = p.other),
  formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= {TIMES} * w.n THEN other END AS form, CASE WHEN r.n >= {TIMES} * w.n THEN r.n END AS form_n
    FROM words w LEFT JOIN ranked r ON r.word = w.word AND rk = 1),
  walk AS (SELECT word, word AS here, 0 AS step FROM formed UNION ALL SELECT k.word, f.form, step + 1 FROM walk k JOIN formed f ON f.word = k.here WHERE f.form IS NOT NULL)
  SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN (SELECT word, arg_max(here, step) AS root FROM walk GROUP BY word) USING (word)"""


@query("op12_spelling_variants", _SQL)
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words and forms."""
    return group_variants(table(spark, sf_dir, "documents"))
