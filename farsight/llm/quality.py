"""Quality rules as a short-circuit cascade.

Base statistics are computed for every document. The rules after them are ordered by rejections
per second, both estimated on a bounded sample, and each document meets them in that order until
one rejects it. The order changes the cost alone: a document is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from farsight.llm.common import arrow_map, texts_of
from farsight.llm.registry import query, table

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
# Letters and bytes beyond ASCII become "a", white space stays, all else goes.
_LETTERS = bytes(0x61 if chr(b).isalpha() or b > 0x7F else b for b in range(256))
_NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha() and b not in SPACE)


class Doc:
    """One text with what the rules share; everything beyond the words is computed on demand."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.words = data.split()
        self.n_words = len(self.words)

    def word_chars(self) -> int:
        return len(self.data.translate(None, _CONTINUATION + SPACE))

    def symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    def lines(self) -> list[bytes]:
        return [x for x in self.data.split(b"\n") if x.strip()]

    def repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        counts = Counter(windows)
        n = upto = 0
        for i, window in enumerate(windows):
            if counts[window] > 1:
                n += i + 3 - max(i, upto)
                upto = i + 3
        return n


def few_letters(doc: Doc) -> bool:
    """Under 70 % of the words hold a letter (ASCII, or any character beyond it)."""
    return 10 * len(doc.data.translate(_LETTERS, _NO_LETTERS).split()) < 7 * doc.n_words


def many_symbols(doc: Doc) -> bool:
    """More than one symbol to ten words."""
    return 10 * doc.symbols() > doc.n_words


def shouting(doc: Doc) -> bool:
    """Over 30 % of the words have two bytes or more, an ASCII capital and no small ASCII letter."""
    return 10 * sum(len(w) > 1 and w.isupper() for w in doc.words) > 3 * doc.n_words


def same_lines(doc: Doc) -> bool:
    """Over 40 % of the lines with a word equal an earlier one."""
    lines = doc.lines()
    return 10 * (len(lines) - len(set(lines))) > 4 * len(lines)


def odd_words(doc: Doc) -> bool:
    """Words of under 2 or over 15 code points on average."""
    chars = doc.word_chars()
    return chars < 2 * doc.n_words or chars > 15 * doc.n_words


def one_word(doc: Doc) -> bool:
    """One word makes over 30 % of all words."""
    return 10 * max(Counter(doc.words).values(), default=0) > 3 * doc.n_words


@dataclass(frozen=True)
class Rule:
    """``rejects(doc)`` is asked of documents with at least one word."""

    name: str
    rejects: Callable[[Doc], bool] = field(compare=False)


RULES = tuple(Rule(f.__name__, f) for f in (few_letters, many_symbols, shouting, same_lines, odd_words, one_word))
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SAMPLE_ROWS = 512


def base_failed(n_words: int, n_repeat: int, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT) -> bool:
    return n_words < min_words or 100 * n_repeat > max_repeat * n_words


def order_rules(docs: DataFrame, rules=RULES, text_column: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` by rejections per second on a sample of at most ``sample_rows`` rows.

    The sample only chooses an order, never a verdict. An empty sample keeps the given order.
    """

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [d for d in map(Doc, texts_of(batch)) if d.n_words]
        costs, rejected = [], []
        for rule in rules:
            began = time.perf_counter()
            rejected.append(sum(rule.rejects(d) for d in found))
            costs.append(time.perf_counter() - began)
        return pa.RecordBatch.from_arrays(
            [pa.array([r.name for r in rules]), pa.array(costs), pa.array(rejected, pa.int64())], names=["rule", "cost", "rejected"]
        )

    sample = docs.select(F.col(text_column).alias("text")).limit(sample_rows)
    rows = arrow_map(sample, measure, "rule string, cost double, rejected long").groupBy("rule").agg(F.sum("cost"), F.sum("rejected")).collect()
    rate = {name: rejected / max(cost, 1e-9) for name, cost, rejected in rows}
    return sorted(rules, key=lambda r: -rate.get(r.name, 0.0))


def quality_cascade(
    docs: DataFrame, rules=RULES, id_column: str = "doc_id", text_column: str = "text", sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: id, base statistics, ``base_failed``, ``kept``, ``failed_rule``.

    A null text has no words, so it fails the base like an empty one. Repeated rows are judged
    each, null ids stay null, other columns are not read. ``failed_rule`` is ``base``, the rule
    that rejected the document first, or null.
    """
    ordered = order_rules(docs, rules, text_column, sample_rows)
    kind = docs.schema[id_column].dataType.simpleString()

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data in texts_of(batch):
            doc = Doc(data)
            lines = doc.lines()
            repeats = doc.repeat_words()
            failed = base_failed(doc.n_words, repeats)
            first = "base" if failed else next((r.name for r in ordered if r.rejects(doc)), None)
            rows.append((doc.n_words, doc.word_chars(), doc.symbols(), len(lines) - len(set(lines)), repeats, failed, first is None, first))
        columns = list(zip(*rows))
        types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    names = [id_column, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule"]
    schema = f"`{id_column}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, failed_rule string"
    return arrow_map(docs.select(F.col(id_column), F.col(text_column).alias("text")), judge, schema)


def keep_good(docs: DataFrame, rules=RULES, text_column: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that pass base and rules, with all their columns, in one pass."""
    ordered = order_rules(docs, rules, text_column, sample_rows)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        flags = []
        for data in texts_of(batch, text_column):
            doc = Doc(data)
            flags.append(not base_failed(doc.n_words, doc.repeat_words()) and not any(r.rejects(doc) for r in ordered))
        return batch.filter(pa.array(flags, pa.bool_()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow_map(docs, keep, schema)


_W = r"[^\x20\x09-\x0D]+"
VERDICT_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_W}') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS l FROM d),
tri AS (SELECT r, i, a FROM (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w), LATERAL (SELECT list_slice(w, i, i + 2) AS a)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a) AS c FROM tri) WHERE c > 1),
nrep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
top AS (SELECT r, max(c) AS c FROM (SELECT r, x, count(*) AS c FROM (SELECT r, unnest(w) AS x FROM w) GROUP BY r, x) GROUP BY r),
s AS (SELECT doc_id, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(nrep.n, 0) AS n_repeat_words, coalesce(top.c, 0) AS top,
  len(list_filter(w, lambda x: strlen(x) > 1 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper,
  len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\\x00-\\x7F]'))) AS n_alpha
  FROM w LEFT JOIN nrep USING (r) LEFT JOIN top USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s)
"""
SQL = f"""{VERDICT_SQL}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_alpha < 7 * n_words OR 10 * n_symbols > n_words OR 10 * n_upper > 3 * n_words
    OR 10 * n_dup_lines > 4 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * top > 3 * n_words) AS kept
FROM b
"""


@query("op3_quality_rules", SQL)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return quality_cascade(table(spark, sf_dir, "documents")).drop("failed_rule")
