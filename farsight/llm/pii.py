"""Personal data with DataFrame functions only.

Patterns propose spans, validators confirm them (Luhn for cards, mod-97 for account numbers, value
ranges for addresses and numbers), and words close to a span raise or lower its score. Spans of the
four base kinds always stay; those of the added kinds stay from a score on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from farsight.llm.common import sha256_hex
from farsight.llm.registry import query, table
from farsight.llm.spans import ends, free_of, matched, pieces

# Code points of context on either side, up to the next candidate of the same kind.
BEFORE, AFTER = 40, 20
# What a word of the context adds and takes, and the least score of an added span.
RAISE, LOWER, MIN_SCORE = 0.4, 0.3, 0.6

UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``pattern`` proposes, ``confirm`` decides over the match, ``prior`` is the score of a confirmed
    span without context. ``words`` raise and ``against`` lower it. ``apart``: the characters next
    to the span must not be letters or digits. ``trigger``: a string without which nothing matches.
    """

    name: str
    pattern: str
    confirm: Callable[[Column], Column]
    prior: float
    words: str
    against: str
    base: bool = True
    apart: bool = False
    trigger: str | None = None


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _address(match: Column) -> Column:
    """Four parts of at most 255, leading zeros aside."""
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    return match.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _card(match: Column) -> Column:
    return F.length(_digits(match)).between(14, 19) & F.call_function("luhn_check", _digits(match))


def mod97(match: Column) -> Column:
    """An account number's remainder: the first four characters go last, letters count from 10."""
    code = F.translate(match, " ", "")
    moved = F.filter(F.split(F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4)), "(?!^)"), lambda c: c != "")
    step = lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(moved, F.lit(0), step)


def _account(match: Column) -> Column:
    return F.length(F.translate(match, " ", "")).between(15, 34) & (mod97(match) == 1)


def _national(match: Column) -> Column:
    """Area, group and serial in use."""
    return ~match.rlike("^(?:000|666|9)|-00-|-0000$")


# The base kinds' languages are fixed by contract. They are written so that a run of characters is
# entered at its start only and never given back, which makes them linear and keeps the stack flat;
# the matches are those of the plain patterns, as what follows a run is never one of its characters.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"
NATIONAL = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
LOCAL = r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"

KINDS = (
    Kind("email", EMAIL, lambda m: F.lit(True), 0.8, "mail|email|contact|write", "example|noreply|sample", trigger="@"),
    Kind("ip", IP, _address, 0.5, "ip|host|address|client|login", "version|release|build|section"),
    Kind("card", CARD, _card, 0.8, "card|visa|credit|debit|mastercard|payment", "order|invoice|tracking|isbn"),
    Kind("phone", PHONE, lambda m: F.length(_digits(m)).between(10, 15), 0.7, "phone|call|tel|mobile|fax|contact", "version|order", trigger="+"),
    Kind("iban", IBAN, _account, 0.9, "iban|account|bank|konto|compte|cuenta", "serial|product", base=False, apart=True),
    Kind("national_id", NATIONAL, _national, 0.3, "ssn|social|security|taxpayer|tin", "order|invoice|part|serial", base=False, apart=True),
    Kind("local_phone", LOCAL, lambda m: F.lit(True), 0.3, "phone|call|tel|mobile|fax|cell", "order|invoice|part|serial", base=False, apart=True),
)


def _near(before: Column, after: Column, words: str) -> Column:
    """Whether one of the words, in either case, stands whole in the context."""
    context = F.translate(F.concat(before, F.lit(" "), after), UPPER, LOW)
    return context.rlike(f"(^|[^a-z])({words})([^a-z]|$)")


def _scored(place: int, kind: Kind, matches: Column, parts: Column) -> Column:
    """The confirmed spans of one kind: (start, kind, end, score)."""
    size = F.size(matches)
    zipped = F.arrays_zip(
        matches.alias("match"), F.slice(parts, 1, size).alias("before"), F.slice(parts, 2, size).alias("after"), ends(parts, matches).alias("end"),
        F.sequence(F.lit(1), size).alias("nth"))

    def confirmed(z: Column) -> Column:
        # A piece that is empty, but for the outer two, is no gap between candidates.
        left = z["before"].rlike("[^A-Za-z0-9]$") | ((z["nth"] == 1) & (z["before"] == ""))
        right = z["after"].rlike("^[^A-Za-z0-9]") | ((z["nth"] == size) & (z["after"] == ""))
        return (left & right & kind.confirm(z["match"])) if kind.apart else kind.confirm(z["match"])

    def span(z: Column) -> Column:
        before, after = F.substring(z["before"], -BEFORE, BEFORE), F.substring(z["after"], 1, AFTER)
        raised = F.when(_near(before, after, kind.words), F.lit(RAISE)).otherwise(F.lit(0.0))
        lowered = F.when(_near(before, after, kind.against), F.lit(LOWER)).otherwise(F.lit(0.0))
        score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(kind.prior) + raised - lowered)), 2)
        return F.struct((z["end"] - F.length(z["match"])).alias("start"), F.lit(place).alias("kind"), z["end"].alias("end"), score.alias("score"))

    none = F.array().cast("array<struct<start:int,kind:int,end:int,score:double>>")
    found = F.transform(F.filter(zipped, confirmed), span)
    if not kind.base:
        found = F.filter(found, lambda s: s["score"] >= MIN_SCORE)
    return F.when(size > 0, found).otherwise(none)


def find_personal(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``spans``, which replaces a column of that name.

    ``spans`` is a sorted array of (start, kind, end, score), in code points with the end exclusive;
    kind is the place in ``KINDS``, counted from 1, the first four being the base kinds. A candidate
    that its validator rejects is dropped and nothing shorter tried in its place. Spans of base kinds
    stay whatever their score and may overlap each other; an added span needs ``MIN_SCORE`` and must
    not overlap a base span. Context is looked for in the ``BEFORE`` code points before and the
    ``AFTER`` after a candidate, up to the next candidate of its kind. Null and empty texts have no
    spans; the same rows give the same spans as often as they occur; no row is dropped.
    """
    # The row is packed, so that no column of ``docs`` clashes with a name used here.
    packed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    names = [k.name for k in KINDS]
    found = packed.select("*", *[matched(F.col("text"), k.pattern, k.trigger).alias(f"m_{k.name}") for k in KINDS])
    cut = found.select("row", *[f"m_{n}" for n in names], *[pieces(F.col("text"), k.pattern, F.col(f"m_{k.name}")).alias(f"p_{k.name}") for k in KINDS])
    spans = cut.select("row", *[_scored(i, k, F.col(f"m_{k.name}"), F.col(f"p_{k.name}")).alias(k.name) for i, k in enumerate(KINDS, 1)])
    every = spans.select("row", F.array_sort(F.concat(*names)).alias("spans"))
    base = lambda s: s["kind"] <= sum(k.base for k in KINDS)
    kept = F.when(F.exists("spans", lambda s: ~base(s)), free_of(F.col("spans"), base)).otherwise(F.col("spans"))
    return every.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "spans"], kept.alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"], s["end"])), ",")


# --- the same in SQL ----------------------------------------------------------------

_CASES = f"'{UPPER}', '{LOW}'"
# Plain forms of the patterns (fixed values), how SQL confirms a match m, and prior, words, words against.
_SQL_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: len(ltrim(x, '0')) > 3 OR coalesce(try_cast(x AS INTEGER), 999) > 255)) = 0"),
    "card": (r"[0-9]([\x20-]?[0-9])+", "len(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN d[-i]::INTEGER "
             "ELSE 2 * d[-i]::INTEGER - CASE WHEN d[-i]::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "len(d) BETWEEN 10 AND 15"),
    "iban": (r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?",
             "len(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(m, 1, 4), ''), lambda c: "
             "CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, c: CASE WHEN c < 10 THEN (a * 10 + c) % 97 ELSE (a * 100 + c) % 97 END) = 1"),
    "national_id": (NATIONAL, "NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$')"),
    "local_phone": (LOCAL, "true"),
}


def _sql_kind(place: int, kind: Kind) -> str:
    pattern, confirm = _SQL_KINDS[kind.name]
    apart = ("(regexp_matches(before, '[^A-Za-z0-9]$') OR i = 1 AND before = '') AND (regexp_matches(after, '^[^A-Za-z0-9]') OR i = len(ms) AND after = '')" if kind.apart else "true")
    near = lambda words: f"regexp_matches(context, '(^|[^a-z])({words})([^a-z]|$)')"
    return f"""SELECT doc_id, {place} AS kind, a AS s, a + len(m) AS e,
      {'true' if kind.base else 'false'} AS base, round(least(1, greatest(0, {kind.prior} + CASE WHEN {near(kind.words)} THEN {RAISE} ELSE 0 END - CASE WHEN {near(kind.against)} THEN {LOWER} ELSE 0 END)), 2) AS score
    FROM (SELECT *, translate(right(before, {BEFORE}) || ' ' || left(after, {AFTER}), {_CASES}) AS context FROM (
      SELECT doc_id, i, ms, ms[i] AS m, ps[i] AS before, ps[i + 1] AS after, regexp_replace(ms[i], '[^0-9]', '', 'g') AS d,
        list_sum(list_transform(ps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0) AS a
      FROM (SELECT doc_id, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS ps FROM documents))))
    WHERE ({confirm}) AND ({apart})"""


def _sql() -> str:
    names = "[" + ", ".join(f"'{k.name}'" for k in KINDS) + "]"
    joined = f"string_agg({names}[kind] || ':' || s || ':' || e, ',' ORDER BY s, kind, e)"
    counts = ", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in KINDS if k.base)
    return f"""WITH found AS ({' UNION ALL '.join(_sql_kind(i, k) for i, k in enumerate(KINDS, 1))}),
    kept AS (SELECT * FROM found f WHERE base OR score >= {MIN_SCORE} AND NOT EXISTS (
      SELECT 1 FROM found b WHERE b.base AND b.doc_id = f.doc_id AND b.s < f.e AND f.s < b.e)),
    sums AS (SELECT doc_id, {', '.join(f'count(*) FILTER (kind = {i}) AS n_{k.name}' for i, k in enumerate(KINDS, 1) if k.base)},
      {joined} FILTER (WHERE base) AS base_spans, {joined} AS spans FROM kept GROUP BY doc_id)
    SELECT d.doc_id, {counts}, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents d LEFT JOIN sums USING (doc_id)"""


@query("op11_personal_data", _sql())
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = find_personal(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["kind"] <= 4)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k.name}") for i, k in enumerate(KINDS, 1) if k.base],
        sha256_hex(span_text(base).cast("binary")).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
    )
