"""Date parsing, date windows and date texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from farsight.functions.text import once, trim_ws

# Invariant-culture month names.
MONTHS = (
    "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|"
    "Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
)
MONTH_KEYS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
WEEKDAY = "(?:(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day|Mon|Tue|Wed|Thu|Fri|Sat|Sun)"

# Each form: regex and the positions of its year, month and day groups.
DATE_FORMS = [
    (r"(\d{4})-(\d{1,2})-(\d{1,2})", (1, 2, 3)),
    (r"(\d{4})/(\d{1,2})/(\d{1,2})", (1, 2, 3)),
    (r"(\d{1,2})/(\d{1,2})/(\d{4})", (3, 1, 2)),
    (rf"(?:{WEEKDAY},? )?(\d{{1,2}})[ -]({MONTHS})[ ,-]+(\d{{4}})", (3, 2, 1)),
    (rf"(?:{WEEKDAY},? )?({MONTHS}) (\d{{1,2}}),? (\d{{4}})", (3, 1, 2)),
]
# Time of day that may follow a date.
TIME = r"(?:[T ,]+\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?: ?[AP]M)?(?: ?(?:Z|GMT|UTC|[+-]\d{2}:?\d{2}))?)?"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
ISO_DATE_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d{1,7})?)?(?:Z|[+-]\d{2}:\d{2})?$"


def _month(c: Column) -> Column:
    named = F.array_position(
        F.array(*[F.lit(m) for m in MONTH_KEYS]), F.lower(F.substring(c, 1, 3))
    )
    return F.when(c.rlike(r"^\d"), c).otherwise(named.cast("string"))


def _parse(c: Column, tail: str) -> Column:
    parsed = F.lit(None).cast("date")
    for form, (y, m, d) in reversed(DATE_FORMS):
        regex = f"^(?i:{form}){tail}"
        parts = F.concat_ws(
            "-",
            F.regexp_extract(c, regex, y),
            _month(F.regexp_extract(c, regex, m)),
            F.regexp_extract(c, regex, d),
        )
        parsed = F.when(c.rlike(regex), F.try_to_date(parts, "y-M-d")).otherwise(parsed)
    return parsed


def lenient_date(c: Column) -> Column:
    """Date from one of the known forms; null for blank, partial or other text."""
    return once(trim_ws(c), lambda t: _parse(t, "$"))


def strict_iso_date(c: Column) -> Column:
    """``yyyy-MM-dd`` or an ISO date-time to its written local date, else null.

    The offset is not applied: the date is the one that was written.
    """
    ok = c.rlike(ISO_DATE) | c.rlike(ISO_DATE_TIME)
    return F.when(ok, F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"))


def leading_date(c: Column) -> Column:
    """Date at the start of a text whose tail may be anything; years 1900-2100 only."""
    head = F.regexp_replace(trim_ws(c), r"[\s\x{85}\p{Z}]+", " ")
    parsed = once(head, lambda t: _parse(t, rf"{TIME}(?=\s|$)"))
    return once(parsed, lambda d: F.when(F.year(d).between(1900, 2100), d))


def window_end(end_date: Column, started_at: Column) -> Column:
    """Upper window bound: the end date, else the UTC date the run started on."""
    return F.coalesce(end_date, F.to_date(started_at))


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def window_text(start_date: Column, end: Column) -> Column:
    return F.when(
        start_date.isNotNull(), F.concat(iso(start_date), F.lit(" to "), iso(end))
    ).otherwise(F.concat(F.lit("on or before "), iso(end)))


def outside_window(
    publication: Column,
    effective: Column,
    applies_from: Column,
    confidence: Column,
    lower: Column,
    upper: Column,
) -> Column:
    """Confidently dated outside the window (bounds inclusive).

    Only a publication date can be too new, so future effective dates stay.
    Too old falls back to the effective, then the applies-from date.
    """
    confident = confidence.isin("Medium", "High")
    too_new = F.coalesce(publication > upper, F.lit(False))
    too_old = F.coalesce(F.coalesce(publication, effective, applies_from) < lower, F.lit(False))
    return F.coalesce(confident, F.lit(False)) & (too_new | too_old)


def dates_line(
    publication: Column, effective: Column, applies_from: Column, applies_to: Column
) -> Column:
    """``published .., effective .., applies from .., applies to ..``; null when no date."""

    def part(label: str, c: Column) -> Column:
        return F.when(c.isNotNull(), F.concat(F.lit(label), iso(c)))

    return F.nullif(
        F.concat_ws(
            ", ",
            part("published ", publication),
            part("effective ", effective),
            part("applies from ", applies_from),
            part("applies to ", applies_to),
        ),
        F.lit(""),
    )


def dates_note(
    publication: Column, effective: Column, applies_from: Column, applies_to: Column, conf: Column
) -> Column:
    """Compact form used for earlier results: ``pub=.. eff=.. applies=..->.. conf=..``."""

    def d(c: Column) -> Column:
        return F.coalesce(iso(c), F.lit("?"))

    return F.concat(
        F.lit("pub="), d(publication), F.lit(" eff="), d(effective),
        F.lit(" applies="), d(applies_from), F.lit("->"), d(applies_to),
        F.lit(" conf="), conf,
    )
