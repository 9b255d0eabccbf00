"""HTML pages to text and labelled dates.

Markup is read in Python (Arrow batches, one pass per page); everything after it is
Catalyst expressions.
"""

from __future__ import annotations

import codecs
import datetime
import re
import sys
from html.entities import name2codepoint

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from farsight.functions.dates import DATE_FORMS, MONTH_KEYS, TIME
from farsight.functions.text import collapse_ws, trim_ws

# Elements whose text is never page content.
BOILERPLATE = frozenset(
    "script style noscript template svg canvas iframe nav header footer aside form "
    "button input select figure figcaption".split()
)
ROOTS = ("main", "article", "body")
# Elements whose nesting matters. Boilerplate without an end tag holds no text.
TRACKED = (
    BOILERPLATE.union(ROOTS, "dl dt dd time div section ul ol table html".split())
    - {"input", "script", "style"}
)
# Charsets decoded as declared; anything else is read as UTF-8.
# The unmarked wide charsets are little-endian.
CHARSETS = {
    "ascii": "ascii", "iso8859-1": "iso8859-1", "utf-8": "utf-8",
    "utf-16": "utf-16-le", "utf-16-le": "utf-16-le", "utf-16-be": "utf-16-be",
    "utf-32": "utf-32-le", "utf-32-le": "utf-32-le", "utf-32-be": "utf-32-be",
}

MARK = T.StructType([T.StructField("label", T.StringType()), T.StructField("date", T.StringType())])
PAGE = T.StructType([T.StructField("body", T.StringType()), T.StructField("dates", T.ArrayType(MARK))])

# Send these functions to executors by value, so that they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ENTITY = re.compile(r"&(?:#(\d{1,7})|#[xX]([0-9a-fA-F]{1,6})|([A-Za-z][A-Za-z0-9]*));")


def _character(match: re.Match) -> str:
    decimal, hexadecimal, name = match.groups()
    code = name2codepoint.get(name) if name else int(decimal or hexadecimal, 10 if decimal else 16)
    if code is None or code >= 0x110000:
        return match.group(0)
    return "\ufffd" if 0xD800 <= code <= 0xDFFF else chr(code)


def unescape(text: str | None) -> str | None:
    """Decodes closed entities only (``&amp;`` but not ``&amp``), once."""
    return text if text is None or "&" not in text else ENTITY.sub(_character, text)


# The shared date forms, followed by an optional time and the end of a word.
LEADING = [(re.compile(f"(?i:{form}){TIME}(?=\\s|$)"), groups) for form, groups in DATE_FORMS]


DATE_WORDS = 12
# What a date's first character may be, if it is ASCII: a digit or the initial of a month or a weekday.
DATE_STARTS = frozenset("0123456789jfmasondtw")


def leading_iso(raw: str) -> str | None:
    """``yyyy-MM-dd`` of the date a text starts with (years 1900-2100), else None."""
    # A date with its time has at most eight words; the words after them cannot matter.
    first = raw.lstrip()[:1]
    if first.isascii() and first.lower() not in DATE_STARTS:
        return None
    head = " ".join(raw.split(None, DATE_WORDS)[:DATE_WORDS])
    # The last two forms may start with a name, and only the last with a month.
    for regex, groups in LEADING[3:] if first.isascii() and first.isalpha() else LEADING:
        found = regex.match(head)
        if found:
            year, month, day = (found.group(g) for g in groups)
            number = int(month) if month.isdigit() else MONTH_KEYS.index(month[:3].lower()) + 1
            try:
                parsed = datetime.date(int(year), number, int(day))
            except ValueError:
                return None
            return parsed.isoformat() if 1900 <= parsed.year <= 2100 else None
    return None


def clean_label(label: str | None) -> str:
    return " ".join((unescape(label) or "").split()).rstrip(":").strip()


def _dated(marks) -> list[dict]:
    """Labelled dates of the candidates, distinct ignoring case, in order."""
    dated = {}
    for label, raw in marks:
        iso = leading_iso(unescape(raw)) if raw and raw.strip() else None
        if iso is not None:
            name = clean_label(label)
            dated.setdefault(f"{name}|{iso}".lower(), {"label": name, "date": iso})
    return list(dated.values())


TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
# A whole tag: its name, and what stands before the first ">" outside quotes. It never goes back.
WHOLE_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)([^"'>]*+(?:"[^"]*+"[^"'>]*+|'[^']*+'[^"'>]*+)*+)>""")
QUOTE_OR_END = re.compile(r"[\"'>]")
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in ("script", "style")}


class Markup:
    """The markup of a page in one forward scan.

    Iterating gives (start, end, closing, tag, attributes); comments, declarations, scripts and
    styles have no tag. What a search did not find once is not sought again, so the time is
    linear in the page.
    """

    def __init__(self, html: str) -> None:
        self.html = html
        self.missing: set[str] = set()  # quotes, or ">", that do not come again

    def _find(self, mark: str, at: int) -> int:
        if mark in self.missing:
            return -1
        found = self.html.find(mark, at)
        if found < 0:
            self.missing.add(mark)
        return found

    def _tag_end(self, at: int) -> int:
        """The ``>`` of the tag whose name ends at ``at``; one in quotes counts only if no other comes."""
        here = at
        while "unquoted" not in self.missing:
            stop = QUOTE_OR_END.search(self.html, here)
            if stop is None:
                self.missing.add("unquoted")
            elif stop.group() == ">":
                return stop.start()
            else:
                closing = self._find(stop.group(), stop.end())
                if closing < 0:
                    break
                here = closing + 1
        return self._find(">", at)

    def __iter__(self):
        html, at = self.html, 0
        whole = WHOLE_TAG.match  # until a tag has no end, which the search below finds out about in linear time
        while True:
            if whole is not None:
                start = html.find("<", at)
                if start < 0:
                    return
                if found := whole(html, start):
                    closing, tag, at = found.group(1) == "/", found.group(2).lower(), found.end()
                    if not closing and tag in RAW_END:
                        raw_end = RAW_END[tag].search(html, at)
                        at = len(html) if raw_end is None else raw_end.end()
                        yield start, at, False, None, ""
                    else:
                        yield start, at, closing, tag, found.group(3)
                    continue
                if TAG_NAME.match(html, start + 1):
                    whole = None
            # Without a ">" to come only a comment can still start.
            start = html.find("<" if self._find(">", at) >= 0 else "<!--", at)
            if start < 0:
                return
            at = start + 1
            following = html[at : at + 1]
            if following in ("!", "?"):
                if html.startswith("<!--", start):
                    end = self._find("-->", start + 4)
                    at = len(html) if end < 0 else end + 3
                    yield start, at, False, None, ""
                elif (end := self._find(">", at)) >= 0:
                    at = end + 1
                    yield start, at, False, None, ""
                continue
            name = TAG_NAME.match(html, at)
            end = self._tag_end(name.end()) if name else -1
            if end < 0:
                continue
            closing, tag = name.group(1) == "/", name.group(2).lower()
            at = end + 1
            if not closing and tag in RAW_END:
                raw_end = RAW_END[tag].search(html, at)
                at = len(html) if raw_end is None else raw_end.end()
                yield start, at, False, None, ""
            else:
                yield start, at, closing, tag, html[name.end() : end]


ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), double or single or bare)
    return found


# The first words of a text, which is where its date would be. No word of a date is nearly as long.
FIRST_WORDS = re.compile(
    rf"(?:\s|&nbsp;|&#160;|&#[xX][aA]0;)*+(\S{{0,200}}(?:\s+\S{{1,200}}){{0,{DATE_WORDS - 1}}})"
)


def read_page(html: str) -> tuple[str, list[dict]]:
    """(text of the page's content root, labelled dates of the whole page)."""
    visible: list[str] = []  # text outside boilerplate
    everything: list[str] = []
    length = 0  # of ``everything``, so that an element's text is a pair of offsets
    roots: dict[str, tuple[int, int | None]] = {}
    metas: list[tuple] = []
    times: list[list] = []
    definitions: list[list] = []
    terms: dict[int, tuple[int, int] | None] = {}  # depth -> text of the last dt there
    stack: list[tuple] = []  # (tag, where its text starts, slot to fill on closing)
    opened: dict[str, int] = {}
    hidden = last = 0

    def close() -> None:
        nonlocal hidden
        tag, start, slot = stack.pop()
        opened[tag] -= 1
        if tag in BOILERPLATE:
            hidden -= 1
        elif tag in ROOTS:
            if slot:
                roots[tag] = (start, len(visible))
        elif tag == "dt":
            terms[len(stack)] = (start, length)
        elif slot is not None and slot[1] is None:
            slot[1] = (start, length)

    for begin, end, closing, tag, attributes in Markup(html):
        if begin > last:
            data = html[last:begin]
            everything.append(data)
            length += len(data)
            if not hidden:
                visible.append(data)
        last = end
        if tag is None:
            continue
        if tag == "meta" and not closing:
            given = _attributes(attributes)
            metas.append((given.get("name", given.get("property")), given.get("content")))
        if tag not in TRACKED:
            continue
        if closing:
            if opened.get(tag):
                while stack[-1][0] != tag:
                    close()
                close()
            continue
        if attributes.endswith("/"):
            continue
        depth, start, slot = len(stack), length, None
        terms[depth + 1] = None
        if tag in BOILERPLATE:
            hidden += 1
        elif tag in ROOTS:
            start = len(visible)
            if not hidden and tag not in roots:
                roots[tag], slot = (start, None), True
        elif tag == "time":
            given = (_attributes(attributes).get("datetime") or "").strip()
            slot = ["date", given or None]
            times.append(slot)
        elif tag == "dd":
            slot = [terms.get(depth), None]
            definitions.append(slot)
        stack.append((tag, start, slot))
        opened[tag] = opened.get(tag, 0) + 1
    if last < len(html):
        everything.append(html[last:])
        length += len(html) - last
        if not hidden:
            visible.append(html[last:])
    while stack:
        close()
    text = "".join(everything)
    labels: dict = {}

    def resolved(marks: list[list]) -> list[tuple]:
        """Offsets to texts: the first words of a date, the whole of a label where there is a date."""
        out = []
        for label, raw in marks:
            if isinstance(raw, tuple):
                raw = FIRST_WORDS.match(text, *raw).group(1)
            if isinstance(label, tuple):
                if not raw or leading_iso(unescape(raw)) is None:
                    continue
                label = labels.setdefault(label, text[slice(*label)])
            out.append((label, raw))
        return out

    start, end = next((roots[r] for r in ROOTS if r in roots), (0, len(visible)))
    return unescape("".join(visible[start:end])), _dated(metas + resolved(times) + resolved(definitions))


@F.arrow_udf(PAGE)
def parse_html(html: pa.Array) -> pa.Array:
    read = [read_page(h or "") for h in html.to_pylist()]
    kinds = [to_arrow_type(f.dataType) for f in PAGE.fields]
    return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*read) if read else ((), ()), kinds)], names=PAGE.names)


def decode_bytes(body: bytes | None, charset: str | None) -> str | None:
    """Bytes in the declared charset, else UTF-8; undecodable bytes are replaced."""
    if body is None:
        return None
    try:
        name = codecs.lookup((charset or "utf-8").strip('" ')).name
    except LookupError:
        name = "utf-8"
    return bytes(body).decode(CHARSETS.get(name, "utf-8"), errors="replace")


@F.pandas_udf(T.StringType())
def _decode(body: pd.Series, charset: pd.Series) -> pd.Series:
    return pd.Series([decode_bytes(b, c) for b, c in zip(body, charset)], dtype=object)


def charset_of(content_type: Column) -> Column:
    found = F.regexp_extract(content_type, r"(?i);\s*charset\s*=\s*\"?([^\s;\"]+)", 1)
    return F.lower(F.nullif(found, F.lit("")))


def decode_body(body: Column, content_type: Column) -> Column:
    """Page bytes to text by the content type's charset, UTF-8 when unknown or missing.

    UTF-8 and Latin-1 stay in the JVM; only the wide charsets send bytes to Python.
    """
    charset = charset_of(content_type)
    wide = F.coalesce(charset.rlike("^utf-?(16|32)"), F.lit(False))
    latin = F.coalesce(charset.isin("iso-8859-1", "latin1", "latin-1", "iso8859-1"), F.lit(False))
    ascii_only = F.coalesce(charset.isin("us-ascii", "ascii"), F.lit(False))
    return (
        F.when(wide, _decode(F.when(wide, body), charset))
        .when(latin, F.decode(body, "ISO-8859-1"))
        .when(ascii_only, F.regexp_replace(F.decode(body, "ISO-8859-1"), r"[^\x00-\x7F]", "?"))
        .otherwise(F.make_valid_utf8(body.cast("string")))
    )


def normalize_label(c: Column) -> Column:
    """White space collapsed, trailing colons dropped; null gives ''."""
    return F.coalesce(trim_ws(F.rtrim(collapse_ws(c), F.lit(":"))), F.lit(""))


def page_text(body: Column, dates: Column) -> Column:
    """Cleaned page text with the block of dates found on the page in front."""
    clean = collapse_ws(body)
    lines = F.transform(
        dates,
        lambda m: F.when(m["label"] == "", F.concat(F.lit("- "), m["date"])).otherwise(
            F.concat(F.lit("- "), m["label"], F.lit(": "), m["date"])
        ),
    )
    block = F.concat(F.lit("Dates found on page:\n"), F.array_join(lines, "\n"))
    return (
        F.when(F.size(dates) == 0, clean)
        .when(clean == "", block)
        .otherwise(F.concat(block, F.lit("\n\n"), clean))
    )
