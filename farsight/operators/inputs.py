"""Input tables for batch inference: context blocks and per-pass prompt sections.

A prompt is a table of ordered text parts (keys, section, part, text). Joining a key's
parts in (section, part) order with newlines gives the whole prompt. Parts hold a bounded
number of rows, so a group of any size is written by many tasks and nothing is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from farsight.functions.dates import dates_line, dates_note, window_end, window_text
from farsight.functions.text import (
    BLOCK_CHARS,
    DOCUMENT_CHARS,
    EXEMPLAR_CHARS,
    ITEM_CHARS,
    document_clip,
    head_clip,
    is_blank,
    text_budget,
    trim_ws,
)
from farsight.operators.numbering import numbered
from farsight.operators.ordinals import PART_ROWS, ordinal, text_parts

GROUP = ["run_id", "group_id"]
PASS = [*GROUP, "pass"]

# Lines of the written blocks.
BLOCK_HEADER = "=== Regulatory document under review (full text below) ==="
NO_FULL_TEXT = "(full text unavailable - the fetch failed)"
UNVERIFIED_NOTE = (
    "NOTE: full-text fetch failed; no content is available (treat as unverified)."
)
NO_EXEMPLARS = (
    "=== Prior Company View records for this jurisdiction ===\n"
    "(none available - write in a professional advisory style)"
)
RECORD_CLOSING = "Produce the Company View record for this regulatory document now."
AREA_CLOSING = (
    "Return the single best impact area for this regulatory document "
    "(verbatim from the approved list) with a one-sentence rationale."
)
TAGS_CLOSING = (
    "Return every applicable tag for this regulatory document "
    "(verbatim from the approved list) with a one-sentence rationale."
)
QUERY_CLOSING = (
    "Return the single best query for this pass, with a one-sentence rationale for choosing it."
)
NO_VETTED = "- none yet (this is the first pass, or nothing has been carried forward)."
NO_ATTEMPTS = "- none - this is the first pass."
NO_QUERIES = (
    "- (none yet - this is the first pass; write a broad query for the whole theme)"
)
SOURCE_URL, RELEVANCE_NOTES = "  Source URL: ", "  Relevance notes: "
EXEMPLARS_NOTE = " (house-style examples; do NOT copy their facts) ==="
ASSIGNED_AREA, ASSIGNED_TAGS = "Impact area (assigned for this group): ", "Tags (assigned for this group): "
EVAL_KEYWORDS_TITLE = "Keyword / synonym OR-list defining the theme:"
QUERY_KEYWORDS_TITLE = "Keyword / synonym OR-list:"
VETTED_TITLE = (
    "Previously vetted results carried from earlier passes (%s) - context only, already "
    "counted toward coverage; do NOT re-evaluate or assign these a verdict:"
)
ATTEMPTS_TITLE = "Previous search attempts (%s):"
DOCUMENTS_TITLE = (
    "Documents to evaluate THIS pass (%s). These are the ONLY documents to classify - return "
    "exactly one verdict per index. Do NOT emit verdicts for the previously-vetted results above:"
)
TRIED_TITLE = (
    "Queries already tried (do not repeat; cover the same theme from an angle that fills a gap):"
)
NOTES_TITLE = (
    "Reviewer notes from earlier passes (what was found and what is still missing - "
    "steer toward the gaps):"
)


def _lines(*lines: Column) -> Column:
    """Lines joined by newlines; null lines are left out."""
    return F.concat_ws("\n", *lines)


def _bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda k: F.concat(F.lit("- "), k)), "\n")


# --- context blocks --------------------------------------------------------------


def update_block(index: Column, budget: Column, text: str = "full_text") -> Column:
    """Block of one item: URL, notes, dates and clipped full text."""
    url = F.coalesce(F.try_element_at("source_urls", F.lit(1)), F.lit("(none)"))
    return _lines(
        F.concat(F.lit("Update "), index.cast("string"), F.lit(":")),
        F.concat(F.lit(SOURCE_URL), url),
        F.when(
            ~is_blank(F.col("eval_rationale")),
            F.concat(F.lit(RELEVANCE_NOTES), F.col("eval_rationale")),
        ),
        F.concat(
            F.lit("  Dates: "),
            dates_line(
                F.col("publication_date"), F.col("effective_date"),
                F.col("applies_from"), F.col("applies_to"),
            ),
        ),
        F.concat(
            F.lit("  Full text: "),
            F.when(is_blank(F.col(text)), F.lit(NO_FULL_TEXT)).otherwise(
                head_clip(F.col(text), budget)
            ),
        ),
        F.lit(""),
    )


def item_blocks(items: DataFrame, text: str = "full_text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``updates_block`` of each item on its own (a row expression, no shuffle).

    Texts longer than ``block_chars`` are clipped and end with the mark of a cut.
    """
    block = update_block(F.lit(1), text_budget(F.lit(1), block_chars), text)
    return items.withColumn("updates_block", _lines(F.lit(BLOCK_HEADER), block))


def group_blocks(
    items: DataFrame, keys: list[str], order: str, text: str = "full_text", rows: int = PART_ROWS,
    block_chars: int = BLOCK_CHARS, item_chars: int = ITEM_CHARS,
) -> DataFrame:
    """Context block over all items of a group, as parts of ``rows`` items each.

    The items share ``block_chars`` characters of text, but each may have ``item_chars``; longer
    texts are clipped and end with the mark of a cut.

    Texts are cut to their share before they are shuffled.
    """
    counts = items.groupBy(*keys).agg(F.count("*").alias("_n"))
    budgeted = items.join(counts, keys).withColumn("_budget", text_budget(F.col("_n"), block_chars, item_chars))
    clipped = budgeted.withColumn(text, head_clip(F.col(text), F.col("_budget")))
    numbered = ordinal(clipped, keys, order, "_index")
    block = update_block(F.col("_index"), F.col("_budget"), text)
    first = F.col("_index") == 1
    lines = numbered.select(
        *keys, (F.col("_index") - 1).alias("_o"),
        F.when(first, _lines(F.lit(BLOCK_HEADER), block)).otherwise(block).alias("_t"),
    )
    return text_parts(lines, keys, "_o", "_t", rows)


# --- evaluation input ------------------------------------------------------------


def document_block(text: str = "cleaned_text", max_chars: int = DOCUMENT_CHARS) -> Column:
    """Block of one document to evaluate; needs doc_index, url, domain, unverified."""
    return _lines(
        F.lit(""),
        F.concat(F.lit("=== Document index "), F.col("doc_index").cast("string"), F.lit(" ===")),
        F.concat(F.lit("URL: "), F.col("url")),
        F.when(~is_blank(F.col("domain")), F.concat(F.lit("Domain: "), F.col("domain"))),
        F.when(F.col("unverified"), F.lit(UNVERIFIED_NOTE)),
        F.lit("Full text:"),
        document_clip(F.col(text), max_chars),
    )


def document_parts(
    docs: DataFrame, rows: int = PART_ROWS, text: str = "cleaned_text", max_chars: int = DOCUMENT_CHARS
) -> DataFrame:
    """Documents of each pass as parts of ``rows`` documents, clipped before they are shuffled."""
    lines = docs.select(*PASS, "doc_index", document_block(text, max_chars).alias("_t"))
    return text_parts(lines, PASS, "doc_index", "_t", rows)


def _later_passes(rows: DataFrame, passes: DataFrame, found_on: str) -> DataFrame:
    """Rows once per later pass of their group that exists (a group has few passes)."""
    targets = passes.select(*GROUP, F.col("pass").alias("_target"))
    return (
        rows.join(targets, GROUP)
        .where(F.col("_target") > F.col(found_on))
    )


def prior_vetted_lines(vetted: DataFrame, passes: DataFrame) -> DataFrame:
    """Earlier vetted results each pass sees, one line per (pass, item)."""
    url = F.coalesce(F.try_element_at("source_urls", F.lit(1)), F.lit("(no url)"))
    note = dates_note(
        F.col("publication_date"), F.col("effective_date"), F.col("applies_from"),
        F.col("applies_to"), F.col("date_confidence"),
    )
    line = _lines(
        F.concat(
            F.lit("- ["), F.col("verdict"), F.lit("] "), url, F.lit(" (found pass "),
            F.col("found_on_pass").cast("string"), F.lit("; dates "), note, F.lit(")"),
        ),
        F.when(
            ~is_blank(F.col("eval_rationale")),
            F.concat(F.lit("    why: "), trim_ws(F.col("eval_rationale"))),
        ),
    )
    rows = vetted.select(*GROUP, "found_on_pass", "doc_index", line.alias("line"))
    return _later_passes(rows, passes, "found_on_pass").select(
        *GROUP, F.col("_target").alias("pass"), "found_on_pass", "doc_index", "line"
    )


def prior_attempt_lines(reviews: DataFrame, passes: DataFrame) -> DataFrame:
    """Earlier reviewed passes each pass sees, one line per (pass, earlier pass)."""
    line = _lines(
        F.concat(
            F.lit("<attempt "), F.col("pass").cast("string"), F.lit("> query: "), F.col("query"),
            F.lit(" | decision: "), F.col("final_decision"),
        ),
        F.when(
            ~is_blank(F.col("thought_process")),
            F.concat(F.lit("    notes: "), trim_ws(F.col("thought_process"))),
        ),
    )
    rows = reviews.select(*GROUP, F.col("pass").alias("attempt"), line.alias("line"))
    return _later_passes(rows, passes, "attempt").select(
        *GROUP, F.col("_target").alias("pass"), "attempt", "line"
    )


def _section(
    heads: DataFrame, lines: DataFrame, parts: DataFrame, number: int, title: str, empty: str
) -> DataFrame:
    """A section's parts behind its title line (part -1) with the number of lines.

    Passes without lines get the ``empty`` line. The count reads no line text.
    """
    counts = lines.groupBy(*PASS).agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0)).cast("string")
    titled = heads.join(counts, PASS, "left").select(
        *PASS, F.lit(-1).alias("part"),
        _lines(F.lit(""), F.format_string(title, n), F.when(F.col("_n").isNull(), F.lit(empty))).alias("text"),
    )
    return titled.unionByName(parts).withColumn("section", F.lit(number))


def eval_input(
    passes: DataFrame, docs: DataFrame, vetted: DataFrame, reviews: DataFrame,
    rows: int = PART_ROWS, document_chars: int = DOCUMENT_CHARS,
) -> DataFrame:
    """Evaluation prompt of each pass as parts: heading, earlier results, attempts, documents.

    A part holds ``rows`` lines or documents of a section; documents are clipped to ``document_chars``.
    ``passes`` carries run_id, group_id, pass and the group and request columns
    (group_name, keywords, max_loops, jurisdiction, start_date, end_date, started_at).
    """
    end = window_end(F.col("end_date"), F.col("started_at"))
    heading = _lines(
        F.concat(F.lit("Topic group: "), F.col("group_name")),
        F.concat(F.lit("Jurisdiction: "), F.col("jurisdiction")),
        F.concat(F.lit("Date range: "), window_text(F.col("start_date"), end)),
        F.concat(
            F.lit("Pass: "), F.col("pass").cast("string"), F.lit(" of up to "),
            F.col("max_loops").cast("string"),
        ),
        F.lit(EVAL_KEYWORDS_TITLE),
        _bullets(F.col("keywords")),
    )
    heads = passes.select(*PASS)
    head = passes.select(
        *PASS, F.lit(0).alias("part"), heading.alias("text"), F.lit(0).alias("section")
    )
    earlier = prior_vetted_lines(vetted, heads).withColumn(
        "_order", F.col("found_on_pass").cast("long") * F.lit(2**31) + F.col("doc_index")
    )
    vetted_section = _section(
        heads, earlier,
        text_parts(ordinal(earlier, PASS, "_order", "_o", start=0), PASS, "_o", "line", rows), 1,
        VETTED_TITLE,
        NO_VETTED,
    )
    attempts = prior_attempt_lines(reviews, heads)
    attempt_parts = text_parts(
        attempts.withColumn("_o", F.col("attempt") - 1), PASS, "_o", "line", rows
    )
    attempt_section = _section(
        heads, attempts, attempt_parts, 2,
        ATTEMPTS_TITLE, NO_ATTEMPTS,
    )
    doc_counts = docs.groupBy(*PASS).agg(F.count("*").alias("_n"))
    doc_title = heads.join(doc_counts, PASS).select(
        *PASS, F.lit(-1).alias("part"),
        _lines(
            F.lit(""),
            F.format_string(DOCUMENTS_TITLE, F.col("_n").cast("string")),
        ).alias("text"),
        F.lit(3).alias("section"),
    )
    doc_section = document_parts(docs, rows, max_chars=document_chars).withColumn("section", F.lit(3))
    return (
        head.unionByName(vetted_section).unionByName(attempt_section)
        .unionByName(doc_title).unionByName(doc_section)
        .select(*PASS, "section", "part", "text")
    )


# --- query input -----------------------------------------------------------------


def query_input(passes: DataFrame, reviews: DataFrame) -> DataFrame:
    """Query prompt of each next pass: keywords, tried queries, reviewer notes.

    ``passes``: run_id, group_id, pass (the pass to write a query for) with group_name,
    keywords, max_loops, jurisdiction. A group has at most ``max_loops`` earlier passes.
    """
    earlier = _later_passes(
        reviews.select(*GROUP, F.col("pass").alias("_p"), "query", "thought_process"),
        passes.select(*PASS), "_p",
    ).select(*GROUP, F.col("_target").alias("pass"), "_p", "query", "thought_process")
    tried = earlier.groupBy(*PASS).agg(
        F.array_sort(F.collect_list(F.struct("_p", "query", "thought_process"))).alias("_tried")
    )
    joined = passes.join(tried, PASS, "left")
    queries = F.transform("_tried", lambda t: t["query"])
    notes = F.filter(F.transform("_tried", lambda t: t["thought_process"]), lambda n: n.isNotNull())
    text = _lines(
        F.concat(F.lit("Topic group: "), F.col("group_name")),
        F.concat(F.lit("Jurisdiction: "), F.col("jurisdiction")),
        F.concat(
            F.lit("Pass: "), F.col("pass").cast("string"), F.lit(" of up to "),
            F.col("max_loops").cast("string"),
        ),
        F.lit(QUERY_KEYWORDS_TITLE),
        _bullets(F.col("keywords")),
        F.lit(TRIED_TITLE),
        F.when(F.col("_tried").isNull(), F.lit(NO_QUERIES)).otherwise(_bullets(queries)),
        F.when(
            F.size(notes) > 0,
            _lines(
                F.lit(NOTES_TITLE),
                _bullets(notes),
            ),
        ),
        F.lit(QUERY_CLOSING),
    )
    return joined.select(*PASS, text.alias("text"))


# --- label and record inputs -----------------------------------------------------


def _context(closing: str, *between: Column) -> Column:
    return _lines(
        F.concat(F.lit("Topic group: "), F.col("group_name")),
        F.concat(F.lit("Jurisdiction: "), F.col("jurisdiction")),
        *between,
        F.lit(""),
        F.col("updates_block"),
        F.lit(closing),
    )


def label_input(items: DataFrame, terms: DataFrame, kind: str) -> DataFrame:
    """Label prompt of each item, with the approved list of the vocabulary.

    ``items`` carries group_name, jurisdiction and ``updates_block``. The list is one
    scalar (vocabularies are small, closed sets), so no join is made. An empty
    vocabulary asks nothing: no rows.
    """
    names = terms.agg(F.array_sort(F.collect_list("name")).alias("n")).scalar()
    closing = AREA_CLOSING if kind == "impact_area" else TAGS_CLOSING
    return (
        items.withColumn("approved", names)
        .where(F.size("approved") > 0)
        .withColumn("approved_list", _bullets(F.col("approved")))
        .withColumn("text", _context(closing))
        .drop("approved", "updates_block")
    )


def approved_parts(terms: DataFrame, rows: int = PART_ROWS) -> DataFrame:
    """(part, text): the approved list of a vocabulary, in the order of its names, as text parts of at most ``rows`` names.

    It is written once for all items that are labelled from it; names are numbered by range partitions, so that no
    task holds the whole list. An empty vocabulary gives no rows.
    """
    lines = numbered(terms.select("name").withColumn("_all", F.lit(0)), ["_all"], ["name"], "_at")
    listed = lines.select("_all", "_at", F.concat(F.lit("- "), F.col("name")).alias("_line"))
    return text_parts(listed, ["_all"], "_at", "_line", rows).drop("_all")


def label_prompts(items: DataFrame, terms: DataFrame, kind: str) -> DataFrame:
    """Label prompt of each item, to be sent after the parts of the approved list (``approved_parts``).

    ``items`` carries group_name, jurisdiction and ``updates_block``; an empty vocabulary asks nothing: no rows.
    """
    closing = AREA_CLOSING if kind == "impact_area" else TAGS_CLOSING
    asked = items.where(F.lit(not terms.isEmpty()))
    return asked.withColumn("text", _context(closing)).drop("updates_block")


def exemplar_block(exemplars: Column, jurisdiction: Column, field_chars: int = EXEMPLAR_CHARS) -> Column:
    """Prior records as numbered examples, each field clipped to ``field_chars``."""

    def field(label: str, c: Column) -> Column:
        return F.when(
            ~is_blank(c), F.concat(F.lit(f"  {label}: "), head_clip(c, field_chars))
        )

    def example(e: Column) -> Column:
        return _lines(
            F.concat(F.lit("Example "), e["exemplar_rank"].cast("string"), F.lit(":")),
            field("Title", e["title_of_update"]),
            field("Impact area", e["impact_area"]),
            F.when(F.size(e["tags"]) > 0, F.concat(F.lit("  Tags: "), F.array_join(e["tags"], ", "))),
            field("Level of authority", e["level_of_authority"]),
            field("Status of change", e["status_of_change"]),
            field("Regulator", e["regulator"]),
            field("Company View", e["company_view"]),
            F.lit(""),
        )

    heading = F.concat(
        F.lit("=== Prior Company View records for "), jurisdiction,
        F.lit(EXEMPLARS_NOTE),
    )
    listed = _lines(heading, F.array_join(F.transform(exemplars, example), "\n"))
    return F.when(F.coalesce(F.size(exemplars), F.lit(0)) == 0, F.lit(NO_EXEMPLARS)).otherwise(listed)


def record_input(items: DataFrame, field_chars: int = EXEMPLAR_CHARS) -> DataFrame:
    """Record prompt of each item: labels, its context block and its group's exemplars.

    ``items`` carries group_name, jurisdiction, updates_block, impact_area, tags, exemplars.
    """
    text = _lines(
        F.concat(F.lit("Topic group: "), F.col("group_name")),
        F.concat(F.lit("Jurisdiction: "), F.col("jurisdiction")),
        F.when(
            ~is_blank(F.col("impact_area")),
            F.concat(F.lit(ASSIGNED_AREA), F.col("impact_area")),
        ),
        F.when(
            F.size("tags") > 0,
            F.concat(F.lit(ASSIGNED_TAGS), F.array_join("tags", ", ")),
        ),
        F.lit(""),
        F.col("updates_block"),
        exemplar_block(F.col("exemplars"), F.col("jurisdiction"), field_chars),
        F.lit(RECORD_CLOSING),
    )
    return items.withColumn("text", text).drop("updates_block", "exemplars")
