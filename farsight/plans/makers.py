"""Pluggable parts of a scan, each a function over tables, with deterministic defaults.

* scorer:       docs -> verdict rows (see ``heuristic_scorer`` and ``predictor_scorer``)
* query maker:  active groups -> the same rows with ``query`` and ``query_rationale``
* search:       queries -> hits
* label maker:  items, vocabulary terms -> label values
* record maker: items -> judged record columns (None leaves them null)
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from farsight.functions.text import fallback_query
from farsight.functions.urls import url_host
from farsight.functions.verdicts import (
    BORDERLINE, FINALIZE, NOT_RELEVANT, RELEVANT, RETRY, UNKNOWN, is_degradable,
)
from farsight.operators.phrases import find_phrases
from farsight.operators.verdicts import DOC, PASS
from farsight.session import stage_dir
from farsight.sources.corpus import MAX_RESULTS, build_index, search_index

# Fixed value: the authoritative domain.
AUTHORITATIVE = ["gov.uk"]
FALLBACK_RATIONALE = (
    "Deterministic keyword fallback: the model returned no usable query, "
    "so the topic group's primary keyword was used."
)

Scorer = Callable[[DataFrame], DataFrame]


def theme_terms(theme: Column, listed: dict[str, list[str]] | None = None) -> Column:
    """Terms that mention a theme: those ``listed`` under its lower-case name, else the theme itself."""
    folded = F.lower(theme)
    terms = F.array(folded)
    for name, words in (listed or {}).items():
        terms = F.when(folded == name, F.array(*[F.lit(t) for t in words])).otherwise(terms)
    return terms


def heuristic_verdict(
    url: Column, text: Column, terms: Column, authoritative: list[str] = AUTHORITATIVE
) -> Column:
    """Relevant on an authoritative site that mentions the theme, Borderline on any other
    site that does, else NotRelevant. The whole text is searched."""
    lowered = F.lower(text)
    mentions = F.coalesce(F.exists(terms, lambda t: lowered.contains(F.lower(t))), F.lit(False))
    known = F.lit(False)
    for domain in authoritative:
        known = known | F.lower(url).contains(domain)
    return F.when(known & mentions, RELEVANT).when(mentions, BORDERLINE).otherwise(NOT_RELEVANT)


def heuristic_scorer(authoritative: list[str] = AUTHORITATIVE) -> Scorer:
    """Default scorer: documents carry url, cleaned_text and the group's keywords."""

    def score(docs: DataFrame) -> DataFrame:
        null_date = F.lit(None).cast("date")
        return docs.select(
            *DOC,
            heuristic_verdict(F.col("url"), F.col("cleaned_text"), F.col("keywords"), authoritative)
            .alias("verdict"),
            F.lit(None).cast("string").alias("rationale"),
            null_date.alias("publication_date"), null_date.alias("effective_date"),
            null_date.alias("applies_from"), null_date.alias("applies_to"),
            F.lit(UNKNOWN).alias("date_confidence"),
            F.lit(False).alias("fallback"), F.lit(None).cast("string").alias("error"),
        )

    return score


PREDICTED = (
    "run_id string, group_id string, pass int, doc_index int, verdict string, rationale string, "
    "publication_date date, effective_date date, applies_from date, applies_to date, "
    "date_confidence string, fallback boolean, error string"
)


class BadOutput(Exception):
    """Raised by a predictor whose model answered something unusable."""


# Unusable answers fall back to Borderline; any other failure fails the group.
FALLBACK_ERRORS = (BadOutput, json.JSONDecodeError)


def predictor_scorer(predict: Callable[[pd.DataFrame], pd.DataFrame]) -> Scorer:
    """Scorer from a pandas predictor run over Arrow batches.

    ``predict`` gets a batch of documents and returns their verdict columns in row order.
    Where a batch fails, its halves are tried, down to single rows, so a failing row costs about twice the
    logarithm of the batch in calls and the other rows few. A row whose answer is unusable
    (``BadOutput`` or broken JSON) is marked ``fallback``; one that fails otherwise carries
    the message in ``error`` instead of failing the job.
    """
    wanted = [f.split()[0] for f in PREDICTED.split(", ")]
    answers = [c for c in wanted if c not in (*DOC, "fallback", "error")]

    def answer(docs: pd.DataFrame) -> list[tuple[int, pd.DataFrame | None, Exception | None]]:
        """(rows, answers or None, failure) of consecutive lots of the batch; a lot that fails is halved down to its failing rows."""
        try:
            got = predict(docs.reset_index(drop=True)).reset_index(drop=True)
            return [(len(docs), got if len(got) == len(docs) else got.reindex(range(len(docs))), None)]
        except Exception as failure:  # noqa: BLE001 - isolate the failing rows
            if len(docs) == 1:
                return [(1, None, failure)]
        half = len(docs) // 2
        return answer(docs.iloc[:half]) + answer(docs.iloc[half:])

    def one_batch(docs: pd.DataFrame) -> pd.DataFrame:
        """The verdict rows of a batch, built once however many lots it was answered in."""
        lots, out = answer(docs), docs[DOC].reset_index(drop=True).copy()
        unusable = [isinstance(failure, FALLBACK_ERRORS) for _, _, failure in lots]
        for name in answers:
            parts = [pd.Series([None] * rows, dtype=object) if got is None or name not in got else got[name] for rows, got, _ in lots]
            out[name] = parts[0] if len(parts) == 1 else pd.Series([v for part in parts for v in part], dtype=object)
        out["fallback"] = [bad for (rows, _, _), bad in zip(lots, unusable) for _ in range(rows)]
        errors = [None if failure is None or bad else str(failure) or type(failure).__name__ for (_, _, failure), bad in zip(lots, unusable)]
        out["error"] = pd.Series([e for (rows, _, _), e in zip(lots, errors) for _ in range(rows)], dtype=object)
        return out[wanted]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for docs in batches:
            if len(docs):
                yield one_batch(docs)

    return lambda docs: docs.mapInPandas(run, PREDICTED)


def split_failures(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable answers, (run_id, group_id, error) of groups whose call failed for good).

    ``answers`` may carry ``error_status`` and ``bad_output``. Unusable output and transient
    statuses only leave the answer out, so defaults apply; other statuses fail the group.
    """
    if "error_status" not in answers.columns:
        return answers, answers.select("run_id", "group_id", F.lit("").alias("error")).limit(0)
    bad = F.col("bad_output") if "bad_output" in answers.columns else F.lit(False)
    marked = answers.withColumn("_degradable", is_degradable(F.col("error_status"), bad))
    usable = marked.where(F.col("_degradable").isNull()).drop("_degradable", "error_status", "bad_output")
    failed = marked.where(~F.col("_degradable")).groupBy("run_id", "group_id").agg(
        F.concat(F.lit("status "), F.min("error_status").cast("string")).alias("error")
    )
    return usable, failed


def coverage_decisions(verdicts: DataFrame) -> DataFrame:
    """Default pass decision: Finalize once a pass carried something, else Retry."""
    carried = F.count_if(F.col("verdict") != NOT_RELEVANT)
    return verdicts.groupBy(*PASS).agg(
        F.when(carried > 0, FINALIZE).otherwise(RETRY).alias("llm_decision"),
    ).withColumn("thought_process", F.lit("Missing facets: none. Weak evidence: none."))


def keyword_queries(active: DataFrame) -> DataFrame:
    """Default query maker: pass p takes the group's keyword p (cyclic), so passes differ."""
    turn = F.pmod(F.col("pass") - 1, F.size("keywords"))
    rotated = F.array(F.element_at("keywords", (turn + 1).cast("int")))
    return active.withColumn(
        "query", fallback_query(rotated, F.col("group_name"), F.col("jurisdiction"))
    ).withColumn("query_rationale", F.lit(FALLBACK_RATIONALE))


def corpus_search(corpus: DataFrame, k: int = MAX_RESULTS, path: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """Default search over a table of ``url, title, cleaned_text`` pages, through an index of all their words.

    The index is written at the first search, below ``path`` if given, and serves all further ones.
    """
    index = None

    def run(queries: DataFrame) -> DataFrame:
        nonlocal index
        if index is None:
            index = build_index(corpus, "url", "cleaned_text", path or stage_dir(corpus.sparkSession, "index"), near=url_host(F.col("url")))
        keys = ["run_id", "group_id", "group_ord", "pass", "query"]
        found = search_index(index, queries.select(*keys), keys, k)
        return found.select(
            "run_id", "group_id", "group_ord", "pass", "rank", F.col("doc_id").alias("url"),
            F.lit(None).cast("string").alias("title"), F.col("query").alias("source_query"),
        )

    return run


def phrase_labels(items: DataFrame, keys: list[str], text: str, terms: DataFrame) -> DataFrame:
    """Default label maker: vocabulary terms that occur in the text, by first occurrence.

    Rows: keys, the columns of ``terms`` (``name`` and any others), at.
    """
    return find_phrases(items, keys, text, terms)
