"""Parsing of the verdict, decision and confidence words an evaluator writes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from farsight.functions.text import trim_ws

# Enumerations and the texts that stand in for missing answers.
RELEVANT, BORDERLINE, NOT_RELEVANT = "Relevant", "Borderline", "NotRelevant"
RETRY, FINALIZE = "Retry", "Finalize"
HIGH, MEDIUM, LOW, UNKNOWN = "High", "Medium", "Low", "Unknown"
OMITTED_RATIONALE = (
    "Eval agent did not return a verdict for this document; carried forward as borderline."
)
FAILED_RATIONALE = (
    "Relevance eval could not be completed; carried forward as borderline for safety."
)
DEFAULT_THOUGHT = "Missing facets: none. Weak evidence: none."
FAILED_THOUGHT = (
    "Eval call failed; no facet analysis available. "
    "Missing facets: unknown. Weak evidence: unknown."
)
EMPTY_THOUGHT = (
    "No documents were retrieved this pass. "
    "Missing facets: none identifiable. Weak evidence: none."
)
SEARCH_FAILED_THOUGHT = (
    "No documents were retrieved this pass because the web search failed (%s). "
    "This is an error state, not an empty result - retrying rather than finalizing "
    "on a broken search."
)


def _word(c: Column) -> Column:
    return F.upper(trim_ws(c))


def parse_verdict(c: Column) -> Column:
    w = _word(c)
    return (
        F.when(w == "RELEVANT", RELEVANT)
        .when(w.isin("NOT_RELEVANT", "NOTRELEVANT", "NOT RELEVANT"), NOT_RELEVANT)
        .otherwise(BORDERLINE)
    )


def parse_decision(c: Column) -> Column:
    return F.when(_word(c).isin("FINALIZE", "FINALISE", "STOP"), FINALIZE).otherwise(RETRY)


def parse_confidence(c: Column) -> Column:
    w = _word(c)
    return (
        F.when(w == "HIGH", HIGH).when(w == "MEDIUM", MEDIUM).when(w == "LOW", LOW)
        .otherwise(UNKNOWN)
    )


def is_degradable(status: Column, bad_output: Column) -> Column:
    """Whether a failed call falls back (True) or fails its group (False); null if no failure.

    Malformed output and the transient statuses 0, 408, 429 and >= 500 fall back.
    """
    transient = status.isin(0, 408, 429) | (status >= 500)
    return F.when(F.coalesce(bad_output, F.lit(False)), True).when(status.isNotNull(), transient)

