"""Fetched pages: cleaning and admission onto hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farsight.functions.html import decode_body, page_text, parse_html
from farsight.functions.text import is_blank, trim_ws
from farsight.functions.urls import is_absolute_http
from farsight.operators.ordinals import first_per

# Admitted media types and the body cap in bytes (10 MiB).
MEDIA_TYPES = ["text/html", "application/xhtml+xml", "application/pdf"]
MAX_BYTES = 10 * 1024 * 1024


def clean_html(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``dates`` (label/date pairs) and ``cleaned_text`` from an HTML text column."""
    parsed = pages.withColumn("_p", parse_html(F.col(html)))
    return (
        parsed.withColumn("cleaned_text", page_text(F.col("_p.body"), F.col("_p.dates")))
        .withColumn("dates", F.col("_p.dates"))
        .drop("_p")
    )


def _media_type(content_type):
    return F.lower(trim_ws(F.split_part(content_type, F.lit(";"), F.lit(1))))


def page_refusal(max_bytes: int = MAX_BYTES):
    """Why a fetched page's metadata or size rules it out; null when admissible."""
    return (
        F.when(F.coalesce(~F.col("status").between(200, 299), F.lit(True)), "status")
        .when(
            F.coalesce(~_media_type(F.col("content_type")).isin(MEDIA_TYPES), F.lit(True)),
            "content_type",
        )
        .when(F.coalesce(F.col("content_length") > max_bytes, F.lit(False)), "declared_size")
        .when(F.octet_length("body") > max_bytes, "actual_size")
    )


def cleaned_pages(pages: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``url, refusal, cleaned_text`` per fetched page; only admissible bodies are parsed.

    PDF bodies arrive as text already (no markup is looked for in them).
    """
    checked = pages.withColumn("refusal", page_refusal(max_bytes))
    pdf = _media_type(F.col("content_type")) == "application/pdf"
    text = F.when(F.col("refusal").isNull(), decode_body(F.col("body"), F.col("content_type")))
    decoded = checked.select("url", "refusal", pdf.alias("pdf"), text.alias("text"))
    cleaned = clean_html(
        decoded.withColumn("html", F.when(~F.col("pdf"), F.col("text")))
    )
    usable = F.when(F.col("pdf"), trim_ws(F.col("text"))).otherwise(F.col("cleaned_text"))
    return cleaned.select(
        "url",
        F.coalesce("refusal", F.when(is_blank(usable), "blank_text")).alias("refusal"),
        F.when(F.col("refusal").isNull() & ~is_blank(usable), usable).alias("cleaned_text"),
    )


def admit(hits: DataFrame, pages: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Every hit with its page's cleaned text, or flagged ``unverified`` with a reason.

    No hit is dropped or multiplied. Pages no hit asks for are left out before
    their bodies are parsed.
    """
    wanted = hits.select("url").where(is_absolute_http(F.col("url"))).distinct()
    needed = pages.join(wanted, "url", "left_semi")
    cleaned = first_per(
        cleaned_pages(needed, max_bytes), ["url"], F.col("refusal").asc_nulls_first(), "cleaned_text"
    )
    joined = hits.join(cleaned.withColumn("_fetched", F.lit(True)), "url", "left")
    reason = (
        F.when(~is_absolute_http(F.col("url")), "not_http")
        .when(F.col("_fetched").isNull(), "not_fetched")
        .otherwise(F.col("refusal"))
    )
    return (
        joined.withColumn("fetch_reason", reason)
        .withColumn("unverified", F.col("fetch_reason").isNotNull())
        .select(*hits.columns, "cleaned_text", "unverified", "fetch_reason")
    )
