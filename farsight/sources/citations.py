"""Search answers to citation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farsight.schemas import CITATIONS_JSON


def parse_answers(answers: DataFrame, column: str = "payload") -> DataFrame:
    """JSON answers to the nested ``messages`` column."""
    return answers.withColumn("messages", F.from_json(column, CITATIONS_JSON))


def citations(answers: DataFrame, keys: list[str], messages: str = "messages") -> DataFrame:
    """message -> content -> annotation to rows that carry a URL, with their positions."""
    return (
        answers.select(*keys, F.posexplode(messages).alias("message_pos", "m"))
        .select(*keys, "message_pos", F.posexplode("m.contents").alias("content_pos", "c"))
        .select(
            *keys, "message_pos", "content_pos",
            F.posexplode("c.annotations").alias("annotation_pos", "a"),
        )
        .where(F.col("a.url").isNotNull())
        .select(
            *keys, "message_pos", "content_pos", "annotation_pos",
            F.col("a.url").alias("url"), F.col("a.title").alias("title"),
        )
    )
