"""Imports every operator module, which registers its query."""

from farsight.llm import bpe, decontaminate, extract, merkle, near_dup, pii, quality, secrets, spelling, substring_exact, substring_fuzzy, token_files, toxicity  # noqa: F401
