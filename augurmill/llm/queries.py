"""Importing this registers every query of the subpackage."""

from __future__ import annotations

from augurmill.llm import decontam, hardneg, html, lm, neardup, packing, phrases, private, quality, secrets, simhash, tokens, toxicity  # noqa: F401
from augurmill.llm.common import LLM_QUERIES
from augurmill.llm.sql import TEXTS as LLM_SQL

__all__ = ["LLM_QUERIES", "LLM_SQL"]
