"""Queries of the training-data operators and their SQL forms."""

from __future__ import annotations

from ragspark.llm import (queries_select, queries_text)

_MODULES = [queries_text, queries_select]


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
