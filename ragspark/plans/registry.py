"""Collects every registered query and its oracle SQL."""

from __future__ import annotations

import importlib

_MODULES = [
    "ragspark.plans.vector_plans",
    "ragspark.plans.telemetry_plans",
    "ragspark.plans.report_plans",
    "ragspark.plans.index_plans",
    "ragspark.plans.model_plans",
    "ragspark.plans.capacity_plans",
    "ragspark.plans.text_plans",
    "ragspark.plans.source_plans",
    "ragspark.plans.stream_plans",
]


def _load():
    queries, sql = {}, {}
    for name in _MODULES:
        mod = importlib.import_module(name)
        queries.update(mod.Q)
        sql.update(mod.SQL)
    return queries, sql


def queries() -> dict:
    return _load()[0]


def oracle_sql() -> dict:
    from ragspark.functions.rounding import scaled_round_sql
    return {k: scaled_round_sql(v) for k, v in _load()[1].items()}
