"""All queries of the core, by name."""

from __future__ import annotations

from mezon.plans import evaluation, messages

MODULES = [messages, evaluation]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
