"""Queries over the test tables, each with the same result stated in SQL."""

from __future__ import annotations

import importlib

from checks.registry import QUERIES, SQL

MODULES = ("ingest", "statistics", "judgement")


def load_all():
    for name in MODULES:
        importlib.import_module(f"checks.{name}")
    return QUERIES, SQL
