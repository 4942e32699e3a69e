"""All registered queries and SQL twins."""

from __future__ import annotations

import importlib

AREAS = ["screening", "review", "panel", "linkage", "text", "search", "documents", "completion", "extraction", "streams"]


def _areas():
    return [importlib.import_module(f"citesieve.plans.{name}") for name in AREAS]


def queries() -> dict:
    return {name: function for area in _areas() for name, function in area.QUERIES.items()}


def oracles() -> dict:
    return {name: text for area in _areas() for name, text in area.ORACLES.items()}
