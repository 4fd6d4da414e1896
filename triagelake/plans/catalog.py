"""Imports every catalog module once, which registers its queries."""

from __future__ import annotations

import importlib

MODULES = [
    "catalog_metrics",
    "catalog_reports",
    "catalog_source",
    "catalog_findings",
    "catalog_review",
    "catalog_streams",
]


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"triagelake.plans.{name}")
