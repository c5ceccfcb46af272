"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import importlib

MODULES = (
    "sentencepiece_codec",
    "toxicity",
    "secret_scan",
    "url_filter",
    "chat_format",
    "quality_rules",
    "license_scan",
    "decontaminate",
    "substring_dedup",
    "jaccard_join",
    "fill_middle",
    "line_dedup",
    "spelling_variants",
)


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{name}"), what)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("SQL")
