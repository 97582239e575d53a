"""All registered queries and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("feed", "timeline", "measure", "editorial", "verify", "search", "records", "picture", "ingest")


def _collect(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"timelinekit.catalogue.{name}"), attribute)
        clash = merged.keys() & part.keys()
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        merged.update(part)
    return merged


def all_queries() -> dict:
    return _collect("QUERIES")


def all_sql() -> dict:
    return _collect("SQL")
