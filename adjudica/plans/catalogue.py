"""All queries of the engine by name, with their SQL twins."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

for _name in ("duels", "samples", "copies", "manifest_queries", "ledger", "texts_and_times", "services", "boards_and_files", "storage"):
    importlib.import_module(f"{__package__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]
