"""Registered queries and, where SQL can express them, their DuckDB twins."""

import importlib

from checks.registry import ORACLES, QUERIES

MODULES = ["urls", "lookalike", "text", "metrics", "scans", "sets", "joins", "vectors", "monitor", "files", "models", "whole"]


def load():
    """(queries, oracle SQL) of all check modules."""
    for name in MODULES:
        importlib.import_module(f"checks.{name}")
    return QUERIES, ORACLES
