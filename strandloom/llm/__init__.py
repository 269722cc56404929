"""Operators for training-data pipelines. Nothing outside this subpackage imports it."""

import importlib

_QUERY_MODULES = ["percentiles", "termfreq", "heavy", "canonical", "packing", "leak", "lookalike"]


def query_modules() -> list:
    """Modules with QUERIES and SQL of this subpackage."""
    return [importlib.import_module(f"{__name__}.{m}_queries") for m in _QUERY_MODULES]
