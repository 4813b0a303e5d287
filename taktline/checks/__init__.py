"""Registered queries over the given tables and the SQL they are checked with."""

import importlib
from types import ModuleType

MODULES = ("service_queries", "catalog_queries", "links_queries", "scalar_queries", "source_queries")


def load() -> ModuleType:
    """Import every module that registers queries."""
    for name in MODULES:
        importlib.import_module(f"taktline.checks.{name}")
    return importlib.import_module("taktline.checks.registry")
