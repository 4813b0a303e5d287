"""Queries and SQL of all operators of this folder."""

from __future__ import annotations

from importlib import import_module

MODULES = ("quality", "lines", "warc", "html", "bpe", "packing", "simhash", "jaccard", "scoring", "repeats", "token_files", "turn_trie", "turn_repair")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"taktline.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
