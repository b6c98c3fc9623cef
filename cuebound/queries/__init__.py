"""All queries of the core: name -> (callable, SQL or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = ["general", "basic", "texts", "language", "labels", "corpus", "tensors", "files"]


def registry() -> dict[str, tuple]:
    """The queries of every module, in order."""
    found: dict[str, tuple] = {}
    for name in MODULES:
        found |= import_module(f"cuebound.queries.{name}").QUERIES
    return found
