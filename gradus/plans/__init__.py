"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from . import registry

MODULES = ("rating", "aggregates", "standardize", "quality", "identity", "master", "recruit", "sources", "research", "catalogue")


def _load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")


def all_queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(registry.SQL)
