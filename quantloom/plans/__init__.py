"""Named queries over the library, and SQL that gives the same rows."""

from __future__ import annotations


def all_queries() -> dict:
    from . import checks, extended, more, panel, pool, rebuilt, registry, study, timing  # noqa: F401  these register their queries

    return registry.QUERIES
