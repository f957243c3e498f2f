"""Registered queries over the star-schema tables, each with SQL giving the same answer."""

from tablewise.workloads import registry


def _load() -> None:
    from tablewise.workloads import (  # noqa: F401
        cataloging, cleaning, editing, inference, linking, lists, loading, profiles, versioning,
    )


def all_queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(registry.SQL)
