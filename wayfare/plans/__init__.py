"""Whole pipelines and the registered queries."""


def all_queries() -> tuple[dict, dict]:
    """Queries by name, and the SQL of those that have any."""
    from wayfare.plans import base_queries, ml_queries, more_queries  # noqa: F401
    from wayfare.plans.registry import QUERIES, SQL

    return dict(QUERIES), dict(SQL)
