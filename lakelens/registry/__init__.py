"""All registered queries by name."""

from importlib import import_module

MODULES = ("profile_queries", "chart_queries", "model_queries", "cluster_queries", "series_queries")


def load():
    """(queries, sql) dictionaries."""
    from lakelens.registry import base

    for m in MODULES:
        import_module(f"lakelens.registry.{m}")
    return dict(base.QUERIES), dict(base.SQL)
