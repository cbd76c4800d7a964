"""Named data products: marts, KPIs, dashboard and benchmark queries, scoring."""

from importlib import import_module

QUERY_MODULES = (
    "mart_queries",
    "kpi_queries",
    "dashboard_queries",
    "benchmark",
    "quality_queries",
    "evaluation_queries",
    "trial_queries",
    "text_queries",
    "source_queries",
)


def all_queries():
    """Every registered query, ``name -> fn(spark, path)``."""
    for module in QUERY_MODULES:
        import_module(f"{__name__}.{module}")
    from tallywork.plans.registry import QUERIES

    return dict(QUERIES)
