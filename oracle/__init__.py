"""DuckDB SQL equivalent to each registered query."""

from importlib import import_module

MODULES = ("marts", "kpis", "dashboard", "benchmark", "quality", "evaluation", "trials", "text", "sources")


def all_sql() -> dict[str, str]:
    merged: dict[str, str] = {}
    for module in MODULES:
        merged.update(import_module(f"oracle.{module}").SQL)
    return merged
