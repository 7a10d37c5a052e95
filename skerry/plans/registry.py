"""All registered queries of the library (without the optional training-data subpackage) and their SQL twins."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES (name -> function of spark and directory) and SQL (name -> DuckDB SQL).
MODULES = ["search_queries", "catalog_queries", "text_queries", "chunk_queries", "table_queries", "stream_queries"]


def collect(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        for key, value in getattr(import_module(f"skerry.plans.{name}"), what).items():
            if key in out:
                raise ValueError(f"two queries are called {key}")
            out[key] = value
    return out
