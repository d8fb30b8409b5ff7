"""Queries of this subpackage by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES (name -> callable) and ORACLES (name -> SQL).
MODULES = (
    "order_minhash",
    "suffix_tree",
    "media",
    "quality_gam",
    "pieces",
    "substrings",
    "mixing",
    "secrets",
    "toxicity",
    "near_dedup",
)


def _all(field: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(import_module(f"larkmill.llm.{name}"), field))
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLES")
