"""Collects every registered query (importing a module registers its queries)."""

from __future__ import annotations

from . import q_clinical, q_eval, q_linear, q_models, q_neighbors, q_prep, q_tabular, q_trees  # noqa: F401
from .registry import REGISTRY


def queries():
    return {name: q.build for name, q in REGISTRY.items()}


def oracle_sql():
    return {name: q.sql for name, q in REGISTRY.items() if q.sql is not None}
