"""Right-closed cuts at explicit edges.

``pd.cut`` semantics: bins are ``(e0, e1], (e1, e2], ...``; a value at or
below the lowest edge, above the highest, or NULL, falls in no bin (NULL).
Spark's ``Bucketizer`` is left-closed, hence a CASE chain with ``<=``.
The chain is a pure projection (codegen, no shuffle).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col


def _checked(edges: Sequence[float], labels: Sequence | None):
    edges = [float(e) for e in edges]
    if any(b <= a for a, b in zip(edges, edges[1:])):
        raise ValueError(f"bin edges must increase strictly: {edges}")
    if labels is not None and len(labels) != len(edges) - 1:
        raise ValueError("need one label per bin")
    return edges


def _chain(x: Column, edges, outs) -> Column:
    expr = None
    for hi, out in zip(edges[1:], outs):
        cond = x <= F.lit(hi)
        expr = F.when(cond, F.lit(out)) if expr is None else expr.when(cond, F.lit(out))
    return F.when(x > F.lit(edges[0]), expr)


def cut_index(c, edges: Sequence[float]) -> Column:
    """0-based bin number of a right-closed cut, NULL outside."""
    edges = _checked(edges, None)
    return _chain(col(c), edges, range(len(edges) - 1))


def cut(c, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the right-closed bin, NULL outside.

    Written as one CASE chain (not an array lookup by ``cut_index``): Spark
    4.1 folds ``element_at(array(...), CASE ...)`` into the branches and then
    returns the last element for a NULL index.
    """
    edges = _checked(edges, labels)
    return _chain(col(c), edges, labels)


def cut_sql(expr: str, edges: Sequence[float], labels: Sequence | None = None) -> str:
    """SQL text of the same cut, for oracles."""
    edges = _checked(edges, labels)
    whens = []
    for i, hi in enumerate(edges[1:]):
        out = str(i) if labels is None else "'" + str(labels[i]) + "'"
        whens.append(f"WHEN {expr} <= CAST({hi!r} AS DOUBLE) THEN {out}")
    return (f"CASE WHEN {expr} > CAST({edges[0]!r} AS DOUBLE) THEN "
            f"CASE {' '.join(whens)} END END")
