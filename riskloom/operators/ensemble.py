"""Ensembles over member score columns (P1-P4): plain column arithmetic."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import clip


def soft_vote(cols: Sequence[str]) -> Column:
    """Mean of member probabilities."""
    s = F.col(cols[0])
    for c in cols[1:]:
        s = s + F.col(c)
    return s / len(cols)


def weighted_vote(weights: Mapping[str, float], normalise: bool = True) -> Column:
    """Weighted sum of member probabilities; weights normalised to sum 1."""
    total = sum(weights.values()) if normalise else 1.0
    s = None
    for c, w in weights.items():
        term = F.col(c) * F.lit(w / total)
        s = term if s is None else s + term
    return s


def vote_label(prob: Column, threshold: float = 0.5) -> Column:
    """Class 1 when the blended probability exceeds the threshold."""
    return F.when(prob > threshold, 1).otherwise(0)


def blend_regression(weights: Mapping[str, float], lo=None, hi=None, expm1: bool = True) -> Column:
    """Fixed-weight blend of log-scale predictions brought back with expm1,
    then clipped (P4)."""
    s = None
    for c, w in weights.items():
        v = F.expm1(F.col(c)) if expm1 else F.col(c)
        term = v * F.lit(float(w))
        s = term if s is None else s + term
    return clip(s, lo, hi) if (lo is not None or hi is not None) else s
