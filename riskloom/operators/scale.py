"""Scalers and the skew correction.

Fit = one aggregate over the fit frame (typically the train split) whose
single row is brought to the driver; transform = a projection with those
values as literals.  Both follow the reference's definitions, which differ
from ``pyspark.ml``: the standard scaler divides by the *population* std
(MLlib uses the sample std), and the robust scaler uses exact quartiles
(MLlib's are approximate).  A zero spread is replaced by 1.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import boxcox1p
from .quantiles import exact_quantiles_multi


def fit_standard(df: DataFrame, cols: Sequence[str]) -> dict:
    row = df.agg(*[F.avg(c).alias(f"m__{c}") for c in cols],
                 *[F.stddev_pop(c).alias(f"s__{c}") for c in cols]).first()
    return {c: (row[f"m__{c}"], row[f"s__{c}"]) for c in cols}


def apply_standard(df: DataFrame, params: dict, suffix: str = "") -> DataFrame:
    cols = {}
    for c, (m, s) in params.items():
        s = 1.0 if (s is None or s == 0) else s
        cols[c + suffix] = (F.col(c) - F.lit(m)) / F.lit(s)
    return df.withColumns(cols)


def standard_scale(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None,
                   suffix: str = "") -> DataFrame:
    """(x - mean) / population std, statistics from ``fit``."""
    return apply_standard(df, fit_standard(fit if fit is not None else df, cols), suffix)


def fit_robust(df: DataFrame, cols: Sequence[str]) -> dict:
    """Exact quartiles per column by distributed selection (no column is
    gathered into one task)."""
    qs = exact_quantiles_multi(df, cols, [0.25, 0.5, 0.75])
    return {c: tuple(qs[c]) for c in cols}


def apply_robust(df: DataFrame, params: dict, suffix: str = "") -> DataFrame:
    cols = {}
    for c, (q1, med, q3) in params.items():
        iqr = None if q1 is None else q3 - q1
        iqr = 1.0 if not iqr else iqr
        cols[c + suffix] = (F.col(c) - F.lit(med)) / F.lit(iqr)
    return df.withColumns(cols)


def robust_scale(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None,
                 suffix: str = "") -> DataFrame:
    """(x - median) / (q75 - q25) with exact quartiles."""
    return apply_robust(df, fit_robust(fit if fit is not None else df, cols), suffix)


def skewed_columns(df: DataFrame, cols: Sequence[str], threshold: float = 0.75) -> list[str]:
    """Columns whose population skewness exceeds ``threshold`` in absolute value."""
    row = df.agg(*[F.skewness(c).alias(c) for c in cols]).first()
    return sorted(c for c in cols if row[c] is not None and abs(row[c]) > threshold)


def skew_fix(df: DataFrame, cols: Sequence[str], threshold: float = 0.75, lam: float = 0.15,
             fit: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Box-Cox(1 + x) on the columns that are skewed in ``fit``.
    Returns the frame and the list of transformed columns."""
    sk = skewed_columns(fit if fit is not None else df, cols, threshold)
    return df.withColumns({c: boxcox1p(c, lam) for c in sk}), sk
