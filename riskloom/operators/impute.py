"""Imputation (inventory K1-K6, E1, E2, C2, D3, D4).

Global statistics are carried into the projection as literals: modes and
means come from one aggregate over the fit frame, medians from the exact
distributed selection of ``quantiles.py`` (no column gathered into one
task).  Group medians come from the group-wise
selection of ``quantiles.py`` (hot groups are spread over many tasks) and are
joined back by ``lookup.py``: broadcast after a check of the table's size,
salted beyond it.
A NULL key never receives a group value: pandas drops NULL groups, and an
equi-join on NULL never matches.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import attach
from .quantiles import exact_quantiles_multi, group_quantile


def fill_const(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Constant fill per column (K1); absent columns are ignored."""
    present = {k: v for k, v in values.items() if k in df.columns}
    return df.fillna(present) if present else df


def global_mode(df: DataFrame, col: str):
    """Most frequent non-null value, the lowest on ties.

    A count per value (partial aggregation, spread over the cluster) and a
    top-1 pick; unlike the ``mode`` aggregate, no task holds every distinct
    value."""
    row = (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
           .orderBy(F.col("_n").desc(), F.col(col).asc()).limit(1).collect())
    return row[0][col] if row else None


def global_stats(df: DataFrame, medians: Sequence[str] = (), modes: Sequence[str] = (),
                 means: Sequence[str] = ()) -> dict:
    """Exact medians (distributed selection, see ``quantiles.py``), modes
    (lowest value on ties) and means (one aggregate pass)."""
    aggs = [F.avg(c).alias(f"mean__{c}") for c in means]
    out = df.agg(*aggs).first().asDict() if aggs else {}
    for c in modes:
        out[f"mode__{c}"] = global_mode(df, c)
    if medians:
        for c, (m,) in exact_quantiles_multi(df, list(medians), [0.5]).items():
            out[f"median__{c}"] = m
    return out


def fill_median(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """Fill NULLs with the column median of ``fit`` (default: ``df``) (K2)."""
    cols = [c for c in cols if c in df.columns]
    st = global_stats(fit if fit is not None else df, medians=cols)
    return df.fillna({c: st[f"median__{c}"] for c in cols if st[f"median__{c}"] is not None})


def fill_mode(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None,
              default=None) -> DataFrame:
    """Fill NULLs with the most frequent value, ``default`` if there is none (K3)."""
    cols = [c for c in cols if c in df.columns]
    st = global_stats(fit if fit is not None else df, modes=cols)
    vals = {}
    for c in cols:
        v = st[f"mode__{c}"]
        v = default if v is None else v
        if v is not None:
            vals[c] = v
    return df.fillna(vals) if vals else df


def group_median(df: DataFrame, col: str, keys: Sequence[str], name: str | None = None) -> DataFrame:
    """Exact median per group, NULL keys dropped (D3).  Large (hot) groups
    are split over many tasks by ``quantiles.group_quantile``; no group's
    values are gathered into one task."""
    return group_quantile(df, col, keys, 0.5, name or f"median_{col}")


def fill_group_median(df: DataFrame, col: str, keys: Sequence[str],
                      fallbacks: Sequence[Sequence[str]] = (), global_fallback: bool = False,
                      fit: DataFrame | None = None, out: str | None = None) -> DataFrame:
    """Fill ``col`` with its median over ``keys``; when the group has no
    value, try each coarser key list of ``fallbacks`` in turn, then (option)
    the global median (K4, K5, E1, E2, C2)."""
    fit = fit if fit is not None else df
    res = df
    fills = []
    for i, ks in enumerate([list(keys), *[list(f) for f in fallbacks]]):
        m = group_median(fit, col, ks, name=f"_gm{i}")
        res = attach(res, m, ks)
        fills.append(F.col(f"_gm{i}"))
    if global_fallback:
        g = global_stats(fit, medians=[col])[f"median__{col}"]
        fills.append(F.lit(g))
    filled = F.coalesce(F.col(col), *fills)
    tmp = [f"_gm{i}" for i in range(len(fallbacks) + 1)]
    return res.withColumn(out or col, filled).drop(*tmp)


def fill_sentinel_median(df: DataFrame, col: str, sentinel=0, fit: DataFrame | None = None,
                         out: str | None = None) -> DataFrame:
    """Replace a sentinel by the column median computed with the sentinels
    still in, as the reference does (K6)."""
    m = global_stats(fit if fit is not None else df, medians=[col])[f"median__{col}"]
    return df.withColumn(out or col, F.when(F.col(col) == sentinel, F.lit(m)).otherwise(F.col(col)))
