"""Data-dependent cuts (I2, I3): edges from one aggregate, then the
right-closed CASE chain of ``functions.binning``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binning import cut_index
from .quantiles import exact_quantiles


def width_edges(lo: float, hi: float, n: int) -> list[float]:
    """Equal-width edges as ``pd.cut(x, n)`` builds them: ``i * step + lo``,
    the last edge exactly ``hi``, the first lowered by 0.1 % of the range."""
    if lo == hi:
        adj = abs(lo) * 0.001 if lo != 0 else 0.001
        return [lo - adj + i * (2 * adj / n) for i in range(n)] + [hi + adj]
    step = (hi - lo) / n
    edges = [i * step + lo for i in range(n)] + [hi]
    edges[0] = edges[0] - (hi - lo) * 0.001
    return edges


def cut_width(df: DataFrame, col: str, n: int, out: str | None = None) -> tuple[DataFrame, list[float]]:
    """Equal-width bins (0-based number) and their edges."""
    row = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    edges = width_edges(float(row["lo"]), float(row["hi"]), n)
    return df.withColumn(out or f"{col}_bin", cut_index(col, edges)), edges


def quantile_probs(n: int) -> list[float]:
    # Same float values as numpy.linspace(0, 1, n + 1).
    step = 1.0 / n
    return [i * step for i in range(n)] + [1.0]


def quantile_edges(df: DataFrame, col: str, n: int) -> list[float]:
    """Exact quantile edges (linear interpolation); duplicate edges are an
    error, as in ``pd.qcut``."""
    qs = exact_quantiles(df, col, quantile_probs(n))
    if len(set(qs)) != len(qs):
        raise ValueError(f"bin edges must be unique: {qs}")
    return [float(q) for q in qs]


def cut_quantile(df: DataFrame, col: str, n: int, out: str | None = None) -> tuple[DataFrame, list[float]]:
    """Quantile bins, lowest value included in the first bin."""
    edges = quantile_edges(df, col, n)
    x = F.col(col)
    idx = F.when(x == F.lit(edges[0]), F.lit(0)).otherwise(cut_index(col, edges))
    return df.withColumn(out or f"{col}_bin", idx), edges
