"""Profiling aggregates (inventory D1-D12, D22, D23, F1-F3).

Each profile is a single aggregate pass (partial aggregation on the map
side, one small final stage) followed, where a long table is wanted, by an
``unpivot`` of the one-row result.  Nothing row-sized reaches the driver.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import exact_quantiles, exact_quantiles_multi, group_quantiles

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Dtype-driven column selection."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """Count per non-null value."""
    return (df.where(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias(name)))


def prevalence(df: DataFrame, label: str) -> DataFrame:
    """Rows, positives, percent positive and the integer imbalance ratio
    ``floor(n0 / n1)`` (D2); the ratio is NULL without positives."""
    n = F.count(F.lit(1))
    pos = F.count_if(F.col(label) == 1)
    neg = F.count_if(F.col(label) == 0)
    return df.agg(n.alias("n"), pos.alias("positives"), neg.alias("negatives"),
                  F.try_divide(F.lit(100.0) * pos, n).alias("positive_pct"),
                  F.floor(F.try_divide(neg, pos)).alias("imbalance_ratio"))


def shape(df: DataFrame) -> DataFrame:
    """Row and column counts."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_cols", F.lit(len(df.columns)))


def null_profile(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """Per column: type, non-null count, missing count and percent (2 dp),
    one pass (D12, D23).  With ``only_missing`` only columns with missing
    values remain; order by ``missing`` descending for the report (F2)."""
    n = F.count(F.lit(1)).alias("_n")
    aggs = [n]
    for c in df.columns:
        aggs.append(F.count(F.col(c)).alias(f"nn__{c}"))
    one = df.agg(*aggs)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    stacked = one.select("_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("dtype"),
                 F.col(f"nn__{c}").alias("non_null")) for c in df.columns])).alias("s"))
    out = stacked.select("s.column_name", "s.dtype", "s.non_null",
                         (F.col("_n") - F.col("s.non_null")).alias("missing"),
                         F.round(F.try_divide(F.lit(100.0) * (F.col("_n") - F.col("s.non_null")), F.col("_n")), 2)
                         .alias("missing_pct"))
    return out.where(F.col("missing") > 0) if only_missing else out


def describe(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max per column (D7),
    optionally per group.  Unlike ``DataFrame.summary`` the quartiles are
    exact (linear interpolation), computed without gathering a column or a
    large group into one task (``quantiles.py``)."""
    aggs = []
    by = list(by)
    qs = {} if by else exact_quantiles_multi(df, cols, [0.25, 0.5, 0.75])
    for c in cols:
        x = F.col(c)
        q = F.array(*[F.lit(v).cast("double") for v in qs[c]]) if not by else F.lit(None)
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).cast("double").alias(f"{c}__min"),
                 F.first(q).alias(f"{c}__q"), F.max(x).cast("double").alias(f"{c}__max")]
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    if by:
        # Quartiles of all columns from one pass, one row per group and column.
        gq = group_quantiles(df, cols, by, [0.25, 0.5, 0.75])
        gq = gq.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("column", "q"))).alias("_qs"))
        wide = wide.drop(*[f"{c}__q" for c in cols]).join(gq, by, "left")
        wide = wide.withColumns({f"{c}__q": F.col("_qs")[c] for c in cols}).drop("_qs")
    rows = F.explode(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col(f"{c}__count").alias("count"),
        F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std"),
        F.col(f"{c}__min").alias("min"), F.col(f"{c}__q")[0].alias("q25"),
        F.col(f"{c}__q")[1].alias("q50"), F.col(f"{c}__q")[2].alias("q75"),
        F.col(f"{c}__max").alias("max")) for c in cols]))
    return wide.select(*by, rows.alias("s")).select(*by, "s.*")


def skew_profile(df: DataFrame, cols: Sequence[str], threshold: float = 0.75) -> DataFrame:
    """Population skewness per column, NULLs skipped, and whether its
    absolute value exceeds ``threshold`` (D9)."""
    one = df.agg(*[F.skewness(c).alias(c) for c in cols])
    s = one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("skew")) for c in cols])).alias("s"))
    return s.select("s.column_name", "s.skew",
                    F.when(F.abs(F.col("s.skew")) > threshold, 1).otherwise(0).alias("skewed"))


def distinct_levels(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-null values."""
    return df.select(col).where(F.col(col).isNotNull()).distinct()


def top_k(df: DataFrame, by: str, k: int, tie: str, ascending: bool = False) -> DataFrame:
    """First ``k`` rows by ``by`` with a tie-breaker (F1, F3); planned as
    TakeOrderedAndProject, a per-task top-k and one merge of k rows each."""
    o = F.col(by).asc() if ascending else F.col(by).desc()
    return df.orderBy(o, F.col(tie).asc()).limit(k)


def output_summary(df: DataFrame, col: str) -> DataFrame:
    """min, max, mean, exact median of one column."""
    x = F.col(col)
    med = exact_quantiles(df, col, [0.5])[0]
    return df.agg(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"),
                  F.lit(med).cast("double").alias("median"))
