"""Exact ordered positions and running sums without a single-partition window.

``row_number().over(Window.orderBy(k))`` (no partition) moves every row into
one task.  Instead rows are split into order-preserving buckets, each bucket's
totals are aggregated (a table of buckets x groups), turned into per-bucket
offsets by a window over that small table, joined back on the bucket, and the
final running value is ``offset + running value within the bucket``.  The
window that remains is partitioned by bucket, so the work spreads over as many
tasks as there are buckets.

Buckets come either from the caller (a column already monotone in the order,
e.g. the leading bits of a uniform hash) or from a range partitioning on the
real order columns, whatever their types; NULL sorts first ascending and last
descending, as in ``row_number()``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, default_parallelism

_B = "_rl_bucket"


def range_buckets(df: DataFrame, order: Sequence[Column], n_buckets: int | None = None) -> DataFrame:
    """Add the number of the range partition that each row falls into.  The
    rows are written to the checkpoint folder: the bounds come from a sample,
    and every reader of the buckets has to see the same ones."""
    n = n_buckets or max(1, default_parallelism(df.sparkSession))
    return cut_lineage(df.repartitionByRange(n, *order).withColumn(_B, F.spark_partition_id()))


def running_sums(df: DataFrame, order_cols: Sequence, sum_cols: Sequence[str],
                 partition_cols: Sequence[str] = (), bucket: Column | None = None,
                 n_buckets: int | None = None, prefix: str = "cum_",
                 descending: bool = False, totals_prefix: str | None = None) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` in ``order_cols`` order within
    ``partition_cols`` (NULL is a group of its own).  ``order_cols`` must make
    the order total (add a key as tie-breaker) for the result to be
    deterministic.  With ``descending`` every order column is descending (a
    caller's bucket is then built ascending on the leading column; it is
    reversed here).  ``totals_prefix`` also adds the whole group's sums."""
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    ordered = [c.desc() if descending else c.asc() for c in order_cols]
    parts = list(partition_cols)
    if bucket is None:
        d = range_buckets(df, [*[F.col(p) for p in parts], *ordered], n_buckets)
        bcol = F.col(_B)
    else:
        d = df.withColumn(_B, bucket)
        bcol = -F.col(_B) if descending else F.col(_B)
    totals = d.groupBy(*parts, _B).agg(*[F.sum(c).alias(f"_rl_t_{c}") for c in sum_cols])
    # One row per bucket (and group): the window over them is small.
    w_off = Window.partitionBy(*parts).orderBy(bcol.asc()).rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum(f"_rl_t_{c}").over(Window.partitionBy(*parts)).alias(f"_rl_a_{c}") for c in sum_cols] if totals_prefix else []
    offsets = totals.select(
        *[F.col(p).alias(f"_rl_p{i}") for i, p in enumerate(parts)], F.col(_B).alias("_rl_ob"), *extra,
        *[F.coalesce(F.sum(f"_rl_t_{c}").over(w_off), F.lit(0)).alias(f"_rl_o_{c}") for c in sum_cols])
    on = F.col(_B) == F.col("_rl_ob")
    for i, p in enumerate(parts):
        on = on & F.col(p).eqNullSafe(F.col(f"_rl_p{i}"))
    # Without groups there is one offset row for each bucket, that is, for each
    # shuffle partition: a bound that does not follow the data.
    joined = d.join(offsets if parts else F.broadcast(offsets), on, "inner")
    w_in = Window.partitionBy(*parts, _B).orderBy(*ordered).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_rl_o_{c}") + F.sum(c).over(w_in)).alias(prefix + c) for c in sum_cols],
        *([F.col(f"_rl_a_{c}").alias(totals_prefix + c) for c in sum_cols] if totals_prefix else []))


def ordered_index(df: DataFrame, order_cols: Sequence, partition_cols: Sequence[str] = (),
                  bucket: Column | None = None, name: str = "rn",
                  n_buckets: int | None = None, size: str | None = None) -> DataFrame:
    """1-based position of each row in ``order_cols`` order within
    ``partition_cols`` (the value ``row_number()`` would give) and, with
    ``size``, the number of rows of its group under that name."""
    one = "_rl_one"
    out = running_sums(df.withColumn(one, F.lit(1).cast("long")), order_cols, [one],
                       partition_cols, bucket, n_buckets, prefix="_rl_cum", totals_prefix="_rl_all" if size else None)
    out = out.withColumnRenamed("_rl_cum" + one, name).drop(one)
    return out.withColumnRenamed("_rl_all" + one, size) if size else out


def hash_order(key_cols: Sequence[str], seed: int = 42) -> Column:
    """Deterministic pseudo-random order key: md5 of the key text and seed.

    Both Spark and SQL engines have the same ``md5``, so an oracle can
    reproduce the order exactly.
    """
    text = F.concat(*[F.col(c).cast("string") for c in key_cols], F.lit(f":{seed}")) \
        if len(key_cols) == 1 else F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols],
                                              F.lit(str(seed)))
    return F.md5(text)


def hash_bucket(md5_col: Column, n_buckets: int) -> Column:
    """Order-preserving bucket of an md5 hex string (its leading 24 bits are
    uniform, so buckets are balanced without a sampling pass)."""
    lead = F.conv(F.substring(md5_col, 1, 6), 16, 10).cast("long")
    return (lead * n_buckets / F.lit(1 << 24)).cast("int")
