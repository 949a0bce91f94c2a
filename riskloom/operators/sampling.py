"""Reproducible splits, folds, class weights and under-sampling.

Randomness is a deterministic hash: rows are ordered by
``md5(key || ':' || seed)`` (key as tie-breaker), so the same data and seed
always give the same split on any cluster layout, and an independent SQL
engine reproduces it exactly.  Exact within-class positions come from
``ordering.ordered_index``: buckets are the leading bits of the md5, which
are uniform, so every class - however large - is spread over many tasks
instead of one window partition per class.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, default_parallelism
from .lookup import attach
from .ordering import hash_bucket, hash_order, ordered_index


def _buckets(df: DataFrame) -> int:
    return max(64, 8 * default_parallelism(df.sparkSession))


def hashed_rank(df: DataFrame, key: str, seed: int = 42, by: Sequence[str] = (),
                name: str = "_rank", size: str | None = None) -> DataFrame:
    """1-based position in md5 order within ``by`` groups (and, with ``size``,
    the group's number of rows)."""
    h = hash_order([key], seed)
    d = df.withColumn("_h", h)
    out = ordered_index(d, [F.col("_h"), F.col(key)], partition_cols=list(by),
                        bucket=hash_bucket(F.col("_h"), _buckets(df)), name=name, size=size)
    return out.drop("_h")


def strat_split(df: DataFrame, key: str, label: str, frac: float = 0.2, seed: int = 42,
                out: str = "_split") -> DataFrame:
    """Stratified hold-out: in each class the first ``floor(frac*n_c + 0.5)``
    rows in hash order are 'test', the rest 'train' (L1)."""
    # Class sizes come with the bucket offsets, so no row moves by its label alone.
    d = hashed_rank(df, key, seed, by=[label], size="_n_class")
    n_test = F.floor(F.col("_n_class") * F.lit(float(frac)) + F.lit(0.5))
    return d.withColumn(out, F.when(F.col("_rank") <= n_test, F.lit("test")).otherwise(F.lit("train"))) \
            .drop("_rank", "_n_class")


def strat_kfold(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42,
                out: str = "fold") -> DataFrame:
    """Stratified k-fold: fold = (position in class - 1) mod k, so fold sizes
    differ by at most one per class (L2)."""
    d = hashed_rank(df, key, seed, by=[label])
    return d.withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Plain shuffled k-fold over the whole table (L3)."""
    d = hashed_rank(df, key, seed)
    return d.withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Balanced weights n / (k * n_c) as a weight column."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n_class"))
    n, k = sizes.agg(F.sum("_n_class"), F.count(F.lit(1))).first()
    weights = sizes.select(label, (F.lit(float(n or 0)) / (F.lit(k) * F.col("_n_class"))).alias(out))
    return attach(df, weights, [label])


def balanced_undersample(df: DataFrame, key: str, label: str, n_bags: int = 3, seed: int = 42,
                         bag: str = "bag") -> DataFrame:
    """For each bag, every class cut to the minority size by hash order with
    a bag-specific seed (L7).  Output rows carry the bag number."""
    n_min = df.groupBy(label).count().agg(F.min("count")).first()[0]
    # Each bag keeps the rows of a class whose hash lies among its smallest.  A
    # row of a class of n rows is one of the n_min smallest only below a
    # threshold near n_min / n, so rows far above it never leave their task.
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n_class"))
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(":"), (F.lit(seed) + F.col(bag)).cast("string")))
    tagged = attach(df, sizes, [label]) if n_min else df.withColumn("_n_class", F.lit(0))
    want = F.lit(float(n_min or 0))
    limit = (want + 12 * F.sqrt(want) + 100) / F.col("_n_class")
    lead = F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / float(1 << 32)
    bags = (tagged.withColumn(bag, F.explode(F.sequence(F.lit(0), F.lit(n_bags - 1)))).withColumn("_h", h))
    near = cut_lineage(bags.where(F.coalesce(lead < limit, F.lit(True))).drop("_n_class"))
    # The threshold holds n_min rows of every class and bag unless chance says
    # otherwise; then (checked, not assumed) all rows are ranked.
    have = near.groupBy(bag, label).count().agg(F.min("count"), F.count(F.lit(1))).first()
    if n_min and (have[0] < n_min or have[1] < n_bags * sizes.count()):
        near = bags.drop("_n_class")
    ranked = ordered_index(near, [F.col("_h"), F.col(key)], partition_cols=[bag, label],
                           bucket=hash_bucket(F.col("_h"), _buckets(df)), name="_rank")
    return ranked.where(F.col("_rank") <= n_min).drop("_rank", "_h")
