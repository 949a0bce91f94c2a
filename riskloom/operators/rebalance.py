"""Minority over-sampling (L4 SMOTE, L5 ADASYN) on the exact kNN engine.

Randomness is derived from the row key and the copy number, so results are
reproducible on any cluster layout (and by an independent SQL engine):

* neighbour rank of copy ``c`` of row ``id``: ``1 + (id*7 + c) % k``;
* interpolation gap: ``u = ((id*13 + c*31) % 1000) / 1000``;
* synthetic vector: ``x + u * (neighbour - x)``.

The synthetic rows are produced with ``explode(sequence(...))`` on the
minority rows and an equi-join to their neighbour lists: no collect of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbors import knn
from .ordering import ordered_index


def _counts(df: DataFrame, label: str, minority) -> tuple[int, int]:
    row = df.agg(F.count_if(F.col(label) == F.lit(minority)).alias("n_min"),
                 F.count_if(F.col(label) != F.lit(minority)).alias("n_maj")).first()
    return int(row["n_min"]), int(row["n_maj"])


def _synthesise(minority_df: DataFrame, key: str, vec: str, copies: DataFrame, k: int) -> DataFrame:
    """``copies``: (key, n_copies).  Returns one row per synthetic sample."""
    nb = knn(minority_df, minority_df, k, key, vec, key, vec, exclude_self=True)
    kk = F.least(F.lit(k), F.col("_n_nb"))
    src = (minority_df.select(F.col(key).cast("long").alias("src_id"), F.col(vec).cast("array<double>").alias("_x"))
           .join(copies.select(F.col(key).cast("long").alias("src_id"), "n_copies"), "src_id")
           .where(F.col("n_copies") > 0)
           .select("src_id", "_x", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy")))
    n_nb = nb.groupBy("q_key").agg(F.count(F.lit(1)).alias("_n_nb"))
    src = src.join(n_nb.withColumnRenamed("q_key", "src_id"), "src_id")
    src = src.withColumn("nb_rank", (1 + (F.col("src_id") * 7 + F.col("copy")) % kk).cast("int")) \
             .withColumn("u", ((F.col("src_id") * 13 + F.col("copy") * 31) % 1000).cast("double") / 1000)
    nbv = nb.select(F.col("q_key").alias("src_id"), F.col("rank").alias("nb_rank"), F.col("nb_key").alias("nb_id"))
    vecs = minority_df.select(F.col(key).cast("long").alias("nb_id"), F.col(vec).cast("array<double>").alias("_n"))
    out = src.join(nbv, ["src_id", "nb_rank"]).join(vecs, "nb_id")
    new = F.zip_with("_x", "_n", lambda a, b: a + F.col("u") * (b - a))
    return out.select("src_id", "copy", "nb_id", "u", new.alias(vec))


def _originals(df: DataFrame, key: str, vec: str, label: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("src_id"), F.lit(None).cast("int").alias("copy"),
                     F.lit(None).cast("long").alias("nb_id"), F.lit(None).cast("double").alias("u"),
                     F.col(vec).cast("array<double>").alias(vec), F.col(label))


def _resampled(df: DataFrame, key: str, vec: str, label: str, new: DataFrame) -> DataFrame:
    """Every input row, then the synthetic ones (``copy`` not NULL)."""
    return _originals(df, key, vec, label).unionByName(new.select("src_id", F.col("copy").cast("int").alias("copy"), "nb_id", "u", vec,
                                                                  F.col(label).cast(df.schema[label].dataType).alias(label)))


def smote(df: DataFrame, key: str, vec: str, label: str, minority, ratio: float = 1.0,
          k: int = 5) -> DataFrame:
    """The table with the minority grown until minority / majority reaches
    ``ratio`` (``int(ratio * n_majority) - n_minority`` new rows, spread evenly
    over the minority rows in key order: the first ``n_new % n_min`` get one
    extra).  Returns ``(src_id, copy, nb_id, u, vec, label)``: the originals,
    with ``copy``, ``nb_id`` and ``u`` NULL, and the synthetic rows."""
    n_min, n_maj = _counts(df, label, minority)
    n_new = int(ratio * n_maj) - n_min
    mino = df.where(F.col(label) == F.lit(minority)).select(key, vec)
    if n_new <= 0 or n_min < 2:
        return _originals(df, key, vec, label)
    base, extra = divmod(n_new, n_min)
    pos = ordered_index(mino.select(key), [key], name="_pos")
    copies = pos.select(key, (F.lit(base) + F.when(F.col("_pos") - 1 < extra, 1).otherwise(0)).alias("n_copies"))
    return _resampled(df, key, vec, label, _synthesise(mino, key, vec, copies, k).withColumn(label, F.lit(minority)))


def adasyn(df: DataFrame, key: str, vec: str, label: str, minority, ratio: float = 1.0,
           k: int = 5) -> DataFrame:
    """ADASYN: each minority row gets copies in proportion to the share of
    majority rows among its ``k`` nearest neighbours (over all rows):
    ``rint(r_i / sum(r) * G)`` with ``G = int(ratio * n_majority) - n_minority``
    (half-to-even rounding).  Synthesis and result as in ``smote``."""
    n_min, n_maj = _counts(df, label, minority)
    g_total = int(ratio * n_maj) - n_min
    mino = df.where(F.col(label) == F.lit(minority)).select(key, vec)
    nb = knn(mino, df.select(key, vec), k, key, vec, key, vec, exclude_self=True)
    labels = df.select(F.col(key).cast("long").alias("nb_key"), F.col(label).alias("_nl"))
    hard = (nb.join(labels, "nb_key").groupBy("q_key")
            .agg((F.count_if(F.col("_nl") != F.lit(minority)) / F.lit(float(k))).alias("r")))
    total = hard.agg(F.sum("r")).first()[0] or 0.0
    if g_total <= 0 or total == 0:
        copies = hard.select(F.col("q_key").alias(key), F.lit(0).alias("n_copies"))
    else:
        copies = hard.select(F.col("q_key").alias(key),
                             F.bround(F.col("r") / F.lit(total) * F.lit(float(g_total)), 0).cast("int").alias("n_copies"))
    return _resampled(df, key, vec, label, _synthesise(mino, key, vec, copies, k).withColumn(label, F.lit(minority)))
