"""Risk stratification tables.

Band a probability with a right-closed cut, then count / sum / mean the label
per band, completing bands that received no rows (count 0, sum 0, mean NULL),
as a categorical ``groupby`` does.

Plan: one partial aggregate per band (map-side combine, so a hot band costs
one row per task), then a join to the literal band dimension.  The dimension
has one row per label, fixed by the caller, so broadcasting it is bounded.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binning import cut_index


def band_dimension(spark, labels: Sequence[str], name: str = "band_label") -> DataFrame:
    schema = T.StructType([T.StructField("band", T.IntegerType(), False),
                           T.StructField(name, T.StringType(), False)])
    return spark.createDataFrame([(i, v) for i, v in enumerate(labels)], schema)


def risk_strata(df: DataFrame, score: str, label: str, edges: Sequence[float],
                labels: Sequence[str], extra_means: Sequence[str] = (),
                label_name: str = "risk_category", count_name: str = "patients",
                sum_name: str = "cases", rate_name: str = "rate") -> DataFrame:
    """One row per band: band number, band label, count, positives, rate,
    plus ``avg_<c>`` for each column in ``extra_means`` (D6)."""
    banded = df.select(cut_index(score, edges).alias("band"), F.col(label).alias("_y"),
                       *[F.col(c) for c in extra_means])
    aggs = [F.count(F.col("_y")).alias("_n"), F.sum("_y").alias("_s"), F.avg("_y").alias("_r")]
    aggs += [F.avg(c).alias(f"avg_{c}") for c in extra_means]
    per_band = banded.where(F.col("band").isNotNull()).groupBy("band").agg(*aggs)
    dim = F.broadcast(band_dimension(df.sparkSession, labels, label_name))
    out = dim.join(per_band, "band", "left")
    return out.select(
        "band", label_name,
        F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias(count_name),
        F.coalesce(F.col("_s"), F.lit(0)).cast("long").alias(sum_name),
        F.col("_r").alias(rate_name),
        *[F.col(f"avg_{c}") for c in extra_means],
    )
