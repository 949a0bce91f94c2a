"""Stateless risk scoring on a stream.

The reference has no streaming component; its "early warning" is a batch
cut on a probability.  Every row-level operator here (flags, rule scores,
right-closed bands) is a pure projection, so the same expressions run
unchanged on ``readStream`` input.  This module wires them into a
Structured Streaming query; checkpoints go to the caller's location.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import scores as S
from ..functions.binning import cut
from ..functions.scores import egfr, mean_arterial_pressure
from ..sources.vitals import vitals_from_orders

# Alert bands of the early-warning table.
ALERT_EDGES = [0, 0.1, 0.3, 0.5, 0.7, 0.9, 1.0]
ALERT_LABELS = ["Green", "Yellow-Low", "Yellow-High", "Orange", "Red", "Critical"]


def score_frame(orders: DataFrame) -> DataFrame:
    """Vitals, SIRS / qSOFA / SOFA and the alert band, as one projection
    (works on batch and streaming frames alike)."""
    v = vitals_from_orders(orders)
    v = v.withColumns({"map": mean_arterial_pressure(), "egfr": egfr()})
    out = v.select("id", "p", "y",
                   S.additive_score(S.SIRS).alias("sirs_score"),
                   S.additive_score(S.QSOFA).alias("qsofa_score"),
                   *S.sofa_columns(),
                   cut("p", ALERT_EDGES, ALERT_LABELS).alias("alert_level"))
    return out.select("id", "p", "y", "sirs_score", "qsofa_score", "sofa_total", "alert_level")


def orders_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Streaming scan of the orders parquet folder (schema taken from the
    batch scan: streaming sources need it up front)."""
    path = f"{sf_dir.rstrip('/')}/orders.parquet"
    schema = spark.read.parquet(path).schema
    # A file stream watches a folder; the glob keeps it to the orders file(s).
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .option("pathGlobFilter", "orders*.parquet").parquet(sf_dir))


def start_scoring(spark: SparkSession, sf_dir: str, sink_table: str, checkpoint: str):
    """Score the orders stream into an in-memory table (tests, notebooks) and
    return the running query."""
    scored = score_frame(orders_stream(spark, sf_dir))
    return (scored.writeStream.format("memory").queryName(sink_table)
            .option("checkpointLocation", checkpoint).outputMode("append").start())
