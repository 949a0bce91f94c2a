"""Sinks (A4-A6): CSV outputs and the metrics report.

Writes are distributed (one file per task under the output folder); a
report is a small long table ``(section, name, value, rank)`` that can also
be written as text lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header and no index column (A4); a group key written by
    the caller is an ordinary column (A5)."""
    df.write.mode(mode).option("header", True).csv(path)


def _long(one_row: DataFrame, section: str, first_rank: int = 1) -> DataFrame:
    cols = one_row.columns
    return one_row.select(F.explode(F.array(*[
        F.struct(F.lit(section).alias("section"), F.lit(c).alias("name"),
                 F.col(c).cast("double").alias("value"), F.lit(first_rank + i).alias("rank"))
        for i, c in enumerate(cols)])).alias("s")).select("s.*")


def metrics_report(*parts: DataFrame, k: int = 10) -> DataFrame:
    """Long report table (A6).  All but the last part are one-row metric
    frames (each column a metric); the last is a one-row frame of feature
    importances of which the top ``k`` are kept (rank by value, then name).
    The importance table has one row per feature, so its ranking window is
    bounded by the schema, not by the data."""
    *metric_frames, importances = parts
    out = None
    rank = 1
    for m in metric_frames:
        cols = [c for c in m.columns if c not in ("tn", "fp", "fn", "tp", "nns")]
        part = _long(m.select(*cols), "metric", rank)
        rank += len(cols)
        out = part if out is None else out.unionByName(part)
    imp = _long(importances, "top_predictor").drop("rank")
    w = Window.orderBy(F.col("value").desc(), F.col("name").asc())
    top = imp.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.unionByName(top.select("section", "name", "value", "rank")) if out is not None else top


def write_report_text(report: DataFrame, path: str) -> None:
    """Report lines ``section<TAB>name<TAB>value`` as text files."""
    line = F.format_string("%s\t%s\t%.4f", F.col("section"), F.col("name"), F.col("value"))
    report.orderBy("section", "rank").select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)
