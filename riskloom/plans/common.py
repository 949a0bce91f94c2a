"""Shared pieces of the query catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import egfr, mean_arterial_pressure
from ..sources import load, vitals_from_orders, vitals_sql

# The oracle's own wording of the mean pressure and the eGFR formula.
SQL_VITALS = ("vitals AS (" + vitals_sql() + """),
vx AS (SELECT *, CAST(sbp + 2 * dbp AS DOUBLE) / 3 AS map,
    CASE WHEN sc IS NOT NULL THEN greatest(5, least(150, 141 * pow(CASE WHEN sc < 0.9 THEN sc / 0.9 ELSE 1 END, -0.411)
        * pow(CASE WHEN sc > 0.9 THEN sc / 0.9 ELSE 1 END, -1.209) * pow(0.993, age) * 0.742)) END AS egfr FROM vitals)""")


def with_vitals(body: str) -> str:
    return "WITH " + SQL_VITALS + "\n" + body


def vx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vitals plus mean arterial pressure and eGFR (used by many scores)."""
    v = vitals_from_orders(load(spark, sf_dir, "orders"))
    return v.withColumns({"map": mean_arterial_pressure(), "egfr": egfr()})


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load(spark, sf_dir, name)
