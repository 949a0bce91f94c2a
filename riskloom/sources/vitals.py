"""Deterministic clinical "vitals" view derived from ``orders``.

The clinical scripts this library re-expresses read small patient tables;
at scale those are stood in for by a view computed from each ``orders`` row
with integer hashing only, so Spark and an independent SQL engine produce
bit-identical inputs.  With

    h(a, m) = (o_orderkey * a + o_custkey * 3 + a) % m
    d(a, m) = CAST(h(a, m) AS DOUBLE) / 10

every measurement is ``offset + h`` or ``offset + d``.  ``temp``, ``sc`` and
``bmi`` are NULL on every 11th, 13th and 17th order key, so missing values come
in every combination.  The ranges reach every band and rule of the scores.  The spec renders one list of SQL expressions that Spark
(``selectExpr``) and the oracle engine both evaluate, so they cannot drift
apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import load

# Fixed values of the view: (name, kind, multiplier a, modulus m, offset, NULL on
# every so many order keys or False).
# kind: "i" = offset + h, "d" = offset + h/10, "n" = offset - h, "f" = flag h == 0.
MEASURES = [
    ("age", "i", 5, 78, 18, False),
    ("temp", "d", 7, 50, 35, 11),
    ("hr", "i", 37, 100, 50, False),
    ("rr", "i", 11, 25, 10, False),
    ("wbc", "d", 13, 240, 1, False),
    ("sbp", "i", 17, 160, 70, False),
    ("dbp", "i", 19, 110, 40, False),
    ("gcs", "n", 23, 6, 15, False),
    ("pf", "i", 29, 450, 50, False),
    ("sc", "d", 31, 60, 0.1, 13),
    ("plt", "i", 41, 400, 10, False),
    ("bili", "d", 43, 140, 0.2, False),
    ("lact", "d", 47, 100, 0.5, False),
    ("vaso", "f", 53, 5, 0, False),
    ("stay_hours", "i", 59, 168, 1, False),
    ("bu", "i", 67, 150, 10, False),
    ("pot", "d", 71, 40, 3, False),
    ("hemo", "d", 73, 120, 6, False),
    ("al", "i", 79, 6, 0, False),
    ("sod", "i", 83, 25, 125, False),
    ("glucose", "i", 89, 200, 60, False),
    ("bmi", "d", 97, 300, 15, 17),
    ("oldpeak", "d", 127, 40, 0, False),
    ("max_hr", "i", 131, 140, 60, False),
    ("insulin", "i", 137, 300, 15, False),
    ("pedigree", "d", 139, 25, 0, False),
    ("pregnancies", "i", 149, 10, 0, False),
    ("chol", "i", 229, 300, 120, False),
    ("hypertension", "f", 151, 4, 0, False),
    ("heart_disease", "f", 157, 4, 0, False),
    ("diabetes", "f", 163, 4, 0, False),
    ("chf", "f", 167, 4, 0, False),
    ("copd", "f", 173, 4, 0, False),
    ("ckd", "f", 179, 4, 0, False),
    ("immuno", "f", 181, 4, 0, False),
    ("pe", "f", 191, 4, 0, False),
    ("ane", "f", 197, 4, 0, False),
    ("fasting_bs", "f", 199, 4, 0, False),
    ("ventilation", "f", 211, 4, 0, False),
]

# Categorical columns, (name, a, m, levels in hash order).
CATEGORIES = [
    ("sex", 107, 2, ["M", "F"]),
    ("chest_pain", 109, 4, ["TA", "ATA", "NAP", "ASY"]),
    ("angina", 113, 4, ["Y", "N", "N", "N"]),
    ("smoking", 103, 4, ["smokes", "formerly smoked", "never smoked", "Unknown"]),
]

# Score-like columns: p = h(61,1001)/1000 hits 0 and 1 exactly; p2, p3 and
# p4 are further member "model" probabilities; y is a noisy function of p.
SCORES = [("p", 61), ("p2", 227), ("p3", 233), ("p4", 241)]
LABEL = ("y", 61, 1001, 101, 400, 850)
# Every 9th order carries a sentinel zero cholesterol (heart table convention).
CHOL_ZERO = (239, 9)


def _h_sql(a: int, m: int) -> str:
    return f"((o_orderkey * {a} + o_custkey * 3 + {a}) % {m})"


def _measure_sql(kind: str, a: int, m: int, off) -> str:
    if kind == "i":
        return f"CAST({off} + {_h_sql(a, m)} AS INTEGER)"
    if kind == "n":
        return f"CAST({off} - {_h_sql(a, m)} AS INTEGER)"
    if kind == "d":
        return f"(CAST({float(off)!r} AS DOUBLE) + CAST({_h_sql(a, m)} AS DOUBLE) / 10)"
    return f"CASE WHEN {_h_sql(a, m)} = 0 THEN 1 ELSE 0 END"


def vitals_from_orders(orders: DataFrame) -> DataFrame:
    """Project the vitals view from an ``orders`` scan.

    Spark parses the very SQL expressions the oracle runs (one
    ``selectExpr``: one plan-building call instead of hundreds of Column
    calls); only ``o_orderkey`` and ``o_custkey`` are read from the scan."""
    return orders.selectExpr(*vitals_exprs())


def vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vitals_from_orders(load(spark, sf_dir, "orders"))


def vitals_exprs() -> list[str]:
    """The view as SQL select expressions (shared by Spark and the oracle)."""
    parts = ["o_orderkey AS id"]
    for name, kind, a, m, off, nullable in MEASURES:
        e = _measure_sql(kind, a, m, off)
        if name == "chol":
            e = f"CASE WHEN {_h_sql(*CHOL_ZERO)} = 0 THEN 0 ELSE {e} END"
        if nullable:
            e = f"CASE WHEN o_orderkey % {nullable} <> 0 THEN {e} END"
        parts.append(f"{e} AS {name}")
    parts.append(f"CASE WHEN {_h_sql(193, 4)} = 0 THEN 0 ELSE 1 END AS appet")
    for name, a, m, levels in CATEGORIES:
        whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(levels))
        parts.append(f"CASE {_h_sql(a, m)} {whens} END AS {name}")
    for name, a in SCORES:
        parts.append(f"CAST({_h_sql(a, 1001)} AS DOUBLE) / 1000 AS {name}")
    yname, a1, m1, a2, m2, thr = LABEL
    parts.append(f"CASE WHEN {_h_sql(a1, m1)} + {_h_sql(a2, m2)} > {thr} THEN 1 ELSE 0 END AS {yname}")
    return parts


def vitals_sql() -> str:
    """The same view as one SQL statement (for the independent oracle)."""
    return "SELECT " + ",\n       ".join(vitals_exprs()) + "\nFROM orders"
