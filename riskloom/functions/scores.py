"""Rule scores and clinical indices (inventory M, B11, B12).

Two reusable operators cover every score of the reference:

* ``additive_score(rules)``: sum of the weights of the rules whose predicate
  holds (conditional increment, B12).
* ``tiered_score(tiers)``: conditional overwrite where the last matching
  assignment wins (B11); rendered as a CASE chain in reverse order.

A rule is ``(name, weight, conditions)`` where ``conditions`` is a list of
``(column, op, value)`` OR-ed together.  A missing input makes its condition
false, never the score NULL.  Each table renders to a Spark ``Column`` and to
SQL text from the same definition.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import clip, col

_OPS = {
    ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
    "==": lambda c, v: c == v, "!=": lambda c, v: c != v,
    "isin": lambda c, v: c.isin(list(v)),
}


def _lit_sql(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return str(v)


def condition(conds, rename=None) -> Column:
    rename = rename or {}
    out = None
    for c, op, v in conds:
        e = _OPS[op](col(rename.get(c, c)), F.lit(v) if op != "isin" else v)
        out = e if out is None else (out | e)
    return out


def condition_sql(conds, rename=None) -> str:
    rename = rename or {}
    parts = []
    for c, op, v in conds:
        name = rename.get(c, c)
        if op == "isin":
            parts.append(f"{name} IN ({', '.join(_lit_sql(x) for x in v)})")
        else:
            parts.append(f"{name} {'=' if op == '==' else '<>' if op == '!=' else op} {_lit_sql(v)}")
    return "(" + " OR ".join(parts) + ")"


def additive_score(rules, rename=None) -> Column:
    """Sum of weights of matching rules; NULL inputs contribute 0."""
    terms = [F.when(condition(conds, rename), F.lit(w)).otherwise(F.lit(0))
             for _, w, conds in rules]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def additive_score_sql(rules, rename=None) -> str:
    return "(" + " + ".join(
        f"CASE WHEN {condition_sql(conds, rename)} THEN {w} ELSE 0 END"
        for _, w, conds in rules) + ")"


def rule_flags(rules, prefix: str = "", rename=None) -> list[Column]:
    """One 0/1 column per rule (component flags kept, M8/M9)."""
    return [F.when(condition(conds, rename), F.lit(1)).otherwise(F.lit(0)).alias(prefix + name)
            for name, _, conds in rules]


def tiered_score(tiers, base: int = 0, rename=None) -> Column:
    """Last matching tier wins; ``tiers`` is in assignment order."""
    out = None
    for value, conds in reversed(tiers):
        c = condition(conds, rename)
        out = F.when(c, F.lit(value)) if out is None else out.when(c, F.lit(value))
    return out.otherwise(F.lit(base))


def tiered_score_sql(tiers, base: int = 0, rename=None) -> str:
    whens = " ".join(f"WHEN {condition_sql(conds, rename)} THEN {value}"
                     for value, conds in reversed(tiers))
    return f"CASE {whens} ELSE {base} END"


# ---------------------------------------------------------------------------
# Rule tables of the reference scores, written against the
# column names of the vitals view (``rename`` maps them onto other tables).

# M1 cardiovascular risk
CV = [
    ("hypertension", 2, [("hypertension", "==", 1)]),
    ("heart_disease", 3, [("heart_disease", "==", 1)]),
    ("age", 1, [("age", ">", 55)]),
    ("glucose", 1, [("glucose", ">", 125)]),
    ("bmi", 1, [("bmi", ">", 30)]),
    ("smoking", 1, [("smoking", "isin", ("smokes", "formerly smoked"))]),
]
# M2 cardiac risk
CARDIAC = [
    ("age", 1, [("age", ">", 55)]),
    ("sex", 1, [("sex", "==", "M")]),
    ("chest_pain", 2, [("chest_pain", "==", "TA")]),
    ("angina", 2, [("angina", "==", "Y")]),
    ("oldpeak", 1, [("oldpeak", ">", 1)]),
    ("fasting_bs", 1, [("fasting_bs", "==", 1)]),
]
# M4 metabolic syndrome (BP is the vitals systolic column)
METABOLIC = [
    ("glucose", 1, [("glucose", ">", 100)]),
    ("bp", 1, [("sbp", ">", 130)]),
    ("bmi", 1, [("bmi", ">", 30)]),
]
# M7 diabetes risk
DIABETES_RISK = [
    ("glucose", 3, [("glucose", ">", 125)]),
    ("bmi", 2, [("bmi", ">", 30)]),
    ("age", 2, [("age", ">", 45)]),
    ("pedigree", 2, [("pedigree", ">", 0.5)]),
    ("bp", 1, [("sbp", ">", 140)]),
]
# M8 SIRS
SIRS = [
    ("temp", 1, [("temp", ">", 38), ("temp", "<", 36)]),
    ("hr", 1, [("hr", ">", 90)]),
    ("rr", 1, [("rr", ">", 20)]),
    ("wbc", 1, [("wbc", ">", 12), ("wbc", "<", 4)]),
]
# M9 qSOFA
QSOFA = [
    ("bp", 1, [("sbp", "<=", 100)]),
    ("rr", 1, [("rr", ">=", 22)]),
    ("gcs", 1, [("gcs", "<", 15)]),
]
# M10-M14 SOFA components, tiers in assignment order
SOFA_CARDIOVASCULAR = [(1, [("map", "<", 70)]), (3, [("vaso", "==", 1)])]
SOFA_RESPIRATORY = [(1, [("pf", "<", 400)]), (2, [("pf", "<", 300)]),
                    (3, [("pf", "<", 200)]), (4, [("pf", "<", 100)])]
SOFA_RENAL = [(1, [("sc", ">=", 1.2)]), (2, [("sc", ">=", 2.0)]),
              (3, [("sc", ">=", 3.5)]), (4, [("sc", ">=", 5.0)])]
SOFA_COAGULATION = [(1, [("plt", "<", 150)]), (2, [("plt", "<", 100)]),
                    (3, [("plt", "<", 50)]), (4, [("plt", "<", 20)])]
SOFA_LIVER = [(1, [("bili", ">=", 1.2)]), (2, [("bili", ">=", 2.0)]),
              (3, [("bili", ">=", 6.0)]), (4, [("bili", ">=", 12.0)])]
SOFA = [("cardiovascular", SOFA_CARDIOVASCULAR), ("respiratory", SOFA_RESPIRATORY),
        ("renal", SOFA_RENAL), ("coagulation", SOFA_COAGULATION), ("liver", SOFA_LIVER)]
# M20 comorbidity flags
COMORBIDITIES = ["diabetes", "hypertension", "chf", "copd", "ckd", "immuno"]
# M27 uraemia risk
URAEMIA = [
    ("bu", 1, [("bu", ">", 40)]),
    ("sc", 2, [("sc", ">", 2)]),
    ("pot", 2, [("pot", ">", 5.5)]),
    ("hemo", 1, [("hemo", "<", 10)]),
    ("appet", 1, [("appet", "==", 0)]),
]
# M28 system involvement (htn is the hypertension flag)
SYSTEM_INVOLVEMENT = [
    ("ane", 1, [("ane", "==", 1)]),
    ("htn", 1, [("hypertension", "==", 1)]),
    ("al", 1, [("al", ">", 0)]),
    ("appet", 1, [("appet", "==", 0)]),
]
# M29 ICU admission risk (bp is the vitals systolic column)
ICU_RISK = [
    ("pot", 3, [("pot", ">", 6.0)]),
    ("egfr", 3, [("egfr", "<", 15)]),
    ("bu", 2, [("bu", ">", 100)]),
    ("bp", 2, [("sbp", ">", 180)]),
    ("hemo", 2, [("hemo", "<", 7)]),
    ("pe", 1, [("pe", "==", 1)]),
]
# M22 eGFR constants, M23 CKD stage edges and labels
EGFR_K, EGFR_KAPPA, EGFR_ALPHA, EGFR_BETA, EGFR_AGE, EGFR_SEX = 141, 0.9, -0.411, -1.209, 0.993, 0.742
EGFR_CLIP = (5, 150)
CKD_STAGE_EDGES = [0, 15, 30, 45, 60, 90, 150]
CKD_STAGE_LABELS = ["Stage5", "Stage4", "Stage3b", "Stage3a", "Stage2", "Stage1"]


def mean_arterial_pressure(sbp="sbp", dbp="dbp") -> Column:
    """(SBP + 2 DBP) / 3."""
    return (col(sbp) + 2 * col(dbp)).cast("double") / 3


def egfr(sc="sc", age="age") -> Column:
    """Simplified CKD-EPI with the fixed sex factor, clipped.

    ``least``/``greatest`` skip NULLs, so a missing creatinine is guarded
    explicitly: the result is NULL, as NaN propagates in the reference."""
    r = col(sc) / EGFR_KAPPA
    g = (F.lit(float(EGFR_K)) * F.pow(F.least(r, F.lit(1.0)), F.lit(EGFR_ALPHA))
         * F.pow(F.greatest(r, F.lit(1.0)), F.lit(EGFR_BETA))
         * F.pow(F.lit(EGFR_AGE), col(age)))
    return F.when(col(sc).isNotNull() & col(age).isNotNull(), clip(g * EGFR_SEX, *EGFR_CLIP))


def egfr_sql(sc="sc", age="age") -> str:
    r = f"({sc} / {EGFR_KAPPA!r})"
    g = (f"(CAST({float(EGFR_K)!r} AS DOUBLE) * pow(least({r}, 1.0), {EGFR_ALPHA!r})"
         f" * pow(greatest({r}, 1.0), {EGFR_BETA!r}) * pow({EGFR_AGE!r}, {age}))")
    g = f"({g} * {EGFR_SEX!r})"
    return (f"CASE WHEN {sc} IS NOT NULL AND {age} IS NOT NULL "
            f"THEN least(greatest({g}, {EGFR_CLIP[0]}), {EGFR_CLIP[1]}) END")


def sofa_columns(rename=None) -> list[Column]:
    """Five SOFA components, their total and the multi-organ count."""
    comps = [tiered_score(t, rename=rename).alias(f"sofa_{n}") for n, t in SOFA]
    total = None
    organs = None
    for n, t in SOFA:
        s = tiered_score(t, rename=rename)
        total = s if total is None else total + s
        o = F.when(s > 0, 1).otherwise(0)
        organs = o if organs is None else organs + o
    return comps + [total.alias("sofa_total"), organs.alias("multi_organ")]
