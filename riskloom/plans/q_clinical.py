"""Clinical scores, bands, flags and risk strata over the vitals view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.binning import cut
from ..functions.columns import between_flag, flag, present_flag, safe_div
from ..operators.impute import fill_sentinel_median
from ..operators.strata import risk_strata
from ..streaming.scoring import ALERT_EDGES, ALERT_LABELS
from .common import r6, vx, with_vitals
from .registry import register

# Band tables of the reference (edges, labels).
STROKE_RISK = ([0, 0.1, 0.3, 0.5, 0.7, 1.0], ["Very Low", "Low", "Moderate", "High", "Critical"])
CKD_RISK = ([0, 0.2, 0.4, 0.6, 0.8, 1.0], ["Very Low", "Low", "Moderate", "High", "Critical"])
ALERT = (ALERT_EDGES, ALERT_LABELS)
ACTION = ([0, 0.3, 0.5, 1.0], ["Monitor", "Investigate", "Intervene"])
BANDS = {
    # column of the vitals view -> (edges, labels)
    "age_risk": ("age", [0, 45, 55, 65, 75, 100], ["Low", "Moderate", "High", "Very High", "Critical"]),
    "bmi_category": ("bmi", [0, 18.5, 25, 30, 35, 100],
                     ["Underweight", "Normal", "Overweight", "Obese", "Severely Obese"]),
    "diabetes_bmi": ("bmi", [0, 18.5, 25, 30, 35, 100],
                     ["Underweight", "Normal", "Overweight", "Obese", "Severely_Obese"]),
    "diabetes_glucose": ("glucose", [0, 100, 125, 200, 500], ["Normal", "Prediabetic", "Diabetic", "Severe"]),
    "glucose_risk": ("glucose", [0, 100, 125, 200, 500], ["Normal", "Prediabetic", "Diabetic", "Uncontrolled"]),
    "dbp_category": ("dbp", [0, 80, 90, 120, 140, 200], ["Low", "Normal", "Elevated", "High", "Crisis"]),
    "age_group": ("age", [0, 30, 40, 50, 60, 100], ["Young", "Middle", "PreSenior", "Senior", "Elder"]),
    "heart_age_risk": ("age", [0, 40, 55, 65, 100], ["Low", "Moderate", "High", "Very High"]),
    "heart_bp": ("sbp", [0, 120, 130, 140, 180, 300], ["Normal", "Elevated", "Stage1", "Stage2", "Crisis"]),
    "chol_risk": ("chol", [0, 200, 240, 1000], ["Desirable", "Borderline", "High"]),
    "anaemia": ("hemo", [0, 8, 10, 12, 20], ["Severe", "Moderate", "Mild", "None"]),
    "k_risk": ("pot", [0, 3.5, 5.0, 5.5, 6.0, 10],
               ["Hypokalemia", "Normal", "Mild_Hyper", "Moderate_Hyper", "Severe_Hyper"]),
    "renal_bp": ("sbp", [0, 120, 130, 140, 160, 200], ["Normal", "Elevated", "Stage1_HTN", "Stage2_HTN", "Crisis"]),
    "proteinuria": ("al", [-1, 0, 1, 3, 5], ["None", "Mild", "Moderate", "Severe"]),
}


# The oracles word every rule a second time, by hand, so a wrong number in a
# rule table cannot pass on both sides.
def _when(*cases: str, other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c}" for c in cases) + f" ELSE {other} END"


def _points(*rules: str) -> str:
    """'3 if pot > 6' -> a sum of CASE terms."""
    return "(" + " + ".join(f"CASE WHEN {r.split(' if ', 1)[1]} THEN {r.split(' if ', 1)[0]} ELSE 0 END" for r in rules) + ")"


SQL_CV = _points("2 if hypertension = 1", "3 if heart_disease = 1", "1 if age > 55", "1 if glucose > 125", "1 if bmi > 30",
                 "1 if smoking = 'smokes' OR smoking = 'formerly smoked'")
SQL_CARDIAC = _points("1 if age > 55", "1 if sex = 'M'", "2 if chest_pain = 'TA'", "2 if angina = 'Y'", "1 if oldpeak > 1",
                      "1 if fasting_bs = 1")
SQL_METABOLIC = _points("1 if glucose > 100", "1 if sbp > 130", "1 if bmi > 30")
SQL_DIABETES = _points("3 if glucose > 125", "2 if bmi > 30", "2 if age > 45", "2 if pedigree > 0.5", "1 if sbp > 140")
SQL_SIRS = {"temp": "temp > 38 OR temp < 36", "hr": "hr > 90", "rr": "rr > 20", "wbc": "wbc > 12 OR wbc < 4"}
SQL_QSOFA = {"bp": "sbp <= 100", "rr": "rr >= 22", "gcs": "gcs < 15"}
SQL_SOFA = {
    "cardiovascular": _when("vaso = 1 THEN 3", "map < 70 THEN 1", other="0"),
    "respiratory": _when("pf < 100 THEN 4", "pf < 200 THEN 3", "pf < 300 THEN 2", "pf < 400 THEN 1", other="0"),
    "renal": _when("sc >= 5.0 THEN 4", "sc >= 3.5 THEN 3", "sc >= 2.0 THEN 2", "sc >= 1.2 THEN 1", other="0"),
    "coagulation": _when("plt < 20 THEN 4", "plt < 50 THEN 3", "plt < 100 THEN 2", "plt < 150 THEN 1", other="0"),
    "liver": _when("bili >= 12 THEN 4", "bili >= 6 THEN 3", "bili >= 2 THEN 2", "bili >= 1.2 THEN 1", other="0"),
}
SQL_URAEMIA = _points("1 if bu > 40", "2 if sc > 2", "2 if pot > 5.5", "1 if hemo < 10", "1 if appet = 0")
SQL_SYSTEMS = _points("1 if ane = 1", "1 if hypertension = 1", "1 if al > 0", "1 if appet = 0")
SQL_ICU = _points("3 if pot > 6", "3 if egfr < 15", "2 if bu > 100", "2 if sbp > 180", "2 if hemo < 7", "1 if pe = 1")
SQL_BANDS = {
    "age_risk": _when("age <= 0 THEN NULL", "age <= 45 THEN 'Low'", "age <= 55 THEN 'Moderate'", "age <= 65 THEN 'High'",
                      "age <= 75 THEN 'Very High'", "age <= 100 THEN 'Critical'"),
    "bmi_category": _when("bmi <= 0 THEN NULL", "bmi <= 18.5 THEN 'Underweight'", "bmi <= 25 THEN 'Normal'", "bmi <= 30 THEN 'Overweight'",
                          "bmi <= 35 THEN 'Obese'", "bmi <= 100 THEN 'Severely Obese'"),
    "diabetes_bmi": _when("bmi <= 0 THEN NULL", "bmi <= 18.5 THEN 'Underweight'", "bmi <= 25 THEN 'Normal'", "bmi <= 30 THEN 'Overweight'",
                          "bmi <= 35 THEN 'Obese'", "bmi <= 100 THEN 'Severely_Obese'"),
    "glucose_risk": _when("glucose <= 0 THEN NULL", "glucose <= 100 THEN 'Normal'", "glucose <= 125 THEN 'Prediabetic'",
                          "glucose <= 200 THEN 'Diabetic'", "glucose <= 500 THEN 'Uncontrolled'"),
    "diabetes_glucose": _when("glucose <= 0 THEN NULL", "glucose <= 100 THEN 'Normal'", "glucose <= 125 THEN 'Prediabetic'",
                              "glucose <= 200 THEN 'Diabetic'", "glucose <= 500 THEN 'Severe'"),
    "dbp_category": _when("dbp <= 0 THEN NULL", "dbp <= 80 THEN 'Low'", "dbp <= 90 THEN 'Normal'", "dbp <= 120 THEN 'Elevated'",
                          "dbp <= 140 THEN 'High'", "dbp <= 200 THEN 'Crisis'"),
    "age_group": _when("age <= 0 THEN NULL", "age <= 30 THEN 'Young'", "age <= 40 THEN 'Middle'", "age <= 50 THEN 'PreSenior'",
                       "age <= 60 THEN 'Senior'", "age <= 100 THEN 'Elder'"),
    "heart_age_risk": _when("age <= 0 THEN NULL", "age <= 40 THEN 'Low'", "age <= 55 THEN 'Moderate'", "age <= 65 THEN 'High'",
                            "age <= 100 THEN 'Very High'"),
    "heart_bp": _when("sbp <= 0 THEN NULL", "sbp <= 120 THEN 'Normal'", "sbp <= 130 THEN 'Elevated'", "sbp <= 140 THEN 'Stage1'",
                      "sbp <= 180 THEN 'Stage2'", "sbp <= 300 THEN 'Crisis'"),
    "chol_risk": _when("chol_k6 <= 0 THEN NULL", "chol_k6 <= 200 THEN 'Desirable'", "chol_k6 <= 240 THEN 'Borderline'",
                       "chol_k6 <= 1000 THEN 'High'"),
    "anaemia": _when("hemo <= 0 THEN NULL", "hemo <= 8 THEN 'Severe'", "hemo <= 10 THEN 'Moderate'", "hemo <= 12 THEN 'Mild'",
                     "hemo <= 20 THEN 'None'"),
    "k_risk": _when("pot <= 0 THEN NULL", "pot <= 3.5 THEN 'Hypokalemia'", "pot <= 5.0 THEN 'Normal'", "pot <= 5.5 THEN 'Mild_Hyper'",
                    "pot <= 6.0 THEN 'Moderate_Hyper'", "pot <= 10 THEN 'Severe_Hyper'"),
    "renal_bp": _when("sbp <= 0 THEN NULL", "sbp <= 120 THEN 'Normal'", "sbp <= 130 THEN 'Elevated'", "sbp <= 140 THEN 'Stage1_HTN'",
                      "sbp <= 160 THEN 'Stage2_HTN'", "sbp <= 200 THEN 'Crisis'"),
    "proteinuria": _when("al <= -1 THEN NULL", "al <= 0 THEN 'None'", "al <= 1 THEN 'Mild'", "al <= 3 THEN 'Moderate'", "al <= 5 THEN 'Severe'"),
}


@register("risk_strata", with_vitals(f"""
, b AS (SELECT {_when("p <= 0 THEN NULL", "p <= 0.1 THEN 0", "p <= 0.3 THEN 1", "p <= 0.5 THEN 2", "p <= 0.7 THEN 3", "p <= 1 THEN 4")} AS band, y FROM vx),
agg AS (SELECT band, count(y) AS n, sum(y) AS s, avg(y) AS r FROM b WHERE band IS NOT NULL GROUP BY band),
dim AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{v}')" for i, v in enumerate(STROKE_RISK[1]))}) d(band, risk_category))
SELECT dim.band AS band, dim.risk_category AS risk_category,
       CAST(coalesce(agg.n, 0) AS BIGINT) AS patients, CAST(coalesce(agg.s, 0) AS BIGINT) AS cases,
       round(agg.r, 6) AS rate
FROM dim LEFT JOIN agg ON dim.band = agg.band"""), "I4 C5 D5 B23")
def q_risk_strata(spark, sf_dir):
    out = risk_strata(vx(spark, sf_dir), "p", "y", *STROKE_RISK)
    return out.withColumn("rate", r6("rate"))


@register("risk_strata_multi", with_vitals(f"""
, s AS (SELECT {SQL_ICU} AS icu_risk, egfr, p, y FROM vx),
b AS (SELECT {_when("p <= 0 THEN NULL", "p <= 0.2 THEN 0", "p <= 0.4 THEN 1", "p <= 0.6 THEN 2", "p <= 0.8 THEN 3", "p <= 1 THEN 4")} AS band, y, icu_risk, egfr FROM s),
agg AS (SELECT band, count(y) AS n, sum(y) AS s, avg(y) AS r, avg(icu_risk) AS ai, avg(egfr) AS ae
        FROM b WHERE band IS NOT NULL GROUP BY band),
dim AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{v}')" for i, v in enumerate(CKD_RISK[1]))}) d(band, risk_category))
SELECT dim.band AS band, dim.risk_category AS risk_category,
       CAST(coalesce(agg.n, 0) AS BIGINT) AS patients, CAST(coalesce(agg.s, 0) AS BIGINT) AS cases,
       round(agg.r, 6) AS rate, round(agg.ai, 6) AS avg_icu_risk, round(agg.ae, 6) AS avg_egfr
FROM dim LEFT JOIN agg ON dim.band = agg.band"""), "D6 I4 C5")
def q_risk_strata_multi(spark, sf_dir):
    v = vx(spark, sf_dir).withColumn("icu_risk", S.additive_score(S.ICU_RISK))
    out = risk_strata(v, "p", "y", *CKD_RISK, extra_means=["icu_risk", "egfr"])
    return out.select("band", "risk_category", "patients", "cases", r6("rate").alias("rate"),
                      r6("avg_icu_risk").alias("avg_icu_risk"), r6("avg_egfr").alias("avg_egfr"))


@register("action_tier", with_vitals(f"""
SELECT id, y, p, {_when("p <= 0 THEN NULL", "p <= 0.1 THEN 'Green'", "p <= 0.3 THEN 'Yellow-Low'", "p <= 0.5 THEN 'Yellow-High'", "p <= 0.7 THEN 'Orange'", "p <= 0.9 THEN 'Red'", "p <= 1 THEN 'Critical'")} AS alert_level,
       {_when("p <= 0 THEN NULL", "p <= 0.3 THEN 'Monitor'", "p <= 0.5 THEN 'Investigate'", "p <= 1 THEN 'Intervene'")} AS action_required FROM vx"""), "I5 I4")
def q_action_tier(spark, sf_dir):
    v = vx(spark, sf_dir)
    return v.select("id", "y", "p", cut("p", *ALERT).alias("alert_level"),
                    cut("p", *ACTION).alias("action_required"))


@register("cut_edges", with_vitals("\nSELECT id, " + ", ".join(f"{e} AS {name}" for name, e in SQL_BANDS.items())
                                  + " FROM (SELECT *, CASE WHEN chol = 0 THEN (SELECT median(chol) FROM vx) ELSE chol END AS chol_k6 FROM vx)"),
          "I1 M24 M31 K6")
def q_cut_edges(spark, sf_dir):
    # Cholesterol is banded after its sentinel zeros were filled (K6).
    v = fill_sentinel_median(vx(spark, sf_dir), "chol")
    return v.select("id", *[cut(c, e, lab).alias(name) for name, (c, e, lab) in BANDS.items()])


_FLAG_SQL = """
SELECT id,
  CASE WHEN pregnancies >= 3 THEN 1 ELSE 0 END AS high_pregnancy,
  CASE WHEN lact > 2 THEN 1 ELSE 0 END AS lactate_elevated,
  CASE WHEN lact > 4 THEN 1 ELSE 0 END AS lactate_critical,
  CASE WHEN map < 65 THEN 1 ELSE 0 END AS hypotensive,
  CASE WHEN stay_hours < 24 THEN 1 ELSE 0 END AS early_admission,
  CASE WHEN stay_hours > 72 THEN 1 ELSE 0 END AS prolonged_stay,
  CASE WHEN diabetes = 1 AND al > 1 THEN 1 ELSE 0 END AS diabetic_kidney,
  CASE WHEN pe = 1 OR sbp > 140 OR sod < 135 THEN 1 ELSE 0 END AS fluid_overload,
  CASE WHEN temp > 38 THEN 1 ELSE 0 END AS febrile,
  CASE WHEN age BETWEEN 40 AND 60 THEN 1 ELSE 0 END AS age_40_60,
  CAST(temp IS NOT NULL AS INTEGER) AS has_temp
FROM vx"""


@register("flags", with_vitals(_FLAG_SQL), "B8 B9 B18 H14 M6 M18 M21 M26")
def q_flags(spark, sf_dir):
    v = vx(spark, sf_dir)
    c = F.col
    return v.select(
        "id",
        flag(c("pregnancies") >= 3).alias("high_pregnancy"),
        flag(c("lact") > 2).alias("lactate_elevated"),
        flag(c("lact") > 4).alias("lactate_critical"),
        flag(c("map") < 65).alias("hypotensive"),
        flag(c("stay_hours") < 24).alias("early_admission"),
        flag(c("stay_hours") > 72).alias("prolonged_stay"),
        flag((c("diabetes") == 1) & (c("al") > 1)).alias("diabetic_kidney"),
        flag((c("pe") == 1) | (c("sbp") > 140) | (c("sod") < 135)).alias("fluid_overload"),
        flag(c("temp") > 38).alias("febrile"),
        between_flag("age", 40, 60).alias("age_40_60"),
        present_flag("temp").alias("has_temp"),
    )


@register("score_cv", with_vitals(f"\nSELECT id, {SQL_CV} AS cv_risk_score FROM vx"), "M1 B10 B12")
def q_score_cv(spark, sf_dir):
    return vx(spark, sf_dir).select("id", S.additive_score(S.CV).alias("cv_risk_score"))


@register("score_cardiac", with_vitals(f"\nSELECT id, {SQL_CARDIAC} AS cardiac_score FROM vx"), "M2")
def q_score_cardiac(spark, sf_dir):
    return vx(spark, sf_dir).select("id", S.additive_score(S.CARDIAC).alias("cardiac_score"))


@register("score_metabolic", with_vitals(
    f"\nSELECT id, {SQL_METABOLIC} AS metabolic_score, "
    f"{SQL_DIABETES} AS diabetes_risk FROM vx"), "M4 M7")
def q_score_metabolic(spark, sf_dir):
    return vx(spark, sf_dir).select("id", S.additive_score(S.METABOLIC).alias("metabolic_score"),
                                    S.additive_score(S.DIABETES_RISK).alias("diabetes_risk"))


def _flags_sql(rules, prefix):
    return ", ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END AS {prefix}{n}" for n, c in rules.items())


def _total_sql(rules):
    return _points(*[f"1 if {c}" for c in rules.values()])


@register("score_sirs", with_vitals(
    f"\nSELECT id, {_flags_sql(SQL_SIRS, 'sirs_')}, {_total_sql(SQL_SIRS)} AS sirs_score FROM vx"), "M8")
def q_score_sirs(spark, sf_dir):
    return vx(spark, sf_dir).select("id", *S.rule_flags(S.SIRS, "sirs_"),
                                    S.additive_score(S.SIRS).alias("sirs_score"))


@register("score_qsofa", with_vitals(
    f"\nSELECT id, {_flags_sql(SQL_QSOFA, 'qsofa_')}, {_total_sql(SQL_QSOFA)} AS qsofa_score FROM vx"), "M9")
def q_score_qsofa(spark, sf_dir):
    return vx(spark, sf_dir).select("id", *S.rule_flags(S.QSOFA, "qsofa_"),
                                    S.additive_score(S.QSOFA).alias("qsofa_score"))


@register("score_sofa", with_vitals(
    "\nSELECT id, " + ", ".join(f"{e} AS sofa_{n}" for n, e in SQL_SOFA.items())
    + ", " + " + ".join(f"({e})" for e in SQL_SOFA.values()) + " AS sofa_total, "
    + " + ".join(f"CASE WHEN ({e}) > 0 THEN 1 ELSE 0 END" for e in SQL_SOFA.values())
    + " AS multi_organ FROM vx"), "M10-M15 M19 B11")
def q_score_sofa(spark, sf_dir):
    return vx(spark, sf_dir).select("id", *S.sofa_columns())


@register("score_comorbidity", with_vitals(
    "\nSELECT id, " + "diabetes + hypertension + chf + copd + ckd + immuno" + " AS comorbidity_count FROM vx"), "M20")
def q_score_comorbidity(spark, sf_dir):
    v = vx(spark, sf_dir)
    total = F.col(S.COMORBIDITIES[0])
    for c in S.COMORBIDITIES[1:]:
        total = total + F.col(c)
    return v.select("id", total.alias("comorbidity_count"))


@register("score_renal", with_vitals(
    f"\nSELECT id, {SQL_URAEMIA} AS uremia_risk, "
    f"{SQL_SYSTEMS} AS system_involvement, "
    f"{SQL_ICU} AS icu_risk_score FROM vx"), "M27 M28 M29")
def q_score_renal(spark, sf_dir):
    return vx(spark, sf_dir).select(
        "id", S.additive_score(S.URAEMIA).alias("uremia_risk"),
        S.additive_score(S.SYSTEM_INVOLVEMENT).alias("system_involvement"),
        S.additive_score(S.ICU_RISK).alias("icu_risk_score"))


@register("additive_score", with_vitals(
    f"\nSELECT {SQL_CV} AS score, CAST(count(*) AS BIGINT) AS n, "
    f"CAST(sum(y) AS BIGINT) AS positives FROM vx GROUP BY 1"), "B12 B10")
def q_additive_score(spark, sf_dir):
    return (vx(spark, sf_dir).groupBy(S.additive_score(S.CV).alias("score"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("positives")))


@register("tiered_score", with_vitals(
    f"\nSELECT {SQL_SOFA['respiratory']} AS resp, {SQL_SOFA['cardiovascular']} AS cardio,"
    f" CAST(count(*) AS BIGINT) AS n FROM vx GROUP BY 1, 2"), "B11")
def q_tiered_score(spark, sf_dir):
    v = vx(spark, sf_dir)
    return (v.groupBy(S.tiered_score(S.SOFA_RESPIRATORY).alias("resp"),
                      S.tiered_score(S.SOFA_CARDIOVASCULAR).alias("cardio"))
            .agg(F.count(F.lit(1)).alias("n")))


@register("clinical_ratios", with_vitals("""
SELECT id,
  round(try_divide_hr, 6) AS hr_reserve,
  round(glucose * insulin / 405, 6) AS insulin_resistance,
  round(map, 6) AS map,
  round(CAST(hr AS DOUBLE) / sbp, 6) AS shock_index,
  round(hr / map, 6) AS modified_shock_index,
  sbp - dbp AS pulse_pressure,
  round(bu / (sc + 0.001), 6) AS bun_cr_ratio
FROM (SELECT *, CASE WHEN 220 - age <> 0 THEN CAST(max_hr AS DOUBLE) / (220 - age) END AS try_divide_hr FROM vx)"""),
    "M3 M5 M16 M17 M25 B6")
def q_clinical_ratios(spark, sf_dir):
    c = F.col
    v = vx(spark, sf_dir)
    return v.select(
        "id",
        r6(safe_div(c("max_hr").cast("double"), 220 - c("age"))).alias("hr_reserve"),
        r6(c("glucose") * c("insulin") / 405).alias("insulin_resistance"),
        r6("map").alias("map"),
        r6(safe_div(c("hr").cast("double"), c("sbp"))).alias("shock_index"),
        r6(safe_div(c("hr"), c("map"))).alias("modified_shock_index"),
        (c("sbp") - c("dbp")).alias("pulse_pressure"),
        r6(c("bu") / (c("sc") + 0.001)).alias("bun_cr_ratio"),
    )


@register("egfr", with_vitals(f"""
SELECT id, round(egfr, 6) AS egfr, {_when("egfr <= 0 THEN NULL", "egfr <= 15 THEN 'Stage5'", "egfr <= 30 THEN 'Stage4'", "egfr <= 45 THEN 'Stage3b'", "egfr <= 60 THEN 'Stage3a'", "egfr <= 90 THEN 'Stage2'", "egfr <= 150 THEN 'Stage1'")} AS ckd_stage,
       CASE WHEN egfr < 15 THEN 1 ELSE 0 END AS dialysis_needed FROM vx"""), "M22 M23 M30 H13")
def q_egfr(spark, sf_dir):
    v = vx(spark, sf_dir)
    return v.select("id", r6("egfr").alias("egfr"),
                    cut("egfr", S.CKD_STAGE_EDGES, S.CKD_STAGE_LABELS).alias("ckd_stage"),
                    flag(F.col("egfr") < 15).alias("dialysis_needed"))


@register("cond_counts", with_vitals("""
SELECT CAST(count(*) AS BIGINT) AS n,
       CAST(count_if(chol = 0) AS BIGINT) AS chol_zero,
       round(100.0 * count_if(chol = 0) / count(*), 6) AS chol_zero_pct,
       CAST(count_if(sex = 'M') AS BIGINT) AS male,
       CAST(count_if(y = 1) AS BIGINT) AS positives,
       round(100.0 * count_if(y = 1) / count(*), 6) AS positive_pct
FROM vx"""), "D11")
def q_cond_counts(spark, sf_dir):
    v = vx(spark, sf_dir)
    n = F.count(F.lit(1))
    return v.agg(
        n.alias("n"),
        F.count_if(F.col("chol") == 0).alias("chol_zero"),
        r6(F.lit(100.0) * F.count_if(F.col("chol") == 0) / n).alias("chol_zero_pct"),
        F.count_if(F.col("sex") == "M").alias("male"),
        F.count_if(F.col("y") == 1).alias("positives"),
        r6(F.lit(100.0) * F.count_if(F.col("y") == 1) / n).alias("positive_pct"),
    )
