"""Model fits, scoring, importances and cross-validation.

Seeds and solvers differ from one library to another, so a fit is held to
exact columns that any solver must give: the held-out rows and their labels,
that every probability lies in [0, 1], and that the held-out ROC-AUC (or error)
passes a floor that a broken fit misses (the features carry signal: ``marker``
and ``marker2`` are noisy functions of the risk that the label is drawn from).

Forests have 100 trees, the balanced one 200 bags, boosting 100 rounds and
AdaBoost 200 stumps.  The network goes on until its held-out loss no longer
falls.  Kernel machines have 200 Fourier features; the flows' Huber boosting
has 12 rounds at a higher rate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import boosting as BO
from ..operators import forests as FO
from ..operators import metrics as M
from ..operators import models as MD
from ..operators import networks as NW
from ..operators import sampling as SA
from ..operators import scale as SC
from ..session import cut_lineage
from ..sources.cohort import SEPSIS, SEPSIS_PREVALENCE, cohort
from .common import t, vx, with_vitals
from .registry import register

TREES, BAGS, ROUNDS, STUMPS, FOURIER = 100, 200, 100, 200, 200
FEATS = ["age", "hr", "rr", "sbp", "dbp", "gcs", "pf", "plt", "bu", "glucose", "insulin",
         "max_hr", "chol", "al", "wbc", "lact", "hemo", "pot", "sod", "marker", "marker2"]
AUC_FLOOR, RMSE_CEILING = 0.8, 0.15

_SPLIT_SQL = """
, n AS (SELECT y, count(*) AS n FROM vx GROUP BY y),
r AS (SELECT id, y, p, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id) AS rk FROM vx),
test AS (SELECT r.id, r.y, r.p FROM r JOIN n ON r.y = n.y WHERE rk <= floor(n.n * 0.2 + 0.5))
"""
CLASS_SQL = with_vitals(_SPLIT_SQL + "SELECT id, y, TRUE AS prob_in_range, TRUE AS auc_above_floor FROM test")


def features(v: DataFrame) -> DataFrame:
    return v.withColumns({"marker": F.col("p") * 10 + F.col("lact") / 5, "marker2": F.col("p") * F.col("p") * 20 + F.col("hemo") / 4})


def split(spark, sf_dir):
    """Train and test rows, ranked once and written to the checkpoint folder."""
    v = features(vx(spark, sf_dir)).select("id", "y", "p", *FEATS)
    s = cut_lineage(SA.strat_split(v, "id", "y", frac=0.2))
    return s.where(F.col("_split") == "train").drop("_split"), s.where(F.col("_split") == "test").drop("_split")


def scaled_split(spark, sf_dir):
    tr, te = split(spark, sf_dir)
    params = SC.fit_standard(tr, FEATS)
    return SC.apply_standard(tr, params), SC.apply_standard(te, params)


def _checked(scored: DataFrame, score: str, floor: float = AUC_FLOOR, bounded: bool = True) -> DataFrame:
    """id, y and the exact checks of a scored hold-out."""
    s = cut_lineage(scored.select("id", "y", F.col(score).cast("double").alias("s")))
    auc = M.roc_auc(s, "y", "s").first()["roc_auc"] or 0.0
    in_range = F.col("s").between(0.0, 1.0) if bounded else ~F.isnan("s")
    return s.select("id", "y", in_range.alias("prob_in_range"), F.lit(auc >= floor).alias("auc_above_floor"))


def _out(pred):
    return _checked(MD.positive_probability(pred), "prob")


@register("rf_fit", CLASS_SQL, "N1 N14 J8")
def q_rf_fit(spark, sf_dir):
    tr, te = split(spark, sf_dir)
    return _checked(FO.random_forest(tr, FEATS, "y", "id", trees=TREES, depth=5, min_rows=5).predict(te), "prob")


@register("gbt_fit", CLASS_SQL, "N2 N3")
def q_gbt_fit(spark, sf_dir):
    tr, te = split(spark, sf_dir)
    m = BO.boost(tr, FEATS, "y", rounds=ROUNDS, rate=0.1, depth=3, subsample=0.8, l2=0.0, min_child=0.0, key="id")
    return _checked(m.predict(te, "prob"), "prob")


@register("logreg_fit", CLASS_SQL, "N4 L6 J4")
def q_logreg_fit(spark, sf_dir):
    tr, te = scaled_split(spark, sf_dir)
    tr = SA.class_weights(tr, "y")
    _, pred = MD.fit_predict("logreg", tr, te, FEATS, "y", weight="weight", C=0.1)
    return _out(pred)


def _regression_checks(scored: DataFrame, names: list[str], target: str = "p", ceiling: float = RMSE_CEILING) -> DataFrame:
    s = cut_lineage(scored.select("id", target, *names))
    err = s.agg(*[M.rmse_expr(target, c).alias(c) for c in names]).first()
    return s.select("id", *[F.lit(err[c] is not None and err[c] <= ceiling).alias(f"{c}_ok") for c in names])


@register("linreg_fit", with_vitals(_SPLIT_SQL + "SELECT id, TRUE AS ridge_ok, TRUE AS lasso_ok, TRUE AS enet_ok FROM test"), "N5 N16 J6")
def q_linreg_fit(spark, sf_dir):
    tr, te = split(spark, sf_dir)
    for name, kw in (("ridge", {"alpha": 10.0}), ("lasso", {"alpha": 0.0005}), ("enet", {"alpha": 0.0005, "l1_ratio": 0.9})):
        _, te = MD.fit_predict(name, tr, te, FEATS, "p", scaler="robust", prediction=name, **kw)
    return _regression_checks(te, ["ridge", "lasso", "enet"])


@register("tree_reg_fit", with_vitals(_SPLIT_SQL + "SELECT id, TRUE AS rf_reg_ok, TRUE AS gbt_reg_ok, TRUE AS extra_trees_reg_ok FROM test"),
          "N1 N2 N6")
def q_tree_reg_fit(spark, sf_dir):
    tr, te = split(spark, sf_dir)
    te = FO.random_forest(tr, FEATS, "p", "id", trees=TREES, depth=8, candidates=len(FEATS) // 3).predict(te, "rf_reg")
    te = BO.boost(tr, FEATS, "p", loss="squared", rounds=20, depth=4, l2=0.0).predict(te, "gbt_reg")
    te = FO.extra_trees(tr, FEATS, "p", trees=TREES, depth=8, candidates=len(FEATS) // 3).predict(te, "extra_trees_reg")
    return _regression_checks(te, ["rf_reg", "gbt_reg", "extra_trees_reg"])


@register("extra_trees_fit", CLASS_SQL, "N6")
def q_extra_trees_fit(spark, sf_dir):
    tr, te = split(spark, sf_dir)
    return _checked(FO.extra_trees(tr, FEATS, "y", trees=TREES, depth=8).predict(te), "prob")


@register("adaboost_fit", CLASS_SQL, "N7")
def q_adaboost_fit(spark, sf_dir):
    tr, te = split(spark, sf_dir)
    out = BO.fit_stumps(tr, FEATS, "y", rounds=STUMPS, rate=0.5, bins=63).predict(te)
    return _checked(out, "ada_score", bounded=False)


@register("rff_svm_fit", CLASS_SQL, "N8")
def q_rff_svm_fit(spark, sf_dir):
    tr, te = scaled_split(spark, sf_dir)
    return _checked(NW.fit_svm(tr, FEATS, "y", "id", components=FOURIER).predict(te, "prob"), "prob")


@register("rff_svr_fit", with_vitals(_SPLIT_SQL + "SELECT id, TRUE AS svr_ok FROM test"), "N8")
def q_rff_svr_fit(spark, sf_dir):
    tr, te = scaled_split(spark, sf_dir)
    svr = NW.fit_svr(tr, FEATS, "p", "id", components=FOURIER, epsilon=0.05)
    return _regression_checks(svr.predict(te, "svr"), ["svr"], ceiling=0.2)


@register("poly_ridge_fit", with_vitals(_SPLIT_SQL + "SELECT id, TRUE AS krr_ok FROM test"), "N10")
def q_poly_ridge_fit(spark, sf_dir):
    tr, te = scaled_split(spark, sf_dir)
    tr, names = MD.poly2_features(tr, FEATS)
    te, _ = MD.poly2_features(te, FEATS)
    _, pred = MD.fit_predict("ridge", tr, te, names, "p", alpha=0.6, intercept=False, prediction="krr")
    return _regression_checks(pred, ["krr"])


@register("mlp_fit", CLASS_SQL, "N11")
def q_mlp_fit(spark, sf_dir):
    tr, te = scaled_split(spark, sf_dir)
    return _checked(NW.fit_network(tr, FEATS, "y", "id", hidden=(100, 50, 25), rate=0.01, patience=4).predict(te), "prob")


@register("rf_balanced_fit", CLASS_SQL, "N12 L7")
def q_rf_balanced_fit(spark, sf_dir):
    tr, te = split(spark, sf_dir)
    return _checked(MD.balanced_forest(tr, te, FEATS, "y", "id", bags=BAGS, depth=8), "prob")


@register("importance_topk", """SELECT model, rank, TRUE AS is_feature, TRUE AS in_range, rank = 1 AS is_marker
FROM (SELECT unnest(['rf', 'gbt', 'extra_trees']) AS model) m, (SELECT CAST(unnest(range(1, 11)) AS INTEGER) AS rank) r""", "N13 F1")
def q_importance_topk(spark, sf_dir):
    tr, _ = split(spark, sf_dir)
    rows = []
    for name, model in (("rf", FO.random_forest(tr, FEATS, "y", "id", trees=TREES, depth=5)),
                        ("gbt", BO.boost(tr, FEATS, "y", rounds=ROUNDS // 2, depth=3)),
                        ("extra_trees", FO.extra_trees(tr, FEATS, "y", trees=TREES, depth=5))):
        top = sorted(model.importances(), key=lambda r: (-r[1], r[0]))[:10]
        rows += [(name, i, f in FEATS, 0.0 <= v <= 1.0, i == 1 and f.startswith("marker")) for i, (f, v) in enumerate(top, 1)]
    return spark.createDataFrame(rows, "model string, rank int, is_feature boolean, in_range boolean, is_marker boolean")


@register("cv_score", """SELECT score, fold, TRUE AS above_floor
FROM (SELECT unnest(['roc_auc', 'accuracy', 'rmse']) AS score) s, (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS fold) f""",
          "N15 N16 D17 D20 D21 L2")
def q_cv_score(spark, sf_dir):
    tr, _ = split(spark, sf_dir)
    folded = cut_lineage(SA.strat_kfold(tr, "id", "y", k=5))

    def classify(fit_on, held):
        _, pred = MD.fit_predict("logreg", fit_on, held, FEATS, "y", scaler="standard", C=1.0)
        s = cut_lineage(MD.positive_probability(pred).select("y", "prob", "prediction"))
        return M.roc_auc(s, "y", "prob").first()[0], M.accuracy(s, "y", "prediction").first()[0]

    def regress(fit_on, held):
        _, pred = MD.fit_predict("ridge", fit_on, held, FEATS, "p", scaler="robust", alpha=10.0)
        return pred.agg(M.rmse_expr("p", "prediction")).first()[0]

    rows = []
    for f, (auc, acc) in MD.cross_validate(folded, "fold", 5, classify):
        rows += [("roc_auc", f, auc >= AUC_FLOOR), ("accuracy", f, acc >= 0.75)]
    rows += [("rmse", f, e <= RMSE_CEILING) for f, e in MD.cross_validate(folded, "fold", 5, regress)]
    return spark.createDataFrame(rows, "score string, fold int, above_floor boolean")


@register("gen_cohort", None, "A3 H14 B16")
def q_gen_cohort(spark, sf_dir):
    keys = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("patient_id"))
    return cohort(keys, "patient_id", "sepsis", SEPSIS_PREVALENCE, SEPSIS)


_REPORT_SQL = """SELECT section, name, TRUE AS in_range FROM (
  SELECT 'metric' AS section, unnest(['roc_auc', 'avg_precision', 'sensitivity', 'specificity', 'ppv', 'npv']) AS name
  UNION ALL SELECT 'top_predictor', 'rank ' || unnest(range(1, 11)) UNION ALL SELECT 'check', 'roc_auc above floor'"""


def _report_out(report: DataFrame, floor: float) -> DataFrame:
    """The report as exact columns: its lines, each within [0, 1], and the floor."""
    r = cut_lineage(report)
    name = F.when(F.col("section") == "metric", F.col("name")).otherwise(F.concat(F.lit("rank "), F.col("rank").cast("string")))
    check = r.where("name = 'roc_auc'").select(F.lit("check").alias("section"), F.lit("roc_auc above floor").alias("name"),
                                               (F.col("value") >= floor).alias("in_range"))
    return r.select("section", name.alias("name"), F.col("value").between(0, 1).alias("in_range")).unionByName(check)


@register("sepsis_flow", _REPORT_SQL + ")", "A6 D6 N1 N2 N4 P3 L1 L6 J4 M8 M9 M16 M17 K2")
def q_sepsis_flow(spark, sf_dir):
    from .flows import sepsis_flow
    _, report = sepsis_flow(spark, sf_dir, trees=TREES, rounds=ROUNDS // 2)
    return _report_out(report, AUC_FLOOR)


@register("resample_flow", _REPORT_SQL + """
  UNION ALL SELECT 'resampled', CAST(n0 AS VARCHAR) || ' of ' || CAST(n1 AS VARCHAR)
  FROM (SELECT greatest(count_if(quality = 0) - CAST(floor(count_if(quality = 0) * 0.2 + 0.5) AS BIGINT),
                        CAST(floor((count_if(quality <> 0) - CAST(floor(count_if(quality <> 0) * 0.2 + 0.5) AS BIGINT)) * 0.5) AS BIGINT)) AS n0,
               count_if(quality <> 0) - CAST(floor(count_if(quality <> 0) * 0.2 + 0.5) AS BIGINT) AS n1
        FROM labels JOIN documents USING (doc_id)))""", "L4 N1 N2 N6 N11 N12 P3 A6 L1 J4")
def q_resample_flow(spark, sf_dir):
    from .flows import resample_flow
    grown, report = resample_flow(spark, sf_dir, trees=TREES, rounds=ROUNDS // 2)
    sizes = grown.groupBy("y").count().collect()
    n = {r["y"]: r["count"] for r in sizes}
    extra = spark.createDataFrame([("resampled", f"{n.get(0, 0)} of {n.get(1, 0)}", True)], "section string, name string, in_range boolean")
    return _report_out(report, 0.6).unionByName(extra)


@register("regression_flow", """WITH k AS (SELECT l_partkey AS id FROM lineitem GROUP BY l_partkey),
r AS (SELECT id, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id) AS rk FROM k)
SELECT id, TRUE AS price_in_range, TRUE AS rmsle_below_ceiling, TRUE AS cv_below_ceiling FROM r WHERE (rk - 1) % 5 = 0""",
          "N1 N2 N5 N6 N8 N10 N15 N16 P4 D19 H10 L3")
def q_regression_flow(spark, sf_dir):
    from .flows import regression_flow
    priced, rmsle, cv = regression_flow(spark, sf_dir, trees=TREES, rounds=12, fourier=FOURIER)
    return priced.select("id", F.col("price").between(*_CLIP).alias("price_in_range"), F.lit(rmsle <= 0.3).alias("rmsle_below_ceiling"),
                         F.lit(all(e <= 0.3 for _, e in cv)).alias("cv_below_ceiling"))


_CLIP = (40000.0, 800000.0)
