"""Metrics, splits and folds, class weights, under-sampling, ensembles and
the metrics report, over the vitals scores ``(y, p)`` and driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensemble as EN
from ..operators import metrics as M
from ..operators import sampling as SA
from ..sources.sinks import metrics_report
from .common import r6, t, vx, with_vitals
from .registry import register

PRED_SQL = "CASE WHEN p > 0.5 THEN 1 ELSE 0 END"


def scored(spark, sf_dir):
    v = vx(spark, sf_dir)
    return v.withColumn("pred", EN.vote_label(F.col("p")))


_CM_SQL = f"""
, s AS (SELECT y, {PRED_SQL} AS pred FROM vx),
cm AS (SELECT CAST(count_if(y = 0 AND pred = 0) AS BIGINT) AS tn, CAST(count_if(y = 0 AND pred = 1) AS BIGINT) AS fp,
              CAST(count_if(y = 1 AND pred = 0) AS BIGINT) AS fn, CAST(count_if(y = 1 AND pred = 1) AS BIGINT) AS tp FROM s)"""


@register("confusion", with_vitals(_CM_SQL + "\nSELECT * FROM cm"), "D13")
def q_confusion(spark, sf_dir):
    return M.confusion(scored(spark, sf_dir), "y", "pred")


def _zr(a, b):
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0)"


_CLIN_SQL = _CM_SQL + f""",
r AS (SELECT *, {_zr('tp', 'tp + fn')} AS sensitivity, {_zr('tn', 'tn + fp')} AS specificity,
             {_zr('tp', 'tp + fp')} AS ppv, {_zr('tn', 'tn + fn')} AS npv FROM cm)"""


@register("clinical_metrics", with_vitals(_CLIN_SQL + """
SELECT tn, fp, fn, tp, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity,
       round(ppv, 6) AS ppv, round(npv, 6) AS npv,
       CAST(CASE WHEN ppv > 0 THEN floor(1.0 / ppv) END AS BIGINT) AS nns FROM r"""), "D14 D15")
def q_clinical_metrics(spark, sf_dir):
    m = M.clinical_metrics(scored(spark, sf_dir), "y", "pred")
    return m.select("tn", "fp", "fn", "tp", *[r6(c).alias(c) for c in ("sensitivity", "specificity", "ppv", "npv")],
                    F.col("nns").cast("long").alias("nns"))


@register("class_report", with_vitals(f"""
, s AS (SELECT y, {PRED_SQL} AS pred FROM vx),
cls AS (SELECT y AS c FROM s UNION SELECT pred FROM s),
per AS (SELECT c, count_if(y = c AND pred = c) AS tp, count_if(pred = c) AS predicted, count_if(y = c) AS support
        FROM cls, s GROUP BY c),
pr AS (SELECT c, {_zr('tp', 'predicted')} AS precision, {_zr('tp', 'support')} AS recall, support, tp FROM per),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM pr)
SELECT CAST(c AS VARCHAR) AS class_name, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f"""), "D16 D20")
def q_class_report(spark, sf_dir):
    r = M.class_report(scored(spark, sf_dir), "y", "pred")
    return r.select("class_name", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


_ROC_SQL = """
, s AS (SELECT p AS s, count_if(y = 1) AS pos, count_if(y <> 1) AS neg FROM vx GROUP BY p),
c AS (SELECT *, sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM s)
SELECT round(sum(pos * (cum_neg - neg + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 6) AS roc_auc FROM c"""


@register("roc_auc", with_vitals(_ROC_SQL), "D17")
def q_roc_auc(spark, sf_dir):
    return M.roc_auc(vx(spark, sf_dir), "y", "p").select(r6("roc_auc").alias("roc_auc"))


@register("avg_precision", with_vitals("""
, s AS (SELECT p AS s, count_if(y = 1) AS pos, count_if(y <> 1) AS neg FROM vx GROUP BY p),
c AS (SELECT *, sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp,
                sum(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn FROM s)
SELECT round(sum(pos * (cp / (cp + cn))) / CAST(sum(pos) AS DOUBLE), 6) AS avg_precision FROM c"""), "D18")
def q_avg_precision(spark, sf_dir):
    return M.avg_precision(vx(spark, sf_dir), "y", "p").select(r6("avg_precision").alias("avg_precision"))


@register("rmse_log", """
SELECT round(sqrt(avg(pow(l_extendedprice - l_extendedprice * (1 - l_discount), 2))), 6) AS rmse,
       round(sqrt(avg(pow(ln(1 + l_extendedprice) - ln(1 + l_extendedprice * (1 - l_discount)), 2))), 6) AS rmsle
FROM lineitem""", "D19")
def q_rmse_log(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select(
        "l_extendedprice", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("pred"))
    return li.agg(r6(M.rmse_expr("l_extendedprice", "pred")).alias("rmse"),
                  r6(M.rmse_expr("l_extendedprice", "pred", log=True)).alias("rmsle"))


def _rank_sql(key, by, seed=42):
    part = f"PARTITION BY {by} " if by else ""
    return (f"row_number() OVER ({part}ORDER BY md5(CAST({key} AS VARCHAR) || ':{seed}'), {key})")


@register("fold_metrics", with_vitals(f"""
, f AS (SELECT y, {PRED_SQL} AS pred, ({_rank_sql('id', 'y')} - 1) % 5 AS fold FROM vx),
a AS (SELECT fold, avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM f GROUP BY fold)
SELECT round(avg(accuracy), 6) AS mean, round(stddev_pop(accuracy), 6) AS std, CAST(count(*) AS BIGINT) AS n_folds FROM a"""),
    "D21 N15")
def q_fold_metrics(spark, sf_dir):
    d = SA.strat_kfold(scored(spark, sf_dir).select("id", "y", "pred"), "id", "y", k=5)
    per_fold = d.groupBy("fold").agg(F.avg(F.when(F.col("y") == F.col("pred"), 1.0).otherwise(0.0)).alias("accuracy"))
    s = M.fold_summary(per_fold, "accuracy")
    return s.select(r6("mean").alias("mean"), r6("std").alias("std"), "n_folds")


@register("strat_split", with_vitals(f"""
, n AS (SELECT y, count(*) AS n FROM vx GROUP BY y),
r AS (SELECT id, y, {_rank_sql('id', 'y')} AS rk FROM vx)
SELECT r.id, r.y, CASE WHEN rk <= floor(n.n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS _split
FROM r JOIN n ON r.y = n.y"""), "L1")
def q_strat_split(spark, sf_dir):
    v = vx(spark, sf_dir).select("id", "y")
    return SA.strat_split(v, "id", "y", frac=0.2).select("id", "y", "_split")


@register("split_shares", with_vitals(f"""
, n AS (SELECT y, count(*) AS n FROM vx GROUP BY y),
r AS (SELECT id, y, {_rank_sql('id', 'y')} AS rk FROM vx),
s AS (SELECT r.y, CASE WHEN rk <= floor(n.n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS _split FROM r JOIN n ON r.y = n.y)
SELECT _split, CAST(count(*) AS BIGINT) AS n, CAST(count_if(y = 1) AS BIGINT) AS positives, round(avg(y), 6) AS share
FROM s GROUP BY _split"""), "D24")
def q_split_shares(spark, sf_dir):
    v = SA.strat_split(vx(spark, sf_dir).select("id", "y"), "id", "y", frac=0.2)
    return v.groupBy("_split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("positives"),
                                   r6(F.avg("y")).alias("share"))


@register("strat_kfold", with_vitals(f"""
SELECT id, y, CAST(({_rank_sql('id', 'y')} - 1) % 5 AS INTEGER) AS fold FROM vx"""), "L2")
def q_strat_kfold(spark, sf_dir):
    return SA.strat_kfold(vx(spark, sf_dir).select("id", "y"), "id", "y", k=5)


@register("kfold", f"""
SELECT o_orderkey, CAST(({_rank_sql('o_orderkey', None)} - 1) % 5 AS INTEGER) AS fold FROM orders""", "L3")
def q_kfold(spark, sf_dir):
    return SA.kfold(t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", k=5)


@register("class_weights", with_vitals("""
, n AS (SELECT y, count(*) AS n FROM vx GROUP BY y),
tot AS (SELECT sum(n) AS total, count(*) AS k FROM n)
SELECT id, vx.y AS y, round(total / (k * n.n), 6) AS weight FROM vx JOIN n ON vx.y = n.y, tot"""), "L6")
def q_class_weights(spark, sf_dir):
    w = SA.class_weights(vx(spark, sf_dir).select("id", "y"), "y")
    return w.select("id", "y", r6("weight").alias("weight"))


@register("balanced_undersample", """
WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic),
m AS (SELECT min(n) AS n_min FROM c),
b AS (SELECT l.doc_id, l.toxic, CAST(g.bag AS INTEGER) AS bag,
        row_number() OVER (PARTITION BY g.bag, l.toxic ORDER BY md5(CAST(l.doc_id AS VARCHAR) || ':' || CAST(42 + g.bag AS VARCHAR)), l.doc_id) AS rk
      FROM labels l CROSS JOIN range(3) g(bag))
SELECT doc_id, toxic, bag FROM b, m WHERE rk <= n_min""", "L7")
def q_balanced_undersample(spark, sf_dir):
    lb = t(spark, sf_dir, "labels").select("doc_id", "toxic")
    return SA.balanced_undersample(lb, "doc_id", "toxic", n_bags=3).select("doc_id", "toxic", "bag")


@register("soft_vote", with_vitals("""
SELECT id, round((p + p2 + p3) / 3, 6) AS prob, CASE WHEN (p + p2 + p3) / 3 > 0.5 THEN 1 ELSE 0 END AS pred FROM vx"""),
    "P1")
def q_soft_vote(spark, sf_dir):
    v = vx(spark, sf_dir)
    prob = EN.soft_vote(["p", "p2", "p3"])
    return v.select("id", r6(prob).alias("prob"), EN.vote_label(prob).alias("pred"))


_MEMBERS = ["p", "p2", "p3"]
# The reference's four-member probability blend.
FIXED_W = {"p": 0.3, "p2": 0.3, "p3": 0.2, "p4": 0.2}


@register("weighted_vote", with_vitals("""
, acc AS (SELECT avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS a1,
                 avg(CASE WHEN (p2 > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS a2,
                 avg(CASE WHEN (p3 > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS a3 FROM vx),
w AS (SELECT a1 / (a1 + a2 + a3) AS w1, a2 / (a1 + a2 + a3) AS w2, a3 / (a1 + a2 + a3) AS w3 FROM acc)
SELECT id, round(p * w1 + p2 * w2 + p3 * w3, 6) AS cv_prob,
       CASE WHEN p * w1 + p2 * w2 + p3 * w3 > 0.5 THEN 1 ELSE 0 END AS cv_pred,
       round(p * 0.3 + p2 * 0.3 + p3 * 0.2 + p4 * 0.2, 6) AS fixed_prob
FROM vx, w"""), "P2 P3")
def q_weighted_vote(spark, sf_dir):
    v = vx(spark, sf_dir)
    accs = v.agg(*[F.avg(F.when((F.col(m) > 0.5) == (F.col("y") == 1), 1.0).otherwise(0.0)).alias(m)
                   for m in _MEMBERS]).first().asDict()
    cv = EN.weighted_vote(accs)
    fixed = EN.weighted_vote(FIXED_W)
    return v.select("id", r6(cv).alias("cv_prob"), EN.vote_label(cv).alias("cv_pred"), r6(fixed).alias("fixed_prob"))


# The reference's six-member regression blend (lasso, elastic net,
# kernel ridge, three boosters) and the clip of its prices.
BLEND_W = {"m1": 0.10, "m2": 0.10, "m3": 0.10, "m4": 0.25, "m5": 0.25, "m6": 0.20}
BLEND_CLIP = (40000.0, 800000.0)


@register("blend_regression", """
WITH m AS (SELECT l_orderkey, l_linenumber, ln(1 + l_extendedprice) * 0.999 AS m1, ln(1 + l_extendedprice * (1 - l_discount)) * 1.001 AS m2,
                  ln(1 + l_extendedprice * (1 + l_tax)) AS m3, ln(1 + l_extendedprice) AS m4, ln(1 + l_extendedprice * 2) AS m5,
                  ln(1 + l_extendedprice * l_quantity) AS m6 FROM lineitem)
SELECT l_orderkey, l_linenumber,
       round(least(greatest((exp(m1) - 1) * 0.10 + (exp(m2) - 1) * 0.10 + (exp(m3) - 1) * 0.10 + (exp(m4) - 1) * 0.25 + (exp(m5) - 1) * 0.25
             + (exp(m6) - 1) * 0.20, 40000.0), 800000.0), 6) AS price
FROM m""", "P4")
def q_blend_regression(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    c = F.col
    # Member predictions on the log scale (slightly distorted, as models are).
    m = li.select("l_orderkey", "l_linenumber", (F.log1p("l_extendedprice") * 0.999).alias("m1"),
                  (F.log1p(c("l_extendedprice") * (1 - c("l_discount"))) * 1.001).alias("m2"),
                  F.log1p(c("l_extendedprice") * (1 + c("l_tax"))).alias("m3"), F.log1p("l_extendedprice").alias("m4"),
                  F.log1p(c("l_extendedprice") * 2).alias("m5"), F.log1p(c("l_extendedprice") * c("l_quantity")).alias("m6"))
    return m.select("l_orderkey", "l_linenumber",
                    r6(EN.blend_regression(BLEND_W, *BLEND_CLIP)).alias("price"))


_FEATURES = ["age", "hr", "rr", "sbp", "dbp", "gcs", "pf", "plt", "bu", "glucose", "insulin", "max_hr", "chol", "al"]


@register("metrics_report", with_vitals(_CLIN_SQL + f""",
roc AS (SELECT * FROM (WITH s AS (SELECT p AS s, count_if(y = 1) AS pos, count_if(y <> 1) AS neg FROM vx GROUP BY p),
   c AS (SELECT *, sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM s)
   SELECT sum(pos * (cum_neg - neg + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS roc_auc FROM c)),
imp AS ({" UNION ALL ".join(f"SELECT '{f}' AS name, abs(corr({f}, y)) AS value FROM vx" for f in _FEATURES)}),
top AS (SELECT name, value, row_number() OVER (ORDER BY value DESC, name) AS rk FROM imp)
SELECT 'metric' AS section, name, round(value, 6) AS value, CAST(rk AS INTEGER) AS rank FROM (
  SELECT 'roc_auc' AS name, roc_auc AS value, 1 AS rk FROM roc UNION ALL
  SELECT 'sensitivity', sensitivity, 2 FROM r UNION ALL SELECT 'specificity', specificity, 3 FROM r UNION ALL
  SELECT 'ppv', ppv, 4 FROM r UNION ALL SELECT 'npv', npv, 5 FROM r)
UNION ALL SELECT 'top_predictor', name, round(value, 6), CAST(rk AS INTEGER) FROM top WHERE rk <= 10"""), "A6 F1")
def q_metrics_report(spark, sf_dir):
    s = scored(spark, sf_dir)
    clin = M.clinical_metrics(s, "y", "pred")
    roc = M.roc_auc(s, "y", "p")
    imp = s.agg(*[F.abs(F.corr(f, "y")).alias(f) for f in _FEATURES])
    rep = metrics_report(roc, clin, imp, k=10)
    return rep.select("section", "name", r6("value").alias("value"), "rank")
