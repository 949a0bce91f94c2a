"""End-to-end flows composed from the library operators.

``sepsis_flow``: scores and indices, stratified hold-out, median fill, class
weights, scaling fitted on the training rows, several models, a fixed-weight
blend, clinical metrics, alert strata and the metrics report.
``resample_flow``: a real label (``labels.quality``) over features of
``documents``, over-sampling of the training minority, four models, the
four-member blend and the report.
``regression_flow``: log target, eight regressors, the fixed-weight blend
brought back and clipped, and cross-validation with the scaler in each fold.

Every step is a Spark plan; the driver only sees one-row statistics and the
small result tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import boosting as BO
from ..operators import encode as E
from ..operators import ensemble as EN
from ..operators import forests as FO
from ..operators import impute as IM
from ..operators import metrics as M
from ..operators import models as MD
from ..operators import networks as NW
from ..operators import rebalance as RB
from ..operators import sampling as SA
from ..operators import scale as SC
from ..operators.strata import risk_strata
from ..session import cut_lineage
from ..sources.sinks import metrics_report
from ..sources.tables import load
from ..streaming.scoring import ALERT_EDGES, ALERT_LABELS
from .common import vx

MEASURES = ["age", "temp", "hr", "rr", "sbp", "dbp", "wbc", "lact", "sc"]
FEATURES = MEASURES + ["map", "shock_index", "sirs_score", "qsofa_score", "marker"]
# Encoded in the flow: a 0/1 column per level, and a code of the sorted levels.
ONE_HOT, CODED = ["chest_pain"], ["smoking"]
# Weights of this flow's three members (forest, boosting, logistic).
BLEND = {"p_rf": 0.4, "p_gbt": 0.4, "p_lr": 0.2}
# The reference's four-member probability blend.
BLEND4 = {"p_brf": 0.3, "p_gbt": 0.3, "p_et": 0.2, "p_nn": 0.2}
# The reference's eight regressors and the clip of its prices.
BLEND8 = {"lasso": 0.10, "enet": 0.10, "ridge": 0.05, "gbt_reg": 0.30, "rf_reg": 0.20, "extra_trees_reg": 0.15, "svr": 0.05, "krr": 0.05}
PRICE_CLIP = (40000.0, 800000.0)


def _report(scored: DataFrame, importances: list[tuple[str, float]]) -> DataFrame:
    spark = scored.sparkSession
    imp = spark.createDataFrame([tuple(v for _, v in importances)], [n for n, _ in importances])
    return metrics_report(M.roc_auc(scored, "y", "prob"), M.avg_precision(scored, "y", "prob"),
                          M.clinical_metrics(scored, "y", "pred"), imp, k=10)


def sepsis_flow(spark: SparkSession, sf_dir: str, trees: int = 200, rounds: int = 200) -> tuple[DataFrame, DataFrame]:
    """The ICU sepsis flow over the vitals view, with the full qSOFA rule set.
    Returns (alert strata table, metrics report)."""
    v = vx(spark, sf_dir)
    c = v.withColumns({"shock_index": F.col("hr") / F.col("sbp"), "sirs_score": S.additive_score(S.SIRS),
                       "qsofa_score": S.additive_score(S.QSOFA), "marker": F.col("p") * 10 + F.col("lact") / 5})
    split = cut_lineage(SA.strat_split(c.select("id", "y", *FEATURES, *ONE_HOT, *CODED), "id", "y", frac=0.2))
    train, test = split.where(F.col("_split") == "train"), split.where(F.col("_split") == "test")
    train, test = (IM.fill_median(d, ["temp", "sc"], fit=train) for d in (train, test))
    # Levels and codes come from the training rows; a level unseen there is the code -1 and no 0/1 column.
    levels = {x: E.level_list(train, x) for x in ONE_HOT}
    codes = [f"{x}_code" for x in CODED]
    train, test = (E.one_hot(E.label_encode(d, CODED, fit=train, suffix="_code"), ONE_HOT, levels).fillna(-1, codes) for d in (train, test))
    features = [*FEATURES, *codes, *[f"{x}_{v}" for x in ONE_HOT for v in levels[x]]]
    train = SA.class_weights(train, "y")
    params = SC.fit_standard(train, features)
    tr, te = cut_lineage(SC.apply_standard(train, params, "_z")), SC.apply_standard(test, params, "_z")
    zf = [f + "_z" for f in features]
    scored = te.select("id", "y", "sirs_score", "lact", *zf)
    forest = FO.random_forest(tr, zf, "y", "id", trees=trees, depth=8, weight="weight")
    scored = forest.predict(scored, "p_rf")
    scored = BO.boost(tr, zf, "y", rounds=rounds, depth=3, subsample=0.8, key="id").predict(scored, "p_gbt")
    _, pred = MD.fit_predict("logreg", tr, scored, zf, "y", weight="weight", C=1.0)
    scored = MD.positive_probability(pred, "p_lr").drop("rawPrediction", "probability", "prediction")
    # Several metrics read the scored hold-out: score it once.
    scored = cut_lineage(scored.withColumn("prob", EN.weighted_vote(BLEND)).withColumn("pred", EN.vote_label(F.col("prob"))))
    strata = risk_strata(scored, "prob", "y", ALERT_EDGES, ALERT_LABELS, extra_means=["sirs_score", "lact"])
    return strata, _report(scored, list(zip(features, [v for _, v in forest.importances()])))


TEXT_FEATURES = ["log_chars", "symbol_share", "upper_share", "digit_share", "mean_word", "distinct_share", "line_rate", "space_share",
                 "pipe_share", "punct_share"]


def text_features(docs: DataFrame) -> DataFrame:
    """doc_id and TEXT_FEATURES, from built-in string functions."""
    x = F.coalesce(F.col("text"), F.lit(""))
    n = F.greatest(F.length(x), F.lit(1)).cast("double")
    words = F.split(x, r"\s+")
    without = lambda pattern: 1 - F.length(F.regexp_replace(x, pattern, "")) / n
    return docs.select("doc_id", F.log(n).alias("log_chars"), without(r"[#$%&*!]").alias("symbol_share"),
                       without("[A-Z]").alias("upper_share"), without("[0-9]").alias("digit_share"), (n / F.size(words)).alias("mean_word"),
                       (F.size(F.array_distinct(words)) / F.size(words)).alias("distinct_share"), without(r"\n").alias("line_rate"),
                       without(" ").alias("space_share"), without(r"\|").alias("pipe_share"), without("[.,;:]").alias("punct_share"))


def resample_flow(spark: SparkSession, sf_dir: str, trees: int = 200, rounds: int = 200, iters: int = 200, ratio: float = 0.5,
                  bags: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Over-sample the training rows of the rarer label, then fit on the grown
    table.  Returns (grown training table (y, features), metrics report)."""
    labels = load(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    docs = text_features(load(spark, sf_dir, "documents").select("doc_id", "text"))
    split = cut_lineage(SA.strat_split(docs.join(labels, "doc_id"), "doc_id", "y", frac=0.2))
    train, test = split.where(F.col("_split") == "train"), split.where(F.col("_split") == "test")
    params = SC.fit_standard(train, TEXT_FEATURES)
    vec = F.array(*[F.col(c).cast("double") for c in TEXT_FEATURES]).alias("v")
    tr = SC.apply_standard(train, params).select("doc_id", "y", vec)
    te = SC.apply_standard(test, params).select(F.col("doc_id").alias("id"), "y", *TEXT_FEATURES)
    grown = RB.smote(tr, "doc_id", "v", "y", minority=0, ratio=ratio)
    grown = cut_lineage(grown.select(
        F.xxhash64("src_id", F.coalesce("copy", F.lit(-1))).alias("id"), "y",
        *[F.col("v")[i].alias(c) for i, c in enumerate(TEXT_FEATURES)]))
    scored = MD.balanced_forest(grown, te, TEXT_FEATURES, "y", "id", bags=bags or trees, depth=8).withColumnRenamed("prob", "p_brf")
    scored = BO.boost(grown, TEXT_FEATURES, "y", rounds=rounds, depth=3, subsample=0.8, key="id").predict(scored, "p_gbt")
    extra = FO.extra_trees(grown, TEXT_FEATURES, "y", trees=trees, depth=8)
    scored = extra.predict(scored, "p_et")
    scored = NW.fit_network(grown, TEXT_FEATURES, "y", "id", hidden=(100, 50, 25), epochs=iters, rate=0.01, patience=4).predict(scored, "p_nn")
    scored = cut_lineage(scored.withColumn("prob", EN.weighted_vote(BLEND4)).withColumn("pred", EN.vote_label(F.col("prob"))))
    return grown, _report(scored, extra.importances())


REG_FEATURES = ["log_quantity", "retail", "p_size", "discount", "tax", "n_lines", "log_retail"]


def regression_flow(spark: SparkSession, sf_dir: str, trees: int = 500, rounds: int = 12, rate: float = 0.3, fourier: int = 300):
    """Price of a part's orders: log1p target, eight regressors, blend, clip.
    Returns (held-out id, y, price; RMSE of logs; [(fold, CV error)])."""
    li = load(spark, sf_dir, "lineitem")
    parts = load(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("retail"), "p_size")
    per = li.groupBy(F.col("l_partkey").alias("id")).agg(
        F.sum("l_extendedprice").alias("total"), F.log1p(F.sum("l_quantity")).alias("log_quantity"),
        F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"), F.count(F.lit(1)).cast("double").alias("n_lines"))
    d = (per.join(parts, F.col("id") == F.col("p_partkey"), "left")
         .withColumns({"y": F.log1p("total"), "retail": F.coalesce("retail", F.lit(0.0)), "p_size": F.coalesce(F.col("p_size").cast("double"), F.lit(0.0))})
         .withColumn("log_retail", F.log1p("retail")))
    folded = cut_lineage(SA.kfold(d.select("id", "y", *REG_FEATURES), "id", k=5))
    train, test = folded.where("fold <> 0"), folded.where("fold = 0")
    for name, kw in (("lasso", {"alpha": 0.0005}), ("enet", {"alpha": 0.0005, "l1_ratio": 0.9}), ("ridge", {"alpha": 10.0})):
        _, test = MD.fit_predict(name, train, test, REG_FEATURES, "y", scaler="robust", prediction=name, **kw)
    test = BO.boost(train, REG_FEATURES, "y", loss="huber", rounds=rounds, rate=rate, depth=4, min_rows=15).predict(test, "gbt_reg")
    test = FO.random_forest(train, REG_FEATURES, "y", "id", trees=trees, depth=10, candidates=3).predict(test, "rf_reg")
    test = FO.extra_trees(train, REG_FEATURES, "y", trees=trees, depth=10, candidates=3).predict(test, "extra_trees_reg")
    params = SC.fit_standard(train, REG_FEATURES)
    tr, te = SC.apply_standard(train, params), cut_lineage(SC.apply_standard(test, params))
    te = NW.fit_svr(tr, REG_FEATURES, "y", "id", c=20.0, epsilon=0.008, components=fourier).predict(te, "svr")
    ptr, pn = MD.poly2_features(tr, REG_FEATURES)
    pte, _ = MD.poly2_features(te, REG_FEATURES)
    _, te = MD.fit_predict("ridge", ptr, pte, pn, "y", alpha=0.6, intercept=False, prediction="krr")
    priced = cut_lineage(te.select("id", "y", *BLEND8, EN.blend_regression(BLEND8, *PRICE_CLIP).alias("price"),
                                   EN.blend_regression(BLEND8).alias("raw")))
    rmsle = priced.agg(F.sqrt(F.avg(F.pow(F.col("y") - F.log1p("raw"), 2)))).first()[0]

    def error(fit_on, held):
        _, pred = MD.fit_predict("lasso", fit_on, held, REG_FEATURES, "y", scaler="robust", alpha=0.0005)
        return pred.agg(M.rmse_expr("y", "prediction")).first()[0]

    return priced, rmsle, MD.cross_validate(folded, "fold", 5, error)
