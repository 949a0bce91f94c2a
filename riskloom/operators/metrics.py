"""Evaluation metrics computed as DataFrame aggregates.

Every metric is exact and distributed:

* confusion counts, clinical ratios, accuracy, RMSE: one aggregate pass;
* the classification report: a (label, prediction) count table (at most
  classes^2 rows) and conditional sums over it;
* ROC-AUC and average precision: positives / negatives per distinct score
  (partial aggregation, so a tied score costs one row per task), then
  running sums over scores with the bucketed ordering of ``ordering.py``
  (no single-partition window), then one sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import running_sums


def _z(num, den):
    """num / den, 0 when den is 0 (the reference's guarded ratios)."""
    return F.coalesce(F.try_divide(num.cast("double"), den), F.lit(0.0))


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """tn, fp, fn, tp of a binary prediction."""
    y, p = F.col(label), F.col(pred)
    return df.agg(F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                  F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def clinical_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Sensitivity, specificity, PPV, NPV (0 when undefined) and the number
    needed to screen, truncated 1/PPV, NULL when PPV is 0 (D14, D15)."""
    cm = confusion(df, label, pred)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    out = cm.select("tn", "fp", "fn", "tp",
                    _z(tp, tp + fn).alias("sensitivity"), _z(tn, tn + fp).alias("specificity"),
                    _z(tp, tp + fp).alias("ppv"), _z(tn, tn + fn).alias("npv"))
    return out.withColumn("nns", F.when(F.col("ppv") > 0, F.floor(F.lit(1.0) / F.col("ppv"))))


def class_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Per class precision / recall / F1 / support, then accuracy, macro and
    weighted averages (D16, D20).  Classes are the union of labels and
    predictions; an undefined ratio is 0."""
    cm = df.groupBy(F.col(label).alias("y"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(zero)
    sides = cm.select(F.explode(F.array(
        F.struct(F.col("y").alias("cls"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("tp")),
        F.struct(F.col("p").alias("cls"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp")))).alias("s"))
    per = sides.select("s.*").groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    per = per.select("cls", _z(F.col("tp"), F.col("predicted")).alias("precision"),
                     _z(F.col("tp"), F.col("support")).alias("recall"), "support", "tp")
    # A row per class, read twice below: written once, so the input is scanned once.
    per = cut_lineage(per.withColumn("f1", _z(2 * F.col("precision") * F.col("recall"),
                                              F.col("precision") + F.col("recall"))))
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  F.try_divide(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("wp"),
                  F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("wr"),
                  F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("wf"))
    rows = per.select(F.col("cls").cast("string").alias("class_name"), "precision", "recall", "f1",
                      F.col("support").cast("long").alias("support"))
    def row(name, p, r, f):
        return F.struct(F.lit(name).alias("class_name"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1"),
                        F.col("n").cast("long").alias("support"))
    nul = F.lit(None)
    summary = tot.select(F.explode(F.array(
        row("accuracy", nul, nul, F.try_divide(F.col("tp"), F.col("n"))),
        row("macro avg", F.col("mp"), F.col("mr"), F.col("mf")),
        row("weighted avg", F.col("wp"), F.col("wr"), F.col("wf")),
    )).alias("s")).select("s.*")
    return rows.unionByName(summary)


def accuracy(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.agg(F.avg(F.when(F.col(label) == F.col(pred), 1.0).otherwise(0.0)).alias("accuracy"))


def score_table(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score (NULL scores dropped)."""
    return (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
            .groupBy(F.col(score).cast("double").alias("s"))
            .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve with tied scores counted half (Mann-Whitney),
    NULL when one class is absent (D17)."""
    st = score_table(df, label, score)
    cum = running_sums(st, ["s"], ["neg"])
    return cum.agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2.0)),
                     F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def avg_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Step-wise average precision: sum over thresholds (distinct scores,
    descending) of recall increase times precision (D18)."""
    st = score_table(df, label, score)
    cum = running_sums(st, ["s"], ["pos", "neg"], descending=True)
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return cum.agg(F.try_divide(F.sum(F.col("pos") * prec), F.sum("pos").cast("double"))
                   .alias("avg_precision"))


def rmse_expr(y: str, p: str, log: bool = False):
    """Aggregate expression of the RMSE; with ``log`` on log1p of both."""
    a, b = F.col(y), F.col(p)
    if log:
        a, b = F.log1p(a), F.log1p(b)
    return F.sqrt(F.avg(F.pow(a - b, 2)))


def rmse(df: DataFrame, y: str, p: str, log: bool = False) -> DataFrame:
    return df.agg(rmse_expr(y, p, log).alias("rmsle" if log else "rmse"))


def fold_summary(folds: DataFrame, metric: str) -> DataFrame:
    """Mean and population std of a per-fold metric."""
    return folds.agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"),
                     F.count(metric).alias("n_folds"))
