"""Distributed model fitting and scoring with ``pyspark.ml``.

The reference's estimators map onto MLlib as follows (gaps stated plainly):

============== ===============================================================
random forest  ``RandomForestClassifier/Regressor``; ``min_samples_leaf`` ->
               ``minInstancesPerNode``; no ``min_samples_split``
boosting       ``GBTClassifier/Regressor`` (squared / absolute loss); second
               order, leaf-wise and Huber: ``boosting.py``
logistic       ``LogisticRegression(regParam=1/(C n), standardization=False)``
linear         lasso: ``regParam=alpha``; ridge: ``regParam=alpha*s/n``; elastic
               net: both parts; MLlib divides an L2 penalty by the label's
               standard deviation s, so s is put back in
extra trees    forest without bootstrap, feature subsets; with random split
               points: ``forests.py``
AdaBoost       ``boosting.py``
balanced       ``forests.py``
kernel SVM     random Fourier features + logistic regression; hinge and epsilon
               losses with probabilities: ``networks.py``
kernel ridge   explicit degree-2 feature map + ridge without intercept from
               sums of products (``linear.py``)
neural net     ``MultilayerPerceptronClassifier`` (sigmoid hidden layers);
               ReLU and early stopping: ``networks.py``
============== ===============================================================

Features are assembled into a vector only at the model edge (J8).
"""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting, forests, linear

FEATURES = "features"


def assemble(df: DataFrame, cols: Sequence[str], out: str = FEATURES) -> DataFrame:
    """Vector column from numeric columns; NULL or NaN is an error."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(df)


def estimator(name: str, label: str, n_rows: int | None = None, weight: str | None = None, label_std: float = 1.0, **p):
    """MLlib estimator for a reference model name."""
    seed = p.pop("seed", 42)
    common = dict(featuresCol=FEATURES, labelCol=label)
    wkw = {"weightCol": weight} if weight else {}
    if name == "rf":
        return RandomForestClassifier(numTrees=p.get("trees", 100), maxDepth=p.get("depth", 5),
                                      minInstancesPerNode=p.get("min_leaf", 1),
                                      featureSubsetStrategy=p.get("features", "sqrt"), seed=seed,
                                      **wkw, **common)
    if name == "rf_reg":
        return RandomForestRegressor(numTrees=p.get("trees", 100), maxDepth=p.get("depth", 5),
                                     featureSubsetStrategy=p.get("features", "onethird"), seed=seed, **common)
    if name == "extra_trees_reg":
        return RandomForestRegressor(numTrees=p.get("trees", 500), maxDepth=p.get("depth", 15), bootstrap=False,
                                     featureSubsetStrategy=p.get("features", "sqrt"), seed=seed, **common)
    if name == "extra_trees":
        return RandomForestClassifier(numTrees=p.get("trees", 100), maxDepth=p.get("depth", 10),
                                      bootstrap=False, featureSubsetStrategy=p.get("features", "sqrt"),
                                      seed=seed, **wkw, **common)
    if name == "gbt":
        return GBTClassifier(maxIter=p.get("rounds", 100), stepSize=p.get("rate", 0.1),
                             maxDepth=p.get("depth", 3), subsamplingRate=p.get("subsample", 1.0),
                             seed=seed, **wkw, **common)
    if name == "gbt_reg":
        return GBTRegressor(maxIter=p.get("rounds", 100), stepSize=p.get("rate", 0.1),
                            maxDepth=p.get("depth", 3), subsamplingRate=p.get("subsample", 1.0),
                            lossType=p.get("loss", "squared"), seed=seed, **common)
    if name == "logreg":
        c = p.get("C", 1.0)
        reg = 1.0 / (c * n_rows) if n_rows else 0.0
        return LogisticRegression(regParam=reg, elasticNetParam=0.0, standardization=False,
                                  maxIter=p.get("iters", 100), **wkw, **common)
    if name in ("lasso", "enet", "ridge"):
        alpha = p.get("alpha", 1.0)
        if name == "ridge":
            return LinearRegression(regParam=alpha * label_std / (n_rows or 1), elasticNetParam=0.0,
                                    standardization=False, fitIntercept=p.get("intercept", True), **common)
        l1 = 1.0 if name == "lasso" else p.get("l1_ratio", 0.5)
        reg = alpha * (l1 + (1 - l1) * label_std)
        return LinearRegression(regParam=reg, elasticNetParam=alpha * l1 / reg if reg else l1, standardization=False, **common)
    if name == "mlp":
        return MultilayerPerceptronClassifier(layers=p["layers"], maxIter=p.get("iters", 500),
                                              seed=seed, **common)
    raise ValueError(f"unknown model {name}")


def positive_probability(pred: DataFrame, out: str = "prob") -> DataFrame:
    """P(class 1) from the probability vector."""
    return pred.withColumn(out, vector_to_array("probability")[1])


def fit_predict(name: str, train: DataFrame, test: DataFrame, features: Sequence[str], label: str,
                weight: str | None = None, scaler: str | None = None, prediction: str = "prediction", **params):
    """Fit on ``train``, score ``test``; returns (model, predictions).  With
    ``scaler`` ("standard" or "robust") the scaling is a stage of the fitted
    pipeline (N16), so within a fold it sees that fold's training rows only.
    ``prediction`` names the result, so several models can score one frame."""
    if name == "ridge" and not params.get("intercept", True) and not scaler:
        model = linear.fit_ridge(train, features, label, params.get("alpha", 1.0))
        return model, model.transform(test, prediction)
    if name == "ridge" and not params.get("intercept", True):
        # MLlib gives a column without variance no weight.  A row of zeros leaves
        # a fit without intercept as it is, and a constant column varies with it.
        zero = train.sparkSession.range(1).select(*[F.lit(0.0).alias(c) for c in (*features, label)])
        train = train.select(*features, label).unionByName(zero)
    n, std = None, 1.0
    if name in ("logreg", "ridge", "lasso", "enet"):
        n, std = train.agg(F.count(F.lit(1)), F.stddev_pop(label)).first()
    est = estimator(name, label, n_rows=n, weight=weight, label_std=std or 1.0, **params).setPredictionCol(prediction)
    vec = f"{FEATURES}_{prediction}"
    raw = f"{vec}_raw" if scaler else vec
    stages = [VectorAssembler(inputCols=list(features), outputCol=raw, handleInvalid="error")]
    if scaler == "standard":
        stages.append(StandardScaler(inputCol=raw, outputCol=vec, withMean=True, withStd=True))
    elif scaler == "robust":
        stages.append(RobustScaler(inputCol=raw, outputCol=vec, withCentering=True, withScaling=True))
    if prediction != "prediction":
        for col in ("rawPrediction", "probability"):
            if est.hasParam(f"{col}Col"):
                est = est.copy({est.getParam(f"{col}Col"): f"{col}_{prediction}"})
    model = Pipeline(stages=[*stages, est.setFeaturesCol(vec)]).fit(train)
    return model, model.transform(test).drop(raw, vec)


def importances(model, names: Sequence[str]) -> list[tuple[str, float]]:
    """Feature importances of a tree model (N13), as (name, value) pairs."""
    m = model.stages[-1] if hasattr(model, "stages") else model
    imp = m.featureImportances.toArray()
    return [(n, float(v)) for n, v in zip(names, imp)]


def cross_validate(df: DataFrame, fold_col: str, k: int, fit_score, parallelism: int = 4) -> list:
    """k-fold scores (N15): ``fit_score(train, held_out) -> float`` runs for
    every fold; folds are fitted concurrently from driver threads, each fit
    being a set of distributed jobs (the scheme of ``CrossValidator``'s
    ``parallelism``).  Returns [(fold, score)] in fold order."""
    from concurrent.futures import ThreadPoolExecutor

    def one(f):
        return f, fit_score(df.where(F.col(fold_col) != f), df.where(F.col(fold_col) == f))

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, k))) as ex:
        return sorted(ex.map(one, range(k)))


# -- ensembles grown on packed rows --------------------------------------------

def balanced_forest(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, key: str,
                    bags: int = 200, depth: int = 10, seed: int = 42) -> DataFrame:
    """``test`` with ``prob`` of a balanced random forest (N12, ``forests.py``)."""
    return forests.balanced_forest(train, features, label, key, trees=bags, depth=depth, seed=seed).predict(test, "prob")


def adaboost(train: DataFrame, test: DataFrame, features: Sequence[str], label: str,
             rounds: int = 200, rate: float = 0.5, checkpoint_every: int = boosting.REFRESH) -> DataFrame:
    """``test`` with the score ``ada_score`` and the class ``ada_pred`` of
    AdaBoost with stumps (N7, ``boosting.py``).  The training rows are written
    with their scores every ``checkpoint_every`` rounds."""
    return boosting.fit_stumps(train, features, label, rounds, rate, refresh=checkpoint_every).predict(test)


# -- kernel approximations --------------------------------------------------------

def rbf_gamma(df: DataFrame, cols: Sequence[str]) -> float:
    """sklearn's "scale" gamma: 1 / (n_features * variance of all input values)."""
    p = len(cols)
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.avg(F.col(c) * F.col(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    mean = sum(row[f"m{i}"] for i in range(p)) / p
    var = sum(row[f"s{i}"] for i in range(p)) / p - mean * mean
    return 1.0 / (p * var) if var > 0 else 1.0


def fourier_features(df: DataFrame, cols: Sequence[str], n_components: int = 300, gamma: float = None,
                     seed: int = 42, prefix: str = "rff_") -> tuple[DataFrame, list[str]]:
    """Random Fourier features of the RBF kernel exp(-gamma |x-z|^2)
    (Rahimi & Recht, 2007) as plain column expressions: the random matrix is
    small (components x inputs) and lives in the plan as literals.  Fit
    ``gamma`` on the training frame (``rbf_gamma``) and pass the same value
    when transforming other frames."""
    p = len(cols)
    if gamma is None:
        gamma = rbf_gamma(df, cols)
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2 * gamma), size=(n_components, p))
    b = rng.uniform(0, 2 * math.pi, size=n_components)
    scale = math.sqrt(2.0 / n_components)
    names = []
    exprs = {}
    for i in range(n_components):
        # One SQL expression per component: a single plan-building call.
        lin = " + ".join([repr(float(b[i]))] + [f"{float(w[i, j])!r} * `{c}`" for j, c in enumerate(cols)])
        exprs[f"{prefix}{i}"] = F.expr(f"{scale!r} * cos({lin})")
        names.append(f"{prefix}{i}")
    return df.withColumns(exprs), names


def poly2_features(df: DataFrame, cols: Sequence[str], gamma: float | None = None, coef0: float = 2.5,
                   prefix: str = "pk_") -> tuple[DataFrame, list[str]]:
    """Explicit feature map of the kernel (gamma x.z + coef0)^2, so kernel
    ridge becomes a linear ridge without intercept (N10)."""
    p = len(cols)
    g = gamma if gamma is not None else 1.0 / p
    exprs = {}
    for i, a in enumerate(cols):
        exprs[f"{prefix}{a}_sq"] = F.lit(g) * F.col(a) * F.col(a)
        for b in cols[i + 1:]:
            exprs[f"{prefix}{a}_{b}"] = F.lit(math.sqrt(2) * g) * F.col(a) * F.col(b)
        exprs[f"{prefix}{a}"] = F.lit(math.sqrt(2 * g * coef0)) * F.col(a)
    exprs[f"{prefix}const"] = F.lit(float(coef0))
    return df.withColumns(exprs), list(exprs)
