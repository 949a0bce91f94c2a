"""Sources and sinks (A2-A6), models (rows + sanity bounds), the cohort
generator, AdaBoost with checkpoints, and stateless stream scoring."""

import tempfile

from pyspark.sql import functions as F

from riskloom.operators import models as MD
from riskloom.sources import read_headerless
from riskloom.sources.cohort import SEPSIS, cohort
from riskloom.sources.sinks import metrics_report, write_csv
from riskloom.streaming.scoring import start_scoring
from conftest import SMALL


def test_headerless_csv_and_csv_sink(spark, tmp_path):
    src = tmp_path / "diabetes.csv"
    src.write_text("6,148,72,35,0,33.6,0.627,50,1\n1,85,66,29,0,26.6,0.351,31,0\n")
    schema = ("Pregnancies int, Glucose double, BloodPressure double, SkinThickness double, Insulin double, "
              "BMI double, DiabetesPedigreeFunction double, Age int, Outcome int")
    df = read_headerless(spark, str(src), schema)
    assert df.count() == 2 and df.columns[0] == "Pregnancies"
    out = tmp_path / "out"
    write_csv(df.select("Age", "Outcome"), str(out))
    back = spark.read.option("header", True).csv(str(out))
    assert sorted(back.columns) == ["Age", "Outcome"] and back.count() == 2


def test_metrics_report_topk(spark):
    m = spark.createDataFrame([(0.9, 0.8)], "roc_auc double, sensitivity double")
    imp = spark.createDataFrame([(0.1, 0.5, 0.3)], "a double, b double, c double")
    rep = metrics_report(m, imp, k=2).collect()
    tops = [(r.name, r.rank) for r in rep if r.section == "top_predictor"]
    assert tops == [("b", 1), ("c", 2)] or sorted(tops) == [("b", 1), ("c", 2)]
    assert {r.name for r in rep if r.section == "metric"} == {"roc_auc", "sensitivity"}


def test_cohort_is_layout_independent(spark):
    keys = spark.range(0, 2000).withColumnRenamed("id", "pid")
    a = cohort(keys.repartition(7), "pid", "sepsis", 0.15, SEPSIS).orderBy("pid").collect()
    b = cohort(keys.coalesce(1), "pid", "sepsis", 0.15, SEPSIS).orderBy("pid").collect()
    assert a == b
    share = sum(r.sepsis for r in a) / len(a)
    assert 0.12 < share < 0.18
    assert all(0.5 <= r.wbc <= 30 and 18 <= r.age <= 95 for r in a)
    pos_t = {round(r.temperature, 6) for r in a if r.sepsis == 1}
    assert len(pos_t) > 10  # mixture drawn per row


def test_models_fit_and_separate(spark):
    rows = [(i, float(i % 10), float(2 * (i % 10) + i % 3), int(i % 10 >= 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    tr, te = df.where("id % 5 <> 1"), df.where("id % 5 = 1")
    for name, kw in (("rf", {"trees": 10, "depth": 3}), ("gbt", {"rounds": 5}), ("logreg", {"C": 1.0})):
        _, pred = MD.fit_predict(name, tr, te, ["a", "b"], "y", **kw)
        acc = pred.select(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
        assert acc > 0.9, name


def test_adaboost_with_checkpoints(spark):
    rows = [(i, float(i % 10), int(i % 10 >= 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, y int")
    out = MD.adaboost(df, df, ["a"], "y", rounds=6, checkpoint_every=3)
    acc = out.select(F.avg((F.col("ada_pred") == F.col("y")).cast("double"))).first()[0]
    assert out.count() == 200 and acc > 0.9


def test_stream_scoring_matches_batch(spark):
    ck = tempfile.mkdtemp(prefix="riskloom-stream-")
    q = start_scoring(spark, SMALL, "scored_stream", ck)
    q.processAllAvailable()
    q.stop()
    n = spark.sql("SELECT count(*) FROM scored_stream").first()[0]
    assert n == spark.read.parquet(f"{SMALL}/orders.parquet").count()


def test_flows_end_to_end(spark):
    from riskloom.plans.flows import regression_flow, resample_flow, sepsis_flow
    strata, report = sepsis_flow(spark, SMALL, trees=5, rounds=5)
    rows = strata.collect()
    assert len(rows) == 6 and sum(r.patients for r in rows) > 0
    rep = {(r.section, r.name): r.value for r in report.collect()}
    assert 0.8 < rep[("metric", "roc_auc")] <= 1.0
    assert len([k for k in rep if k[0] == "top_predictor"]) == 10
    grown, report = resample_flow(spark, SMALL, trees=5, rounds=5, iters=20, bags=4)
    n = {r["y"]: r["count"] for r in grown.groupBy("y").count().collect()}
    assert n[0] == int(0.5 * n[1])
    assert {r.name for r in report.where("section = 'metric'").collect()} >= {"roc_auc", "avg_precision", "ppv"}
    priced, rmsle, cv = regression_flow(spark, SMALL, trees=5, rounds=5, fourier=30)
    assert rmsle < 0.3 and len(cv) == 5 and all(e < 0.3 for _, e in cv)
    assert priced.where("price < 40000 OR price > 800000").count() == 0


def test_ridge_equals_closed_form(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, y double")
    _, pred = MD.fit_predict("ridge", df, df, ["a", "b", "c"], "y", alpha=5.0)
    xc, yc = x - x.mean(0), y - y.mean()
    want = xc @ np.linalg.solve(xc.T @ xc + 5.0 * np.eye(3), xc.T @ yc) + y.mean()
    assert np.allclose([r.prediction for r in pred.orderBy("id").collect()], want, atol=1e-4)
    k, names = MD.poly2_features(df, ["a", "b", "c"])
    _, pred = MD.fit_predict("ridge", k, k, names, "y", alpha=0.6, intercept=False)
    gram = (x @ x.T / 3 + 2.5) ** 2
    want = gram @ np.linalg.solve(gram + 0.6 * np.eye(200), y)
    assert np.allclose([r.prediction for r in pred.orderBy("id").collect()], want, atol=1e-3)
