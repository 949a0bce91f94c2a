"""Table operators against pandas / brute force on small fixtures, plus
property checks (fold balance, one-hot sums, SMOTE geometry, AUC invariance)."""

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators import binning as B
from riskloom.operators import encode as E
from riskloom.operators import impute as I
from riskloom.operators import metrics as M
from riskloom.operators import neighbors as NB
from riskloom.operators import ordering as O
from riskloom.operators import profile as P
from riskloom.operators import rebalance as RB
from riskloom.operators import sampling as SA
from riskloom.operators import scale as SC
from riskloom.operators.strata import risk_strata


def test_ordered_index_matches_row_number(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.randint(0, 50), rnd.choice("ab")) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, v int, g string")
    got = O.ordered_index(df, ["v", "k"], partition_cols=["g"], name="rn", n_buckets=7)
    w = Window.partitionBy("g").orderBy("v", "k")
    ref = df.withColumn("rn2", F.row_number().over(w))
    j = got.join(ref, ["k", "v", "g"])
    assert j.where("rn <> rn2").count() == 0 and j.count() == 400


def test_running_sums_descending(spark):
    df = spark.createDataFrame([(float(i % 17), i % 3) for i in range(100)], "s double, x int")
    df = df.groupBy("s").agg(F.sum("x").alias("x"))
    got = {r.s: r.cum_x for r in O.running_sums(df, ["s"], ["x"], descending=True, n_buckets=4).collect()}
    pdf = df.toPandas().sort_values("s", ascending=False)
    pdf["c"] = pdf["x"].cumsum()
    assert all(got[s] == c for s, c in zip(pdf["s"], pdf["c"]))


def _auc_brute(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    tot = sum((1.0 if p > n else 0.5 if p == n else 0.0) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def _ap_brute(y, s):
    order = sorted(set(s), reverse=True)
    P_ = sum(y)
    ap, prev_r = 0.0, 0.0
    for th in order:
        tp = sum(1 for a, b in zip(y, s) if b >= th and a == 1)
        fp = sum(1 for a, b in zip(y, s) if b >= th and a == 0)
        r = tp / P_
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    return ap


def test_roc_auc_and_ap_brute_force_and_monotone(spark):
    rnd = random.Random(7)
    y = [rnd.randint(0, 1) for _ in range(300)]
    s = [round(rnd.random() * (0.5 + 0.5 * a), 2) for a in y]
    df = spark.createDataFrame(list(zip(y, s)), "y int, s double")
    auc = M.roc_auc(df, "y", "s").first()[0]
    assert math.isclose(auc, _auc_brute(y, s), rel_tol=1e-12)
    auc2 = M.roc_auc(df.withColumn("s", F.exp(F.col("s") * 3)), "y", "s").first()[0]
    assert math.isclose(auc, auc2, rel_tol=1e-12)
    ap = M.avg_precision(df, "y", "s").first()[0]
    assert math.isclose(ap, _ap_brute(y, s), rel_tol=1e-9)
    one = spark.createDataFrame([(1, 0.3), (1, 0.4)], "y int, s double")
    assert M.roc_auc(one, "y", "s").first()[0] is None


def test_clinical_metrics_no_predicted_positive(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (0, 0)], "y int, p int")
    r = M.clinical_metrics(df, "y", "p").first()
    assert r.ppv == 0.0 and r.nns is None and r.sensitivity == 0.0 and r.specificity == 1.0


def test_class_report_matches_manual(spark):
    y = [0, 0, 1, 1, 1, 2]
    p = [0, 1, 1, 1, 0, 1]
    df = spark.createDataFrame(list(zip(y, p)), "y int, p int")
    rep = {r.class_name: r for r in M.class_report(df, "y", "p").collect()}
    assert math.isclose(rep["1"].precision, 2 / 4) and math.isclose(rep["1"].recall, 2 / 3)
    assert rep["2"].precision == 0.0 and rep["2"].f1 == 0.0 and rep["2"].support == 1
    assert math.isclose(rep["accuracy"].f1, 3 / 6)


def test_risk_strata_completes_empty_bands(spark):
    df = spark.createDataFrame([(0.0, 1), (0.05, 0), (0.1, 1), (0.95, 1), (1.0, 0)], "p double, y int")
    out = {r.band: r for r in risk_strata(df, "p", "y", [0, 0.1, 0.3, 0.5, 0.7, 1.0],
                                          ["VL", "L", "M", "H", "C"]).collect()}
    assert out[0].patients == 2 and out[0].cases == 1 and out[0].rate == 0.5
    assert out[2].patients == 0 and out[2].cases == 0 and out[2].rate is None
    assert out[4].patients == 2


def test_group_median_null_key_not_filled(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (3, None, None), (4, "b", None), (5, "a", 3.0)],
                               "id int, g string, v double")
    got = {r.id: r.v for r in I.fill_group_median(df, "v", ["g"]).collect()}
    assert got[2] == 2.0 and got[3] is None and got[4] is None
    got2 = {r.id: r.v for r in I.fill_group_median(df, "v", ["g"], global_fallback=True).collect()}
    assert got2[4] == 2.0 and got2[3] == 2.0


def test_mode_ties_lowest_and_sentinel_median(spark):
    df = spark.createDataFrame([("S",), ("C",), ("S",), ("C",), (None,)], "e string")
    assert I.fill_mode(df, ["e"]).where("e IS NULL").count() == 0
    assert I.global_stats(df, modes=["e"])["mode__e"] == "C"
    h = spark.createDataFrame([(0,), (200,), (240,), (0,), (300,)], "chol int")
    got = sorted(r.chol for r in I.fill_sentinel_median(h, "chol").collect())
    assert got == [200.0, 200.0, 200.0, 240.0, 300.0]


def test_label_encode_one_hot_freq(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b"), (5, "c")], "id int, s string")
    codes = {r.id: r.s for r in E.label_encode(df, ["s"]).collect()}
    assert codes == {2: 0, 1: 1, 4: 1, 5: 2, 3: 3}  # 'nan' sorts after 'c'
    oh = E.one_hot(df, ["s"])
    assert set(oh.columns) == {"id", "s_a", "s_b", "s_c"}
    sums = [r[0] for r in oh.select(F.col("s_a") + F.col("s_b") + F.col("s_c")).collect()]
    assert sorted(sums) == [0, 1, 1, 1, 1]
    fq = {r.id: r.s_count for r in E.freq_encode(df, "s").collect()}
    assert fq[1] == 2 and fq[3] is None


def test_scalers_population_std_and_exact_iqr(spark):
    x = [1.0, 2.0, 3.0, 4.0, 10.0]
    df = spark.createDataFrame([(v, 5.0) for v in x], "x double, c double")
    z = [r.x for r in SC.standard_scale(df, ["x", "c"]).collect()]
    assert np.allclose(z, (np.array(x) - np.mean(x)) / np.std(x))
    assert [r.c for r in SC.standard_scale(df, ["c"]).collect()] == [0.0] * 5
    rz = [r.x for r in SC.robust_scale(df, ["x"]).collect()]
    q1, med, q3 = np.percentile(x, [25, 50, 75])
    assert np.allclose(rz, (np.array(x) - med) / (q3 - q1))


def test_cut_width_and_quantile_match_pandas(spark):
    rnd = random.Random(3)
    x = [round(rnd.uniform(0, 100), 2) for _ in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double")
    out, edges = B.cut_width(df, "x", 5)
    ref = pd.cut(pd.Series(x), 5, labels=False)
    got = [r.x_bin for r in out.orderBy("i").collect()]
    assert got == list(ref)
    outq, _ = B.cut_quantile(df, "x", 5)
    refq = pd.qcut(pd.Series(x), 5, labels=False)
    assert [r.x_bin for r in outq.orderBy("i").collect()] == list(refq)


def test_describe_and_skew_match_pandas(spark):
    rnd = random.Random(5)
    x = [rnd.expovariate(1.0) for _ in range(101)]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    d = P.describe(df, ["x"]).first()
    ref = pd.Series(x).describe()
    assert np.allclose([d["count"], d["mean"], d["std"], d["min"], d["q25"], d["q50"], d["q75"], d["max"]],
                       ref.values)
    sk = P.skew_profile(df, ["x"]).first()["skew"]
    m = np.mean(x)
    pop = np.mean((np.array(x) - m) ** 3) / np.mean((np.array(x) - m) ** 2) ** 1.5
    assert math.isclose(sk, pop, rel_tol=1e-9)


def test_strat_kfold_balance_and_split_sizes(spark):
    rnd = random.Random(11)
    df = spark.createDataFrame([(i, int(rnd.random() < 0.3)) for i in range(1000)], "id long, y int")
    f = SA.strat_kfold(df, "id", "y", k=5).groupBy("y", "fold").count().collect()
    for cls in (0, 1):
        sizes = [r["count"] for r in f if r.y == cls]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    s = SA.strat_split(df, "id", "y", frac=0.2).groupBy("y", "_split").count().collect()
    n = {(r.y, r._split): r["count"] for r in s}
    for cls in (0, 1):
        total = n[(cls, "test")] + n[(cls, "train")]
        assert n[(cls, "test")] == math.floor(total * 0.2 + 0.5)


def test_knn_matches_brute_force_with_hot_duplicates(spark):
    rng = np.random.default_rng(0)
    pts = rng.normal(size=(300, 4))
    pts[:100] = pts[0]  # a third of the rows identical: one hot cell
    rows = [(i, pts[i].tolist()) for i in range(len(pts))]
    df = spark.createDataFrame(rows, "key long, vec array<double>")
    got = NB.knn(df, df, 3, exclude_self=True, block=64).collect()
    d2 = ((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1).round(6)
    np.fill_diagonal(d2, np.inf)
    expect = {}
    for i in range(len(pts)):
        order = sorted(range(len(pts)), key=lambda j: (d2[i, j], j))[:3]
        expect.update({(i, r + 1): j for r, j in enumerate(order)})
    assert {(r.q_key, r.rank): r.nb_key for r in got} == expect


def test_knn_impute_matches_brute_force(spark):
    rows = [(1, 1.0, 2.0, None), (2, 1.0, None, 3.0), (3, 2.0, 2.0, 2.0), (4, 5.0, 5.0, 5.0),
            (5, None, 1.0, 1.0), (6, 1.5, 2.5, 2.0), (7, 9.0, 9.0, 9.0), (8, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = {r.id: (r.a, r.b, r.c) for r in NB.knn_impute(df, "id", ["a", "b", "c"], k=2).collect()}
    X = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows])

    def dist(u, v):
        m = ~np.isnan(u) & ~np.isnan(v)
        return np.sqrt(((u[m] - v[m]) ** 2).sum() * 3 / m.sum()) if m.any() else np.nan

    for i, r in enumerate(rows):
        for c in range(3):
            if not np.isnan(X[i, c]):
                continue
            donors = [j for j in range(len(rows)) if not np.isnan(X[j, c])]
            ds = sorted((round(dist(X[i], X[j]), 6), rows[j][0], X[j, c]) for j in donors)
            assert math.isclose(got[r[0]][c], np.mean([v for _, _, v in ds[:2]]))


def test_smote_points_between_parents(spark):
    rng = np.random.default_rng(2)
    pts = rng.normal(size=(60, 3))
    rows = [(i, pts[i].tolist(), int(i < 12)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    out = RB.smote(df, "id", "v", "label", minority=1, ratio=1.0, k=5).collect()
    syn = [r for r in out if r["copy"] is not None]
    assert len(syn) == 48 - 12 and len(out) == 60 + len(syn)
    for r in syn:
        a, b = pts[r.src_id], pts[r.nb_id]
        assert np.allclose(np.array(r.v), a + r.u * (b - a))
        assert 0 <= r.u < 1


def test_shape_null_profile_value_counts(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, 2.0, None), (3, 3.0, "x")], "a int, b double, c string")
    assert P.shape(df).first().asDict() == {"n_rows": 3, "n_cols": 3}
    prof = {r.column_name: (r.missing, r.missing_pct) for r in P.null_profile(df).collect()}
    assert prof == {"b": (1, 33.33), "c": (1, 33.33)}
    assert {r.c: r.n for r in P.value_counts(df, "c").collect()} == {"x": 2}


def test_exact_quantiles_match_percentile_with_ties(spark):
    from riskloom.operators.quantiles import exact_quantiles
    rnd = random.Random(9)
    vals = [rnd.expovariate(1.0) for _ in range(3000)] + [5.0] * 1000 + [None] * 5
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    probs = [0, 0.1, 0.25, 0.5, 0.6000000000000001, 0.75, 0.999, 1.0]
    ref = df.agg(F.percentile("x", probs)).first()[0]
    for margin in (4e-4, 1e-9):  # a bracket that misses its rank is widened
        assert exact_quantiles(df, "x", probs, margin=margin) == list(ref)
    assert exact_quantiles(df.where("x IS NULL"), "x", [0.5]) == [None]


def test_group_quantile_hot_group_matches_median(spark):
    from riskloom.operators.quantiles import group_quantile
    rnd = random.Random(1)
    rows = []
    for i in range(6000):
        g = "hot" if i % 3 == 0 else f"g{rnd.randint(0, 20)}"
        v = None if i % 17 == 0 else (5.0 if i % 7 == 0 else rnd.expovariate(1.0))
        rows.append((g, None if i % 101 == 0 else i % 2, v))
    df = spark.createDataFrame(rows, "g string, h int, v double")
    ref = {(r.g, r.h): r.m for r in df.where("g IS NOT NULL AND h IS NOT NULL")
           .groupBy("g", "h").agg(F.median("v").alias("m")).collect()}
    got = {(r.g, r.h): r.q for r in group_quantile(df, "v", ["g", "h"], 0.5, "q").collect()}
    assert got == ref


def test_knn_prunes_cells_on_clustered_data(spark):
    rng = np.random.default_rng(0)
    centers = rng.normal(0, 10, size=(12, 6))
    pts = np.vstack([c + rng.normal(0, 0.3, size=(150, 6)) for c in centers])
    df = spark.createDataFrame([(i, pts[i].tolist()) for i in range(len(pts))], "key long, vec array<double>")
    res = NB.knn(df, df, 4, exclude_self=True, block=128)
    got = {(r.q_key, r.rank): r.nb_key for r in res.collect()}
    st = dict(NB.LAST_STATS)
    assert st["candidate_pairs"] < 0.35 * len(pts) * st["pivots"]
    d2 = ((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1).round(6)
    np.fill_diagonal(d2, np.inf)
    for i in range(0, len(pts), 37):
        order = sorted(range(len(pts)), key=lambda j: (d2[i, j], j))[:4]
        assert [got[(i, r + 1)] for r in range(4)] == order
