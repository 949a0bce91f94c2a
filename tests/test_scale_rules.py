"""Ordering on any key, joins without key shuffles, kNN rounding and volume,
and the defined results of odd inputs."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.operators import encode as E
from riskloom.operators import impute as I
from riskloom.operators import metrics as M
from riskloom.operators import neighbors as NB
from riskloom.operators import ordering as O
from riskloom.operators import profile as P
from riskloom.operators import sampling as SA
from riskloom.operators.lookup import attach
from riskloom.operators.quantiles import group_quantile, group_quantiles


@pytest.mark.parametrize("kind", ["string", "long", "double"])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_ordered_index_on_any_key_with_nulls(spark, kind, by):
    rnd = random.Random(2)
    value = {"string": lambda i: f"Customer#{i:09d}", "long": lambda i: 2**53 + i, "double": lambda i: i / 7}[kind]
    ids = list(range(300))
    rnd.shuffle(ids)
    rows = [(value(i) if i % 50 else None, i, None if i % 3 == 0 else "x") for i in ids]
    df = spark.createDataFrame(rows, f"v {kind}, k long, g string")
    for n in (1, 5, 64):
        got = O.ordered_index(df, ["v", "k"], partition_cols=by, name="rn", n_buckets=n)
        ref = df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy("v", "k")))
        assert sorted(map(tuple, got.select("k", "rn").collect())) == sorted(map(tuple, ref.select("k", "rn").collect()))


def test_levels_with_a_shared_prefix_fall_in_many_buckets(spark):
    df = spark.range(10000).select(F.format_string("a long shared prefix %06d", "id").alias("s"))
    buckets = O.range_buckets(df, [F.col("s").asc()], 16).groupBy("_rl_bucket").count().collect()
    assert len(buckets) >= 12 and max(r["count"] for r in buckets) < 2500
    codes = E.label_codes(df, "s").where("_code <> cast(substring(_level, 22, 6) AS int)")
    assert codes.count() == 0


def test_key_joins_do_not_shuffle_on_the_key(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("g"),
                                  (F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 2).cast("int").alias("y"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        for out, key in ((E.freq_encode(df, "g"), "g"), (I.fill_group_median(df, "v", ["g"]), "g"), (SA.strat_split(df, "id", "y"), "y")):
            lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
            for k, line in enumerate(lines):
                if re.search(rf"Exchange hashpartitioning\({key}#\d+, \d+\)", line):
                    assert "Aggregate" in lines[k + 1]  # sums, not rows
        stats = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        salted = attach(df, stats, ["g"], limit=0, copies=8)
        assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, attach(df, stats, ["g"]).collect()))
        assert "_salt" in salted._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_wide_range_group_has_its_median(spark):
    rows = [("w", 10.0 ** e) for e in range(-300, 301)] + [("n", None), (None, 1.0), ("t", 2.0), ("t", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    assert {r.g: r.q for r in group_quantile(df, "v", ["g"], 0.5, "q").collect()} == {"w": 1.0, "t": 2.5}
    many = group_quantiles(df.withColumn("u", -F.col("v")), ["v", "u"], ["g"], [0.0, 0.25, 1.0]).collect()
    assert {(r.g, r.column): r.q for r in many if r.g == "t"} == {("t", "v"): [2.0, 2.25, 3.0], ("t", "u"): [-3.0, -2.75, -2.0]}


def knn_case(spark, query, data, k):
    q = spark.createDataFrame([(10**6 + i, v) for i, v in enumerate(query)], "key long, vec array<double>")
    d = spark.createDataFrame(list(data.items()), "key long, vec array<double>")
    return [(r.q_key - 10**6, r.rank, r.nb_key) for r in NB.knn(q, d, k).orderBy("q_key", "rank").collect()]


def test_knn_ties_after_rounding(spark):
    data = {9: [math.sqrt(1.0000001)], 1: [math.sqrt(1.0000004)], 5: [7.0]}
    assert knn_case(spark, [[0.0]], data, 1) == [(0, 1, 1)]


def test_knn_far_from_the_origin(spark):
    rng = np.random.default_rng(1)
    pts = 1e5 + rng.normal(size=(120, 8)) * 0.01
    data = {i: p.tolist() for i, p in enumerate(pts)}
    queries = 1e5 + rng.normal(size=(20, 8)) * 0.01
    got = knn_case(spark, queries.tolist(), data, 2)
    for i, q in enumerate(queries):
        d = (((pts - q) ** 2).sum(1)).round(6)
        assert [g[2] for g in got if g[0] == i] == sorted(range(120), key=lambda j: (d[j], j))[:2]


def test_knn_impute_far_from_the_origin_and_ties(spark):
    rows = [(1, 1e6, 1e6, None), (2, 1e6 + 0.001, 1e6, 10.0), (3, 1e6 + 0.0003, 1e6, 20.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    assert NB.knn_impute(df, "id", ["a", "b", "c"], k=1).where("id = 1").first()["c"] == 20.0
    rows = [(i, 1.0, float(i)) for i in range(500)] + [(1000 + i, 1.0, None) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, a double, c double")
    out = NB.knn_impute(df, "id", ["a", "c"], k=3, block=64).where("id >= 1000").collect()
    assert len(out) == 20 and all(r["c"] == 1.0 for r in out)
    rows = [(1, 1.0, None), (2, 4.0, 8.0), (3, None, 5.0)]
    df = spark.createDataFrame(rows, "id long, a double, c double")
    assert NB.knn_impute(df, "id", ["a", "c"], k=5).where("id = 1").first()["c"] == 8.0


def test_white_space_tokens(spark):
    texts = ["", None, "\tA B", "A\n", " a  b c ", "\u00a0x\u2003y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.select("i", C.token_count("t").alias("n"), C.last_token("t").alias("w")).orderBy("i").collect()
    assert [(r.n, r.w) for r in out] == [(len((t or "").split()), (t or "").split()[-1] if (t or "").split() else None) for t in texts]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id long, y int, p int, s double")
    assert P.prevalence(df, "y").first()["positive_pct"] is None
    assert {r.missing_pct for r in P.null_profile(df, only_missing=False).collect()} == {None}
    assert M.roc_auc(df, "y", "s").first()[0] is None and M.avg_precision(df, "y", "s").first()[0] is None
    assert {r.class_name for r in M.class_report(df, "y", "p").collect()} == {"accuracy", "macro avg", "weighted avg"}
    assert SA.balanced_undersample(df, "id", "y").count() == 0 and SA.strat_split(df, "id", "y").count() == 0


def test_class_report_reads_its_input_once(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 3).alias("y"), (F.col("id") % 4).alias("p"))
    df.write.parquet(str(tmp_path / "t"))
    read = M.class_report(spark.read.parquet(str(tmp_path / "t")), "y", "p").inputFiles()
    assert not any(str(tmp_path) in f for f in read)  # the classes were written once, and both parts read those


def test_balanced_bags_are_the_smallest_hashes(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("y"))
    got = SA.balanced_undersample(df, "id", "y", n_bags=3)
    h = F.md5(F.concat(F.col("id").cast("string"), F.lit(":"), (F.lit(42) + F.col("bag")).cast("string")))
    w = Window.partitionBy("bag", "y").orderBy(h, "id")
    want = df.crossJoin(spark.range(3).select(F.col("id").cast("int").alias("bag"))).withColumn("r", F.row_number().over(w)).where("r <= 400")
    key = lambda d: sorted(map(tuple, d.select("bag", "y", "id").collect()))
    assert key(got) == key(want)
