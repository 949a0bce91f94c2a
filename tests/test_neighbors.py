"""The pivot tree and the pattern index against brute force."""

import numpy as np
import pytest

from riskloom.operators import neighbors as NB


def brute(q, d, k, same=False):
    out = {}
    for i, x in q.items():
        best = sorted((round(float(((np.array(x) - np.array(y)) ** 2).sum()), 6), j) for j, y in d.items() if not (same and i == j))[:k]
        out.update({(i, r + 1): (j, s) for r, (s, j) in enumerate(best)})
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in rows.items()], "key long, vec array<double>")


def check(spark, q, d, k, block, same=False):
    dd = frame(spark, d)
    got = NB.knn(dd if same else frame(spark, q), dd, k, exclude_self=same, block=block).collect()
    assert {(r.q_key, r.rank): (r.nb_key, round(r.sq_dist, 6)) for r in got} == brute(q, d, k, same)


@pytest.mark.parametrize("block,k", [(16, 3), (40, 7), (500, 2)])
def test_knn_tree_two_tables(spark, block, k):
    rng = np.random.default_rng(block)
    d = {int(i): rng.normal(size=3).round(2) for i in rng.permutation(400)}
    d.update({1000 + i: d[0] for i in range(60)})  # equal rows beyond a block
    q = {int(i): rng.normal(size=3).round(2) * 3 for i in range(350, 520)}
    q[9999] = d[0]
    check(spark, q, d, k, block)


def test_knn_tree_of_the_table_itself(spark):
    rng = np.random.default_rng(3)
    pts = {i: (rng.normal(size=4) + 8 * (i % 5)).round(2) for i in range(300)}
    pts.update({400 + i: np.array([99.0, 0, 0, i]) for i in range(3)})  # a cell with fewer rows than k
    check(spark, pts, pts, 6, 24, same=True)


def test_knn_more_neighbours_than_rows(spark):
    d = {i: [float(i)] for i in range(5)}
    check(spark, {7: [2.2]}, d, 9, 2)
    check(spark, d, d, 9, 2, same=True)


def test_knn_empty_sides(spark):
    d = frame(spark, {1: [0.0], 2: [1.0]})
    assert NB.knn(d, d.limit(0), 2).collect() == [] and NB.knn(d.limit(0), d, 2).collect() == []


def brute_impute(x, k):
    out = x.copy()
    n, m = x.shape
    has = ~np.isnan(x)
    for i, c in zip(*np.nonzero(~has)):
        best = []
        for j in range(n):
            both = has[i] & has[j]
            if has[j, c] and both.any():
                best.append((round(float(np.sqrt(((x[i, both] - x[j, both]) ** 2).sum() * m / both.sum())), 6), j))
        best = [j for _, j in sorted(best)[:k]]
        out[i, c] = x[best, c].mean() if best else np.nanmean(x[:, c])
    return out


@pytest.mark.parametrize("seed,block,rounds", [(1, 8, (2, 4)), (2, 16, (1,)), (3, 64, (2,)), (4, 8, ())])
def test_impute_index_brute_force(spark, seed, block, rounds):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(size=(120, 4)) * [1, 5, 0.01, 2] + 10 * rng.integers(0, 3, (120, 1)), np.ones((40, 4))]).round(3)
    x[rng.random(x.shape) < 0.25] = np.nan
    x[5] = np.nan  # nothing is known of this row
    x[6:9] = [[np.nan, np.nan, np.nan, 1.0]] * 3
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id long, a double, b double, c double, d double")
    got = {r.id: r for r in NB.knn_impute(df, "id", cols, k=3, block=block, rounds=rounds).collect()}
    want = brute_impute(x, 3)
    for i in range(len(x)):
        assert np.allclose([got[i][c] for c in cols], want[i]), i


def test_impute_column_without_values(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, 3.0, None)], "id long, a double, b double")
    got = {r.id: (r.a, r.b) for r in NB.knn_impute(df, "id", ["a", "b"]).collect()}
    assert got == {1: (1.0, None), 2: (2.0, None), 3: (3.0, None)}
    assert NB.knn_impute(df.where("id = 2"), "id", ["a", "b"]).collect()[0]["a"] is None


def test_impute_reads_few_donors_on_clustered_data(spark):
    rng = np.random.default_rng(0)
    x = np.repeat(rng.normal(0, 50, (40, 3)), 50, axis=0) + rng.normal(0, 0.2, (2000, 3))
    gone = rng.random(2000) < 0.2
    df = spark.createDataFrame([(i, float(r[0]), float(r[1]), None if gone[i] else float(r[2])) for i, r in enumerate(x)], "id long, a double, b double, c double")
    out = NB.knn_impute(df, "id", ["a", "b", "c"], k=3, block=16)
    assert out.where("c IS NULL").count() == 0
    assert NB.LAST_STATS["compared_per_receiver"] < 0.1 * NB.LAST_STATS["donors"]


@pytest.mark.parametrize("seed,cell", [(5, 12), (6, 40)])
def test_impute_visits_across_cells(spark, seed, cell):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.integers(0, 9, (150, 4)) * [1.0, 2.0, 0.5, 1.0], np.full((30, 4), 3.0)])
    x[rng.random(x.shape) < 0.2] = np.nan
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id long, a double, b double, c double, d double")
    got = {r.id: r for r in NB.knn_impute(df, "id", cols, k=3, block=8, cell=cell).collect()}
    want = brute_impute(x, 3)
    for i in range(len(x)):
        assert np.allclose([got[i][c] for c in cols], want[i]), i


def test_impute_compares_no_more_rows_on_larger_tables(spark):
    compared = []
    for n in (1500, 12000):
        rng = np.random.default_rng(1)
        x = np.column_stack([rng.integers(0, 8, (n, 2)), rng.uniform(0, 1, (n, 2))]).astype(float)
        x[rng.random(n) < 0.1, 2:] = np.nan  # what is left of these rows equals that of many donors
        df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)],
                                   "id long, a double, b double, c double, d double")
        assert NB.knn_impute(df, "id", ["a", "b", "c", "d"], k=3, block=32).count() == n
        compared.append(NB.LAST_STATS["compared_per_receiver"])
    assert compared[1] < 1.5 * compared[0]


def test_knn_sends_a_chunk_once_to_a_tile(spark, monkeypatch):
    sent = []
    plain = NB._tiles
    monkeypatch.setattr(NB, "_tiles", lambda pairs, *a: sent.append((pairs.count(), pairs.select("cell", "chunk", "d_group").distinct().count())) or plain(pairs, *a))
    monkeypatch.setattr(NB, "TILE_BYTES", 1 << 14)
    rng = np.random.default_rng(8)
    pts = {i: rng.normal(size=16).round(2) for i in range(600)}
    check(spark, pts, pts, 4, 16, same=True)
    pairs, copies = sent[0]
    assert pairs > 1000 and copies < pairs / 3
