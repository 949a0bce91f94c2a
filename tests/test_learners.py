"""Boosting, forests, networks, kernel machines and linear models against
brute force, closed forms and optimality conditions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import boosting as B
from riskloom.operators import forests as FO
from riskloom.operators import linear as LI
from riskloom.operators import networks as N
from riskloom.operators import trees as T


def table(spark, x, y, parts=3):
    cols = [f"x{i}" for i in range(x.shape[1])]
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols) + ", y double").repartition(parts)
    return df, cols


def data(seed, n=400, f=3, values=9, missing=0.0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, values, (n, f)).astype(float)
    y = (x[:, 0] + x[:, 1] * 0.5 + rng.normal(0, 2, n) > values * 0.75).astype(float)
    x[rng.random(x.shape) < missing] = np.nan
    return x, y


# -- boosting --------------------------------------------------------------------

def left_of(x, cut):
    return np.isnan(x) | (x <= cut)


def brute_tree(x, g, h, depth, l1, l2, gamma, min_child, rows=None):
    """Value of each row by the best first-order splits."""
    rows = np.arange(len(x)) if rows is None else rows
    soft = lambda v: math.copysign(max(abs(v) - l1, 0), v)
    worth = lambda r: soft(g[r].sum()) ** 2 / (h[r].sum() + l2)
    best = (1e-12, None, None)
    for f in range(x.shape[1]) if depth else []:
        for cut in [-math.inf, *sorted(set(x[~np.isnan(x[:, f]), f]))]:
            a = rows[left_of(x[rows, f], cut)]
            b = np.setdiff1d(rows, a)
            if len(a) and len(b) and min(h[a].sum(), h[b].sum()) >= min_child:
                gain = 0.5 * (worth(a) + worth(b) - worth(rows)) - gamma
                if gain > best[0] + 1e-9 * abs(best[0]):
                    best = (gain, a, b)
    out = np.zeros(len(x))
    if best[1] is None:
        out[rows] = -soft(g[rows].sum()) / (h[rows].sum() + l2)
        return out
    for part in best[1:]:
        out[part] = brute_tree(x, g, h, depth - 1, l1, l2, gamma, min_child, part)[part]
    return out


@pytest.mark.parametrize("kw", [{}, {"l1": 1.5, "l2": 0.5}, {"gamma": 1.0, "min_child": 4.0}])
def test_boosting_equals_brute_force(spark, kw):
    x, y = data(1, missing=0.1)
    df, cols = table(spark, x, y)
    m = B.boost(df, cols, "y", rounds=4, rate=0.5, depth=2, start=0.0, **kw)
    s = np.zeros(len(y))
    p = {"l1": 0.0, "l2": 1.0, "gamma": 0.0, "min_child": 1.0, **kw}
    for _ in range(4):
        q = 1 / (1 + np.exp(-s))
        s += 0.5 * brute_tree(x, q - y, q * (1 - q), 2, p["l1"], p["l2"], p["gamma"], p["min_child"])
    got = {r.id: r.prob for r in m.predict(df, "prob").collect()}
    assert np.allclose([got[i] for i in range(len(y))], 1 / (1 + np.exp(-s)), atol=1e-9)


def test_boosting_squared_loss_and_leaf_wise(spark):
    x, y = data(2)
    t = y * 3 + x[:, 2]
    df, cols = table(spark, x, t)
    m = B.boost(df, cols, "y", loss="squared", rounds=1, rate=1.0, depth=9, l2=0.0, min_child=0.0)
    cells = {}
    for r, v in zip(x, t):
        cells.setdefault(tuple(r), []).append(v)
    full = {k: np.mean(v) for k, v in cells.items()}
    got = {r.id: r.prediction for r in m.predict(df).collect()}
    assert np.mean([(got[i] - full[tuple(x[i])]) ** 2 for i in range(len(t))]) < 0.5 * np.var(t)
    w = B.boost(df, cols, "y", loss="squared", rounds=1, rate=1.0, leaves=4, l2=0.0, min_child=0.0)
    assert len(w.history) == 3
    # Best leaf first: each split is the best that was open at its time.
    assert w.history[0][4] >= max(h[4] for h in w.history[1:])
    gains = [h[4] for h in B.boost(df, cols, "y", loss="squared", rounds=1, rate=1.0, depth=3, l2=0.0, min_child=0.0).history]
    assert sorted(h[4] for h in w.history) == pytest.approx(sorted(gains, reverse=True)[:3][::-1])


def test_huber_round_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    x, _ = data(4, n=301)
    y = x[:, 0] + rng.standard_cauchy(301).round(3)
    df, cols = table(spark, x, y)
    lower = lambda v, q: np.sort(v)[max(0, math.ceil(q * len(v)) - 1)]
    m = B.boost(df, cols, "y", loss="huber", rounds=1, rate=0.7, depth=2, l2=0.0, min_child=0.0)
    start = lower(y, 0.5)
    assert m.start == start
    delta = lower(np.abs(y - start), 0.9)
    g = np.clip(start - y, -delta, delta)
    leaf = brute_tree(x, g, np.ones(301), 2, 0, 0, 0, 0)
    want = np.zeros(301)
    for v in np.unique(leaf):
        r = (y - start)[leaf == v]
        med = lower(r, 0.5)
        want[leaf == v] = start + 0.7 * (med + np.clip(r - med, -delta, delta).mean())
    got = {r.id: r.prediction for r in m.predict(df).collect()}
    assert np.allclose([got[i] for i in range(301)], want)


def test_stumps_equal_brute_force(spark):
    x, y = data(5, missing=0.05)
    df, cols = table(spark, x, y)
    m = B.fit_stumps(df, cols, "y", rounds=10, rate=0.5, refresh=3)
    w, total = np.ones(len(y)), np.zeros(len(y))
    for _ in range(10):
        best = (math.inf,)
        for f in range(x.shape[1]):
            for cut in [-math.inf, *sorted(set(x[~np.isnan(x[:, f]), f]))]:
                side = left_of(x[:, f], cut)
                loss = sum(2 * w[s & (y == 1)].sum() * w[s & (y == 0)].sum() / max(w[s].sum(), 1e-300) for s in (side, ~side))
                if loss < best[0] - 1e-9 * w.sum():
                    best = (loss, side)
        side = best[1]
        says = [int(w[s & (y == 1)].sum() > w[s & (y == 0)].sum()) for s in (side, ~side)]
        pred = np.where(side, *says)
        err = w[pred != y].sum() / w.sum()
        say = 0.5 * math.log((1 - err) / err)
        total += say * (2 * pred - 1)
        w = w * np.exp(say * (pred != y))
    got = {r.id: r.ada_score for r in m.predict(df).collect()}
    assert len(m.stumps) == 10 and np.allclose([got[i] for i in range(len(y))], total)


def test_learners_of_empty_and_pure_tables(spark):
    df, cols = table(spark, *data(1, n=20))
    for part in (df.limit(0), df.where("y = 1")):
        for m in (B.boost(part, cols, "y", rounds=2), B.fit_stumps(part, cols, "y", rounds=2),
                  FO.extra_trees(part, cols, "y", trees=2, depth=2), FO.random_forest(part, cols, "y", "id", trees=2, depth=2),
                  FO.balanced_forest(part, cols, "y", "id", trees=2, depth=2)):
            assert m.predict(df).count() == 20


# -- forests ----------------------------------------------------------------------

def test_extra_trees_split_at_their_cuts(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = (x[:, 0] > 0.2).astype(float)
    x[::9, 1] = np.nan
    df, cols = table(spark, x, y)
    forest = FO.extra_trees(df, cols, "y", trees=3, depth=3, candidates=3, seed=7)
    for t, arrays in enumerate(forest.trees):
        feature, _, threshold, left, right, value, _ = arrays
        inside = {0: np.arange(500)}
        for node in range(len(feature)):
            rows = inside[node]
            assert value[node] == pytest.approx(y[rows].mean())
            if feature[node] < 0:
                continue
            best = (-1.0, None)
            for f in range(3):
                v = x[rows, f][~np.isnan(x[rows, f])]
                cut = v.min() + FO.cut_share(7, t, node, f) * (v.max() - v.min())
                side = left_of(x[rows, f], cut)
                gain = sum(y[rows][s].sum() ** 2 / max(1, s.sum()) for s in (side, ~side)) if 0 < side.sum() < len(rows) else -1.0
                if gain > best[0] + 1e-9:
                    best = (gain, f, cut)
            assert (feature[node], threshold[node]) == (best[1], pytest.approx(best[2]))
            side = left_of(x[rows, feature[node]], threshold[node])
            inside[left[node]], inside[right[node]] = rows[side], rows[~side]


def test_bags_are_exact(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(5000) < 0.13).astype(float)
    df, cols = table(spark, rng.normal(size=(5000, 1)), y)
    packed = T.pack(df, cols, "y", T.edges_of(df, cols, 15), "id")
    sizes = {0.0: int((y == 0).sum()), 1.0: int((y == 1).sum())}
    limits = FO.bag_thresholds(packed, sizes, 20, 5, 1)
    u = np.array([r.h for r in df.select(F.xxhash64("id").alias("h"), "y").where("y = 0").collect()], np.int64).view(np.uint64)
    bags = [set(u[T.draw(u, 5 + b) <= limits[0.0][b]]) for b in range(20)]
    assert {len(b) for b in bags} == {sizes[1.0]} and len(set().union(*bags)) > 3 * sizes[1.0]


def test_balanced_and_random_forest_learn(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 4))
    y = (x[:, 0] + x[:, 1] > 1.8).astype(float)
    df, cols = table(spark, x, y)
    for m, cut in ((FO.balanced_forest(df, cols, "y", "id", trees=20, depth=6), 0.5), (FO.random_forest(df, cols, "y", "id", trees=20, depth=6), 0.3)):
        got = {r.id: r.prob for r in m.predict(df).collect()}
        pred = np.array([got[i] > cut for i in range(3000)])
        assert (pred[y == 1]).mean() > 0.9 and (~pred[y == 0]).mean() > 0.9
        assert sorted(m.importances(), key=lambda r: -r[1])[1][0] in ("x0", "x1")


def test_sums_fold_in_groups(spark, monkeypatch):
    monkeypatch.setattr(T, "FAN", 2)
    x, y = data(6)
    df, cols = table(spark, x, y, parts=7)
    packed = T.pack(df, cols, "y", T.edges_of(df, cols, 15), chunk=16, tasks=7)
    assert packed.parts > 2
    total = packed.summed(lambda b: np.array([sum(len(c.y) for c in T.chunks_of(b, 3)), 1.0]))
    assert total[0] == len(y)
    forest = FO.random_forest(df, cols, "y", "id", trees=2, depth=2)
    assert forest.predict(df).count() == len(y)


# -- networks and kernel machines --------------------------------------------------

def test_network_gradient_equals_finite_differences():
    rng = np.random.default_rng(0)
    shapes = N._shapes(4, (5, 3))
    flat = rng.normal(size=sum(a * b + b for a, b in shapes))
    x, y, w = rng.normal(size=(30, 4)), rng.integers(0, 2, 30).astype(float), rng.random(30)
    _, g = N.loss_and_gradient(flat, shapes, x, y, w)
    for i in range(len(flat)):
        e = np.zeros_like(flat)
        e[i] = 1e-6
        a, b = (N.loss_and_gradient(flat + s * e, shapes, x, y, w)[0] for s in (1, -1))
        assert g[i] == pytest.approx((a - b) / 2e-6, abs=1e-5)


def test_network_stops_early_and_learns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] * x[:, 1] > 0)).astype(float)
    df, cols = table(spark, x, y)
    m = N.fit_network(df, cols, "y", "id", hidden=(16, 8), epochs=60, batches=1, rate=0.03, patience=5)
    got = {r.id: r.prob for r in m.predict(df).collect()}
    assert np.mean([(got[i] > 0.5) == (y[i] == 1) for i in range(2000)]) > 0.9
    assert len(m.held_out) < 60 or m.held_out[-1] <= m.held_out[0]


@pytest.mark.parametrize("number", [False, True])
def test_kernel_machine_is_optimal(spark, number):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 2))
    inside = (x ** 2).sum(1) < 1.2
    y = np.sin(2 * x[:, 0]) if number else inside.astype(float)
    df, cols = table(spark, x, y)
    kw = {"components": 40, "gamma": 0.7, "c": 2.0, "seed": 3}
    m = N.fit_svr(df, cols, "y", "id", epsilon=0.05, **kw) if number else N.fit_svm(df, cols, "y", "id", folds=3, **kw)
    z = m.map(x.T)
    s = z @ m.weights
    r = np.sign(s - y) * np.maximum(np.abs(s - y) - 0.05, 0) if number else np.where((2 * y - 1) * s < 1, s - (2 * y - 1), 0)
    g = np.append(m.weights[:-1], 0) + 4 * r @ z
    assert np.abs(g).max() < 1e-4
    got = {q.id: q.prediction for q in m.predict(df).collect()}
    p = np.array([got[i] for i in range(900)])
    if number:
        assert np.allclose(p, s) and np.sqrt(np.mean((p - y) ** 2)) < 0.15
    else:
        assert ((p > 0.5) == inside).mean() > 0.95 and abs(p.mean() - y.mean()) < 0.03 and m.sigmoid[0] < 0


# -- linear ------------------------------------------------------------------------

def test_linear_models_from_moments(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4)) * [1, 10, 0.1, 1] + [1e4, 0, 5, 0]
    x[:, 3] = 7.0
    y = x[:, 0] * 2 - x[:, 1] + rng.normal(size=300)
    df, cols = table(spark, x, y)
    df = df.withColumn("fold", (F.col("id") % 3).cast("int"))
    got = LI.cross_validate_linear(df, cols, "y", "fold", [(5.0, 0.0), (0.0, 0.3), (3.0, 0.1)])
    for ridge, lasso, f, err in got:
        tr, te = np.arange(300) % 3 != f, np.arange(300) % 3 == f
        mean, std = x[tr].mean(0), x[tr].std(0)
        std[3] = 1.0
        z, t = (x[tr] - mean) / std, y[tr] - y[tr].mean()
        z[:, 3] = 0
        if lasso:
            b = np.zeros(4)
            for _ in range(3000):
                for j in range(3):
                    rho = z[:, j] @ (t - z @ b) + z[:, j] @ z[:, j] * b[j]
                    b[j] = np.sign(rho) * max(abs(rho) - tr.sum() * lasso, 0) / (z[:, j] @ z[:, j] + ridge)
        else:
            b = np.linalg.solve(z.T @ z + ridge * np.eye(4), z.T @ t)
        p = ((x[te] - mean) / std) @ (b * [1, 1, 1, 0]) + y[tr].mean()
        assert err == pytest.approx(np.sqrt(np.mean((p - y[te]) ** 2)), rel=1e-6)
    model = LI.solve(LI.fold_moments(df, cols, "y")[0], cols, 0.0)
    assert model.coef[0] == pytest.approx(2, abs=0.3) and model.coef[3] == 0
    assert model.predict(df).agg(F.avg("prediction")).first()[0] == pytest.approx(y.mean())
    assert LI.cross_validate_linear(df.limit(0), cols, "y", "fold", [(1.0, 0.0)]) == []


def test_small_trees_find_the_leaves_of_the_plain_walk(monkeypatch):
    rng = np.random.default_rng(4)
    tree, todo = T.Tree(), [0]
    for _ in range(15):
        node = todo.pop(int(rng.integers(len(todo))))
        at = int(rng.integers(1, 60))
        todo += tree.split(node, int(rng.integers(3)), at, at / 7)
    bins, raw = rng.integers(0, 64, (3, 500)).astype(np.uint8), rng.uniform(0, 9, (3, 500))
    raw[:, :20] = np.nan
    fast = [T.leaves_of(tree.arrays(), bins), T.leaves_of(tree.arrays(), raw, raw=True)]
    monkeypatch.setattr(T, "SMALL_TREE", -1)
    slow = [T.leaves_of(tree.arrays(), bins), T.leaves_of(tree.arrays(), raw, raw=True)]
    assert all((a == b).all() for a, b in zip(fast, slow)) and fast[0].dtype == np.uint8


def test_one_vector_of_a_pass_comes_to_the_driver(spark, monkeypatch):
    rows = []
    df = spark.range(4000).repartition(4).selectExpr("id", "cast(id % 2 as int) y", "cast(id as double) x")
    packed = T.pack(df, ["x"], "y", None, "id", chunk=100, tasks=4)
    assert packed.parts > 1
    cls = type(packed.df)
    plain = cls.toArrow

    def counted(self):
        out = plain(self)
        rows.append(out.num_rows)
        return out

    monkeypatch.setattr(cls, "toArrow", counted)

    def sums(batches):
        total = np.zeros(150_000)
        for c in T.chunks_of(batches, 1, binned=False):
            total[::1000] += c.x.sum()
        return total

    got = packed.summed(sums)
    assert got.shape == (150_000,) and (got[::1000] == 4000 * 3999 / 2).all() and got.sum() == 150 * 4000 * 3999 / 2
    assert rows == [3]  # pieces of one vector, not one vector for each task


def test_leaves_of_places_and_both_ways_agree():
    """Small trees go by columns, large ones level by level; ``place`` picks rows."""
    from riskloom.operators import trees as T

    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, (4, 500)).astype(np.uint8)
    t, nodes = T.Tree(), [0]
    for _ in range(5):
        nodes = [c for k in nodes for c in t.split(k, int(rng.integers(4)), int(rng.integers(2, 18)), 0.0)]
    place, a = np.flatnonzero(rng.random(500) < 0.4), t.arrays()
    small, T.SMALL_TREE = T.SMALL_TREE, 1 << 7
    try:
        by_columns = T.leaves_of(a, x)
        assert (T.leaves_of(a, x, place=place) == by_columns[place]).all()
        T.SMALL_TREE = 0
        assert (T.leaves_of(a, x) == by_columns).all() and (T.leaves_of(a, x, place=place) == by_columns[place]).all()
    finally:
        T.SMALL_TREE = small
    raw = np.where(rng.random((4, 500)) < 0.1, np.nan, rng.random((4, 500)))
    t = T.Tree()
    t.split(0, 2, 0, 0.5)
    assert (T.leaves_of(t.arrays(), raw, raw=True, place=place) == np.where(raw[2] > 0.5, 2, 1)[place]).all()


def test_ridge_without_intercept_from_one_pass(spark):
    """the closed form from summed products; a missing value is an error."""
    x, y = data(5, 300)
    df, cols = table(spark, x, y)
    m = LI.fit_ridge(df, cols, "y", 0.6)
    assert np.allclose(m.coef, np.linalg.solve(x.T @ x + 0.6 * np.eye(3), x.T @ y), atol=1e-10)
    got = {r["id"]: r["p"] for r in m.transform(df, "p").collect()}
    assert np.allclose([got[i] for i in range(len(x))], x @ m.coef)
    with pytest.raises(ValueError):
        LI.fit_ridge(df.withColumn("x0", F.expr("if(id = 7, null, x0)")), cols, "y", 0.6)


def test_fourier_cosines_and_a_start_from_few_rows(spark, monkeypatch):
    """the cosines are exact to rounding; a start from a share of the rows ends at the same minimum."""
    t = np.random.default_rng(0).normal(0, 50, (40, 7))
    assert np.abs(N._cos_of_turns(t) - np.cos(2 * math.pi * (t - np.rint(t)))).max() < 5e-15
    x, y = data(6, 600)
    df, cols = table(spark, (x - x.mean(0)) / x.std(0), y)
    whole = N.fit_svm(df, cols, "y", "id", components=20)
    monkeypatch.setattr(N, "START_ROWS", 50)
    started = N.fit_svm(df, cols, "y", "id", components=20)
    assert np.allclose(whole.weights, started.weights, atol=1e-5) and np.allclose(whole.sigmoid, started.sigmoid, atol=1e-4)


def test_best_leaf_first_takes_few_passes(spark, monkeypatch):
    """the passes over the rows follow the height of a tree, not its leaves; of two new leaves one is summed."""
    x, y = data(7, 800, values=40)
    df, cols = table(spark, x, y)
    asked, plain = [], B._histograms
    monkeypatch.setattr(B, "_histograms", lambda rows, tree, leaves, *a: asked.append(len(leaves)) or plain(rows, tree, leaves, *a))
    m = B.boost(df, cols, "y", rounds=1, leaves=16, min_child=0.0)
    assert len(m.history) == 15 and len(asked) < 12
    del asked[:]
    B.boost(df, cols, "y", rounds=1, depth=3, min_child=0.0)
    assert asked == [1, 1, 2]


# -- bin bounds and the first level of a forest --------------------------------------

@pytest.mark.parametrize("parts", [3, 70])
def test_bin_bounds_are_the_values_at_even_ranks(spark, parts):
    """15,000 distinct values are exact, whatever the number of tasks; missing values do not count."""
    rng = np.random.default_rng(7)
    x = np.stack([rng.normal(size=15_000), rng.integers(0, 6, 15_000)], axis=1)
    x[rng.random(x.shape) < 0.1] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], "a double, b double").repartition(parts)
    got = T.edges_of(df, ["a", "b"], 255)
    for v, e in zip(x.T, got):
        v = np.sort(v[~np.isnan(v)])
        at = np.array([(i + 1) / 255 for i in range(254)])
        assert e.tolist() == np.unique(v[np.ceil(at * len(v)).astype(int) - 1]).tolist()
    assert [len(e) for e in T.edges_of(df.where("a > 1e9"), ["a", "b"], 9)] == [0, 0]


def test_summaries_of_many_values_keep_ranks():
    rng = np.random.default_rng(8)
    v = rng.permutation(400_000).astype(float)
    ranks = T._Ranks(2000)
    for lo in range(0, len(v), 10_000):
        ranks.add(v[lo:lo + 10_000])
    values, counts = ranks.summary()
    assert len(values) <= 2000 and counts.sum() == len(v)
    off = np.abs(np.cumsum(counts) - (values + 1)) / len(v)
    assert off.max() <= 5 / 2000


def test_root_of_extra_trees_from_sorted_features():
    """A root's range and sums at its cuts, from one sort of a feature for all trees."""
    x, y = data(9, n=300, f=3, values=40, missing=0.1)
    w = np.random.default_rng(9).random(300)
    whole = FO._whole(T.Chunk(x.T.copy(), y, w, None, None))
    for f in range(3):
        v, after = whole(f)
        assert (v == np.sort(x[:, f][~np.isnan(x[:, f])])).all()
        for cut in (-1.0, 0.0, 7.0, 20.5, 39.0):
            right = x[:, f] > cut
            assert np.allclose(after[np.searchsorted(v, cut, side="right")], [w[right].sum(), (w * y)[right].sum()])


# -- shares of a network's rows ----------------------------------------------------------

def test_each_pass_of_a_network_reads_its_share_alone(spark):
    x, y = data(11, n=500, f=3, missing=0.1)
    df, cols = table(spark, x, y, parts=2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "32")
    try:
        packed = T.pack(df, cols, "y", None, "id", chunk=32)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    shares = N._shares(packed, 3, 4, 0.1, 42)
    assert len(shares) == 5
    for i, s in enumerate(shares):
        assert {f"share={i}" in r[0] for r in s.df.select(F.input_file_name()).collect()} == {True}
        assert "PartitionFilters: [isnotnull(share" in s.df._jdf.queryExecution().executedPlan().toString()

    got = [s.summed(lambda read: np.sum([np.zeros(3), *([len(v), v.sum(), a.sum(dtype=np.float64)] for a, v, _ in N._rows_of(read, 3))], axis=0))
           for s in shares]
    assert np.allclose(np.sum(got, axis=0), [len(y), y.sum(), np.nansum(x)])

    def held(read):
        return np.sum([np.zeros(2), *([(T.draw(c.u, 42) < 0.1).sum(), c.y[T.draw(c.u, 42) < 0.1].sum()] for c in T.chunks_of(read, 3, binned=False))], axis=0)

    assert np.allclose(got[4][:2], packed.summed(held))
    assert min(g[0] for g in got) > 0


def test_network_of_fewer_chunks_than_shares(spark):
    """a share without chunks has no files; its sums are 0 and the other shares are fitted.  Chunks of few tasks go to all shares."""
    x, y = data(12, n=300, f=3)
    df, cols = table(spark, x, y, parts=1)
    for part, epochs in ((df, 3), (df.limit(0), 1)):
        m = N.fit_network(part, cols, "y", "id", hidden=(4,), epochs=3, batches=4)
        assert len(m.held_out) == epochs and m.predict(df).where("prob BETWEEN 0 AND 1").count() == 300
    shares = N._shares(T.pack(df, cols, "y", None, "id"), 3, 4, 0.1, 42)

    def count(read):
        return np.sum([np.zeros(1), *([len(v)] for _, v, _ in N._rows_of(read, 3))], axis=0)

    assert sum(s.summed(count)[0] for s in shares) == 300 and sorted(s.parts > 0 for s in shares) == [False] * 3 + [True] * 2
    packed = T.pack(df.repartition(4), cols, "y", None, "id", tasks=4)
    dealt = N._shares(packed, 3, 4, 0.1, 42)
    assert sum(s.summed(count)[0] for s in dealt) == 300 and sum(s.parts > 0 for s in dealt[:4]) >= min(4, packed.parts)


# -- packed rows are held a few at a time --------------------------------------------------

def row_groups(df):
    """(row group's bytes, row) of each row group of a written table's files."""
    import pyarrow.parquet as pq
    for f in df.inputFiles():
        m = pq.ParquetFile(f.removeprefix("file://")).metadata
        for i in range(m.num_row_groups):
            yield m.row_group(i).total_byte_size, m.row_group(i).num_rows


def test_packed_rows_are_written_in_small_groups(spark, monkeypatch):
    """a task of a large table has hundreds of MB, of which a reader, and a writer before its hundredth row, holds a row group."""
    monkeypatch.setattr(T, "GROUP_BYTES", 100_000, raising=False)
    x = np.random.default_rng(13).normal(size=(6000, 5))
    df, cols = table(spark, x, (x[:, 0] > 0).astype(float), parts=1)
    packed = T.pack(df, cols, "y", None, "id", chunk=500)
    assert packed.df.selectExpr("max(n)", "count(*)", "sum(n)").first()[:] == (500, 12, 6000)  # chunks are no larger than asked for
    shares = N._shares(packed, 5, 2, 0.1, 42)
    for t in (packed, *shares):
        groups = list(row_groups(t.df))
        assert len(groups) > 2 or t is shares[-1]
        assert max(size for size, _ in groups) < 100_000 + 500 * 8 * 9
    assert sum(n for _, n in row_groups(packed.df)) == 12


def written_by(monkeypatch, module):
    """The tables that ``module`` writes from now on."""
    tables, plain = [], module.cut_lineage

    def write(df, *args, **kw):
        tables.append(plain(df, *args, **kw))
        return tables[-1]

    monkeypatch.setattr(module, "cut_lineage", write)
    return tables


def test_scores_of_the_sigmoid_are_written_in_small_groups(spark, monkeypatch):
    """the packed rows of the fit and the scores that the sigmoid is fitted to."""
    monkeypatch.setattr(T, "GROUP_BYTES", 20_000, raising=False)
    monkeypatch.setattr(N, "SMALL_CHUNK", 200)
    x = np.random.default_rng(14).normal(size=(4000, 3))
    df, cols = table(spark, x, (x[:, 0] > 0).astype(float), parts=1)
    tables = written_by(monkeypatch, N)
    N.fit_svm(df, cols, "y", "id", components=4, gamma=0.5, folds=2, steps=2)
    groups = [g for t in tables for g in row_groups(t)]
    assert len(tables) == 1 and sum(n for _, n in groups) == 20 and max(size for size, _ in groups) < 20_000 + 200 * 8 * 5


def test_scores_of_boosting_are_written_in_small_groups(spark, monkeypatch):
    """the rows that boosting writes with their scores, and those of extra trees."""
    monkeypatch.setattr(T, "GROUP_BYTES", 20_000, raising=False)
    x = np.random.default_rng(15).normal(size=(5000, 3))
    df, cols = table(spark, x, (x[:, 0] > 0).astype(float), parts=1)
    tables, packs, plain = written_by(monkeypatch, B), [], T.pack

    def pack(*args, **kw):
        packs.append(plain(*args, **{**kw, "chunk": 500}))
        return packs[-1]

    monkeypatch.setattr(T, "pack", pack)
    B.boost(df, cols, "y", rounds=B.REFRESH, depth=1)
    FO.extra_trees(df, cols, "y", trees=2, depth=1)
    assert len(tables) == 1 and len(packs) == 2
    for t in (tables[0], *(p.df for p in packs)):
        groups = list(row_groups(t))
        assert sum(n for _, n in groups) == 10 and max(size for size, _ in groups) < 20_000 + 500 * 8 * 7


def test_sums_of_a_forest_are_sent_tree_by_tree(spark, monkeypatch):
    """a task holds the sums of all trees once, not again as what it sends."""
    import pyarrow as pa

    df, cols = table(spark, *data(16), parts=2)
    runs, cls = [], type(df)
    plain = cls.mapInArrow

    def kept(self, f, schema, *args, **kw):
        if schema == FO._SENT:
            runs.append((self, f))
        return plain(self, f, schema, *args, **kw)

    monkeypatch.setattr(cls, "mapInArrow", kept)
    FO.random_forest(df, cols, "y", "id", trees=5, depth=2)
    src, run = runs[0]
    sent = plain(src, lambda read: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in run(read)), "n long").collect()
    assert len(sent) % 5 == 0 and {r.n for r in sent} == {1}
