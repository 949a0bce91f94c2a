"""Boosting on histograms of pre-binned features.

``boost``: second-order boosting with logistic, squared or Huber loss.  One
pass over the packed rows sums gradients and hessians by (leaf, feature, bin);
a split is scored with L1 and L2 penalties, gamma and a least child weight.
Trees grow level by level to ``depth`` or, with ``leaves``, the best leaf first.
Huber loss takes the quantile of the absolute residuals each round and
re-estimates every leaf from its median.

``adaboost``: SAMME with stumps, one pass a round that sums the weights by
(feature, bin, class).

Scores are brought up to date with the trees since the last write when a pass
reads the rows; every REFRESH rounds the rows are written with their scores, so
neither the plan nor that work grows with the rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import trees as T

REFRESH = 16


@dataclass
class Boosted:
    """A fitted model: a start, trees whose leaf values include the rate, and
    the gain of every feature's splits."""
    features: list[str]
    loss: str
    start: float
    trees: list
    gains: np.ndarray
    history: list

    def raw(self, x: np.ndarray) -> np.ndarray:
        s = np.full(x.shape[1], self.start)
        for t in self.trees:
            s += t[5].take(T.leaves_of(t, x, raw=True))
        return s

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Probability of class 1 (logistic loss) or the value, as column ``out``."""
        bc = df.sparkSession.sparkContext.broadcast(self)
        logistic = self.loss == "logistic"

        def of(x: np.ndarray) -> np.ndarray:
            s = bc.value.raw(x)
            return 1 / (1 + np.exp(-s)) if logistic else s

        return T.scored(df, self.features, of, out)

    def importances(self) -> list[tuple[str, float]]:
        return list(zip(self.features, map(float, T.shares(self.gains))))


def _soft(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def best_splits(g: np.ndarray, h: np.ndarray, n: np.ndarray, l1: float, l2: float, gamma: float, min_child: float,
                allowed: np.ndarray | None = None, min_rows: int = 1) -> list[tuple]:
    """For each leaf (first axis; then features, bins): (gain, feature, bin,
    left value, right value) of the best split, the first feature and the
    smallest bin among equals; a gain of 0 or less is no split."""
    gl, hl, nl = (np.cumsum(a, axis=2)[:, :, :-1] for a in (g, h, n))
    gt, ht, nt = (a.sum(2)[:, :, None] for a in (g, h, n))
    gr, hr, nr = gt - gl, ht - hl, nt - nl

    def worth(gs, hs):
        return np.divide(_soft(gs, l1) ** 2, hs + l2, out=np.zeros_like(gs), where=hs + l2 > 0)

    gain = 0.5 * (worth(gl, hl) + worth(gr, hr) - worth(gt, ht)) - gamma
    ok = (hl >= min_child) & (hr >= min_child) & (nl >= min_rows) & (nr >= min_rows)
    if allowed is not None:
        ok &= allowed[None, :, None]
    gain = np.where(ok, gain, -np.inf)
    out = []
    for i in range(len(g)):
        # Gains that differ by rounding alone are equal.
        top = gain[i].max() if gain[i].size else -np.inf
        if not np.isfinite(top):
            out.append((-np.inf, 0, 0, 0.0, 0.0))
            continue
        f, b = np.unravel_index(np.argmax(gain[i] >= top - 1e-9 * abs(top)), gain[i].shape)
        left, right = (-_soft(a[i, f, b], l1) / (c[i, f, b] + l2) if c[i, f, b] + l2 > 0 else 0.0 for a, c in ((gl, hl), (gr, hr)))
        out.append((float(gain[i, f, b]), int(f), int(b), float(left), float(right)))
    return out


def _gradients(loss: str, y: np.ndarray, s: np.ndarray, w: np.ndarray, delta: float) -> tuple[np.ndarray, np.ndarray]:
    if loss == "logistic":
        p = 1 / (1 + np.exp(-s))
        return (p - y) * w, p * (1 - p) * w
    r = s - y
    return (np.clip(r, -delta, delta) if loss == "huber" else r) * w, w


class _Rows:
    """The packed rows with the trees that their scores lack."""

    def __init__(self, packed: T.Packed, n_f: int, refresh: int = REFRESH):
        self.packed, self.n_f, self.refresh, self.pending = packed, n_f, refresh, []

    def read(self):
        """A function from a task's batches to chunks with scores up to date."""
        n_f, pending = self.n_f, list(self.pending)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[T.Chunk]:
            for c in T.chunks_of(batches, n_f):
                if pending:
                    c.s = c.s.copy()
                    for t in pending:
                        c.s += t[5].take(T.leaves_of(t, c.x))
                yield c

        return read

    def learned(self, tree: tuple) -> None:
        self.pending.append(tree)
        if len(self.pending) < self.refresh:
            return
        read = self.read()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for c in read(batches):
                cells = [pa.array([a.tobytes()], pa.binary()) for a in (c.x, c.y, c.w, c.u, c.s)]
                yield pa.RecordBatch.from_arrays([pa.array([len(c.y)], pa.int32()), *cells], names=["n", "x", "y", "w", "u", "s"])

        self.packed = T.Packed.of(cut_lineage(self.packed.df.mapInArrow(run, self.packed.df.schema), group_bytes=T.GROUP_BYTES))
        self.pending = []


def _histograms(rows: _Rows, tree: T.Tree, leaves: list[int], n_bins: int, loss: str, delta: float, subsample: float, seed: int) -> list:
    """(gradient, hessian, rows) by (feature, bin) of each leaf."""
    n_f, arrays, pending = rows.n_f, tree.arrays(), list(rows.pending)
    slot = np.full(len(tree.feature), -1, np.int64)
    slot[leaves] = np.arange(len(leaves))
    size = len(leaves) * n_bins

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((3, n_f, size))
        for c in T.chunks_of(batches, n_f):
            at = slot.take(T.leaves_of(arrays, c.x))
            use = at >= 0
            if subsample < 1:
                use &= T.draw(c.u, seed) < subsample
            place = None if use.all() else np.flatnonzero(use)
            own = (lambda a: a) if place is None else (lambda a: a.take(place))
            s = own(c.s).copy()
            for t in pending:
                s += t[5].take(T.leaves_of(t, c.x, place=place))
            gs, hs = _gradients(loss, own(c.y), s, own(c.w), delta)
            # Without weights the hessian of these losses is the number of rows.
            counted = loss != "logistic" and bool((c.w == 1).all())
            first = own(at) * n_bins
            for f in range(n_f):
                k = first + own(c.x[f])
                n = np.bincount(k, minlength=size)
                total[0, f] += np.bincount(k, gs, size)
                total[1, f] += n if counted else np.bincount(k, hs, size)
                total[2, f] += n
        return total

    total = rows.packed.summed(sums).reshape(3, n_f, len(leaves), n_bins)
    return [tuple(total[:, :, i]) for i in range(len(leaves))]


class _Grown:
    """A tree whose leaves are known by their sums: of two new leaves the one
    with fewer rows is summed, the other is what it leaves of the parent."""

    def __init__(self, measure, split, edges: list):
        self.tree, self.measure, self.split, self.edges = T.Tree(), measure, split, edges
        self.sums = {0: measure(self.tree, [0])[0]}
        self.found = {0: split(self.sums[0])}

    def expand(self, nodes: list[int]) -> None:
        """Split the nodes by their best splits and find those of the new leaves, in one pass."""
        pairs = []
        for x in nodes:
            _, f, b, left, right = self.found[x]
            n = self.sums[x][2][f]
            a, z = self.tree.split(x, f, b, float(self.edges[f][b - 1]) if b else -math.inf, left, right)
            pairs.append((x, a, z) if 2 * n[:b + 1].sum() <= n.sum() else (x, z, a))
        if not pairs:
            return
        for (x, few, many), got in zip(pairs, self.measure(self.tree, [p[1] for p in pairs])):
            rest = self.sums.pop(x)
            n = rest[2] - got[2]
            self.sums[few], self.sums[many] = got, (*(np.where(n > 0, r - g, 0.0) for r, g in zip(rest[:2], got)), n)
            for k in (few, many):
                self.found[k] = self.split(self.sums[k])

    def children(self, x: int) -> tuple[int, int] | None:
        return (self.tree.left[x], self.tree.right[x]) if self.tree.feature[x] >= 0 else None


def _best_first(grown: _Grown, leaves: int) -> list[int]:
    """The nodes to split, best leaf first, up to so many leaves.  Children are
    found for all leaves at a time that can still come into question, so the
    passes follow the height of the tree, not the number of its leaves."""
    while True:
        order, place, open_leaves, last = [], {0: 0}, {0}, 0
        while len(order) + 1 < leaves:
            # Among equals the leaf that was made first; its number is that of the tree so far.
            best = max(open_leaves, key=lambda x: (grown.found[x][0], -place[x]))
            if grown.found[best][0] <= 0:
                return order
            order.append(best)
            own = grown.children(best)
            if len(order) + 1 == leaves:
                return order
            if own is None:
                break
            open_leaves.remove(best)
            open_leaves.update(own)
            for x in own:
                last += 1
                place[x] = last
        else:
            return order
        # A leaf with as many better ones as there are splits left is not split, and the last split's children are not asked for.
        left = leaves - len(order) - 1
        ends = sorted((x for x in grown.found if grown.children(x) is None and grown.found[x][0] > 0 and x != order[-1]), key=lambda x: -grown.found[x][0])
        grown.expand([order[-1], *ends[:left - 1]])


def boost(train: DataFrame, features: Sequence[str], label: str, loss: str = "logistic", rounds: int = 100, rate: float = 0.1, depth: int = 3,
          leaves: int | None = None, l1: float = 0.0, l2: float = 1.0, gamma: float = 0.0, min_child: float = 1.0, min_rows: int = 1,
          subsample: float = 1.0, columns: float = 1.0, bins: int = 255, key: str | None = None, weight: str | None = None,
          start: float | None = None, alpha: float = 0.9, seed: int = 42) -> Boosted:
    """Fit ``rounds`` trees to a 0/1 label (logistic) or a number (squared,
    huber).  ``subsample`` draws rows per round from a hash of ``key``,
    ``columns`` features per tree.  With ``leaves`` a tree grows best leaf
    first up to that many leaves, whatever ``depth`` says.  ``start`` is the
    first score (default: the log odds or the mean of the label; for huber
    its median).  Missing values go left; rows with a missing label are left
    out; without rows the model is the start alone."""
    features = list(features)
    n_f = len(features)
    train = train.where(F.col(label).isNotNull())
    edges = T.edges_of(train, features, bins)
    n_bins = max((len(e) for e in edges), default=0) + 2
    if start is None:
        y = F.col(label).cast("double")
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        mean, median = train.agg(F.sum(y * w) / F.sum(w), F.percentile_approx(y, 0.5)).first()
        mean = 0.0 if mean is None else mean
        start = (median or 0.0) if loss == "huber" else mean
        if loss == "logistic":
            start = math.log(max(mean, 1e-12) / max(1 - mean, 1e-12)) if 0 < mean < 1 else (30.0 if mean >= 1 else -30.0)
    rows = _Rows(T.pack(train, features, label, edges, key, weight, start), n_f)
    gains, fitted, history = np.zeros(n_f), [], []
    rng = np.random.default_rng(seed)
    for m in range(rounds):
        delta = _residual_quantile(rows, alpha) if loss == "huber" else 0.0
        allowed = None
        if columns < 1:
            allowed = np.zeros(n_f, bool)
            allowed[rng.choice(n_f, max(1, round(columns * n_f)), replace=False)] = True
        grown = _Grown(lambda tree, own: _histograms(rows, tree, own, n_bins, loss, delta, subsample, seed * 1_000_003 + m),
                       lambda sums: best_splits(*(a[None] for a in sums), l1, l2, gamma, min_child, allowed, min_rows)[0], edges)
        if leaves is None:
            level, order = [0], []
            for d in range(depth):
                level = [x for x in level if grown.found[x][0] > 0]
                order += level
                if d + 1 < depth:
                    grown.expand(level)
                    level = [x for k in level for x in grown.children(k)]
        else:
            order = _best_first(grown, leaves)
        tree, number = T.Tree(), {0: 0}
        if not order and n_f and (leaves is not None or depth):
            gs, hs = grown.sums[0][0][0].sum(), grown.sums[0][1][0].sum()
            tree.value[0] = float(-_soft(gs, l1) / (hs + l2)) * rate if hs + l2 > 0 else 0.0
        for x in order:
            gain, f, b, left, right = grown.found[x]
            threshold = float(edges[f][b - 1]) if b else -math.inf
            made = tree.split(number[x], f, b, threshold, left * rate, right * rate)
            number.update(zip(grown.children(x) or (), made))
            gains[f] += gain
            history.append((m, number[x], features[f], threshold, gain, left, right))
        if loss == "huber":
            _median_leaves(rows, tree, delta, rate)
        arrays = tree.arrays()
        fitted.append(arrays)
        rows.learned(arrays)
    return Boosted(features, loss, start, fitted, gains, history)


def _residuals(rows: _Rows, tree: T.Tree | None) -> DataFrame:
    """(leaf, r): label minus score of every row."""
    read, arrays = rows.read(), tree.arrays() if tree else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in read(batches):
            leaf = T.leaves_of(arrays, c.x) if arrays else np.zeros(len(c.y), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(c.y - c.s)], names=["leaf", "r"])

    return rows.packed.df.mapInArrow(run, "leaf int, r double")


def _residual_quantile(rows: _Rows, alpha: float) -> float:
    return float(_residuals(rows, None).agg(F.percentile_approx(F.abs("r"), alpha)).first()[0] or 0.0)


def _median_leaves(rows: _Rows, tree: T.Tree, delta: float, rate: float) -> None:
    """Leaf values of the Huber loss: the median of the leaf's residuals plus
    the mean of what lies around it, cut at ``delta``."""
    r = _residuals(rows, tree)
    medians = {x["leaf"]: x["m"] for x in r.groupBy("leaf").agg(F.percentile_approx("r", 0.5).alias("m")).collect()}
    if not medians:
        return
    table = r.sparkSession.createDataFrame(list(medians.items()), "leaf int, m double")
    off = F.col("r") - F.col("m")
    mean = r.join(F.broadcast(table), "leaf").groupBy("leaf").agg(F.avg(F.greatest(F.least(off, F.lit(delta)), F.lit(-delta))).alias("d"))
    for x in mean.collect():  # a row for each leaf of the tree
        tree.value[x["leaf"]] = rate * (medians[x["leaf"]] + x["d"])


# -- AdaBoost ------------------------------------------------------------------

@dataclass
class Stumps:
    features: list[str]
    stumps: list  # (feature, threshold, class left, class right, say)

    def predict(self, df: DataFrame, score: str = "ada_score", label: str = "ada_pred") -> DataFrame:
        bc = df.sparkSession.sparkContext.broadcast(self.stumps)

        def of(x: np.ndarray) -> np.ndarray:
            s = np.zeros(x.shape[1])
            for f, t, a, b, say in bc.value:
                s += say * np.where(x[f] > t, 2 * b - 1, 2 * a - 1)
            return s

        return T.scored(df, self.features, of, score).withColumn(label, (F.col(score) > 0).cast("int"))


def fit_stumps(train: DataFrame, features: Sequence[str], label: str, rounds: int = 200, rate: float = 0.5, bins: int = 255,
               refresh: int = REFRESH) -> Stumps:
    """Discrete AdaBoost (SAMME) on a 0/1 label with depth-1 trees: each round
    takes the split of least Gini impurity under the current weights (the
    first feature and the smallest value among equals), each side says its
    heavier class (0 on a tie), and weights of missed rows grow by
    ``exp(say)``.  A round without error ends the fit with a say of ten times
    the rate; one no better than chance ends it without."""
    features = list(features)
    n_f = len(features)
    edges = T.edges_of(train, features, bins)
    n_bins = max((len(e) for e in edges), default=0) + 2
    rows = _Rows(T.pack(train.where(F.col(label).isNotNull()), features, label, edges), n_f, refresh)
    stumps = []
    for _ in range(rounds):
        read = rows.read()

        def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros((n_f, n_bins, 2))
            for c in read(batches):
                # Up to a factor for all, exp(says of the misses) is this function of the score.
                w = np.exp(-(2 * c.y - 1) * c.s / 2)
                for k in (0, 1):
                    own = c.y == k
                    for f in range(n_f):
                        total[f, :, k] += np.bincount(c.x[f][own], w[own], n_bins)
            return total

        by = rows.packed.summed(sums).reshape(n_f, n_bins, 2)
        left = np.cumsum(by, axis=1)[:, :-1]
        right = by.sum(1)[:, None] - left
        weight = by[0].sum() if n_f else 0.0
        if not weight > 0:
            break
        loss = T.gini(left) + T.gini(np.maximum(right, 0))
        f, b = np.unravel_index(np.argmax(loss <= loss.min() + 1e-9 * weight), loss.shape)
        a, z = int(left[f, b, 1] > left[f, b, 0]), int(right[f, b, 1] > right[f, b, 0])
        err = (left[f, b, 1 - a] + max(0.0, right[f, b, 1 - z])) / weight
        threshold = float(edges[f][b - 1]) if 0 < b <= len(edges[f]) else (-math.inf if not b else math.inf)
        if err >= 0.5:
            break
        say = rate * (10.0 if err <= 1e-12 else math.log((1 - err) / err))
        stumps.append((int(f), threshold, a, z, say))
        if err <= 1e-12:
            break
        stump = T.Tree()
        stump.split(0, int(f), int(b), threshold, say * (2 * a - 1), say * (2 * z - 1))
        rows.learned(stump.arrays())
    return Stumps(features, stumps)
