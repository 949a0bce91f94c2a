"""Forests whose trees all grow together, level by level.

One pass a level sends every row down every tree.  A task sums, for each open
node, the weight and the weighted label on the left of each candidate split;
its sums are sent tree by tree and block of nodes, added up one by one in groups of
``trees.FAN`` tasks, and the best split of each node is chosen where the last sum is made.
Only the chosen splits come to the driver.

``extra_trees``: every tree sees all rows; a node draws some features and, for
each, one cut between the node's least and largest value, from a hash of the
seed, tree, node and feature.  A level takes two passes: the ranges, then the sums at the cuts.

``balanced_forest``: every bag under-samples each class to the size of the
smallest one.  A row is in a bag if the hash of its key and the bag is at most
the bag's threshold for its class, which is found exactly by counting; splits
are those of binned features.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees as T

BLOCK_NODES = 128
_SENT = "tree int, block int, part int, cells binary"


@dataclass
class Forest:
    """Trees whose leaf values are means of the label; a prediction is their mean."""
    features: list[str]
    trees: list
    gains: np.ndarray
    root_gains: list

    def predict(self, df: DataFrame, out: str = "prob") -> DataFrame:
        bc = df.sparkSession.sparkContext.broadcast(self.trees)

        def of(x: np.ndarray) -> np.ndarray:
            return sum((t[5].take(T.leaves_of(t, x, raw=True)) for t in bc.value), np.zeros(x.shape[1])) / max(1, len(bc.value))

        return T.scored(df, self.features, of, out)

    def importances(self) -> list[tuple[str, float]]:
        return list(zip(self.features, map(float, T.shares(self.gains))))


class _Level:
    """The open nodes of all trees: their number within the tree, the candidate
    features of each and, for random cuts, the cuts."""

    def __init__(self, grown: list[T.Tree], nodes: list[list[int]], n_f: int, m: int, rng: np.random.Generator):
        self.arrays = [t.arrays() for t in grown]
        self.nodes = nodes
        self.slots = []
        for t, own in zip(grown, nodes):
            slot = np.full(len(t.feature), -1, np.int64)
            slot[own] = np.arange(len(own))
            self.slots.append(slot)
        self.features = [np.argsort(rng.random((len(own), n_f)), axis=1)[:, :m].astype(np.int32) if m < n_f
                         else np.tile(np.arange(n_f, dtype=np.int32), (len(own), 1)) for own in nodes]
        self.cuts: list[np.ndarray] = []


@dataclass
class _Own:
    """The rows of a chunk that are in open nodes of a tree: their places, slots,
    labels and weights (None: all 1); ``binary``: all labels are 0 or 1."""
    flat: np.ndarray
    n: int
    place: np.ndarray
    slot: np.ndarray
    y: np.ndarray
    w: np.ndarray | None
    binary: bool
    every: np.ndarray | None = None  # weight and weighted label of all rows of the chunk
    whole: Callable | None = None  # of all rows of the chunk: a feature's (values in order, sums of weight and label from each on)

    def values(self, features: np.ndarray) -> np.ndarray:
        """Each row's value of the feature that ``features`` has for its slot."""
        return self.flat.take((features.astype(np.int64) * self.n).take(self.slot) + self.place)

    def sums(self, key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Weight and weighted label by ``key``."""
        if self.binary:
            # One count by key and label is both sums.
            by = np.bincount(2 * key + self.y, self.w, 2 * size).reshape(size, 2)
            return by[:, 0] + by[:, 1], by[:, 1]
        return np.bincount(key, self.w, size), np.bincount(key, self.y if self.w is None else self.w * self.y, size)

    def by_slot(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The rows in the order of their slots: order, rows of each slot, slots
        that have rows, and where they begin."""
        # Small numbers are sorted by counting.
        order = np.argsort(self.slot.astype(np.uint8 if size <= 1 << 8 else np.uint16 if size <= 1 << 16 else np.int64), kind="stable")
        count = np.bincount(self.slot, minlength=size)
        there = np.flatnonzero(count)
        return order, count, there, (np.cumsum(count) - count)[there]


def _whole(c: T.Chunk) -> Callable:
    """Of a chunk's feature: its values in order (missing ones left out) and the
    sums of (weight, weighted label) of the rows from each place on; once for all trees."""
    done: dict[int, tuple] = {}

    def of(f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in done:
            order = np.argsort(c.x[f], kind="stable")
            v = c.x[f].take(order)
            n = len(v) - int(np.isnan(v).sum())
            after = np.zeros((n + 1, 2))
            w = c.w.take(order[:n])
            after[:n] = np.cumsum(np.stack([w, w * c.y.take(order[:n])], axis=1)[::-1], axis=0)[::-1]
            done[f] = v[:n], after
        return done[f]

    return of


def _passed(packed: T.Packed, level: _Level, n_f: int, binned: bool, bags: Callable, cells: Callable, merge: Callable, finish: Callable,
            schema: str):
    """One pass: ``cells(level, tree, own, total)`` adds a chunk's rows to a
    tree's sums (nodes first); ``merge(a, b, out)`` joins two sums, ``finish`` turns those of
    a block of nodes into rows.  ``bags(chunk)`` gives the tree's rows of the
    chunk as (places, weights), None for all and for weights of 1."""
    open_trees = [t for t, own in enumerate(level.nodes) if own]

    sent_as = pa.schema([("tree", pa.int32()), ("block", pa.int32()), ("part", pa.int32()), ("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, sums = TaskContext.get().partitionId(), {}
        for c in T.chunks_of(batches, n_f, binned):
            bag, flat, n, every = bags(c), c.x.ravel(), len(c.y), np.arange(len(c.y))
            binary, equal = bool(((c.y == 0) | (c.y == 1)).all()), bool((c.w == 1).all())
            label, whole = c.y.astype(np.int64) if binary else c.y, None if binned else _whole(c)
            for t in open_trees:
                place, w = bag(t)
                if whole and place is None and w is None and len(level.arrays[t][0]) == 1:
                    # All rows are in the root.
                    sums[t] = cells(level, t, _Own(flat, n, every, every, label, None, binary, np.array([c.w.sum(), (c.w * c.y).sum()]), whole), sums.get(t))
                    continue
                slot = level.slots[t].take(T.leaves_of(level.arrays[t], c.x, raw=not binned, place=place))
                live = slot >= 0
                if not live.all():
                    live = np.flatnonzero(live)
                    slot, place, w = slot.take(live), live if place is None else place.take(live), None if w is None else w.take(live)
                place = every if place is None else place
                if not equal:
                    w = c.w.take(place) if w is None else c.w.take(place) * w
                sums[t] = cells(level, t, _Own(flat, n, place, slot, label if place is every else label.take(place), w, binary), sums.get(t))
        # A tree's sums go as they are sent: those of all trees may be a hundred MB.
        while sums:
            t, total = sums.popitem()
            for b in range(-(-len(total) // BLOCK_NODES)):
                yield pa.RecordBatch.from_pylist([{"tree": t, "block": b, "part": part, "cells": total[b * BLOCK_NODES:(b + 1) * BLOCK_NODES].tobytes()}],
                                                 schema=sent_as)

    def joined(t: pa.Table) -> np.ndarray:
        cells = (np.frombuffer(x.as_buffer()) for x in t.column("cells"))
        total = next(cells).copy()
        for x in cells:
            merge(total, x, out=total)
        return total

    def fold(t: pa.Table) -> pa.Table:
        return pa.table({"tree": t.column("tree")[:1], "block": t.column("block")[:1], "part": t.column("part")[:1], "cells": [joined(t).tobytes()]},
                        schema=sent_as)

    def last(t: pa.Table) -> pa.Table:
        return finish(t.column("tree")[0].as_py(), t.column("block")[0].as_py(), joined(t))

    sent, parts = packed.df.mapInArrow(run, _SENT), packed.parts
    while parts > T.FAN:
        sent = sent.withColumn("part", F.expr(f"cast(part div {T.FAN} AS int)")).groupBy("tree", "block", "part").applyInArrow(fold, _SENT)
        parts = -(-parts // T.FAN)
    return sent.groupBy("tree", "block").applyInArrow(last, schema).toArrow()


_CHOSEN = "tree int, slot int, feature int, at int, cut double, gain double, total double, left double, right double, n double"


def _choose(level: _Level, t: int, block: int, sums: np.ndarray, all_sums: np.ndarray, cuts: np.ndarray | None, min_rows: float) -> pa.Table:
    """The best split of each node: ``sums`` is nodes x candidates x splits x
    (weight, weighted label) of the left side, ``all_sums`` nodes x 2."""
    def part(n, s):
        return np.divide(s * s, n, out=np.zeros_like(s), where=n > 0)

    n, s = all_sums[:, 0][:, None, None], all_sums[:, 1][:, None, None]
    nl, sl = sums[..., 0], sums[..., 1]
    gain = part(nl, sl) + part(n - nl, s - sl) - part(n, s)
    gain = np.where((nl >= min_rows) & (n - nl >= min_rows), gain, -1.0)
    flat = gain.reshape(len(gain), -1)
    top = flat.max(1)
    # Gains that differ by rounding alone are equal; the first candidate wins.
    best = (flat >= (top - 1e-9 * np.abs(top))[:, None]).argmax(1)
    j, b = np.unravel_index(best, gain.shape[1:])
    i = np.arange(len(gain))
    first = block * BLOCK_NODES
    own = level.features[t][first:first + len(gain)]
    mean = lambda a, c: np.divide(a, c, out=np.zeros_like(a), where=c > 0)
    tot, left = all_sums, sums[i, j, b]
    return pa.table({"tree": np.full(len(i), t, np.int32), "slot": (first + i).astype(np.int32), "feature": own[i, j].astype(np.int32), "at": b.astype(np.int32),
                     "cut": cuts[first + i, j] if cuts is not None else np.zeros(len(i)), "gain": np.maximum(top, 0.0),
                     "total": mean(tot[:, 1], tot[:, 0]), "left": mean(left[:, 1], left[:, 0]),
                     "right": mean(tot[:, 1] - left[:, 1], tot[:, 0] - left[:, 0]), "n": tot[:, 0]})


def _grow(packed: T.Packed, n_f: int, n_trees: int, depth: int, m: int, seed: int, min_rows: float, edges: list | None, bags: Callable,
          min_gain: float = 1e-12) -> tuple[list, np.ndarray, list]:
    binned = edges is not None
    n_bins = max((len(e) for e in edges), default=0) + 2 if binned else 0
    grown = [T.Tree() for _ in range(n_trees)]
    nodes: list[list[int]] = [[0] for _ in range(n_trees)]
    gains, root_gains = np.zeros(n_f), [0.0] * n_trees
    for d in range(depth):
        level = _Level(grown, nodes, n_f, m, np.random.default_rng([seed, d]))
        if binned:
            def cells(level, t, own, total):
                size = len(level.nodes[t])
                total = np.zeros((size, m * n_bins * 2)) if total is None else total
                by, first = total.reshape(size, m, n_bins, 2), own.slot * n_bins
                for j in range(m):
                    n, s = own.sums(first + own.values(level.features[t][:, j]), size * n_bins)
                    by[:, j, :, 0] += n.reshape(size, n_bins)
                    by[:, j, :, 1] += s.reshape(size, n_bins)
                return total

            def finish(t, block, total):
                by = total.reshape(-1, m, n_bins, 2)
                return _choose(level, t, block, np.cumsum(by, axis=2)[:, :, :-1], by[:, 0].sum(1), None, min_rows)

            found = _passed(packed, level, n_f, True, bags, cells, np.add, finish, _CHOSEN)
        else:
            _draw_cuts(packed, level, n_f, m, seed, bags)

            def cells(level, t, own, total):
                size = len(level.nodes[t])
                total = np.zeros((size, 2 * m + 2)) if total is None else total
                if own.whole:
                    for j, (f, cut) in enumerate(zip(level.features[t][0], level.cuts[t][0])):
                        v, after = own.whole(int(f))
                        total[0, 2 * j:2 * j + 2] += own.every - after[np.searchsorted(v, cut, side="right")]
                    total[0, 2 * m:] += own.every
                    return total
                order, count, there, first = own.by_slot(size)
                if not len(there):
                    return total
                place, y, w = own.place.take(order), own.y.take(order).astype(np.float64), None if own.w is None else own.w.take(order)
                y = y if w is None else w * y
                n = count[there].astype(np.float64) if w is None else np.add.reduceat(w, first)
                s = np.add.reduceat(y, first)
                start = level.features[t].astype(np.int64) * own.n
                for j in range(m):
                    # The rows of a slot are side by side, so its feature and cut are repeated, not looked up.
                    x = own.flat.take(np.repeat(start[:, j], count) + place)
                    right = x > np.repeat(level.cuts[t][:, j], count)
                    total[there, 2 * j] += n - (np.add.reduceat(right, first, dtype=np.int64) if w is None else np.add.reduceat(w * right, first))
                    total[there, 2 * j + 1] += s - np.add.reduceat(y * right, first)
                total[there, 2 * m] += n
                total[there, 2 * m + 1] += s
                return total

            def finish(t, block, total):
                by = total.reshape(-1, m + 1, 2)
                return _choose(level, t, block, by[:, :m, None], by[:, m], level.cuts[t], min_rows)

            found = _passed(packed, level, n_f, False, bags, cells, np.add, finish, _CHOSEN)
        nodes = [[] for _ in range(n_trees)]
        for r in found.sort_by([("tree", "ascending"), ("slot", "ascending")]).to_pylist():
            t, node = r["tree"], level.nodes[r["tree"]][r["slot"]]
            if not d:
                grown[t].value[0], root_gains[t] = r["total"], r["gain"]
            if r["gain"] <= min_gain:
                continue
            cut = r["cut"] if not binned else (float(edges[r["feature"]][r["at"] - 1]) if 0 < r["at"] <= len(edges[r["feature"]]) else -np.inf)
            a, b = grown[t].split(node, r["feature"], r["at"], cut, r["left"], r["right"])
            gains[r["feature"]] += r["gain"]
            nodes[t] += [a, b]
        if not any(nodes):
            break
    return [t.arrays() for t in grown], gains, root_gains


def cut_share(seed: int, tree: int, node: int, feature: int) -> float:
    """Where a cut lies in its node's range: from an md5 that SQL can repeat."""
    return int(hashlib.md5(f"{seed}:{tree}:{node}:{feature}".encode()).hexdigest()[:8], 16) / 2.0 ** 32


def _draw_cuts(packed: T.Packed, level: _Level, n_f: int, m: int, seed: int, bags: Callable) -> None:
    def cells(level, t, own, total):
        size = len(level.nodes[t])
        total = np.full((size, 2 * m), np.inf) if total is None else total
        if own.whole:
            for j, f in enumerate(level.features[t][0]):
                v, _ = own.whole(int(f))
                if len(v):
                    total[0, 2 * j:2 * j + 2] = np.fmin(total[0, 2 * j:2 * j + 2], [v[0], -v[-1]])
            return total
        order, count, there, first = own.by_slot(size)
        if len(there):
            place, start = own.place.take(order), level.features[t].astype(np.int64) * own.n
            for j in range(m):
                v = own.flat.take(np.repeat(start[:, j], count) + place)
                total[there, 2 * j] = np.fmin(total[there, 2 * j], np.fmin.reduceat(v, first))
                total[there, 2 * j + 1] = np.fmin(total[there, 2 * j + 1], -np.fmax.reduceat(v, first))
        return total

    def finish(t, block, total):
        return pa.table({"tree": pa.array([t], pa.int32()), "block": pa.array([block], pa.int32()), "part": pa.array([0], pa.int32()),
                         "cells": [total.tobytes()]})

    got = _passed(packed, level, n_f, False, bags, cells, np.fmin, finish, _SENT)
    level.cuts = [np.full((len(own), m), np.nan) for own in level.nodes]
    for r in got.to_pylist():
        t, first = r["tree"], r["block"] * BLOCK_NODES
        ends = np.frombuffer(r["cells"]).reshape(-1, m, 2)
        rows = range(first, first + len(ends))
        u = np.array([[cut_share(seed, t, level.nodes[t][i], int(f)) for f in level.features[t][i]] for i in rows])
        lo, hi = ends[..., 0], -ends[..., 1]
        level.cuts[t][first:first + len(ends)] = np.where(np.isfinite(lo) & (hi > lo), lo + u * (hi - lo), np.inf)


def extra_trees(train: DataFrame, features: Sequence[str], label: str, trees: int = 100, depth: int = 10, candidates: int | None = None,
                min_rows: float = 1, weight: str | None = None, seed: int = 42) -> Forest:
    """Extremely randomised trees for a 0/1 label or a number: no bootstrap,
    ``candidates`` features per node (default: the square root of all), one
    random cut each, the split of largest gain (least squares, for 0/1 labels
    the same as Gini).  Missing values go left; rows without a label are left
    out; without rows every prediction is 0."""
    features = list(features)
    n_f = len(features)
    packed = T.pack(train.where(F.col(label).isNotNull()), features, label, None, weight=weight,
                    tasks=train.sparkSession.sparkContext.defaultParallelism)
    m = min(n_f, candidates or max(1, int(np.sqrt(n_f))))
    grown, gains, roots = _grow(packed, n_f, trees, depth, m, seed, min_rows, None, lambda c: lambda t: (None, None))
    return Forest(features, grown, gains, roots)


def bag_thresholds(packed: T.Packed, sizes: dict, bags: int, seed: int, n_f: int, cells: int = 256) -> dict:
    """{class: the least value per bag such that exactly the smallest class's
    number of rows draws at most it}.  Counting in ever smaller windows around
    the expected place; the last window's draws are looked at themselves."""
    low = min(sizes.values())
    out = {}
    for k, n in sizes.items():
        if n == low:
            out[k] = np.full(bags, 2.0)
            continue
        q = low / n
        spread = 8 * np.sqrt(q * (1 - q) / n) + 2.0 / n
        lo, hi = np.full(bags, max(0.0, q - spread)), np.full(bags, min(1.0, q + spread))
        found = np.full(bags, np.nan)
        while np.isnan(found).any():
            todo = np.flatnonzero(np.isnan(found))

            def count(batches, k=k, lo=lo, hi=hi, todo=todo):
                total = np.zeros((len(todo), cells + 1))
                for c in T.chunks_of(batches, n_f):
                    u = c.u[c.y == k]
                    for i, b in enumerate(todo):
                        d = T.draw(u, seed + int(b))
                        total[i, 0] += (d < lo[b]).sum()
                        d = d[(d >= lo[b]) & (d < hi[b])]
                        at = np.minimum(((d - lo[b]) / (hi[b] - lo[b]) * cells).astype(np.int64), cells - 1)
                        total[i, 1:] += np.bincount(at, minlength=cells)
                return total

            run = np.cumsum(packed.summed(count).reshape(len(todo), cells + 1), axis=1)
            missed = (run[:, 0] >= low) | (run[:, -1] < low)
            lo, hi = lo.copy(), hi.copy()
            lo[todo[missed]], hi[todo[missed]] = 0.0, 1.0
            held = {}
            for i in np.flatnonzero(~missed):
                j = int(np.searchsorted(run[i], low))  # the cell that holds the threshold, from 1
                b, width = int(todo[i]), (hi[todo[i]] - lo[todo[i]]) / cells
                # A hair wider, for draws on a cell's edge.
                new_lo, new_hi = lo[b] + (j - 1) * width, lo[b] + j * width
                held[b] = (max(lo[b], new_lo - 1e-15), min(hi[b], new_hi + 1e-15))
                if run[i, j] - run[i, j - 1] > 4096:
                    lo[b], hi[b] = held.pop(b)

            def collect(batches, k=k, held=held):
                bag, val = [], []
                below = np.zeros(bags)
                for c in T.chunks_of(batches, n_f):
                    u = c.u[c.y == k]
                    for b, (x, z) in held.items():
                        d = T.draw(u, seed + b)
                        below[b] += (d < x).sum()
                        d = d[(d >= x) & (d <= z)]
                        bag += [b] * len(d)
                        val += d.tolist()
                yield pa.RecordBatch.from_arrays([pa.array([*bag, *range(bags)], pa.int32()), pa.array([*val, *[None] * bags], pa.float64()),
                                                  pa.array([*[0.0] * len(bag), *below])], names=["bag", "d", "below"])

            if held:
                got = packed.df.mapInArrow(collect, "bag int, d double, below double").toArrow().to_pandas()
                below = got.groupby("bag")["below"].sum()
                for b in held:
                    d = np.sort(got[(got.bag == b) & got.d.notna()]["d"].to_numpy())
                    found[b] = d[int(low - below[b]) - 1]
        out[k] = found
    return out


def random_forest(train: DataFrame, features: Sequence[str], label: str, key: str, trees: int = 100, depth: int = 10,
                  candidates: int | None = None, min_rows: float = 1, weight: str | None = None, bins: int = 63, seed: int = 42) -> Forest:
    """Random forest for a 0/1 label or a number: a row is in a tree's bag as
    often as a Poisson(1) draw from the hash of ``key`` and the tree says (the
    bootstrap of a large table); otherwise as ``balanced_forest``."""
    features = list(features)
    n_f = len(features)
    train = train.where(F.col(label).isNotNull())
    edges = T.edges_of(train, features, bins)
    packed = T.pack(train, features, label, edges, key, weight, tasks=train.sparkSession.sparkContext.defaultParallelism)
    m = min(n_f, candidates or max(1, int(np.sqrt(n_f))))
    # P(count <= k) for k = 0, 1, ...
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])

    def bags(c: T.Chunk) -> Callable:
        def of(t: int) -> tuple:
            d = T.draw(c.u, seed + t)
            place = np.flatnonzero(d >= steps[0])
            d = d.take(place)
            w = np.ones(len(d))
            for x in steps[1:4]:
                w += d >= x
            many = np.flatnonzero(d >= steps[3])
            w[many] = np.searchsorted(steps, d.take(many), side="right")
            return place, w

        return of

    grown, gains, roots = _grow(packed, n_f, trees, depth, m, seed, min_rows, edges, bags)
    return Forest(features, grown, gains, roots)


def balanced_forest(train: DataFrame, features: Sequence[str], label: str, key: str, trees: int = 200, depth: int = 10,
                    candidates: int | None = None, min_rows: float = 1, bins: int = 63, seed: int = 42) -> Forest:
    """Balanced random forest: each tree sees every row of the smallest class
    and as many rows of each other class, drawn for it by a hash of ``key``
    (unique) and the tree's number.  ``candidates`` features per node (default: the square root
    of all); splits between bins of the features.  Missing values go left;
    rows without a label are left out; without rows every prediction is 0."""
    features = list(features)
    n_f = len(features)
    train = train.where(F.col(label).isNotNull())
    edges = T.edges_of(train, features, bins)
    packed = T.pack(train, features, label, edges, key, tasks=train.sparkSession.sparkContext.defaultParallelism)
    sizes = {float(r[0]): r[1] for r in train.groupBy(label).count().collect()}
    m = min(n_f, candidates or max(1, int(np.sqrt(n_f))))
    most = bag_thresholds(packed, sizes, trees, seed, n_f) if sizes else {}

    def bags(c: T.Chunk) -> Callable:
        # A limit above 1 takes every row of its class.
        classes = [(np.flatnonzero(c.y == k), v) for k, v in most.items()]
        drawn = [(own, c.u.take(own), v) for own, v in classes]

        def of(t: int) -> tuple:
            return np.concatenate([own if v[t] > 1 else own.take(np.flatnonzero(T.draw(u, seed + t) <= v[t])) for own, u, v in drawn]), None

        return of

    grown, gains, roots = _grow(packed, n_f, trees, depth, m, seed, min_rows, edges, bags)
    return Forest(features, grown, gains, roots)
