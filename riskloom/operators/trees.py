"""What the tree learners share: binned rows in packed chunks, trees as
arrays, sums of gradients by (leaf, feature, bin), and scoring.

A table is packed once (``pack``): a row of the result holds some thousand
rows as binary matrices, the bin numbers feature by feature, the label, the
weight, a hash of the key and the score so far.  A pass over the table is one
job: every task sends its rows down the trees that are being grown, sums what
a split needs with numpy, and Spark adds the tasks' cells up.  What comes to the
driver is bounded by leaves x features x bins, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

CHUNK = 1 << 14
TASK_BYTES = 4 << 20
FAN = 64
#: Of more bytes, the tasks' numbers are added up before they go to the driver.
DRIVER_BYTES = 1 << 20
#: Numbers of one piece of a sum, bytes of a task of a large table, inner nodes of a small tree.
PIECE, LARGE_TASK_BYTES, SMALL_TREE = 1 << 16, 256 << 20, 15
#: Of packed rows on disk that a writer or reader holds at a time.
GROUP_BYTES = 8 << 20
#: Values of a feature that a task holds before it sums them up.
HELD = 1 << 17


@dataclass
class Tree:
    """Nodes as parallel lists; feature -1 is a leaf.  A value of at most
    ``threshold`` (in bins: of at most ``bin``) goes left, a missing one too."""
    feature: list = field(default_factory=lambda: [-1])
    bin: list = field(default_factory=lambda: [0])
    threshold: list = field(default_factory=lambda: [0.0])
    left: list = field(default_factory=lambda: [0])
    right: list = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int, threshold: float, left: float = 0.0, right: float = 0.0) -> tuple[int, int]:
        a, b = len(self.feature), len(self.feature) + 1
        self.feature[node], self.bin[node], self.threshold[node], self.left[node], self.right[node] = feature, at, threshold, a, b
        for v in (left, right):
            self.feature.append(-1)
            self.bin.append(0)
            self.threshold.append(0.0)
            self.left.append(0)
            self.right.append(0)
            self.value.append(v)
        return a, b

    def arrays(self) -> tuple:
        return (np.array(self.feature, np.int32), np.array(self.bin, np.int32), np.array(self.threshold), np.array(self.left, np.int32),
                np.array(self.right, np.int32), np.array(self.value, np.float64), self.height())

    def height(self) -> int:
        level = [0] * len(self.feature)
        for i, f in enumerate(self.feature):  # children stand behind their parents
            if f >= 0:
                level[self.left[i]] = level[self.right[i]] = level[i] + 1
        return max(level)


def leaves_of(arrays: tuple, rows: np.ndarray, raw: bool = False, place: np.ndarray | None = None) -> np.ndarray:
    """The leaf of each row: ``rows`` are features x rows, bins or raw values;
    with ``place`` of the rows at these places only."""
    feature, at, threshold, left, right, _, height = arrays
    n = rows.shape[1] if place is None else len(place)
    inner = np.flatnonzero(feature >= 0)
    if len(inner) <= SMALL_TREE:
        # Few nodes: whole columns against one bound each, without a lookup per row.
        node = np.zeros(n, np.uint8)
        columns = {f: rows[f] if place is None else rows[f].take(place) for f in set(feature[inner].tolist())}
        for i in inner.tolist():  # children stand behind their parents
            x = columns[int(feature[i])]
            here = node == i
            go = here & (~(x > threshold[i]) if raw else x <= at[i])
            node += here.view(np.uint8) * np.uint8(right[i] - i)
            node -= go.view(np.uint8) * np.uint8(right[i] - left[i])
        return node
    # A leaf is its own child on both sides.
    own = np.arange(len(feature))
    leaf = feature < 0
    child = np.stack([np.where(leaf, own, left), np.where(leaf, own, right)], axis=1).ravel().astype(np.int64)
    start, bound = np.where(leaf, 0, feature).astype(np.int64) * rows.shape[1], threshold if raw else at
    flat, place = rows.ravel(), np.arange(n) if place is None else place
    node = np.zeros(n, np.int64)
    for _ in range(height):
        node = child.take(2 * node + (flat.take(start.take(node) + place) > bound.take(node)))
    return node


def condensed(values: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order and how often each is there; of more than
    ``most``, those at evenly spaced ranks, each for the ranks up to its own."""
    order = np.argsort(values, kind="stable")
    values, counts = values.take(order), counts.take(order)
    if len(values):
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        values, counts = values.take(first), np.add.reduceat(counts, first)
    if len(values) <= most:
        return values, counts
    run = np.cumsum(counts)
    at = np.unique(np.searchsorted(run, np.linspace(0, run[-1], most + 1)[1:]))
    return values.take(at), np.diff(run.take(at), prepend=0)


class _Ranks:
    """Values by rank, from pieces of any size.  Only summaries of as many pieces are
    joined, so a value's rank is off by 1 / ``most`` of the rows for each doubling."""

    def __init__(self, most: int):
        self.most, self.held, self.n, self.levels = most, [], 0, []

    def add(self, values: np.ndarray) -> None:
        self.held.append(values[~np.isnan(values)])
        self.n += len(self.held[-1])
        if self.n >= HELD:
            self._close()

    def _close(self) -> None:
        values = np.concatenate([np.zeros(0), *self.held])
        self.held, self.n = [], 0
        level, own = 0, condensed(values, np.ones(len(values), np.int64), self.most)
        while self.levels and self.levels[-1][0] == level:
            own = condensed(*(np.concatenate(x) for x in zip(self.levels.pop()[1], own)), self.most)
            level += 1
        self.levels.append((level, own))

    def summary(self) -> tuple[np.ndarray, np.ndarray]:
        self._close()
        return condensed(*(np.concatenate(x) for x in zip(*(own for _, own in self.levels))), self.most)


def edges_of(df: DataFrame, features: Sequence[str], bins: int = 255, accuracy: int = 10000) -> list[np.ndarray]:
    """Upper bin bounds of each feature, distinct values of its data at evenly
    spaced ranks (exact up to 2 * ``accuracy`` distinct values): each task sums
    its rows up in as many values, and a feature's are joined in a task of its
    own, in groups of FAN.  A feature with few values that are about equally
    frequent has each of them as a bound."""
    features = list(features)
    if not features:
        return []
    most, at = 2 * accuracy, np.array([(i + 1) / bins for i in range(bins - 1)])
    src = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])

    def rows_of(feature: list, part: list, own: list) -> list[pa.Array]:
        return [pa.array(feature, pa.int32()), pa.array(part, pa.int32()), *(pa.array([x.tobytes() for x in xs], pa.binary()) for xs in zip(*own))]

    names, schema = ["feature", "part", "v", "n"], "feature int, part int, v binary, n binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, ranks = TaskContext.get().partitionId(), [_Ranks(most) for _ in features]
        for b in batches:
            for i, r in enumerate(ranks):
                r.add(b.column(i).to_numpy(zero_copy_only=False).astype(np.float64))
        yield pa.RecordBatch.from_arrays(rows_of(list(range(len(ranks))), [part] * len(ranks), [r.summary() for r in ranks]), names=names)

    def joined(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        t = t.sort_by("part")
        raw = [np.concatenate([np.frombuffer(x, k) for x in t.column(c).to_pylist()]) for c, k in (("v", np.float64), ("n", np.int64))]
        return condensed(*raw, most)

    def fold(t: pa.Table) -> pa.Table:
        return pa.table(rows_of(t.column("feature")[:1].to_pylist(), t.column("part")[:1].to_pylist(), [joined(t)]), names=names)

    def last(t: pa.Table) -> pa.Table:
        values, counts = joined(t)
        cum = np.cumsum(counts)
        got = values.take(np.searchsorted(cum, np.ceil(at * cum[-1]))) if len(values) else values
        return pa.table({"feature": t.column("feature")[:1], "edges": pa.array([np.unique(got)], pa.list_(pa.float64()))})

    sent, parts = src.mapInArrow(run, schema), src.rdd.getNumPartitions()
    while parts > FAN:
        sent = sent.withColumn("part", F.expr(f"cast(part div {FAN} AS int)")).groupBy("feature", "part").applyInArrow(fold, schema)
        parts = -(-parts // FAN)
    got = {r["feature"]: r["edges"] for r in sent.groupBy("feature").applyInArrow(last, "feature int, edges array<double>").collect()}
    return [np.array(got.get(i, []), np.float64) for i in range(len(features))]


_PACKED = "n int, x binary, y binary, w binary, u binary, s binary"


def pack(df: DataFrame, features: Sequence[str], label: str, edges: list[np.ndarray] | None, key: str | None = None,
         weight: str | None = None, start: float = 0.0, chunk: int = CHUNK, tasks: int = 1) -> Packed:
    """The packed table.  ``x`` holds bin numbers (uint8; 0 is missing) or, without
    ``edges``, the values as float64.  It is read by as many tasks as its
    bytes need, but by ``tasks`` at least where it has that many chunks."""
    n_f = len(features)
    cols = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]
    u = F.xxhash64(F.col(key) if key else F.monotonically_increasing_id())
    src = df.select(*cols, F.col(label).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), u.alias("u"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out(t: pa.Table) -> pa.RecordBatch:
            raw = np.stack([t.column(i).to_numpy() for i in range(n_f)]) if n_f else np.zeros((0, t.num_rows))
            x = raw
            if edges is not None:
                x = np.stack([np.where(np.isnan(v), 0, 1 + np.searchsorted(e, v)).astype(np.uint8) for v, e in zip(raw, edges)])
            cells = [x, t.column(n_f).to_numpy().astype(np.float64), t.column(n_f + 1).to_numpy().astype(np.float64),
                     t.column(n_f + 2).to_numpy().view(np.uint64), np.full(t.num_rows, start)]
            return pa.RecordBatch.from_arrays([pa.array([t.num_rows], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)],
                                              names=["n", "x", "y", "w", "u", "s"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= chunk:
                t = pa.Table.from_batches(held)
                for at in range(0, n - n % chunk, chunk):
                    yield out(t.slice(at, chunk))
                held, n = t.slice(n - n % chunk).to_batches(), n % chunk
        if n:
            yield out(pa.Table.from_batches(held))

    packed = cut_lineage(src.mapInArrow(run, _PACKED), group_bytes=GROUP_BYTES)
    # As many tasks as the bytes need, so that a pass over a small table is a small job.
    n, chunks = packed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    size = n * (n_f * (8 if edges is None else 1) + 32)
    # Each task of a pass gives sums of one size, so their number stops at some for each core until a task holds LARGE_TASK_BYTES.
    most = max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-size // LARGE_TASK_BYTES))
    return Packed.of(cut_lineage(packed.repartition(max(1, min(most, -(-size // TASK_BYTES)), min(tasks, chunks))), group_bytes=GROUP_BYTES))


@dataclass
class Chunk:
    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    u: np.ndarray
    s: np.ndarray


def chunks_of(batches: Iterator[pa.RecordBatch], n_f: int, binned: bool = True) -> Iterator[Chunk]:
    for b in batches:
        col = {n: b.column(n) for n in b.schema.names}
        for i in range(b.num_rows):
            raw = {n: col[n][i].as_buffer() for n in ("x", "y", "w", "u", "s")}
            yield Chunk(np.frombuffer(raw["x"], np.uint8 if binned else np.float64).reshape(n_f, -1), np.frombuffer(raw["y"]),
                        np.frombuffer(raw["w"]), np.frombuffer(raw["u"], np.uint64), np.frombuffer(raw["s"]))


@dataclass
class Packed:
    """A packed table and the number of tasks that read it."""
    df: DataFrame
    parts: int

    @classmethod
    def of(cls, df: DataFrame) -> Packed:
        return cls(df, df.rdd.getNumPartitions())

    def summed(self, sums: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
        """One pass: ``sums(batches)`` gives a task's numbers, always as many;
        equal places are added up, in groups of FAN tasks until so few are
        left, and then, unless they are few numbers, piece by piece: the driver
        gets one vector, whatever the number of tasks.  A table without files
        has no tasks; its sums are those of no rows."""
        if not self.parts:
            return sums(iter(())).astype(np.float64).ravel()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part, v = TaskContext.get().partitionId(), sums(batches).astype(np.float64).ravel()
            pieces = [v[i:i + PIECE].tobytes() for i in range(0, max(1, len(v)), PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(pieces), pa.int32()), pa.array(range(len(pieces)), pa.int32()),
                                              pa.array(pieces, pa.binary())], names=["part", "piece", "v"])

        def fold(t: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(x) for x in t.sort_by("part").column("v").to_pylist()], axis=0)
            return pa.table({"part": t.column("part")[:1], "piece": t.column("piece")[:1], "v": pa.array([total.tobytes()], pa.binary())})

        schema = "part int, piece int, v binary"
        sent, parts = self.df.mapInArrow(run, schema), self.parts
        while parts > FAN:
            sent = sent.withColumn("part", F.expr(f"cast(part div {FAN} AS int)")).groupBy("part", "piece").applyInArrow(fold, schema)
            parts = -(-parts // FAN)
        if parts > 1 and parts * 8 * sums(iter(())).size > DRIVER_BYTES:
            sent = sent.groupBy("piece").applyInArrow(fold, schema)
        got: dict[int, list] = {}
        for r in sent.toArrow().sort_by([("piece", "ascending"), ("part", "ascending")]).to_pylist():
            got.setdefault(r["piece"], []).append(np.frombuffer(r["v"]))
        return np.concatenate([np.sum(x, axis=0) for x in got.values()])


def draw(u: np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from hashes and a seed (splitmix64)."""
    z = u + np.uint64((seed * 0x9E3779B97F4A7C15) & (2 ** 64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def scored(df: DataFrame, features: Sequence[str], of: Callable[[np.ndarray], np.ndarray], out: str) -> DataFrame:
    """``df`` with ``out``: ``of`` gets features x rows (missing: NaN), in Arrow batches."""
    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        return pd.Series(of(np.stack([c.to_numpy(np.float64) for c in cols])))

    return df.withColumn(out, score(*[F.col(c).cast("double") for c in features]))


def gini(counts: np.ndarray) -> np.ndarray:
    """Gini impurity times the weight, over the last axis."""
    n = counts.sum(-1)
    return n - np.divide((counts * counts).sum(-1), n, out=np.zeros_like(n), where=n > 0)


def shares(importance: np.ndarray) -> np.ndarray:
    total = importance.sum()
    return importance / total if total > 0 else importance
