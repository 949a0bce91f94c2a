"""Exact k-nearest-neighbour joins (C3, C4, N9, K7) without a cross join.

Rows meet in *chunks*: at most ``block`` rows that lie near each other, packed
as one row of two binary columns (keys and numbers).  An index over the chunks
gives the pairs of chunks that can hold neighbours, as ids; the pairs form tiles
of a group of query chunks and a group of data chunks.  A packed chunk is sent
once to every tile that it has a pair in, and a task holds the two groups of a
tile, whatever the size of the tables.

``knn`` (vectors): a tree of pivots, which are data rows.  About
``sqrt(n / block)`` pivots cut the data into parts, and each part has one pivot
of its own for every ``block`` of its rows; a leaf cell is what lies nearest to
such a pivot.  Every query gets an upper bound of its k-th distance from the
pivots that it passes and from its own cell.  A cell is visited only if the
triangle inequality allows it for the chunk's queries, first for the part,
then for the cell.  A cell larger than ``block`` (equal rows) is cut into
chunks by a hash of the key.

``knn_impute`` (rows with missing values): the distance of a receiver and a donor
is Euclidean over the columns that both have, so for each pattern of donors and
each set of shared columns that receivers ask for, the donors are seen in the
space of these columns.  Of donors at one place only the k lowest keys count.
Each space is cut into cells at medians of a sample; a cell's donors meet its
visitors in one task, which has a tree of its own over them.  A receiver visits
its own cell for an upper bound of its k-th distance, and then every cell of
every space whose box is within the bound.  What a receiver is compared with
grows little with the table.

Ranking is on the squared distance rounded to 6 decimals (``knn_impute``: on the
distance), then the data key.  Bounds carry a slack that covers the rounding and the error
of the expanded form, and distances are recomputed from plain differences, so
results are exact and do not depend on the chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import trees as T

ROUND = 6
#: Numbers that a task holds in one matrix of distances to pivots.
MATRIX = 1 << 22
#: Packed bytes of a group of chunks; a task holds a group of each side.
TILE_BYTES = 64 << 20
#: Rows that a task deals to cells at a time, and cells of one space.
DEALT = 1 << 17
MAX_CELLS = 2048
#: What the last call compared (see the functions).
LAST_STATS: dict = {}


def _slack(dim: int, q2, x2):
    """Error bound of ``|q|^2 + |x|^2 - 2 q.x`` from the squared norms."""
    return 8 * np.finfo(float).eps * (dim + 4) * (q2 + x2)


def _vectors(col: pa.Array, dim: int) -> np.ndarray:
    """A column of vectors of ``dim`` numbers as a matrix."""
    return np.asarray(col.flatten(), np.float64).reshape(-1, dim)


def _lists(m: np.ndarray) -> pa.Array:
    off = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    return pa.ListArray.from_arrays(pa.array(off), pa.array(m.ravel()))


def _matrix(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, width)


def _distances(v: np.ndarray, piv: np.ndarray) -> np.ndarray:
    d2 = (v * v).sum(1)[:, None] + (piv * piv).sum(1)[None, :] - 2.0 * (v @ piv.T)
    return np.sqrt(np.maximum(d2, 0.0))


def _nearest(qk, qv, dk, dv, k: int, exclude_self: bool, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, data key, rounded squared distance) of the ``k`` best
    data rows of each query, as far as they are within its ``limit``."""
    dim = qv.shape[1]
    centre = dv.mean(0)
    qc, dc = qv - centre, dv - centre
    q2, d2 = (qc * qc).sum(1), (dc * dc).sum(1)
    approx = q2[:, None] + d2[None, :] - 2.0 * (qc @ dc.T)
    if exclude_self:
        approx[qk[:, None] == dk[None, :]] = np.inf
    slack = 2 * 10.0 ** -ROUND + 2 * _slack(dim, q2, d2.max())
    # Everything that could round to a distance among the k best.
    near = (approx <= (limit + slack)[:, None]) & np.isfinite(approx)
    many = np.flatnonzero(near.sum(1) > 4 * k)
    if len(many):
        kth = np.partition(approx[many], min(k, len(dk)) - 1, axis=1)[:, min(k, len(dk)) - 1]
        near[many] &= approx[many] <= (kth + slack[many])[:, None]
    ends = np.cumsum(near.sum(1))
    parts = []
    lo = 0
    while lo < len(qk):  # as many queries at once as have MATRIX numbers in their candidates
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + MATRIX // dim, side="right")))
        qi, di = np.nonzero(near[lo:hi])
        diff = qv[lo:hi][qi] - dv[di]
        ex = np.round(np.einsum("ij,ij->i", diff, diff), ROUND)
        order = np.lexsort((dk[di], ex, qi))
        qi, di, ex = qi[order], di[order], ex[order]
        best = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
        parts.append((qi[best] + lo, dk[di[best]], ex[best]))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*parts))


class _Tree:
    """The pivots over the data of one search: ``top`` (a matrix, on the driver:
    sqrt(n / block) rows) and, below it, a written table (top, sub, key, vec)."""

    def __init__(self, data: DataFrame, n: int, dim: int, block: int, k: int):
        self.dim, self.block, self.k = dim, block, k
        rows = data.orderBy(F.md5(F.col("key").cast("string")), "key").limit(math.ceil(math.sqrt(n / block))).collect()
        self.keys = np.array([r["key"] for r in rows], np.int64)
        top = np.array([r["vec"] for r in rows], np.float64).reshape(-1, dim)
        self.centre = top.mean(0)
        self.top = top - self.centre
        parts = cut_lineage(self._part(data))
        sizes = parts.groupBy("top").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius")).collect()
        self.sizes = {r["top"]: r["n"] for r in sizes}
        self.radius = np.zeros(len(top))
        for r in sizes:
            self.radius[r["top"]] = r["radius"]
        first = Window.partitionBy("top").orderBy(F.md5(F.col("key").cast("string")), "key")
        self.sub = cut_lineage(self._sized(parts, self.sizes).withColumn("sub", F.row_number().over(first) - 1)
                               .where(F.col("sub") < F.ceil(F.col("n") / block)).select("top", "sub", "key", "vec"))
        self.rows = cut_lineage(self._leaf(parts, self.sizes))

    def _sized(self, parts: DataFrame, sizes: dict) -> DataFrame:
        table = parts.sparkSession.createDataFrame(list(sizes.items()), "top int, n long")
        return parts.join(table, "top")

    def _part(self, rows: DataFrame) -> DataFrame:
        """(key, vec, top, d, reach): the nearest top pivot, its distance, and
        the k-th distance among the top pivots other than the row itself."""
        top, keys, centre, dim, k = self.top, self.keys, self.centre, self.dim, self.k
        step = max(1, MATRIX // max(1, len(top)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, step):
                    t = b.slice(lo, step)
                    near, d, reach = _to_pivots(t.column(0).to_numpy(), _vectors(t.column(1), dim) - centre, keys, top, k)
                    yield pa.RecordBatch.from_arrays([*t.columns, pa.array(near.astype(np.int32)), pa.array(d), pa.array(reach)],
                                                     names=["key", "vec", "top", "d", "reach"])

        return rows.mapInArrow(run, "key long, vec array<double>, top int, d double, reach double")

    def _leaf(self, parts: DataFrame, sizes: dict) -> DataFrame:
        """(key, vec, cell, d, reach) with the nearest of the part's own pivots."""
        dim, centre, k = self.dim, self.centre, self.k
        share = 8 * self.block
        own = self._sized(parts, sizes).withColumn("share", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / share)).cast("int")).drop("n")
        subs = self._sized(self.sub, sizes).withColumn("share", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / share).cast("int") - 1))).drop("n")

        def run(own: pa.Table, subs: pa.Table) -> pa.Table:
            if not own.num_rows or not subs.num_rows:
                return pa.table({"key": pa.array([], pa.int64()), "vec": pa.array([], pa.list_(pa.float64())), "cell": pa.array([], pa.int64()),
                                 "d": pa.array([], pa.float64()), "reach": pa.array([], pa.float64())})
            subs = subs.sort_by("sub")
            own = own.combine_chunks()
            piv = _vectors(subs.column("vec").combine_chunks(), dim) - centre
            keys, top = subs.column("key").to_numpy(), own.column("top")[0].as_py()
            step, out = max(1, MATRIX // len(piv)), []
            for lo in range(0, own.num_rows, step):
                t = own.slice(lo, step)
                near, d, reach = _to_pivots(t.column("key").to_numpy(), _vectors(t.column("vec").combine_chunks(), dim) - centre, keys, piv, k)
                out.append(pa.table({"key": t.column("key"), "vec": t.column("vec"), "cell": (top << 32) + near, "d": d,
                                     "reach": np.minimum(reach, t.column("reach").to_numpy())}))
            return pa.concat_tables(out)

        return own.groupBy("top", "share").cogroup(subs.groupBy("top", "share")).applyInArrow(
            run, "key long, vec array<double>, cell long, d double, reach double")

    def place(self, queries: DataFrame) -> DataFrame:
        """The queries in their nearest cells, as ``rows`` are."""
        parts = cut_lineage(self._part(queries))
        sizes = {r["top"]: r["n"] for r in parts.groupBy("top").agg(F.count(F.lit(1)).alias("n")).collect()}
        return cut_lineage(self._leaf(parts, sizes))


def _to_pivots(key: np.ndarray, v: np.ndarray, keys: np.ndarray, piv: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dist = _distances(v, piv)
    near = dist.argmin(1)
    d = dist[np.arange(len(v)), near]
    dist[key[:, None] == keys[None, :]] = np.inf
    reach = np.partition(dist, k - 1, axis=1)[:, k - 1] if len(piv) >= k else np.full(len(v), np.inf)
    return near, d, reach


def _packed(rows: DataFrame, block: int, dim: int) -> DataFrame:
    """Chunks (cell, chunk, n, keys, vecs, reach, far) of rows (key, vec, cell, d, reach)."""
    sizes = rows.groupBy(F.col("cell").alias("c")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("m"))
    own = rows.join(sizes, F.col("cell") == F.col("c")).withColumn("chunk", F.pmod(F.xxhash64("key", F.lit(1)), F.col("m")).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        return pa.table({"cell": t.column("cell")[:1], "chunk": t.column("chunk")[:1], "n": pa.array([t.num_rows], pa.int32()),
                         "keys": [t.column("key").to_numpy().tobytes()], "vecs": [_vectors(t.column("vec").combine_chunks(), dim).tobytes()],
                         "reach": [t.column("reach").to_numpy().tobytes()], "far": [max(t.column("d").to_numpy())]})

    return own.drop("c", "m").groupBy("cell", "chunk").applyInArrow(
        run, "cell long, chunk int, n int, keys binary, vecs binary, reach binary, far double")


def _tiles(pairs: DataFrame, asked: DataFrame, data: DataFrame, dim: int, k: int, exclude_self: bool) -> DataFrame:
    """Neighbours from ``pairs`` (cell, chunk, q_group, d_cell, d_chunk, d_group)
    of chunk ids.  A tile is a group of query chunks and a group of data chunks;
    a packed chunk goes once to each tile that has a pair of it, and what a
    query finds in a tile lowers its limit there."""
    tile = ["q_group", "d_group"]
    wanted = pairs.groupBy("cell", "chunk", *tile).agg(F.collect_list(F.struct("d_cell", "d_chunk")).alias("wanted"))
    left = wanted.select("cell", "chunk", *tile, F.transform("wanted", lambda x: x["d_cell"]).alias("w_cell"),
                         F.transform("wanted", lambda x: x["d_chunk"]).alias("w_chunk")).join(asked, ["cell", "chunk"])
    right = pairs.select("d_cell", "d_chunk", F.col("q_group").alias("to_q"), F.col("d_group").alias("to_d")).distinct().join(data, ["d_cell", "d_chunk"])

    def run(own: pa.Table, given: pa.Table) -> pa.Table:
        chunks = {}
        for c, h, dk, dv in zip(*(given.column(x).to_pylist() for x in ("d_cell", "d_chunk", "dkeys", "dvecs"))):
            chunks[c, h] = np.frombuffer(dk, np.int64), _matrix(dv, dim)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for keys, vecs, reach, cells, parts in zip(*(own.column(x).to_pylist() for x in ("keys", "vecs", "reach", "w_cell", "w_chunk"))):
            qk, qv, limit = np.frombuffer(keys, np.int64), _matrix(vecs, dim), np.frombuffer(reach, np.float64).copy()
            at, key, sq = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for c, h in sorted(zip(cells, parts)):
                at, key, sq = (np.concatenate(x) for x in zip((at, key, sq), _nearest(qk, qv, *chunks[c, h], k, exclude_self, limit)))
                order = np.lexsort((key, sq, at))
                at, key, sq = at[order], key[order], sq[order]
                rank = np.arange(len(at)) - np.searchsorted(at, at)
                last = rank == k - 1
                limit[at[last]] = np.minimum(limit[at[last]], sq[last] + 10.0 ** -ROUND)
                at, key, sq = at[rank < k], key[rank < k], sq[rank < k]
            out.append((qk[at], key, sq))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out)], names=["q_key", "nb_key", "sq_dist"])

    return left.select(*tile, "keys", "vecs", "reach", "w_cell", "w_chunk").groupBy(*tile).cogroup(right.groupBy("to_q", "to_d")).applyInArrow(
        run, "q_key long, nb_key long, sq_dist double")


def _compare(pairs: DataFrame, dim: int, k: int, exclude_self: bool, bounds_only: bool) -> DataFrame:
    """Compare the chunks of each row of ``pairs`` (keys, vecs, reach of the
    queries; dkeys, dvecs of the data).  With ``bounds_only`` ``reach`` (the
    squared k-th distance) is lowered; else the rows are neighbours."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(n) for n in b.schema.names}
            for i in range(b.num_rows):
                qk, qv = np.frombuffer(cols["keys"][i].as_py(), np.int64), _matrix(cols["vecs"][i].as_py(), dim)
                limit = np.frombuffer(cols["reach"][i].as_py(), np.float64)
                raw = cols["dkeys"][i].as_py()
                if raw is None:
                    at, key, sq = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                else:
                    at, key, sq = _nearest(qk, qv, np.frombuffer(raw, np.int64), _matrix(cols["dvecs"][i].as_py(), dim), k, exclude_self, limit)
                if not bounds_only:
                    yield pa.RecordBatch.from_arrays([pa.array(qk[at]), pa.array(key), pa.array(sq)], names=["q_key", "nb_key", "sq_dist"])
                    continue
                last = np.arange(len(at)) - np.searchsorted(at, at) == k - 1
                limit = limit.copy()
                limit[at[last]] = np.minimum(limit[at[last]], sq[last] + 10.0 ** -ROUND)
                yield pa.RecordBatch.from_arrays([pa.array([cols["cell"][i].as_py()], pa.int64()), pa.array([cols["chunk"][i].as_py()], pa.int32()),
                                                  pa.array([limit.tobytes()], pa.binary()), pa.array([limit.max()], pa.float64())],
                                                 names=["cell", "chunk", "reach", "most"])

    return pairs.mapInArrow(run, "cell long, chunk int, reach binary, most double" if bounds_only
                            else "q_key long, nb_key long, sq_dist double")


def knn(query: DataFrame, data: DataFrame, k: int, q_key: str = "key", q_vec: str = "vec",
        d_key: str = "key", d_vec: str = "vec", exclude_self: bool = False, block: int = 2048) -> DataFrame:
    """Exact k nearest data rows of every query row.

    Returns ``(q_key, nb_key, sq_dist, rank)``; ``rank`` starts at 1.  With
    ``exclude_self`` a data row with the query's key is not its neighbour.
    Vectors are arrays of numbers of equal length; keys are longs.
    ``LAST_STATS`` has the number of leaf cells (pivots), of data rows and of
    (query, cell) pairs that were compared."""
    spark = query.sparkSession
    same = query is data and (q_key, q_vec) == (d_key, d_vec)
    data = data.select(F.col(d_key).cast("long").alias("key"), F.col(d_vec).cast("array<double>").alias("vec"))
    query = data if same else query.select(F.col(q_key).cast("long").alias("key"), F.col(q_vec).cast("array<double>").alias("vec"))
    n, dim = data.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not n:
        return spark.createDataFrame([], "q_key long, nb_key long, sq_dist double, rank int")
    if n <= block:  # one cell, one chunk
        one = lambda df: df.select("key", "vec", F.lit(0).cast("long").alias("cell"), F.lit(0.0).alias("d"), F.lit(float("inf")).alias("reach"))
        chunks = _packed(one(data), block, dim)
        asked = chunks if same else _packed(one(query), block, dim)
        pairs = asked.join(chunks.select("cell", F.col("keys").alias("dkeys"), F.col("vecs").alias("dvecs")), "cell")
        LAST_STATS.clear()
        LAST_STATS.update(pivots=1, data_rows=int(n))
    else:
        return _ranked(_tree_found(_Tree(data, n, dim, block, k), query, same, n, dim, k, exclude_self, block), k)
    return _ranked(_compare(pairs, dim, k, exclude_self, False), k)


def _ranked(cand: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q_key").orderBy("sq_dist", "nb_key")
    return (cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("int")))


def _tree_found(tree: _Tree, query: DataFrame, same: bool, n: int, dim: int, k: int, exclude_self: bool, block: int) -> DataFrame:
    """Candidates from the chunks of queries and data that can hold neighbours."""
    placed = tree.rows if same else tree.place(query)
    centre, top, radius = tree.centre, tree.top, tree.radius
    top2 = float((top * top).sum(1).max())
    # Squared bounds; a distance to a pivot carries the error of the expanded form.
    spread = math.sqrt(top2) + float(radius.max())
    err = 2 * float(np.sqrt(_slack(dim, spread ** 2, spread ** 2)))
    square = (F.col("reach") + F.lit(err)) * (F.col("reach") + F.lit(err)) + F.lit(10.0 ** -ROUND)
    chunks = cut_lineage(_packed(tree.rows, block, dim))
    asked = cut_lineage(_packed(placed.withColumn("reach", square), block, dim))
    data = chunks.select(F.col("cell").alias("d_cell"), F.col("chunk").alias("d_chunk"), F.col("keys").alias("dkeys"), F.col("vecs").alias("dvecs"))
    home = asked.join(data.where("d_chunk = 0"), F.col("cell") == F.col("d_cell"), "left")
    bounds = cut_lineage(_compare(home, dim, k, exclude_self, True))
    cells = cut_lineage(tree.rows.groupBy("cell").agg(F.max("d").alias("radius"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("m")).join(
        tree.sub.select(((F.col("top").cast("long") * (1 << 32)) + F.col("sub")).alias("cell"), F.col("vec").alias("pivot")), "cell"))

    # Parts of the tree that a chunk's queries can reach, from the pivot of their own cell.
    heads = (asked.select("cell", "chunk", "n", "far").join(bounds.select("cell", "chunk", "most"), ["cell", "chunk"])
             .join(tree.sub.select(((F.col("top").cast("long") * (1 << 32)) + F.col("sub")).alias("cell"), "vec"), "cell")
             .select("cell", "chunk", "n", "far", "most", "vec"))

    def reach_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, MATRIX // len(top))
        for b in batches:
            for lo in range(0, b.num_rows, step):
                t = b.slice(lo, step)
                far, most = t.column(3).to_numpy(), t.column(4).to_numpy()
                dist = _distances(_vectors(t.column(5), dim) - centre, top)
                i, j = np.nonzero(dist - radius[None, :] <= (far + np.sqrt(most) + 3 * err)[:, None])
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(i)) for c in t.columns), pa.array(j.astype(np.int32))],
                                                 names=["cell", "chunk", "n", "far", "most", "vec", "top"])

    head = "cell long, chunk int, n int, far double, most double, vec array<double>"
    parts = heads.mapInArrow(reach_parts, f"{head}, top int")
    own = cells.select(F.col("cell").alias("d_cell"), "radius", "m", "pivot", (F.col("cell") / F.lit(1 << 32)).cast("long").cast("int").alias("top"))

    def reach_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {x: b.column(x) for x in b.schema.names}
            diff = _vectors(c["vec"], dim) - _vectors(c["pivot"], dim)
            dist = np.sqrt((diff * diff).sum(1))
            ok = dist - c["radius"].to_numpy() <= c["far"].to_numpy() + np.sqrt(c["most"].to_numpy()) + 3 * err
            yield pa.RecordBatch.from_arrays([c[x] for x in ("cell", "chunk", "n", "d_cell", "m")], names=["cell", "chunk", "n", "d_cell", "m"]).filter(pa.array(ok))

    found = cut_lineage(parts.join(own, "top").mapInArrow(reach_cells, "cell long, chunk int, n int, d_cell long, m int"))
    LAST_STATS.clear()
    LAST_STATS.update(pivots=cells.count(), data_rows=int(n), candidate_pairs=int(found.agg(F.sum("n")).first()[0] or 0))
    # Groups of chunks that follow each other: their number goes with the cores, but
    # none holds much more than TILE_BYTES, so that a chunk is sent a bounded number of times.
    groups = max(math.ceil(math.sqrt(8 * query.sparkSession.sparkContext.defaultParallelism)), math.ceil(n * 8 * (dim + 1) / TILE_BYTES))
    span = max(block, math.ceil(n / groups))
    starts, at = [], 0
    for t in sorted(tree.sizes):
        starts += [F.lit(t), F.lit(at)]
        at += tree.sizes[t]
    first = F.create_map(*starts)

    def group(cell: str, chunk: str) -> Column:
        place = first[F.shiftright(cell, 32).cast("int")] + (F.col(cell).bitwiseAND(F.lit((1 << 32) - 1)) + F.col(chunk)) * block
        return F.floor(place / span).cast("int")

    ids = found.select("cell", "chunk", "d_cell", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("d_chunk"))
    ids = ids.withColumns({"q_group": group("cell", "chunk"), "d_group": group("d_cell", "d_chunk")})
    return _tiles(ids, asked.drop("n", "reach", "far").join(bounds.drop("most"), ["cell", "chunk"]), data, dim, k, exclude_self)


def knn_classify(df: DataFrame, key: str, vec: str, label: str, k: int = 5) -> DataFrame:
    """Leave-one-out kNN vote for every row (N9): ``pred_uniform`` is the most
    frequent neighbour label, ``pred_distance`` maximises the sum of
    1/distance (a zero distance outweighs all others); ties go to the
    smallest label."""
    nb = knn(df, df, k, key, vec, key, vec, exclude_self=True)
    labels = df.select(F.col(key).cast("long").alias("nb_key"), F.col(label).alias("nb_label"))
    j = nb.join(labels, "nb_key")
    d = F.sqrt(F.col("sq_dist"))
    votes = j.groupBy("q_key", "nb_label").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(d > 0, 1.0 / d).otherwise(F.lit(0.0))).alias("w"),
        F.count_if(d == 0).alias("zero"))
    wu = Window.partitionBy("q_key").orderBy(F.col("n").desc(), F.col("nb_label").asc())
    ww = Window.partitionBy("q_key").orderBy(F.col("zero").desc(), F.col("w").desc(), F.col("nb_label").asc())
    ranked = votes.select("q_key", "nb_label", F.row_number().over(wu).alias("ru"),
                          F.row_number().over(ww).alias("rw"))
    pu = ranked.where(F.col("ru") == 1).select(F.col("q_key").alias(key), F.col("nb_label").alias("pred_uniform"))
    pw = ranked.where(F.col("rw") == 1).select(F.col("q_key").alias(key), F.col("nb_label").alias("pred_distance"))
    return pu.join(pw, key)


def _patterns(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(_k, _c0 .., mask): doubles and the bit set of the present ones."""
    values = [F.col(c).cast("double") for c in cols]
    mask = sum((F.when(v.isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, v in enumerate(values)), F.lit(0).cast("long"))
    return df.select(F.col(key).cast("long").alias("_k"), *[v.alias(f"_c{i}") for i, v in enumerate(values)], mask.alias("mask"))


def _columns(mask: int, ncol: int) -> list[int]:
    return [i for i in range(ncol) if mask >> i & 1]


def _split_tree(x: np.ndarray, size: int) -> tuple[tuple, np.ndarray]:
    """A tree of median cuts along the widest side (``trees.Tree`` arrays)
    whose leaves hold about ``size`` rows of ``x``, and each row's leaf."""
    tree, leaf = T.Tree(), np.zeros(len(x), np.int32)
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, own = todo.pop()
        leaf[own] = node
        if len(own) <= size:
            continue
        v = x[own]
        lo, hi = v.min(0), v.max(0)
        c = int(np.argmax(hi - lo))
        if not hi[c] > lo[c]:
            continue  # equal rows
        v = v[:, c]
        at = np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2]
        at = at if at < hi[c] else v[v < hi[c]].max()
        a, b = tree.split(node, c, 0, float(at))
        todo += [(a, own[v <= at]), (b, own[v > at])]
    return tree.arrays(), leaf


def _node_boxes(tree: tuple, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The boxes of all nodes from those of the leaves (an empty one: inf, -inf)."""
    for i in range(len(tree[0]) - 1, -1, -1):  # children stand behind their parents
        if tree[0][i] >= 0:
            a, b = tree[3][i], tree[4][i]
            lo[i], hi[i] = np.minimum(lo[a], lo[b]), np.maximum(hi[a], hi[b])
    return lo, hi


def _reached(tree: tuple, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, limit2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf): the leaves whose boxes are within the rows' squared limits."""
    row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    rows, leaves = [], []
    while len(row):
        v = x[row]
        gap = np.maximum(np.maximum(lo[node] - v, v - hi[node]), 0.0)
        near = np.einsum("ij,ij->i", gap, gap) <= limit2[row]
        near &= lo[node, 0] <= hi[node, 0]
        row, node = row[near], node[near]
        end = tree[0][node] < 0
        rows.append(row[end])
        leaves.append(node[end])
        row, node = row[~end], node[~end]
        row, node = np.concatenate([row, row]), np.concatenate([tree[3][node], tree[4][node]]).astype(np.int64)
    return np.concatenate(rows), np.concatenate(leaves)


def _few_equal(key: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` lowest keys of each distinct row of ``x``: no
    other row can be among the k nearest of anything."""
    order = np.lexsort((key, *x.T))
    s = x[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]).any(1)
    first = np.flatnonzero(new)
    return order[np.arange(len(s)) - first[np.cumsum(new) - 1] < k]


def _cell_search(q: np.ndarray, limit: np.ndarray | None, dk: np.ndarray, d: np.ndarray, k: int, leaf: int, factor: float) -> tuple:
    """(query's place, donor's place, rounded distance) of each query's ``k``
    best donors within its ``limit`` (None: of all), and the comparisons made."""
    tree, of = _split_tree(d, leaf)
    order = np.argsort(of, kind="stable")
    first, ends = np.searchsorted(of[order], np.arange(len(tree[0]))), np.searchsorted(of[order], np.arange(len(tree[0])), side="right")
    size = ends - first
    lo, hi = np.full((len(size), d.shape[1]), np.inf), np.full((len(size), d.shape[1]), -np.inf)
    for i in np.flatnonzero(size):
        v = d[order[first[i]:ends[i]]]
        lo[i], hi[i] = v.min(0), v.max(0)
    lo, hi = _node_boxes(tree, lo, hi)
    # Donors by leaf, filled up with places that are far from all.
    width = int(size.max())
    place = first[:, None] + np.arange(width)
    real = np.arange(width) < size[:, None]
    place = np.where(real, order[np.minimum(place, len(order) - 1)], 0)
    vals = np.where(real[:, :, None], d[place], np.inf)
    compared = 0

    def squares(row, node):
        diff = vals[node] - q[row][:, None, :]
        return np.einsum("ijk,ijk->ij", diff, diff)

    step = max(1, MATRIX // (width * d.shape[1]))
    if limit is None:
        # A first bound from the leaf that holds the query's place.
        own = T.leaves_of(tree, q.T, raw=True)
        limit = np.full(len(q), np.inf)
        if width >= k:
            for at in range(0, len(q), step):
                row = np.arange(at, min(len(q), at + step))
                limit[row] = np.sqrt(np.partition(squares(row, own[row]), k - 1, axis=1)[:, k - 1] * factor)
            compared += len(q) * width
    wide = limit + 2 * 10.0 ** -ROUND
    row, node = _reached(tree, lo, hi, q, wide * wide / factor * (1 + 1e-12))
    compared += int(size[node].sum())
    by = np.argsort(row, kind="stable")
    row, node = row[by], node[by]
    out, at = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
    while at < len(row):  # all leaves of some queries at a time
        end = len(row) if at + step >= len(row) else max(int(np.searchsorted(row, row[at + step])), int(np.searchsorted(row, row[at], side="right")))
        r, s = row[at:end], node[at:end]
        dist = np.concatenate([np.sqrt(squares(r[i:i + step], s[i:i + step]) * factor) for i in range(0, len(r), step)])
        i, j = np.nonzero((dist <= wide[r][:, None]) & real[s])
        dist, who, r = np.round(dist[i, j], ROUND), place[s[i], j], r[i]
        best = np.lexsort((dk[who], dist, r))
        r, who, dist = r[best], who[best], dist[best]
        best = np.arange(len(r)) - np.searchsorted(r, r) < k
        out.append((r[best], who[best], dist[best]))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out)), compared


_SENT = "cell int, keys binary, vals binary"


@dataclass
class _Unit:
    """Donors of the pattern ``donor`` seen in the ``shared`` columns: the space
    of all receivers that have of the donors' columns just these."""
    shared: list[int]
    donor: int
    targets: list[int]
    tree: tuple
    cells: np.ndarray  # number of a leaf's cell, by node
    lo: np.ndarray | None = None
    hi: np.ndarray | None = None


def _held(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _by_cell(cell: np.ndarray, key: np.ndarray, vals: np.ndarray) -> pa.RecordBatch:
    """One packed row for each cell."""
    order = np.argsort(cell, kind="stable")
    cell, key, vals = cell[order], key[order], vals[order]
    own, first = np.unique(cell, return_index=True)
    ends = [*first[1:], len(cell)]
    return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([key[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
                                       pa.array([vals[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())], names=["cell", "keys", "vals"])


def _rows_of(t: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    return (np.frombuffer(b"".join(t.column("keys").to_pylist()), np.int64), _matrix(b"".join(t.column("vals").to_pylist()), width))


def _values(t: pa.Table, names: list[str]) -> np.ndarray:
    return np.column_stack([t.column(c).to_numpy() for c in names]).astype(np.float64)


def _units(rows: DataFrame, counts: dict, ncol: int, cell: int) -> list[_Unit]:
    """The spaces and their cells, cut at medians of a sample of 32 rows a cell."""
    vcols = [f"_c{i}" for i in range(ncol)]
    pairs = sorted({(r & d, d) for r in counts for d in counts if r & d and d & ~r})
    cells = {d: min(MAX_CELLS, -(-counts[d] // cell)) for _, d in pairs}
    share = F.lit(0)
    for d, n in cells.items():
        share = F.when(F.col("mask") == d, F.lit(min(1 << 30, (1 << 30) * 32 * n // counts[d]))).otherwise(share)
    picked = rows.where(F.pmod(F.xxhash64("_k", F.lit(7)), F.lit(1 << 30)) < share).select("mask", *vcols).toArrow()
    mask, vals = picked.column("mask").to_numpy(), _values(picked, vcols) if picked.num_rows else np.zeros((0, ncol))
    out, n = [], 0
    for s, d in pairs:
        shared = _columns(s, ncol)
        x = vals[mask == d][:, shared]
        tree, _ = _split_tree(x, max(1, -(-len(x) // cells[d]))) if cells[d] > 1 else (T.Tree().arrays(), None)
        leaves = np.flatnonzero(tree[0] < 0)
        number = np.full(len(tree[0]), -1)
        number[leaves] = n + np.arange(len(leaves))
        n += len(leaves)
        out.append(_Unit(shared, d, _columns(d & ~s, ncol), tree, number))
    return out


def _visiting(r: int, units: list[_Unit]) -> list[int]:
    """The spaces in which receivers of the pattern ``r`` have donors."""
    return [i for i, u in enumerate(units) if r & u.donor == sum(1 << c for c in u.shared)]


def knn_impute(df: DataFrame, key: str, cols: list[str], k: int = 5, block: int = 256, rounds: tuple[int, ...] = (1,),
               cell: int | None = None) -> DataFrame:
    """kNN imputation with the missing-aware Euclidean distance (K7, C4).

    For every (row, missing column) the donors are the rows having that
    column; distance = sqrt(n_cols / n_common * sum over coordinates present
    in both of the squared difference); the fill is the mean of the column
    over the ``k`` nearest donors (by distance rounded to 6 decimals, then
    key).  A row sharing no coordinate with any donor gets the column mean.

    Donors are dealt to cells of about ``cell`` rows (128 blocks) in each space
    of shared columns (see the module) and compared in leaves of a quarter
    ``block``.  With ``rounds`` every receiver first gets bounds from its own cells;
    without, it visits all.  ``LAST_STATS`` has the receivers, the donors and the
    donor rows compared per receiver in the search within the bounds."""
    ncol = len(cols)
    full = (1 << ncol) - 1
    vcols, bcols = [f"_c{i}" for i in range(ncol)], [f"_b{i}" for i in range(ncol)]
    rows = cut_lineage(_patterns(df, key, cols))
    mean = list(df.agg(*[F.avg(F.col(c).cast("double")) for c in cols]).first())
    counts = {r["mask"]: r["n"] for r in rows.groupBy("mask").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_receivers, n_donors = sum(n for m, n in counts.items() if m != full), sum(n for m, n in counts.items() if m)
    LAST_STATS.clear()
    if not n_receivers:
        return df
    if not n_donors:
        return df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])
    leaf = max(4, block // 4)
    units = _units(rows, counts, ncol, cell or 128 * block)
    asks = {r: _visiting(r, units) for r in counts if r != full}
    spaces = [(u.shared, u.targets, ncol / len(u.shared)) for u in units]
    owner = np.concatenate([np.zeros(0, np.int64), *[np.full(int((u.cells >= 0).sum()), i) for i, u in enumerate(units)]])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _held(batches, DEALT):
            keys, mask, vals = t.column("_k").to_numpy(), t.column("mask").to_numpy(), _values(t, vcols)
            for u in units:
                own = np.flatnonzero(mask == u.donor)
                if len(own):
                    own = own[_few_equal(keys[own], vals[own][:, u.shared], k)]
                    at = u.cells[T.leaves_of(u.tree, vals[own][:, u.shared].T, raw=True)]
                    yield _by_cell(at, keys[own], vals[own])

    donors = cut_lineage(rows.where("mask <> 0").mapInArrow(deal, _SENT))

    def box(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [_matrix(x, ncol) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(_lists(np.array([f(np.where(np.isnan(x), 0.0, x), axis=0) for x in v]).reshape(-1, ncol))
                                                            for f in (np.min, np.max))], names=["cell", "lo", "hi"])

    boxes = donors.select("cell", "vals").mapInArrow(box, "cell int, lo array<double>, hi array<double>").groupBy("cell").agg(
        *[F.array(*[f(F.col(c)[i]) for i in range(ncol)]).alias(c) for c, f in (("lo", F.min), ("hi", F.max))]).collect()
    ends = {r["cell"]: (r["lo"], r["hi"]) for r in boxes}
    for u in units:
        lo, hi = np.full((len(u.cells), len(u.shared)), np.inf), np.full((len(u.cells), len(u.shared)), -np.inf)
        for i, c in enumerate(u.cells.tolist()):
            if c in ends:
                lo[i], hi[i] = (np.array(x)[u.shared] for x in ends[c])
        u.lo, u.hi = _node_boxes(u.tree, lo, hi)

    # The space that gives a target its first bounds: the one with most donors.
    first = {r: sorted({max((i for i in us if c in units[i].targets), key=lambda i: (counts[units[i].donor], -i))
                        for c in _columns(full & ~r, ncol) if any(c in units[i].targets for i in us)}) for r, us in asks.items()}
    receivers = rows.where((F.col("mask") != full) & (F.col("mask") != 0))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _held(batches, DEALT):
            keys, mask, vals = t.column("_k").to_numpy(), t.column("mask").to_numpy(), _values(t, vcols)
            for r, us in first.items():
                own = np.flatnonzero(mask == r)
                for i in us if len(own) else ():
                    u = units[i]
                    yield _by_cell(u.cells[T.leaves_of(u.tree, vals[own][:, u.shared].T, raw=True)], keys[own], vals[own])

    def bounds(asked: pa.Table, given: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({c: pa.array([], k) for c, k in (("_k", pa.int64()), *((c, pa.float64()) for c in (*vcols, *bcols)))})
        shared, targets, factor = spaces[owner[asked.column("cell")[0].as_py()]]
        qk, qv = _rows_of(asked, ncol)
        reach = np.full((len(qk), ncol), np.inf)
        if given.num_rows:
            dk, dv = _rows_of(given, ncol)
            own = _few_equal(dk, dv[:, shared], k)
            (at, _, dist), _ = _cell_search(qv[:, shared], None, dk[own], dv[own][:, shared], k, leaf, factor)
            last = np.arange(len(at)) - np.searchsorted(at, at) == k - 1
            reach[np.ix_(at[last], targets)] = dist[last][:, None] + 10.0 ** -ROUND
        return pa.table({"_k": qk, **{c: qv[:, i] for i, c in enumerate(vcols)}, **{c: reach[:, i] for i, c in enumerate(bcols)}})

    if rounds:
        at_home = sorted({i for us in first.values() for i in us})
        mine = donors.where(F.col("cell").isin(np.flatnonzero(np.isin(owner, at_home)).tolist())) if len(at_home) < len(units) else donors
        bounded = receivers.mapInArrow(homes, _SENT).groupBy("cell").cogroup(mine.groupBy("cell")).applyInArrow(
            bounds, ", ".join(["_k long", *[f"{c} double" for c in (*vcols, *bcols)]]))
        if any(len(us) > 1 for us in first.values()):
            bounded = bounded.groupBy("_k").agg(*[F.first(c).alias(c) for c in vcols], *[F.min(c).alias(c) for c in bcols])
    else:
        bounded = receivers.select("_k", *vcols, *[F.lit(float("inf")).alias(c) for c in bcols])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _held(batches, DEALT):
            keys, vals, reach = t.column("_k").to_numpy(), _values(t, vcols), _values(t, bcols)
            mask = (~np.isnan(vals)) @ (1 << np.arange(ncol))
            for r, us in asks.items():
                own = np.flatnonzero(mask == r)
                for i in us if len(own) else ():
                    u = units[i]
                    limit = reach[own][:, u.targets].max(1) + 2 * 10.0 ** -ROUND
                    row, node = _reached(u.tree, u.lo, u.hi, vals[own][:, u.shared], limit * limit * len(u.shared) / ncol * (1 + 1e-12))
                    yield _by_cell(u.cells[node], keys[own[row]], np.column_stack([vals[own[row]], reach[own[row]]]))

    def compare(asked: pa.Table, given: pa.Table) -> pa.Table:
        names = ["rk", "ci", "dk", "dist", "val"]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
        if asked.num_rows and given.num_rows:
            shared, targets, factor = spaces[owner[asked.column("cell")[0].as_py()]]
            qk, q = _rows_of(asked, 2 * ncol)
            reach = q[:, ncol:]
            dk, dv = _rows_of(given, ncol)
            own = _few_equal(dk, dv[:, shared], k)
            dk, dv = dk[own], dv[own]
            (at, who, dist), compared = _cell_search(q[:, shared], reach[:, targets].max(1), dk, dv[:, shared], k, leaf, factor)
            out.append((np.zeros(1, np.int64), np.full(1, -1, np.int32), np.zeros(1, np.int64), np.zeros(1), np.array([float(compared)])))
            for c in targets:
                near = dist <= reach[at, c] + 2 * 10.0 ** -ROUND
                out.append((qk[at[near]], np.full(int(near.sum()), c, np.int32), dk[who[near]], dist[near], dv[who[near], c]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out)], names=names)

    cand = cut_lineage(bounded.mapInArrow(visits, _SENT).groupBy("cell").cogroup(donors.groupBy("cell")).applyInArrow(
        compare, "rk long, ci int, dk long, dist double, val double"))
    compared = cand.where("ci = -1").agg(F.sum("val")).first()[0]
    LAST_STATS.update(receivers=int(n_receivers), donors=int(n_donors), compared_per_receiver=(compared or 0.0) / n_receivers)
    w = Window.partitionBy("rk", "ci").orderBy("dist", "dk")
    best = cand.where("ci >= 0").repartition("rk").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    fills = best.groupBy("rk").agg(*[F.avg(F.when(F.col("ci") == i, F.col("val"))).alias(f"_fill_{i}") for i in range(ncol)])
    out = df.join(fills, F.col(key).cast("long") == F.col("rk"), "left")
    return out.select(*[
        F.coalesce(F.col(c).cast("double"), F.col(f"_fill_{cols.index(c)}"), F.lit(mean[cols.index(c)])).alias(c)
        if c in cols else F.col(c) for c in df.columns])
