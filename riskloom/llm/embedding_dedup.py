"""Embedding near-duplicates: spherical k-means cells, blocked cosine products.

Cells have two levels, both fitted on bounded samples, and their number grows
with the rows: about sqrt(n / cell_rows) top cells, each cut into one cell for
every ``cell_rows`` of its own vectors.  Every vector is assigned.  Pairs within
``min_cosine`` can lie on both sides of a border, so a vector also visits each
later cell that could hold a partner: with unit centres c and d, y in cell d
(so y.d >= y.c) within the angle t = acos(min_cosine) of x has

    x.(c - d) <= sin(t) |c - d|      and      angle(x, d) <= radius(d) + t.

The test is taken between top cells, then between the cells of each top cell
that is left.  No pair is lost.

Consecutive cells of a top cell are shipped together, ``block`` vectors at a time
(a host); a visitor is sent to a host once, with the list of its cells there.
Inside the task only a cell and its visitors are multiplied, in double
precision and in tiles; it returns link counts and a spanning forest, not pairs.
Equal vectors are merged first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, components, fold_labels, prepare

SLICE_BYTES = 64 << 20  # centres that are broadcast at once
HOST_BYTES = 32 << 20  # vectors of a host, as doubles
TILE = 2048


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centres of unit rows ``x``."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[lo:lo + TILE] @ centres.T).argmax(1) for lo in range(0, len(x), TILE)])
        total = np.zeros_like(centres)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1)
        centres[norm > 1e-12] = total[norm > 1e-12] / norm[norm > 1e-12, None]
    return centres


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Packed vectors (of single or double precision) as rows of doubles."""
    raw = b"".join(col.to_pylist())
    kind = np.float32 if len(raw) == 4 * dim * len(col) else np.float64
    return np.frombuffer(raw, kind).reshape(-1, dim).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def near_pairs(x: np.ndarray, y: np.ndarray, min_cosine: float) -> np.ndarray:
    """Boolean matrix: cosine >= min_cosine of rows of x and y, in double
    precision; pairs at the bound are summed once more one by one."""
    size = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
    cos = (x @ y.T) / size
    near = cos >= min_cosine
    i, j = np.nonzero(np.abs(cos - min_cosine) <= 1e-9)
    near[i, j] = np.einsum("ij,ij->i", x[i], y[j]) / size[i, j] >= min_cosine
    return near


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", min_cosine: float = 0.95,
                 cell_rows: int = 2048, block: int = 16384, sample_rows: int = 16384,
                 slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per input row: id, n_links (other rows linked directly),
    component_id (smallest id reachable), kept (id = component_id).

    A vector that is null, empty, zero, or holds null or non-finite components
    links with nothing, not even an equal one: it is its own component.
    Vectors of different lengths do not link.  Rows that repeat an id are
    vectors of their own; with a null id a row counts as linked but never
    names a component unless all ids of it are null, and it is kept only
    then.  Other columns are not read; an empty table gives an empty result.

    ``sample_rows`` bounds the vectors that the top centres, and on average
    those that the centres inside one top cell, are fitted on."""
    if not 4 <= sample_rows <= 1 << 17:
        raise ValueError("sample_rows must lie between 4 and 131072")
    spark = df.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "cosine")
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("v"))
    kind = src.schema["v"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    if not single:
        src = src.withColumn("v", F.col("v").cast("array<double>"))
    usable = F.expr("""v IS NOT NULL AND size(v) > 0 AND NOT exists(v, a -> a IS NULL OR isnan(a) OR abs(a) = double('Infinity'))
                       AND exists(v, a -> a <> 0)""")
    id_type = src.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, dims = [], []
            for v in b.column(1):
                if v.values is None:
                    raw.append(None)
                    dims.append(None)
                    continue
                a = v.values.to_numpy(zero_copy_only=False)
                if not single:  # a power of two is exact, and squares then neither overflow nor vanish
                    a = np.ldexp(a, -int(np.frexp(np.abs(a).max())[1]))
                raw.append((a + a.dtype.type(0)).tobytes())  # -0 as 0
                dims.append(len(a))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], names=["id", "dim", "x"])

    rows = scratch.write(src.select("id", F.when(usable, F.col("v")).alias("v")).mapInArrow(pack, f"id {id_type}, dim int, x binary")
                         .withColumn("key", F.expr("unhex(sha2(x, 256))")))
    vectors = scratch.write(rows.filter("x IS NOT NULL").groupBy("dim", "key").agg(
        F.min("id").alias("low"), F.count(F.lit(1)).alias("times"), F.first("x").alias("x")).withColumn("nid", F.monotonically_increasing_id()))
    packed = vectors.select("nid", "dim", "x", "times")
    tree = None
    # Vectors of another length can never link; lengths are few (one, as a rule).
    for dim, n in [tuple(r) for r in packed.groupBy("dim").count().collect()]:
        part = _link_dimension(scratch, packed.filter(F.col("dim") == dim).drop("dim"), dim, n, min_cosine, cell_rows, block,
                               sample_rows, slice_bytes)
        tree = part if tree is None else tree.union(part)
    if tree is None:
        links = spark.createDataFrame([], "nid long, links long")
        roots = spark.createDataFrame([], "node long, root long")
    else:
        found = scratch.write(tree)
        links = found.groupBy("nid").agg(F.sum("links").alias("links"))
        roots = components(scratch, found.select(F.col("nid").alias("a"), F.col("to").alias("b")))
    named = (vectors.select("nid", "dim", "key", "low", "times").join(links, "nid", "left")
             .join(roots, F.col("nid") == F.col("node"), "left")
             .select("dim", "key", "low", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"),
                     F.coalesce("root", "nid").alias("root")))
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = scratch.write(named.join(low, "root").select("dim", "key", "n_links", "component_id"))
    linked = rows.filter("x IS NOT NULL").select("id", "dim", "key").join(classes, ["dim", "key"]).select("id", "n_links", "component_id")
    alone = rows.filter("x IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.union(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    return out.withColumnRenamed("id", id_col)


# -- cells -----------------------------------------------------------------

def _border(x: np.ndarray, centres: np.ndarray, radius: np.ndarray, angle: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, cells) of the border test of unit rows against sibling cells;
    a radius of nan marks an empty cell."""
    dots = x @ centres.T
    best = dots.argmax(1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (centres[best] @ centres.T)))
    with np.errstate(invalid="ignore"):
        reach = np.cos(np.minimum(np.pi, radius + angle + 1e-7))
        can = (dots.max(1)[:, None] - dots <= apart * np.sin(angle) + 1e-7) & (dots >= reach[None, :])
    return np.nonzero(can)


def _visits(leaf: np.ndarray, x: np.ndarray, tops: tuple, cells: dict, angle: float) -> pa.Array:
    """For each unit row the hosts that it goes to (guest: not its own) with the
    cells to meet there: those after its own cell, and its own host in any case."""
    centres, radius = tops
    rows, at, to = [], [], []
    for lo in range(0, len(x), 1024):
        part, home = x[lo:lo + 1024], leaf[lo:lo + 1024] >> 16
        r, t = _border(part, centres, radius, angle)
        late = t >= home[r]
        r, t = r[late], t[late]
        for top in np.intersect1d(np.append(t, home), np.array(list(cells), np.int64)):
            sub, sub_radius, host = cells[top]
            here = np.union1d(r[t == top], np.flatnonzero(home == top))
            i, c = _border(part[here], sub, sub_radius, angle)
            i = here[i] + lo
            later = (top << 16) + c > leaf[i]
            own = np.flatnonzero(home == top) + lo  # at home: cell -1
            rows += [i[later], own]
            at += [host[c[later]], host[leaf[own] & 0xFFFF]]
            to += [(top << 16) + c[later], np.full(len(own), -1, np.int64)]
    r, h, c = (np.concatenate([np.zeros(0, np.int64)] + p) for p in (rows, at, to))
    order = np.lexsort((c, h, r))
    r, h, c = r[order], h[order], c[order]
    first = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (h[1:] != h[:-1]))) if len(r) else np.zeros(0, np.int64)
    keep = c >= 0
    inner = np.append(0, np.cumsum(keep))[np.append(first, len(r))].astype(np.int32)
    met = pa.StructArray.from_arrays([pa.array(h[first], pa.int64()), pa.array(c[first] >= 0),
                                      pa.ListArray.from_arrays(pa.array(inner), pa.array(c[keep].astype(np.int32)))],
                                     names=["host", "guest", "cells"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(r[first], np.arange(len(x) + 1)).astype(np.int32)), met)


def _slices(sizes: list[tuple[int, int]], limit: int) -> Iterator[tuple[int, int]]:
    """Runs lo..hi of top cells whose centres take about ``limit`` bytes."""
    lo, held = None, 0
    for i, (top, size) in enumerate(sizes):
        if lo is not None and held + size > limit:
            yield lo, sizes[i - 1][0]
            lo, held = None, 0
        lo, held = (top if lo is None else lo), held + size
    if lo is not None:
        yield lo, sizes[-1][0]


def _link_dimension(scratch: Scratch, vecs: DataFrame, dim: int, n: int, min_cosine: float, cell_rows: int, block: int,
                    sample_rows: int, slice_bytes: int) -> DataFrame:
    """(nid, links, to): link counts and spanning links of vectors of one length."""
    spark = vecs.sparkSession
    angle = float(np.arccos(min_cosine))
    block = min(block, max(256, HOST_BYTES // (8 * dim)))

    def send(value) -> Broadcast:
        return spark.sparkContext.broadcast(value)

    # Top cells: their centres are bounded by the sample.
    sample = vecs.orderBy(F.xxhash64("nid")).limit(sample_rows).select("x").toPandas()["x"]
    s = _unit(_matrix(pa.array([bytes(v) for v in sample], pa.binary()), dim))
    tops = spherical_kmeans(s, max(1, min(int(np.ceil(np.sqrt(n / cell_rows))), len(s) // 4)))
    shared = send(tops)

    def to_top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, TILE):
                part = b.slice(lo, TILE)
                dots = _unit(_matrix(part.column("x"), dim)) @ shared.value.T
                yield part.append_column("top", pa.array(dots.argmax(1).astype(np.int32))).append_column("top_dot", pa.array(dots.max(1)))

    fields = "nid long, x binary, times long"
    vecs = vecs.select("nid", "x", "times")
    at_top = scratch.write(vecs.mapInArrow(to_top, fields + ", top int, top_dot double"))
    stat = at_top.groupBy("top").agg(F.count(F.lit(1)).alias("n"), F.min("top_dot").alias("dot")).orderBy("top").collect()  # one row a top centre
    radius = np.full(len(tops), np.nan)
    for r in stat:
        radius[r["top"]] = np.arccos(np.clip(r["dot"], -1, 1))
    wanted = {r["top"]: min(max(1, -(-r["n"] // cell_rows)), sample_rows // 4) for r in stat}

    # Cells of each top cell, fitted by one task each on about sample_rows of its vectors.
    def fit(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        top = key[0].as_py()
        t = t.sort_by("nid")
        y = _unit(_matrix(t.column("x"), dim))
        c = spherical_kmeans(y, max(1, min(wanted[top], len(y) // 4)))
        return pa.table({"top": pa.array([top], pa.int32()), "centres": pa.array([c.tobytes()], pa.binary())})

    rate = spark.createDataFrame([(r["top"], min(1.0, sample_rows / r["n"])) for r in stat], "top int, rate double")
    # A top cell of a few rows must not miss all of them: at a rate of 1 none is left out.
    drawn = at_top.join(F.broadcast(rate), "top").filter(F.expr("pmod(xxhash64(nid, 5), 1048576) < rate * 1048576")).select("top", "nid", "x")
    centres = scratch.write(drawn.groupBy("top").applyInArrow(fit, "top int, centres binary"))
    runs = list(_slices([(r["top"], 8 * dim * wanted[r["top"]]) for r in stat], slice_bytes))

    def within(df: DataFrame, run: tuple[int, int]) -> DataFrame:
        return df.filter(F.col("top").between(*run))

    def assign(run: tuple[int, int]) -> DataFrame:
        held = send({r["top"]: np.frombuffer(r["centres"], np.float64).reshape(-1, dim) for r in within(centres, run).collect()})

        def to_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, TILE):
                    part = b.slice(lo, TILE)
                    x, top = _unit(_matrix(part.column("x"), dim)), part.column("top").to_numpy()
                    leaf, dot = np.empty(len(x), np.int32), np.empty(len(x))
                    for c in np.unique(top):
                        at = np.flatnonzero(top == c)
                        dots = x[at] @ held.value[c].T
                        leaf[at], dot[at] = (int(c) << 16) + dots.argmax(1), dots.max(1)
                    yield pa.RecordBatch.from_arrays([part.column(i) for i in range(4)] + [pa.array(leaf), pa.array(dot)],
                                                     names=["nid", "x", "times", "top", "leaf", "dot"])

        out = scratch.write(within(at_top, run).drop("top_dot").mapInArrow(to_cell, fields + ", top int, leaf int, dot double"))
        held.destroy()
        return out

    at_home = _union([assign(run) for run in runs])
    scratch.drop(at_top)
    # Hosts: runs of cells of one top cell that begin within the same ``block`` rows.
    before = F.sum("n").over(Window.partitionBy("top").orderBy("leaf")) - F.col("n")
    leaves = scratch.write(at_home.groupBy("top", "leaf").agg(F.count(F.lit(1)).alias("n"), F.min("dot").alias("dot"))
                           .withColumn("host", F.col("top").cast("long") * (1 << 32) + F.floor(before / block)))

    def visit(run: tuple[int, int]) -> DataFrame:
        cells = {r["top"]: np.frombuffer(r["centres"], np.float64).reshape(-1, dim) for r in within(centres, run).collect()}
        cells = {t: (c, np.full(len(c), np.nan), np.full(len(c), -1, np.int64)) for t, c in cells.items()}
        for r in within(leaves, run).collect():
            _, rad, host = cells[r["top"]]
            rad[r["leaf"] & 0xFFFF], host[r["leaf"] & 0xFFFF] = np.arccos(np.clip(r["dot"], -1, 1)), r["host"]
        held = send(((tops, radius), cells))

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    to = _visits(b.column("leaf").to_numpy().astype(np.int64), _unit(_matrix(b.column("x"), dim)), *held.value, angle)
                    yield b.append_column("visits", to)

        out = scratch.write(at_home.select("nid", "x", "times", "leaf").filter(F.shiftright("leaf", 16) <= run[1])
                            .mapInArrow(go, fields + ", leaf int, visits array<struct<host:bigint,guest:boolean,cells:array<int>>>").filter("size(visits) > 0"))
        held.destroy()
        return out

    there = _union([visit(run) for run in runs])
    member = (there.select("nid", "x", "times", "leaf", F.explode("visits").alias("v"))
              .select("nid", "x", "times", "leaf", "v.host", "v.guest", "v.cells"))
    size = scratch.write(member.groupBy("host").agg(F.sum(F.expr("int(NOT guest)")).alias("homes"), F.sum(F.expr("int(guest)")).alias("guests"))
                         .select("host", F.expr(f"int(ceil(homes / {block}))").alias("hc"), F.expr(f"int(ceil(guests / {block}))").alias("gc")))
    tasks = F.expr("""if(guest, transform(sequence(0, hc - 1), i -> named_struct('i', i, 'j', own)),
                      concat(transform(sequence(0, hc - 1), j -> named_struct('i', least(own, j), 'j', greatest(own, j))),
                             if(gc > 0, transform(sequence(0, gc - 1), j -> named_struct('i', own, 'j', -1 - j)), array())))""")
    rows = (member.join(size, "host").withColumn("own", F.expr("cast(pmod(xxhash64(nid), if(guest, gc, hc)) AS int)"))
            .withColumn("own", F.expr("if(guest, -1 - own, own)"))
            .select("host", "guest", "own", "nid", "times", "leaf", "cells", "x", F.explode(tasks).alias("t"))
            .select("host", "t.i", "t.j", "guest", "own", "nid", "times", "leaf", "cells", "x"))

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        x, nid, times = _matrix(t.column("x"), dim), t.column("nid").to_numpy(), t.column("times").to_numpy()
        leaf, own, m = t.column("leaf").to_numpy(), t.column("own").to_numpy(), t.num_rows
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        cells = t.column("cells")
        goes = np.repeat(np.arange(m), pc.list_value_length(cells).to_numpy())
        to = np.concatenate([np.zeros(0, np.int32)] + [c.flatten().to_numpy() for c in cells.chunks])
        links, order = np.zeros(m, np.int64), np.argsort(nid)
        rank = np.empty(m, np.int64)
        rank[order] = np.arange(m)
        labels = np.arange(m)

        def meet(a: np.ndarray, b: np.ndarray, same: bool = False) -> None:
            nonlocal labels
            for lo in range(0, len(a), TILE):
                for start in range(lo if same else 0, len(b), TILE):
                    p, q = a[lo:lo + TILE], b[start:start + TILE]
                    near = near_pairs(x[p], x[q], min_cosine)
                    if same and lo == start:
                        near = np.triu(near, 1)
                    if near.any():
                        links[p] += near @ times[q]
                        links[q] += times[p] @ near
                        r, c = np.nonzero(near)
                        labels = fold_labels(labels, rank[p[r]], rank[q[c]])

        left, right = own == i, own == j
        for c in np.unique(leaf[right if j >= i else left]):
            visitors = goes[to == c]
            if j < 0:  # guests
                meet(visitors[right[visitors]], np.flatnonzero(left & (leaf == c)))
            elif i == j:
                here = np.flatnonzero(leaf == c)
                meet(here, here, same=True)
                meet(visitors, here)
            else:
                meet(np.flatnonzero(left & (leaf == c)), np.flatnonzero(right & (leaf == c)))
                meet(visitors[left[visitors]], np.flatnonzero(right & (leaf == c)))
        if 0 <= i < j:  # visitors from the later chunk
            for c in np.unique(leaf[left]):
                visitors = goes[to == c]
                meet(visitors[right[visitors]], np.flatnonzero(left & (leaf == c)))
        k = np.flatnonzero(links)
        return pa.table({"nid": nid[k], "links": links[k], "to": nid[order[labels[rank[k]]]]})

    return rows.groupBy("host", "i", "j").applyInArrow(compare, "nid long, links long, to long")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
