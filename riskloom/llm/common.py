"""Helpers shared by the training-data operators: scratch tables in the
shared folder, Arrow plumbing and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package


def prepare(spark: SparkSession) -> str:
    """Ship the package to the Python workers and return the shared folder."""
    ship_package(spark)
    return ensure_checkpoint_dir(spark)


class Scratch:
    """Intermediate tables of one operator run, in the folder that
    ``spark.checkpoint.dir`` names.  Writing a table cuts the lineage, and the
    files outlive a lost executor.  ``drop`` removes a table whose readers
    have all been written themselves."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{prepare(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[int, str] = {}
        self.n = 0

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/t{self.n}"

    def write(self, df: DataFrame) -> DataFrame:
        p = self.path()
        df.write.option("compression", "zstd").parquet(p)
        out = self.spark.read.schema(df.schema).parquet(p)
        self.paths[id(out)] = p
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, hconf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(t)))
            p.getFileSystem(hconf).delete(p, True)


PART_BYTES = 128 << 20


def range_parts(spark: SparkSession, total_bytes: int) -> int:
    """Parts of a range shuffle of ``total_bytes``: about PART_BYTES each, and
    no fewer than the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), int(total_bytes // PART_BYTES) + 1)


def by_position(df: DataFrame) -> DataFrame:
    """The table with its columns named c0, c1, ... by position, so that no
    name of the input, dotted or clashing, meets one that an operator uses.
    ``toDF(*names)`` gives the names back."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def utf8_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without its nulls' content, and
    n+1 offsets; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    col = col.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and off[-1] else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def by_bytes(batches: Iterator[pa.RecordBatch], text: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each (a single
    longer text is a slice of its own), so memory follows the limit."""
    for b in batches:
        if not b.num_rows:
            continue
        _, off = utf8_buffers(b.column(text))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
            yield b.slice(lo, hi - lo)
            lo = hi


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(s, s + l)``."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(lens) - lens), lens)
    return np.arange(total, dtype=np.int64) + shift


def fold_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the components of ``labels`` (each entry the index of its
    component's smallest member) along the links a[i]-b[i]."""
    while len(a):
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of an undirected edge table (a, b: long) by
    alternating large-star and small-star rounds, each written to the shared
    folder.  Returns (node, root) for every node that is not its own root;
    the root is the smallest node of the component.  Degrees are reduced by
    partial aggregation before the shuffle; the joins are plain equi-joins
    that adaptive execution splits when a hub is hot."""
    cur = scratch.write(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        # small star: every edge already points to a smaller node.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").filter("u <> v").distinct())
        nxt = scratch.write(small)
        scratch.drop(cur)
        cur = nxt
        now = tuple(cur.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(u % 1000003 AS long))")).first())
        if now == mark or now[0] == 0:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


BROADCAST_ROWS = 1 << 21


def small_enough(keys: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of one or two longs, marked for broadcast if its row
    count, which is taken here, is within ``limit`` (32 MB of keys); a larger
    one is joined by shuffling both sides."""
    return F.broadcast(keys) if keys.count() <= limit else keys
