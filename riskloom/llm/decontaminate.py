"""Benchmark decontamination as a prefix-filtered set join.

Every run of ``window`` item words (a shorter item is one run) is a set of word
shingles.  All shingles of a run must occur for the run to occur, so the
necessary prefix, with shingles ordered by rarity over the whole corpus, is the
single rarest one.  Documents and runs are joined on that shingle; a length
bound (the document has as many words as the run) and positional bounds (the
run fits around the shingle's place) come before the exact comparison of the
words.

The corpus is read twice, once for shingle frequencies and once for the join
candidates.  What goes to the tasks is a bitmap of shingle hashes with a fixed
size, whatever the number of items; the tables themselves meet in ordinary
Spark joins, which broadcast only below the session's threshold and split hot
keys otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, by_bytes, by_position, prepare, small_enough, utf8_buffers

BITMAP_BITS = 1 << 26  # 8 MB
SHINGLE = 3
BATCH = 1 << 20
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_BYTE = (np.random.default_rng(30).integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# A word byte: 0-9, a-z (after lower-casing), or any byte of a non-ASCII character.
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


class Words:
    """The words of a batch of texts: byte ranges, text index and hash."""

    def __init__(self, col: pa.Array):
        data, off = utf8_buffers(col)
        self.n_texts = len(off) - 1
        # One blank after each text keeps words of neighbours apart.
        sep = off[1:] + np.arange(self.n_texts)
        self.data = np.full(len(data) + self.n_texts, 32, np.uint8)
        place = np.ones(len(self.data), bool)
        place[sep] = False
        self.data[place] = _LOWER[data]
        inside = _IS_WORD[self.data]
        edge = np.diff(inside.astype(np.int8), prepend=0)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.text = np.searchsorted(sep, self.start)
        self.first = np.searchsorted(self.text, np.arange(self.n_texts + 1))
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * _powers(_MULT, n), out=total[1:])
        h = (total[self.end] - total[self.start]) * _powers(_INV, n + 1)[self.start]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        self.hash = h ^ (h >> np.uint64(32))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of ``size`` words within one text."""
        k = len(self.hash) - size + 1
        if k <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = np.full(k, size, np.uint64)
        for i in range(size):
            h = h * np.uint64(_MULT) + self.hash[i:i + k]
            h ^= h >> np.uint64(29)
        at = np.flatnonzero(self.text[:k] == self.text[size - 1:])
        return at, h[at].view(np.int64)

    def line(self, a: int, b: int) -> str:
        """Words a..b-1, separated by single blanks."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b])).decode()


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item_id, win, n): the runs of each item, as single-blank lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1, BATCH):
            w = Words(b.column(1))
            ids = b.column(0).to_pylist()
            rows = []
            for t in range(w.n_texts):
                a, e = int(w.first[t]), int(w.first[t + 1])
                size = min(window, e - a)
                rows += [(ids[t], w.line(i, i + size), size) for i in range(a, e - size + 1) if size]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                                              pa.array([r[2] for r in rows], pa.int32())], names=["item_id", "win", "n"])

    return items.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")).mapInArrow(
        run, "item_id string, win string, n int")


def window_shingles(wins: DataFrame) -> DataFrame:
    """(win, n, h, off) of the distinct runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 0, BATCH):
            w = Words(b.column(0))
            n = b.column(1).to_numpy()
            for size in np.unique(np.minimum(n, SHINGLE)):
                at, h = w.shingles(int(size))
                keep = np.minimum(n, SHINGLE)[w.text[at]] == size
                at, h = at[keep], h[keep]
                t = w.text[at]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(t)), pa.array(n[t].astype(np.int32)), pa.array(h),
                                                  pa.array((at - w.first[t]).astype(np.int32))], names=["win", "n", "h", "off"])

    return wins.select("win", "n").distinct().mapInArrow(run, "win string, n int, h long, off int")


def hash_bitmap(spark: SparkSession, hashes: DataFrame) -> np.ndarray:
    """A bitmap of BITMAP_BITS bits with a bit set for each ``h``.  It is put
    together by Spark's bitmap aggregates, so the driver gets 8 MB at most."""
    spot = F.expr(f"pmod(h, {BITMAP_BITS}L) + 1")
    rows = (hashes.select(F.bitmap_bucket_number(spot).alias("k"), F.bitmap_bit_position(spot).alias("p"))
            .groupBy("k").agg(F.bitmap_construct_agg("p").alias("m")).collect())
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["m"]), np.uint8)
        at = (r["k"] - 1) * len(part)
        out[at:at + len(part)] = part
    return out


def _in_bitmap(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    k = (h.view(np.uint64) & np.uint64(BITMAP_BITS - 1)).astype(np.int64)
    return (bitmap[k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", window: int = 13,
                  spans: bool = False) -> DataFrame:
    """One row per document row: id, row hash ``text_hash`` (xxhash64 of the
    text), n_words, n_hit, n_items, items_sha256, contaminated and, with
    ``spans``, hit_spans (array of first word and length of each occurrence).

    A document word is hit if it lies inside any occurrence of a run of
    ``window`` consecutive item words (or of a whole shorter item); it is
    contaminated if n_hit > 0 and 20 * n_hit >= n_words.  Null and empty texts
    have no words; items without words have no runs; null and repeated ids
    stay separate rows; repeated items count once per item id (a null item id
    is never listed); an empty table on either side gives the rows of the
    documents without hits.  Other columns are not read."""
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "decontaminate")
    runs = scratch.write(item_windows(items, item_id_col, item_text_col, window))
    sh = scratch.write(window_shingles(runs))
    sizes = sorted(r[0] for r in sh.select(F.least("n", F.lit(SHINGLE))).distinct().collect())  # SHINGLE rows at most
    all_bits = hash_bitmap(spark, sh)
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    all_bits = spark.sparkContext.broadcast(all_bits)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 0, BATCH):
            w = Words(b.column(0))
            for size in sizes:
                _, h = w.shingles(size)
                u, c = np.unique(h[_in_bitmap(all_bits.value, h)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c.astype(np.int64))], names=["h", "c"])

    seen = src.select("text").mapInArrow(frequencies, "h long, c long").groupBy("h").agg(F.sum("c").alias("df"))
    rarest = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("h").alias("h"), F.col("off").alias("off")))
    prefix = scratch.write(sh.join(seen, "h", "left").groupBy("win", "n").agg(rarest.alias("r"))
                           .select("win", "n", "r.h", "r.off", F.xxhash64("win").alias("wid")))
    prefix_bits = spark.sparkContext.broadcast(hash_bitmap(spark, prefix))
    reach = window - 1

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1, BATCH):
            w = Words(b.column(1))
            found: list[list] = [[] for _ in range(w.n_texts)]
            for size in sizes:
                at, h = w.shingles(size)
                sel = _in_bitmap(prefix_bits.value, h)
                for i, v in zip(at[sel].tolist(), h[sel].tolist()):
                    t = int(w.text[i])
                    lo, hi = max(int(w.first[t]), i - reach), min(int(w.first[t + 1]), i + window)
                    found[t].append({"h": v, "pos": i - int(w.first[t]), "at": i - lo, "ctx": w.line(lo, hi)})
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(np.diff(w.first)),
                 pa.array(found, pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("at", pa.int32()), ("ctx", pa.string())])))],
                names=["id", "text_hash", "n_words", "cand"])

    id_type = src.schema["id"].dataType.simpleString()
    read = src.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        candidates, f"id {id_type}, text_hash long, n_words long, cand array<struct<h:long,pos:int,at:int,ctx:string>>")
    base = scratch.write(read.withColumn("row", F.monotonically_increasing_id()))
    near = base.filter(F.size("cand") > 0).select("row", "n_words", F.explode("cand").alias("c")).select("row", "n_words", "c.*")
    fits = (F.col("n") <= F.col("n_words")) & (F.col("pos") >= F.col("off")) & (F.col("pos") - F.col("off") + F.col("n") <= F.col("n_words"))
    # Length and positional bounds first, then the words themselves.
    same = F.expr("array_join(slice(split(ctx, ' '), at - off + 1, n), ' ') = win")
    hits = scratch.write(near.join(prefix, "h").filter(fits).filter(same)
                         .select("row", (F.col("pos") - F.col("off")).alias("s"), "n", "wid", "win"))
    seq = Window.partitionBy("row").orderBy("s", "n").rowsBetween(Window.unboundedPreceding, -1)
    cover = (hits.select("row", "s", "n").distinct()
             .withColumn("done", F.coalesce(F.max(F.col("s") + F.col("n")).over(seq), F.lit(0)))
             .groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("s") + F.col("n") - F.greatest("s", "done"))).cast("long").alias("n_hit"),
                                 *([F.sort_array(F.collect_list(F.array("s", "n"))).alias("hit_spans")] if spans else [])))
    owners = runs.select("item_id", "win").distinct()
    names = (hits.select("row", "win").distinct().join(owners, "win").filter("item_id IS NOT NULL").select("row", "item_id").distinct()
             .groupBy("row").agg(F.count(F.lit(1)).alias("n_items"),
                                 F.sha2(F.array_join(F.sort_array(F.collect_list("item_id")), ","), 256).alias("items_sha256")))
    out = base.select("row", "id", "text_hash", "n_words").join(cover.join(names, "row", "left"), "row", "left")
    none = hashlib.sha256(b"").hexdigest()
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(F.col("id").alias(id_col), "text_hash", "n_words", n_hit.alias("n_hit"),
                      F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                      F.coalesce("items_sha256", F.lit(none)).alias("items_sha256"),
                      ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
                      *([F.col("hit_spans")] if spans else []))


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents that are not contaminated, with all their columns under
    any name, dotted or clashing.  Null and empty texts are clean; rows that
    repeat an id are judged each by its own text, equal rows alike; without
    documents or items nothing is dropped."""
    names = docs.columns
    plain = by_position(docs)
    key, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    bad = Scratch(docs.sparkSession, "contaminated").write(
        contamination(plain, items, key, text, **kw).filter("contaminated")
        .select(F.col(key).alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct())
    same = F.col(key).eqNullSafe(F.col("bad_id")) & (F.xxhash64(F.col(text).cast("string")) == F.col("bad_hash"))
    return plain.join(small_enough(bad), same, "left_anti").toDF(*names)
