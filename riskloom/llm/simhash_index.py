"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints (64 bits, one per document) are reduced to their distinct
values, then searched for pairs within ``max_bits`` differing bits:

* Upper nodes factor a shared masked bit pattern.  The root has the empty
  mask; a node with more than ``node_limit`` fingerprints is split into
  ``max_bits + 1`` children masks, each fixing one block of the bits that are
  still free.  Two fingerprints within ``max_bits`` bits agree on at least one
  of those blocks, so every pair meets in some child.  A node with f free
  bits holds at most 2^f distinct fingerprints, so splitting ends.
* Inside a node, fingerprints are sorted by Gray rank and cut into leaves;
  each leaf, and each run of leaves above it, stores the bits its members
  share.  Two groups are compared through the differences accumulated on the
  bits both factor out; more than ``max_bits`` prunes all their pairs.

Links become a spanning forest per node, and components are found over the
whole corpus with star rounds.  No pair list of a dense group is emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_position, Scratch, components, fold_labels, prepare, ranges, small_enough

LEAF = 32
FAN = 16
PAIR_CHUNK = 1 << 20


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of one text (null or no words: 0).

    Words are runs of bytes other than space and 0x09-0x0D after lower-casing
    A-Z; a text with fewer words than a shingle is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, seed)]
    else:
        ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
        starts = [0] + [e + 1 for e in ends[:-shingle]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[s:e], seed) for s, e in zip(starts, ends[shingle - 1:])]
    n, ones = len(hashes), np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        h = np.array(hashes[lo:lo + (1 << 16)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["id", "fp"])

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of a code word in the reflected Gray sequence."""
    r = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def child_masks(mask: int, parts: int) -> list[int]:
    """Masks of a node's children: each adds one block of the free bits."""
    free = [i for i in range(63, -1, -1) if not mask >> i & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def _patterns(fp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shared bits, their values) of each run beginning at ``starts``."""
    lo, hi = np.bitwise_and.reduceat(fp, starts), np.bitwise_or.reduceat(fp, starts)
    shared = ~(lo ^ hi)
    return shared, lo & shared


def _close_groups(a: np.ndarray, b: np.ndarray, shared: np.ndarray, value: np.ndarray, max_bits: int) -> np.ndarray:
    return np.bitwise_count((value[a] ^ value[b]) & shared[a] & shared[b]) <= max_bits


def _pairs(n_of: np.ndarray, start_of: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Member index pairs (i < j) of the group pairs (a <= b), in chunks."""
    counts = n_of[a] * n_of[b]
    cuts = np.flatnonzero(np.diff(np.cumsum(counts) // PAIR_CHUNK, prepend=0))
    for part in np.split(np.arange(len(a)), cuts):
        if not len(part):
            continue
        pa_, pb, c = a[part], b[part], counts[part]
        k = ranges(np.zeros(len(part), np.int64), c)
        nb = np.repeat(n_of[pb], c)
        i = np.repeat(start_of[pa_], c) + k // nb
        j = np.repeat(start_of[pb], c) + k % nb
        keep = i < j
        yield i[keep], j[keep]


def node_forest(mask: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the pairs within ``max_bits`` bits inside each node
    (mask, fp & mask): arrays (fingerprint, root fingerprint)."""
    key = fp & mask
    order = np.lexsort((gray_rank(fp), key, mask))
    mask, fp, key = mask[order], fp[order], key[order]
    n = len(fp)
    new = np.ones(n, bool)
    new[1:] = (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])
    node_start = np.flatnonzero(new)
    node_len = np.diff(np.append(node_start, n))
    # Leaves: runs of LEAF in Gray order that do not cross nodes; above them runs of FAN groups.
    levels = []
    start, length, node_of = node_start, node_len, np.arange(len(node_start))
    per = -(-length // LEAF)
    first_leaf = np.cumsum(per) - per
    leaf_node = np.repeat(node_of, per)
    leaf_start = start[leaf_node] + (np.arange(per.sum()) - first_leaf[leaf_node]) * LEAF
    levels.append((leaf_start, leaf_node, None))
    while True:
        g_start, g_node, _ = levels[-1]
        per = np.bincount(g_node, minlength=len(node_start))
        if per.max() <= FAN:
            break
        up = -(-per // FAN)
        first_up, first_g = np.cumsum(up) - up, np.cumsum(per) - per
        up_node = np.repeat(node_of, up)
        child = first_g[up_node] + (np.arange(up.sum()) - first_up[up_node]) * FAN
        levels.append((g_start[child], up_node, child))
    pats = [_patterns(fp, s) for s, _, _ in levels]
    labels = np.arange(n)
    # All pairs of the top groups of one node, a <= b (at most FAN groups a node).
    top_node = levels[-1][1]
    per = np.bincount(top_node, minlength=len(node_start))
    base = (np.cumsum(per) - per)[top_node]
    rest = per[top_node] - (np.arange(len(top_node)) - base)
    a = np.repeat(np.arange(len(top_node)), rest)
    b = ranges(np.arange(len(top_node)), rest)
    work = [(len(levels) - 1, a, b)]
    while work:
        lv, a, b = work.pop()
        near = (a == b) | _close_groups(a, b, *pats[lv], max_bits)
        a, b = a[near], b[near]
        if not len(a):
            continue
        if lv:
            child = levels[lv][2]
            cnt = np.diff(np.append(child, len(levels[lv - 1][0])))
            for x, y in _all_pairs(cnt, child, a, b):
                work.append((lv - 1, x, y))
            continue
        cnt = np.diff(np.append(levels[0][0], n))
        for i, j in _pairs(cnt, levels[0][0], a, b):
            link = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
            labels = fold_labels(labels, i[link], j[link])
    linked = labels != np.arange(n)
    return fp[linked], fp[labels[linked]]


def _all_pairs(n_of, start_of, a, b):
    """Child group pairs, x <= y, of the group pairs (a <= b)."""
    counts = n_of[a] * n_of[b]
    cuts = np.flatnonzero(np.diff(np.cumsum(counts) // PAIR_CHUNK, prepend=0))
    for part in np.split(np.arange(len(a)), cuts):
        if not len(part):
            continue
        c = counts[part]
        k = ranges(np.zeros(len(part), np.int64), c)
        nb = np.repeat(n_of[b[part]], c)
        x = np.repeat(start_of[a[part]], c) + k // nb
        y = np.repeat(start_of[b[part]], c) + k % nb
        keep = x <= y
        yield x[keep], y[keep]


def near_links(scratch: Scratch, codes: DataFrame, max_bits: int = 3, node_limit: int = 16384,
               bucket_rows: int = 65536) -> DataFrame:
    """Spanning links (a, b) of all pairs of distinct ``fp`` values within
    ``max_bits`` bits, searched node by node."""
    parts = max_bits + 1
    small, masks = [], [0]
    cur, n = codes.select(F.lit(0).cast("long").alias("mask"), "fp"), codes.count()
    root = n > node_limit
    while root:
        kids = {m: child_masks(m, parts) for m in masks}
        masks = sorted({c for v in kids.values() for c in v})
        # One literal table of the masks of this level (parts ** level entries).
        expr = "CASE mask " + " ".join(
            f"WHEN {_signed(m)}L THEN array({', '.join(f'{_signed(c)}L' for c in v)})" for m, v in kids.items()) + " END"
        cur = cur.select(F.explode(F.expr(expr)).alias("mask"), "fp")
        size = cur.groupBy("mask", F.expr("fp & mask").alias("pat")).count()
        hot = scratch.write(size.filter(F.col("count") > node_limit).select("mask", "pat"))
        tagged = cur.withColumn("pat", F.expr("fp & mask"))
        if not hot.take(1):
            small.append(tagged.select("mask", "fp"))
            break
        small.append(tagged.join(hot, ["mask", "pat"], "left_anti").select("mask", "fp"))
        cur = scratch.write(tagged.join(hot, ["mask", "pat"], "left_semi").select("mask", "fp"))
        masks = [r[0] & (1 << 64) - 1 for r in hot.select("mask").distinct().collect()]  # at most parts ** level
    nodes = cur if not root else small[0]
    for s in small[1:]:
        nodes = nodes.union(s)

    def search(t: pa.Table) -> pa.Table:
        m = t.column("mask").to_numpy().view(np.uint64)
        f = t.column("fp").to_numpy().view(np.uint64)
        a, b = node_forest(m, f, max_bits)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    buckets = max(1, parts * n // bucket_rows)
    dealt = nodes.withColumn("bucket", F.expr(f"pmod(xxhash64(mask, fp & mask), {buckets})"))
    return dealt.groupBy("bucket").applyInArrow(search, "a long, b long")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                max_bits: int = 3, node_limit: int = 16384) -> DataFrame:
    """One row per input row: id, fp (signed long), root (the component's
    smallest signed fingerprint) and component_id (the smallest id reachable
    through links, itself included; null only if every id there is null).

    Null and empty texts have fingerprint 0 and link like any other; repeated
    rows stay separate rows; other columns of the input are not read; an
    empty table gives an empty result."""
    spark = df.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "simhash")
    rows = scratch.write(fingerprints(df, id_col, text_col, shingle))
    codes = scratch.write(rows.groupBy("fp").agg(F.min("id").alias("low")))
    tree = components(scratch, near_links(scratch, codes, max_bits, node_limit))
    rooted = codes.join(tree, codes.fp == tree.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = rooted.join(lowest, "root").select("fp", "root", "component_id")
    return rows.join(classes, "fp").select("id", "fp", "root", "component_id")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       max_bits: int = 3) -> DataFrame:
    """(id_col, fingerprint as 16 hex digits, component_id) per input row."""
    g = near_groups(df, id_col, text_col, shingle, max_bits)
    return g.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                         max_bits: int = 3) -> DataFrame:
    """The input's rows, one for each component: the row with the smallest id
    (null ids last, then the smallest fingerprint and text).

    Null and empty texts are one component; of rows that repeat an id those
    with the representative's fingerprint come down to the smallest row; texts
    of any length count whole; an empty table gives an empty result.  Other
    columns pass through under any name, dotted or clashing."""
    names = df.columns
    return _representatives(by_position(df), f"c{names.index(id_col)}", f"c{names.index(text_col)}", shingle, max_bits).toDF(*names)


def _representatives(df: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> DataFrame:
    spark = df.sparkSession
    scratch = Scratch(spark, "simhash-keep")
    g = scratch.write(near_groups(df, id_col, text_col, shingle, max_bits))
    rank = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("fp").alias("fp"))
    reps = scratch.write(g.groupBy("root").agg(F.min(rank).alias("r")).select("r.id", "r.fp"))
    # Ids are usually unique: then the id alone tells which rows go, and no text is compared.
    counted = g.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("fp"))
    repeated = scratch.write(counted.filter("n > 1").select("id"))
    gone = scratch.write(counted.join(reps, ["id", "fp"], "left_anti").select("id").union(repeated).distinct())
    key = df[id_col].cast("long")
    kept = df.filter(key.isNotNull()).join(small_enough(gone.withColumnRenamed("id", "_gone")), key == F.col("_gone"), "left_anti")
    null_id = g.filter("id IS NULL").take(1)
    if not null_id and not repeated.take(1):
        return kept

    def refp(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(text_col)], np.uint64).view(np.int64)
            yield b.append_column("_fp", pa.array(fps))

    odd = df.filter(key.isNull()).unionByName(
        df.join(small_enough(repeated.withColumnRenamed("id", "_again")), key == F.col("_again"), "left_semi"))
    schema = T.StructType([*odd.schema.fields, T.StructField("_fp", T.LongType())])
    text_first = [text_col] + [c for c in df.columns if c != text_col]
    one = (odd.mapInArrow(refp, schema)
           .join(reps.select(F.col("id").alias("_rid"), F.col("fp").alias("_rfp")),
                 (F.col("_fp") == F.col("_rfp")) & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_rid")), "left_semi")
           .groupBy(id_col, "_fp").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in text_first])).alias("r"))
           .select(*[F.col(f"r.`{c}`").alias(c) for c in df.columns]))
    return kept.unionByName(one)
