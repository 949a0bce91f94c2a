"""Sharding by extendible hashing, in DataFrame operations only.

A row's address is 60 hash bits: 48 of its key, then 12 that tell rows of one
key apart.  A bucket of the directory is a hash prefix; it splits on the next
bit only while it is over the byte limit and has more than one row.  Sizes are
first summed by a prefix a few bits longer than an even spread would need, and
the directory above that depth follows from these sums alone.  Buckets that are
still too large there (hot keys) are searched again, deeper, by themselves.  A
bucket that is too large with all 60 bits equal goes on splitting on the 64 bits
of a one-to-one hash of the row number, in which no two rows agree.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, prepare

KEY_BITS, TIE_BITS = 48, 12
BITS = KEY_BITS + TIE_BITS
ROW_BITS = 64
STEP = 6


def address(*key: str):
    """The 60 address bits of the key columns as a non-negative long."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\x00")) for k in key])
    high = F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")
    return high * (1 << TIE_BITS) + F.expr(f"pmod(xxhash64(monotonically_increasing_id()), {1 << TIE_BITS})")


def row_bits():
    """64 bits that differ between any two rows (xxhash64 maps longs one to one)."""
    return F.expr("xxhash64(monotonically_increasing_id())")


def _directory(sizes: DataFrame, tree: list[str], top: int, leaf: int, limit: int) -> DataFrame:
    """Buckets (depth, prefix, bytes, rows, over) that split no further, from
    the sums at depth ``leaf``, for trees whose root is at depth ``top``; the
    columns ``tree`` tell trees of equal prefixes apart."""
    node = [*tree, "depth", "prefix"]
    nodes = (sizes.select(F.explode(F.sequence(F.lit(top), F.lit(leaf))).alias("depth"), *tree, "prefix", "bytes", "rows")
             .select(*tree, "depth", F.expr(f"shiftrightunsigned(prefix, {leaf} - depth)").alias("prefix"), "bytes", "rows")
             .groupBy(*node).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
             .withColumn("over", F.expr(f"bytes > {limit} AND rows > 1")))
    # The parents that split: each is found again from its own row, so a node needs no sibling.
    parents = nodes.filter("over").select(*tree, (F.col("depth") + 1).alias("depth"), F.explode(F.array(
        F.shiftleft("prefix", 1), F.shiftleft("prefix", 1) + 1)).alias("prefix"), F.lit(True).alias("split"))
    below = nodes.join(parents, node, "left")
    return below.filter(((F.col("depth") == top) | F.col("split")) & (~F.col("over") | (F.col("depth") == leaf))).select(
        *node, "bytes", "rows", "over")


def assign_shards(df: DataFrame, key: list[str], text_col: str, limit: int, id_col: str | None = None) -> DataFrame:
    """One row per input row: the key columns (or ``id_col``), depth and
    prefix of its shard, and the shard's bytes and rows.

    No shard exceeds ``limit`` UTF-8 bytes of text unless it is a single row
    that does by itself.  A null text has no bytes; a null key is a key of its
    own; rows that repeat a key share its 48 bits and are told apart by the
    other 12, then by 64 bits of their own; a shard deeper than 60 bits, whose
    address exceeds a long, has a negative number as its prefix (unique within
    its depth); an empty table has no shard.  Other columns are not read."""
    prepare(df.sparkSession)
    scratch = Scratch(df.sparkSession, "shards")
    ids = [id_col] if id_col else key
    rows = scratch.write(df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(ids)], address(*key).alias("h"),
                                   row_bits().alias("own"), F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long").alias("size")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    left, done, names = rows, [], [f"k{i}" for i in range(len(ids))]
    # First the address; rows that are left then have whole addresses in common, each a tree of its own.
    for word, bits, tree in (("h", BITS, []), ("own", ROW_BITS, ["h"])):
        top, more = 0, True
        while more and top < bits:
            first = math.ceil(math.log2(max(1, total) / limit + 1)) + 3 if not tree and not top else 0
            deep = min(bits, max(top + STEP, first))
            at = F.shiftrightunsigned(word, bits - deep)
            sums = left.groupBy(*tree, at.alias("prefix")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
            found = scratch.write(_directory(sums, tree, top, deep, limit))
            final = found.filter("NOT over").withColumn("name", F.col("prefix"))
            if tree:
                final = scratch.write(final.withColumn("name", -1 - F.monotonically_increasing_id()))
            # Every bucket as the leaves that it covers, for an equi-join with the rows.
            leaves = final.select(*tree, (F.col("depth") + (BITS if tree else 0)).alias("depth"), "name", "bytes", "rows", F.expr(
                f"explode(sequence(shiftleft(prefix, {deep} - depth), shiftleft(prefix, {deep} - depth) + (shiftleft(1L, {deep} - depth) - 1)))").alias("leaf"))
            here = left.withColumn("leaf", at)
            done.append(here.join(leaves, [*tree, "leaf"]).select(*names, "depth", F.col("name").alias("prefix"), "bytes", "rows"))
            over = found.filter("over").select(*tree, F.col("prefix").alias("leaf"))
            more = bool(over.take(1))
            if more:
                left, top = scratch.write(here.join(over, [*tree, "leaf"], "left_semi").drop("leaf")), deep
        if not more:
            break
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(ids)], "depth", "prefix",
                      F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"))
