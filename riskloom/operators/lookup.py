"""Joins of group statistics back onto rows without a shuffle on the group key.

A hot key may hold a third of all rows, so the fact side never moves by the key
alone.  The statistics table is written to the checkpoint folder and measured:
up to ``limit`` bytes it is broadcast; beyond that the join key gets a salt,
as many values for each key as the rows of the hottest one need.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

BROADCAST_BYTES = 64 * 1024 * 1024
SALT_ROWS = 1 << 20


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], limit: int = BROADCAST_BYTES,
           copies: int | None = None) -> DataFrame:
    """``df`` left-joined with ``stats`` (one row per key) on ``keys``; NULL
    keys match nothing.  Unless given, ``copies`` is what brings the rows of the
    hottest key, which are counted, down to SALT_ROWS a task."""
    stats = cut_lineage(stats)
    size = stats.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    if size <= limit:
        return df.join(F.broadcast(stats), list(keys), "left")
    if copies is None:
        hottest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        copies = max(1, -(-hottest // SALT_ROWS))
    salt = F.expr(f"cast(pmod(xxhash64(monotonically_increasing_id()), {copies}) AS int)")
    spread = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return df.withColumn("_salt", salt).join(spread, [*keys, "_salt"], "left").drop("_salt")
