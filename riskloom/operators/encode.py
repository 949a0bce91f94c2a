"""Categorical encodings.

Level lists are data-dependent.  ``one_hot`` needs them at plan time (each
level becomes a column), so they are collected once, after a size check,
sorted, and emitted as a static projection.  ``label_encode`` does not need
them on the driver: codes are exact ranks over the distinct levels, in range
buckets of the level itself (``ordering.py``), and joined back (``lookup.py``).
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dict_map
from .lookup import attach
from .ordering import ordered_index

MAX_ONE_HOT_LEVELS = 1000


def level_list(df: DataFrame, col: str, max_levels: int = MAX_ONE_HOT_LEVELS) -> list:
    """Sorted distinct non-null levels; refuses more than ``max_levels``
    (the check reads at most max_levels + 1 rows)."""
    lv = df.select(col).where(F.col(col).isNotNull()).distinct()
    got = [r[0] for r in lv.limit(max_levels + 1).collect()]
    if len(got) > max_levels:
        raise ValueError(f"{col}: more than {max_levels} levels; use a vector encoder instead")
    return sorted(got)


def one_hot(df: DataFrame, cols: Sequence[str], levels: Mapping[str, list] | None = None,
            drop_original: bool = True, max_levels: int = MAX_ONE_HOT_LEVELS) -> DataFrame:
    """One 0/1 column ``<col>_<level>`` per level, all levels kept, NULL gives
    all zeros (J3)."""
    levels = dict(levels or {})
    new = []
    for c in cols:
        lv = levels.get(c)
        if lv is None:
            lv = level_list(df, c, max_levels)
        for v in lv:
            new.append(F.when(F.col(c) == F.lit(v), 1).otherwise(0).alias(f"{c}_{v}"))
    keep = [F.col(c) for c in df.columns if not (drop_original and c in cols)]
    return df.select(*keep, *new)


def label_codes(df: DataFrame, col: str, null_label: str | None = "nan") -> DataFrame:
    """Table (level, code): code is the 0-based rank of the level among the
    sorted distinct levels (binary string order)."""
    x = F.coalesce(F.col(col).cast("string"), F.lit(null_label)) if null_label is not None \
        else F.col(col).cast("string")
    lv = df.select(x.alias("_level")).where(F.col("_level").isNotNull()).distinct()
    ranked = ordered_index(lv, ["_level"], name="_code")
    return ranked.select("_level", (F.col("_code") - 1).cast("int").alias("_code"))


def label_encode(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None,
                 null_label: str | None = "nan", suffix: str = "") -> DataFrame:
    """Replace (or add, with ``suffix``) each column by its label code.

    Fitted on ``fit`` (default: ``df``); a level unseen at fit time gets
    NULL.  With ``null_label`` a missing value is encoded as that text, as a
    string cast of NaN does in the reference.
    """
    fit = fit if fit is not None else df
    out = df
    for c in cols:
        codes = label_codes(fit, c, null_label)
        key = F.coalesce(F.col(c).cast("string"), F.lit(null_label)) if null_label is not None \
            else F.col(c).cast("string")
        out = attach(out.withColumn("_level", key), codes, ["_level"]).drop("_level")
        out = out.withColumn(c + suffix, F.col("_code")).drop("_code")
    return out


def ordinal_encode(df: DataFrame, scales: Mapping[str, Mapping[str, int]], default: int = 0,
                   suffix: str = "") -> DataFrame:
    """Map ordered quality labels to integers, unmapped gives ``default``."""
    return df.withColumns({c + suffix: dict_map(c, m, default) for c, m in scales.items()
                           if c in df.columns})


def freq_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Attach the number of rows sharing the value (C1); NULL value gives NULL.

    A partial aggregate per value, then a measured join back (``lookup.py``)."""
    counts = (df.where(F.col(col).isNotNull()).groupBy(col)
              .agg(F.count(F.lit(1)).alias(out or f"{col}_count")))
    return attach(df, counts, [col])
