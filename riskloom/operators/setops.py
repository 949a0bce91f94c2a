"""Union of train and test tables.

Spark rows have no position, so the reference's positional re-split becomes
a ``_split`` literal carried on every row; ``split_of`` filters it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLIT = "_split"


def union_tagged(train: DataFrame, test: DataFrame, train_tag: str = "train",
                 test_tag: str = "test") -> DataFrame:
    """Union by column name; a column absent on one side is NULL there."""
    a = train.withColumn(SPLIT, F.lit(train_tag))
    b = test.withColumn(SPLIT, F.lit(test_tag))
    return a.unionByName(b, allowMissingColumns=True)


def split_of(df: DataFrame, tag: str) -> DataFrame:
    return df.where(F.col(SPLIT) == tag).drop(SPLIT)
