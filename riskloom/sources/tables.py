"""Table scans (A1, A2) and the NaN-to-null rule.

Missing is SQL NULL everywhere in this library.  Parquet and CSV doubles can
still carry NaN; in Spark ``NaN > 1`` is true and ``median`` counts NaN as a
value, so floating columns are normalised to NULL once, at load.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Replace NaN by NULL in floating columns (all of them by default)."""
    floating = {f.name for f in df.schema.fields
                if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    targets = floating if cols is None else floating.intersection(cols)
    if not targets:
        return df
    return df.select(*[
        F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) if c in targets else F.col(c)
        for c in df.columns
    ])


def load(spark: SparkSession, sf_dir: str, name: str, normalise: bool = True) -> DataFrame:
    """Lazy parquet scan of one table; column pruning and filter pushdown are
    left to Catalyst, so callers should select only what they use.

    ``normalise`` turns NaN into NULL in the floating columns of a table that is
    not one of ``TABLES``; those store missing values as NULL, and a wrapped
    column would keep filters from the scan."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return nan_to_null(df) if normalise and name not in TABLES else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             header: bool = True) -> DataFrame:
    """CSV scan with a header (A1).

    An explicit schema avoids the extra inference pass over the whole input;
    ``schema=None`` falls back to inference for exploratory use.
    """
    r = spark.read.option("header", header).option("mode", "PERMISSIVE")
    if schema is None:
        r = r.option("inferSchema", True)
    else:
        r = r.schema(schema)
    return nan_to_null(r.csv(path))


def read_headerless(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV without a header line, columns named by ``schema`` (A2)."""
    return read_csv(spark, path, schema=schema, header=False)
