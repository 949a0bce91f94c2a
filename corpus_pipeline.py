"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  ``run`` writes every stage's result
as Parquet into the shared folder and reads it back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import compression_toxicity, decontaminate, packing, simhash_index, suffix_dedup
from riskloom.llm.common import Scratch, by_position

TOXIC_SCORE = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC_SCORE; the model learns from the
    labelled ones among ``docs``.  Null and empty texts have the score of no
    evidence; rows that repeat an id are scored each by its text; without
    documents the result is empty; other columns pass through."""
    model = compression_toxicity.fit_from_tables(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return compression_toxicity.keep_below(docs, model, TOXIC_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints linked at 3 bits or fewer:
    the one with the smallest id, null last.  Null and empty texts are one
    group; of equal rows one stays; without documents the result is empty;
    other columns pass through."""
    return simhash_index.keep_representatives(docs, shingle=3, max_bits=3)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte passages that start in an earlier document.
    Every document stays a row; n_chars follows the text.  Null texts stay
    null; a null id is behind every id; rows that repeat an id cost each other
    nothing; without documents the result is empty; other columns pass through
    under any name, also one that the operator uses."""
    names = docs.columns
    plain = by_position(docs)
    at = {c: f"c{i}" for i, c in enumerate(names)}
    out = suffix_dedup.remove_repeats(plain, at["doc_id"], at["text"], length=50)
    text = F.when(F.col("_n_removed") > 0, F.col("_kept")).otherwise(F.col(at["text"]))
    new = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in at else None}
    return out.select(*[new.get(c, F.col(at[c])).alias(c) for c in names])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark
    runs.  Null and empty texts are clean; rows that repeat an id are judged
    each by its text; without documents or items nothing is dropped; other
    columns pass through."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with their ids.  Null and
    empty texts are the end id alone; null and repeated ids are documents of
    their own; without documents there is no piece; other columns are not read."""
    return packing.pack_documents(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: Compression lengths, fingerprint components and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs
