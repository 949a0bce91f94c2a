"""Chat formatting by multi-party perspective rotation, in DataFrame
operations only.

Each dialogue is rendered once for every participant: that speaker is the
assistant, the others are named users, and the mask covers the assistant's
words.  System turns belong to every view.  A rendering comes as chunks of
``chunk_turns`` turns, so a dialogue of any length is never one row or one
group; its chunks in order are the whole text.

Positions come from a range sort of all turns and sums over the sorted parts,
so a dialogue that holds a third of all turns is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, prepare, range_parts

OPEN, CLOSE, END = "<|", "|>", "<|end|>"


def perspectives(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", chunk_turns: int = 64, system: tuple[str, ...] = ("system",),
                 views_per_task: int = 256) -> DataFrame:
    """One row per dialogue, participant and chunk: conv, speaker, chunk,
    n_turns, text, mask (array of struct<start, end>: character spans of the
    assistant's words within the chunk's text) and n_masked (characters).

    Turns are ordered by turn, role and text, nulls first; repeated rows stay
    repeated turns.  A null role is the speaker "unknown"; a null text is
    empty; a null conversation id is one dialogue of its own; a "<|" inside a
    text is written "< |", so content never forms a control token.  A
    dialogue of system turns alone has no view.  Other columns are not read;
    an empty table gives an empty result."""
    spark = df.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "views")
    src = df.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("unknown")).alias("role"),
        F.replace(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
        F.col(f"`{role_col}`").isNotNull().alias("named"), F.col(f"`{text_col}`").isNotNull().alias("told"),
        F.monotonically_increasing_id().alias("tie"))
    keys = ["conv", "turn", "named", "role", "told", "text", "tie"]
    parts = range_parts(spark, src.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0)
    sorted_turns = scratch.write(
        src.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
        .select("conv", "role", "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")))
    # Turns of a dialogue in earlier parts: a dialogue has one row here for each part that it touches.
    runs = sorted_turns.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    before = runs.select("conv", "part", "first", (F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n")).alias("before"))
    place = before.select(F.col("conv").alias("c"), F.col("part").alias("p"), (F.col("before") - F.col("first")).alias("shift"))
    placed = (sorted_turns.join(place, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
              .select("conv", "role", "text", (F.col("seq") + F.col("shift")).alias("pos")))
    chunks = scratch.write(
        placed.groupBy("conv", F.expr(f"cast(pos div {chunk_turns} AS long)").alias("chunk"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns")))

    speakers = sorted_turns.filter(~F.col("role").isin(list(system))).groupBy("conv", "role").agg(F.count(F.lit(1)).alias("k"))
    # Views meet the chunks in blocks of a dialogue, so a long one is no single join key.
    block = F.expr(f"chunk div {views_per_task}")
    blocks = chunks.groupBy("conv", block.alias("block")).agg(F.count(F.lit(1)).alias("m"))
    views = blocks.join(speakers.select(F.col("conv").alias("c"), F.col("role").alias("speaker")), F.col("conv").eqNullSafe(F.col("c"))).select(
        F.col("conv").alias("vc"), F.col("block").alias("vb"), "speaker")
    seen = chunks.withColumn("block", block).join(views, F.col("conv").eqNullSafe(F.col("vc")) & (F.col("block") == F.col("vb")))

    mine = lambda t: t["role"] == F.col("speaker")
    head = lambda t: (F.when(mine(t), F.lit(OPEN + "assistant" + CLOSE))
                      .when(t["role"].isin(list(system)), F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE)))
                      .otherwise(F.concat(F.lit(OPEN + "user name="), t["role"], F.lit(CLOSE))))
    segments = F.transform("turns", lambda t: F.struct(
        mine(t).alias("mine"), head(t).alias("head"), t["text"].alias("text")))
    seen = seen.withColumn("segs", segments)
    whole = F.array_join(F.transform("segs", lambda s: F.concat(s["head"], s["text"], F.lit(END + "\n"))), "")
    # Spans: a running offset over the chunk's turns.
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("spans"))

    def step(acc, s):
        a = acc["at"] + F.length(s["head"])
        b = a + F.length(s["text"])
        return F.struct((b + F.lit(len(END) + 1)).alias("at"), F.when(
            s["mine"], F.concat(acc["spans"], F.array(F.struct(a.alias("start"), b.alias("end"))))).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("segs", start, step)["spans"]
    return seen.select(F.col("conv").alias(conv_col), "speaker", "chunk", F.size("segs").cast("long").alias("n_turns"),
                       whole.alias("text"), spans.alias("mask")).withColumn(
        "n_masked", F.aggregate("mask", F.lit(0), lambda a, m: a + m["end"] - m["start"]).cast("long"))
