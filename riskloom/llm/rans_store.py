"""Token-id files coded by a static range asymmetric numeral system.

One frequency table, counted over all documents, serves every block.  A block
of BLOCK ids is coded by LANES interleaved states that share one stream of
32-bit words; every CHECK ids it stores a checkpoint (the lane states and the
place in the stream), so a reader may start there, and it ends with the CRC-32
of its ids.  A frame is a row of the file: whole documents in ascending order
with their ids, lengths and blocks, coded without any other frame.  Files are
Parquet, so that Spark's committers and readers handle them on any store.

Coding runs over all blocks of a frame at once: a step codes one id in every
lane of every block.  Decoding runs over all checkpoint intervals at once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, by_bytes, prepare, range_parts, utf8_buffers
from .tokens import encoder, tokenizer_path

MAGIC = b"RANS1\0\0\0"
LANES, BLOCK, CHECK = 32, 1 << 15, 1 << 13
SCALE = 20  # frequencies add up to 2^SCALE
LOW = np.uint64(1 << 31)
FRAME_IDS = 1 << 22
TEXT_BYTES = 1 << 21


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2^SCALE, at least 1 for every id."""
    total = 1 << SCALE
    c = counts.astype(np.float64) + 1e-9
    f = np.maximum(1, np.floor(c * ((total - len(c)) / c.sum())).astype(np.int64))
    f[int(np.argmax(f))] += total - f.sum()
    return f.astype(np.uint64)


class Table:
    """The shared frequencies, their running sums and the id of every slot."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq
        self.cum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(freq)]).astype(np.uint64)
        self.of_slot = np.repeat(np.arange(len(freq), dtype=np.int32), freq.astype(np.int64))


def encode_blocks(ids: np.ndarray, table: Table) -> list[bytes]:
    """The blocks of a frame's ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    steps = BLOCK // LANES
    padded = np.full(blocks * BLOCK, int(np.argmax(table.freq)), np.uint32)
    padded[:n] = ids
    # sym[t, block, lane]: id number t * LANES + lane of the block.
    sym = np.ascontiguousarray(padded.reshape(blocks, steps, LANES).transpose(1, 0, 2))
    state = np.full((blocks, LANES), LOW, np.uint64)
    word = np.zeros(sym.shape, np.uint32)
    out = np.zeros(sym.shape, bool)
    marks = np.zeros((BLOCK // CHECK, blocks, LANES), np.uint64)
    shift, one = np.uint64(31 - SCALE + 32), np.uint64(1 << SCALE)
    per = CHECK // LANES
    low = np.uint64(0xFFFFFFFF)
    for t in range(steps - 1, -1, -1):
        f = table.freq[sym[t]]
        full = state >= (f << shift)
        word[t] = state & low
        out[t] = full
        state >>= np.where(full, np.uint64(32), np.uint64(0))
        q = state // f
        # (q << SCALE) + state % f + cum
        state += table.cum[sym[t]] + q * (one - f)
        if t % per == 0:
            marks[t // per] = state
    result = []
    for b in range(blocks):
        used = out[:, b]
        stream = word[:, b][used]
        places = np.concatenate([[0], np.cumsum(used.reshape(BLOCK // CHECK, -1).sum(1))[:-1]]).astype("<u4")
        own = ids[b * BLOCK:(b + 1) * BLOCK]
        head = MAGIC + struct.pack("<IIIII", len(own), LANES, CHECK, len(stream), zlib.crc32(own.astype("<u4").tobytes()))
        result.append(head + places.tobytes() + marks[:, b].astype("<u8").tobytes() + stream.astype("<u4").tobytes())
    return result


def decode_blocks(blobs: list[bytes], table: Table) -> np.ndarray:
    """The ids of consecutive blocks; raises ValueError if a checksum or the
    layout does not hold."""
    per, checks = CHECK // LANES, BLOCK // CHECK
    size = struct.calcsize("<IIIII") + len(MAGIC)
    counts, sums, at, state, streams, base = [], [], [], [], [], 0
    for blob in blobs:
        if blob[:len(MAGIC)] != MAGIC:
            raise ValueError("not a block of token ids")
        n, lanes, check, words, crc = struct.unpack_from("<IIIII", blob, len(MAGIC))
        if (lanes, check) != (LANES, CHECK) or len(blob) != size + 4 * checks + 8 * checks * LANES + 4 * words:
            raise ValueError("a block has another layout")
        counts.append(n)
        sums.append(crc)
        at.append(np.frombuffer(blob, "<u4", checks, size).astype(np.int64) + base)
        state.append(np.frombuffer(blob, "<u8", checks * LANES, size + 4 * checks).reshape(checks, LANES))
        streams.append(np.frombuffer(blob, "<u4", words, size + 4 * checks + 8 * checks * LANES))
        base += words
    # A row for each checkpoint interval of each block; the words past the end are read but not used.
    x, at = np.concatenate(state).astype(np.uint64), np.concatenate(at)
    stream = np.concatenate(streams + [np.zeros(LANES, np.uint32)]).astype(np.uint64)
    low_bits = np.uint64((1 << SCALE) - 1)
    got = np.zeros((per, len(x), LANES), np.uint32)
    rows, flat_x = x.shape[0], x.reshape(-1)
    for t in range(per):
        slot = flat_x & low_bits
        s = table.of_slot.take(slot.view(np.int64))
        got[t] = s.reshape(rows, LANES)
        flat_x >>= np.uint64(SCALE)
        flat_x *= table.freq.take(s)
        flat_x += slot
        flat_x -= table.cum.take(s)
        # Lanes that ran low take the next words of their stream, in lane order.
        need = np.flatnonzero(flat_x < LOW)
        count = np.bincount(need // LANES, minlength=rows)
        src = np.repeat(at - (np.cumsum(count) - count), count) + np.arange(len(need))
        flat_x[need] = (flat_x[need] << np.uint64(32)) | stream.take(np.minimum(src, len(stream) - 1))
        at = at + count
    flat = got.transpose(1, 0, 2).reshape(len(blobs), BLOCK)
    parts = []
    for row, n, crc in zip(flat, counts, sums):
        ids = row[:n]
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("a block's checksum does not hold")
        parts.append(ids)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


_FRAME = "part int, frame long, n_ids long, doc_ids array<long>, lengths array<long>, blocks array<binary>"


def write_token_files(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                      tokenizer: str | None = None, end_id: int = 1) -> None:
    """Write the ids of all documents, in ascending id order, under ``path``:
    ``frames`` and ``table`` (id, freq).

    Null and empty texts are the single ``end_id``; null ids come first;
    repeated ids follow each other by length and checksum; an empty table
    writes no frame.  Other columns are not read."""
    tok_path = tokenizer or tokenizer_path()
    spark = df.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "tokens")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tok_path)
        for b in by_bytes(batches, 1, TEXT_BYTES):
            ids, off = enc.encode(b.column(1), end_id)
            ids = ids.astype(width)
            raw = [ids[s:e].tobytes() for s, e in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off)), pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                                              pa.array(raw, pa.binary())], names=["id", "n", "crc", "ids"])

    vocab = encoder(tok_path).tok.get_vocab_size(with_added_tokens=True)
    width = "<u2" if vocab <= 1 << 16 else "<u4"
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    toks = scratch.write(src.mapInArrow(tokenise, "id long, n long, crc long, ids binary")
                         .withColumn("tie", F.monotonically_increasing_id()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab, np.int64)
        for b in batches:
            total += np.bincount(utf8_buffers(b.column(0))[0].view(width), minlength=vocab)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["token", "c"])

    # The vocabulary bounds what comes to the driver.
    counts = np.zeros(vocab, np.int64)
    for r in toks.select("ids").mapInArrow(count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).toLocalIterator():
        counts[r["token"]] = r["c"]
    table = Table(quantise(counts))
    (spark.createDataFrame(pa.table({"token": np.arange(vocab), "freq": table.freq.astype(np.int64)}).to_pandas())
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/table"))
    shared = spark.sparkContext.broadcast(table.freq)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab, part, frame = Table(shared.value), TaskContext.get().partitionId(), 0
        doc_ids, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            blocks = encode_blocks(np.concatenate(ids), tab)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([frame]), pa.array([held]), pa.array([doc_ids], pa.list_(pa.int64())),
                 pa.array([[len(i) for i in ids]], pa.list_(pa.int64())), pa.array([blocks], pa.list_(pa.binary()))],
                names=["part", "frame", "n_ids", "doc_ids", "lengths", "blocks"])

        for b in batches:
            for i, raw in zip(b.column(0), b.column(1)):
                doc_ids.append(i.as_py())
                ids.append(np.frombuffer(raw.as_py(), width))
                held += len(ids[-1])
                if held >= FRAME_IDS:
                    yield flush()
                    doc_ids, ids, held, frame = [], [], 0, frame + 1
        if ids:
            yield flush()

    # Dealt by ranges of the id; the other keys spread an id that many rows repeat.
    parts = range_parts(spark, int(counts.sum()) * np.dtype(width).itemsize)
    keys = ["id", "n", "crc", "tie"]
    (toks.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("id", "ids")
     .mapInArrow(code, _FRAME).write.mode("overwrite").option("compression", "none").parquet(f"{path}/frames"))
    scratch.drop(toks)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: id, start (ids of all documents
    before it), n_tokens, ids_crc32 and, with ``with_ids``, ids (array)."""
    prepare(spark)
    frames = spark.read.schema(_FRAME).parquet(f"{path}/frames")
    table = spark.read.schema("token long, freq long").parquet(f"{path}/table").toPandas().sort_values("token")
    shared = spark.sparkContext.broadcast(table["freq"].to_numpy().astype(np.uint64))

    # Starts: running sums within a part, after sums over the parts (one row each).
    sizes = frames.select("part", "frame", "n_ids")
    before = (sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
              .select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")))
    inside = sizes.withColumn("inner", F.sum("n_ids").over(Window.partitionBy("part").orderBy("frame")) - F.col("n_ids"))
    base = inside.join(before, "part").select("part", "frame", (F.col("before") + F.col("inner")).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab = Table(shared.value)
        for b in batches:
            for part, frame, doc_ids, lengths, blocks in zip(*(b.column(c) for c in ("part", "frame", "doc_ids", "lengths", "blocks"))):
                ids = decode_blocks(blocks.as_py(), tab)
                n = np.array(lengths.as_py(), np.int64)
                starts = np.cumsum(n) - n
                raw = ids.astype("<u4")
                cols = [pa.array(np.full(len(n), part.as_py(), np.int32)), pa.array(np.full(len(n), frame.as_py())),
                        pa.array(doc_ids.as_py(), pa.int64()), pa.array(starts), pa.array(n),
                        pa.array([zlib.crc32(raw[s:s + k].tobytes()) for s, k in zip(starts, n)], pa.int64())]
                if with_ids:
                    cols.append(pa.array([raw[s:s + k].astype(np.int64) for s, k in zip(starts, n)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=["part", "frame", "id", "inner", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    rows = frames.drop("n_ids").mapInArrow(
        decode, "part int, frame long, id long, inner long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    return rows.join(base, ["part", "frame"]).select(
        "id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def store_and_read(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Write the documents' token files to the shared folder and return what
    reading them gives."""
    path = Scratch(df.sparkSession, "token-files").path()
    write_token_files(df, path, id_col, text_col, tokenizer)
    return read_token_files(df.sparkSession, path).withColumnRenamed("id", id_col)
