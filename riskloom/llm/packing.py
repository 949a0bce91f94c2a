"""Order-preserving packing of token streams by dynamic programming.

Documents stay in the order of their input partition.  Cuts between sequences
fall at document ends (free) or sentence ends (a penalty for the truncation);
a sentence longer than ``piece`` tokens also offers cuts inside (a larger
penalty).  With cut places p_0 < p_1 < ... the cheapest cost of ending a
sequence at p_j is

    f(j) = penalty(j) + window - p_j + min over p_j - window <= p_i < p_j of (f(i) + p_i)

a sliding minimum that a monotone queue holds.  A partition is one stream, read
in blocks of bounded size, so nothing is shuffled; what a block cannot fill
starts the next one, and the rest at the end of the partition may come as
sequences of power-of-two lengths, which need no padding.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, prepare, ranges
from .tokens import encoder, tokenizer_path

WINDOW = 2048
SENTENCE_CUT, INNER_CUT = 2, 48  # penalties, in tokens of padding
PIECE = 64
BLOCK_TOKENS = 1 << 19
TEXT_BYTES = 1 << 21
_FLAGS: dict = {}


def choose_cuts(places: np.ndarray, penalty: np.ndarray, window: int = WINDOW, close: bool = True) -> list[int]:
    """Places of the cheapest cuts.  ``places`` rise from 0 with gaps of at
    most ``window``; the last is the end of the stream.  With ``close`` the
    stream ends there, otherwise the cuts stop at the best place within the
    last window, whose rest belongs to the next call."""
    p, pen = places.tolist(), penalty.tolist()
    n = len(p)
    best, back = [0] * n, [0] * n
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # f + place (rising), place, index
    pop, push = queue.pop, queue.append
    for j in range(1, n):
        pj = p[j]
        while queue[0][1] < pj - window:
            queue.popleft()
        low, _, back[j] = queue[0]
        best[j] = cost = low + window - pj + pen[j]
        key = cost + pj
        while queue and queue[-1][0] >= key:
            pop()
        push((key, pj, j))
    j = n - 1
    if not close:
        low = int(np.searchsorted(places, p[-1] - window, side="right"))
        j = min(range(max(low, 1), n), key=best.__getitem__)
    cuts = []
    while j:
        cuts.append(p[j])
        j = back[j]
    return cuts[::-1]


def _sentence_ids(path: str) -> np.ndarray:
    """Flags of the ids whose text ends a sentence."""
    if path in _FLAGS:
        return _FLAGS[path]
    tok = encoder(path).tok
    size = tok.get_vocab_size(with_added_tokens=True)
    flags = np.zeros(size, bool)
    for i in range(size):
        t = (tok.id_to_token(i) or "").removesuffix("</w>")
        flags[i] = t.endswith((".", "!", "?", '."', '!"', '?"', ".)", "!)", "?)"))
    _FLAGS[path] = flags
    return flags


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, penalties): document ends, sentence ends, and inner cuts every
    PIECE tokens of a longer sentence."""
    cost = np.where(ends_sentence[ids], SENTENCE_CUT, -1)
    cost[doc_ends - 1] = 0
    places = np.append(0, np.flatnonzero(cost >= 0) + 1)
    inside = (np.diff(places) - 1) // PIECE
    cost[ranges(np.zeros(len(inside), np.int64), inside) * PIECE + np.repeat(places[:-1], inside) + PIECE - 1] = INNER_CUT
    at = np.flatnonzero(cost >= 0)
    return np.append(0, at + 1), np.append(0, cost[at])


def tail_lengths(n: int, window: int) -> list[int]:
    """Lengths of the last sequences of a stream: powers of two need no
    padding, a cut costs INNER_CUT."""
    parts = [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]
    return parts if (len(parts) - 1) * INNER_CUT < window - n else [n]


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                   window: int = WINDOW, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, with ``with_ids``, ids (little-endian unsigned
    32-bit binary, the training data itself).

    Every id of every document (``end_id`` last) lies in exactly one piece.
    Null and empty texts are the single ``end_id``; null and repeated ids are
    documents of their own; a text of any length is cut like the rest; an
    empty table gives no piece.  Other columns are not read.  sequence_id is
    the partition's number times 2^33 plus a running number."""
    path = tokenizer or tokenizer_path()
    prepare(df.sparkSession)
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    id_type = src.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        enc, flags = encoder(path), _sentence_ids(path)
        seq = TaskContext.get().partitionId() << 33
        # The stream not yet in a sequence: documents as (id, number of its ids, ids already placed, the other ids).
        docs: list[list] = []
        held = 0

        def emit(lengths: list[int]) -> Iterator[pa.RecordBatch]:
            nonlocal seq, docs, held
            rows: list[list] = [[] for _ in names]
            d = 0
            for size in lengths:
                at = 0
                while at < size:
                    doc = docs[d]
                    take = min(size - at, len(doc[3]))
                    raw = doc[3][:take].tobytes()
                    for col, v in zip(rows, (doc[0], doc[2], take, zlib.crc32(raw), doc[1], seq, at, raw)):
                        col.append(v)
                    doc[2] += take
                    doc[3] = doc[3][take:]
                    at += take
                    d += not len(doc[3])
                seq += 1
                held -= size
            docs = docs[d:]
            types = [to_arrow_type(id_type)] + [pa.int64()] * 6 + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)

        def cuts(close: bool) -> list[int]:
            ids = np.concatenate([d[3] for d in docs])
            ends = np.cumsum([len(d[3]) for d in docs])
            places, pen = cut_places(ids, ends, flags)
            return np.diff([0] + choose_cuts(places, pen, window, close)).tolist()

        for b in by_bytes(batches, 1, TEXT_BYTES):
            ids, off = enc.encode(b.column(1), end_id)
            for i, s, e in zip(b.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist()):
                docs.append([i, e - s, 0, ids[s:e]])
            held += len(ids)
            if held >= BLOCK_TOKENS:
                yield from emit(cuts(False))
        if held > window:
            yield from emit(cuts(False))
        if held:
            yield from emit(tail_lengths(held, window))

    kinds = f"id {id_type.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    out = src.mapInArrow(run, kinds + ", ids binary" * with_ids)
    return out.withColumnRenamed("id", id_col)
