"""Removal of repeated byte passages by column-wise collection BWT and LCP.

A byte goes when it lies in a ``length``-byte string that also starts in a
document with a smaller id.  Whole documents as strings would need one round
for each symbol of the longest document, over one structure that no task can
hold, so the collection is cut along content first:

1. *Anchors.*  Of every ``length - GRAM + 1`` consecutive GRAM-byte grams the one
   with the least hash is an anchor, so equal ``length``-byte strings hold the
   same anchor at the same place.  Each segment of documents sends its anchor
   hashes, as packed columns, to hash buckets; a bucket answers with one bit per
   anchor: does it occur elsewhere.
2. *Collections.*  For a repeated anchor the segment sends the bytes around it
   that any string over the anchor can cover, one copy for each distinct
   surrounding, with the smallest id.  A bucket's strings are one collection, all
   of one width, aligned at their anchors.  Every round inserts one symbol of
   each string, right to left: the suffix order, the Burrows-Wheeler column (the
   symbols that come next) and the common-prefix column of a round are made from
   those of the round before in one sequential pass.  After ``length`` symbols, runs
   with common prefixes of ``length`` are equal strings, and those from a
   document above the run's smallest id are marked.
3. *Removal.*  Segments turn the marks into covered bytes.

Only bounded pieces move: a segment's packed columns, never all occurrences of
a group.  An anchor with more than ``hot_limit`` occurrences is spread: each
``length``-byte string over it becomes its own collection entry, dealt by that
string's hash, so a passage that a third of all documents share meets in many
buckets, once per segment and distinct string; the rounds decide there as well.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, prepare

GRAM = 16
PAD = 0xFF  # no byte of UTF-8
NO_ID = np.iinfo(np.int64).max  # a null id ranks behind every id
SLICE = 1 << 20
STEP = 1 << 16  # strings that are compared at once
_MULT = 0x9E3779B97F4A7C15
_BYTE = (np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_WORDS = (np.random.default_rng(21).integers(0, 1 << 63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def _mix(h: np.ndarray, mult: int) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(mult)
    return h ^ (h >> np.uint64(29))


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every window of ``width`` entries, by doubling."""
    n = 1
    while n * 2 <= width:
        x = f(x[:-n], x[n:])
        n *= 2
    return f(x[:len(x) - (width - n)], x[width - n:]) if n < width else x


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, 64-bit hashes) of a text's anchors."""
    n, width = len(data), length - GRAM + 1
    pos, val = [], []
    for lo in range(0, n if n >= length else 0, SLICE):
        a, b = max(0, lo - length), min(n, lo + SLICE + length)
        h = _BYTE[data[a:b]]
        step = 1
        while step < GRAM:
            h = h[:-step] * np.uint64(pow(_MULT, step, 1 << 64)) + h[step:]
            step *= 2
        h = _mix(h, 0xD6E8FEB86659FD93)
        least = _slide(h, width, np.minimum)
        edge = np.zeros(width - 1, np.uint64)
        at = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), width, np.maximum) == h)
        at = at[(at + a >= lo) & (at + a < lo + SLICE)]
        pos.append(at + a)
        val.append(h[at])
    if not pos:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # Anchors are small hashes; mixed again they spread evenly.
    return np.concatenate(pos), _mix(np.concatenate(val), 0xA0761D6478BD642F)


def _row_hash(x: np.ndarray) -> np.ndarray:
    """64-bit hash of every row of a byte matrix."""
    wide = np.zeros((len(x), -(-x.shape[1] // 8) * 8), np.uint8)
    wide[:, :x.shape[1]] = x
    w = wide.view(np.uint64)
    h = np.zeros(len(x), np.uint64)
    for i in range(w.shape[1]):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(_MULT) + w[:, i] * _WORDS[i % 64]
    return _mix(h, 0xD6E8FEB86659FD93)


def _distinct(key: np.ndarray, x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (key, row, id) and, in that order, the first entry of each
    distinct (key, row).  Rows are told apart by hash, then byte by byte."""
    order = np.lexsort((ids, _row_hash(x), key))
    k, r = key[order], x[order]
    first = np.ones(len(order), bool)
    first[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1]).any(1)
    return order, first


def column_rounds(group: np.ndarray, x: np.ndarray, cap: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Column-wise construction over equal-width strings ``x`` (grouped, groups
    contiguous).  Yields after each round (column, order, lcp): the order of
    the suffixes that begin at ``column`` and the common prefix of each with
    its predecessor, cut at ``cap`` and 0 where a group begins.

    A round reads three sequential columns (order, BWT, LCP) and writes the
    next three; the BWT column of a round holds the symbols that the next
    round inserts."""
    m, width = x.shape
    order = np.arange(m)
    lcp = np.zeros(m + 1, np.uint8)
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    base = np.repeat(np.arange(len(starts)) << 8, np.diff(np.append(starts, m)))
    columns = np.ascontiguousarray(x.T)
    bwt = columns[width - 1]  # what precedes the empty suffixes
    for col in range(width - 1, -1, -1):
        key = base + bwt
        perm = np.argsort(key, kind="stable")
        k = key[perm]
        same = np.flatnonzero(k[1:] == k[:-1])
        nxt = np.zeros(m + 1, np.uint8)
        if len(same):
            span = np.empty(2 * len(same), np.int64)
            span[0::2], span[1::2] = perm[same] + 1, perm[same + 1] + 1
            low = np.minimum.reduceat(lcp, span)[::2]
            nxt[same + 1] = np.minimum(low, cap - 1) + 1
        order, lcp = order[perm], nxt
        yield col, order, lcp[:m]
        if col:
            bwt = columns[col - 1][order]


def marks(key: np.ndarray, x: np.ndarray, ids: np.ndarray, length: int, settle: bool = True) -> np.ndarray:
    """For each string a bit per offset: the ``length`` bytes from there also
    occur, under the same key and offset, with a smaller id.  Exact copies of a
    row are settled before the rounds, or (``settle=False``) by the rounds too."""
    out = np.zeros(len(key), np.uint64)
    if not len(key):
        return out
    offsets = x.shape[1] - length + 1
    full = np.uint64((1 << offsets) - 1)
    if settle:
        order, first = _distinct(key, x, ids)
    else:
        order, first = np.argsort(key, kind="stable"), np.ones(len(key), bool)
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    copy = ids[order] > ids[order[lead]]
    out[order[copy]] = full
    reps = order[first]
    g = key[reps]
    alone = np.ones(len(g), bool)
    alone[1:] &= g[1:] != g[:-1]
    alone[:-1] &= g[1:] != g[:-1]
    many = reps[~alone]
    rep_mark = np.zeros(len(key), np.uint64)
    if len(many):
        doc = ids[many]
        found = np.zeros(len(many), np.uint64)
        for col, at, lcp in column_rounds(key[many], x[many], length):
            if col < offsets:
                run = np.flatnonzero(lcp < length)
                least = np.repeat(np.minimum.reduceat(doc[at], run), np.diff(np.append(run, len(at))))
                hit = at[doc[at] > least]
                found[hit] |= np.uint64(1 << col)
        rep_mark[many] = found
    out[order] |= rep_mark[order[lead]]
    return out


# -- packed columns between segments and buckets ---------------------------

def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


class _Segment:
    """The distinct texts of one segment, their anchors and surroundings."""

    def __init__(self, ids: pa.ChunkedArray, texts: pa.ChunkedArray, length: int):
        self.length, self.side = length, length - GRAM
        self.ids = ids.to_numpy() if ids.null_count == 0 else ids.fill_null(NO_ID).to_numpy()
        self.row_text, seen, self.texts, low = [], {}, [], []
        for i, t in enumerate(texts):
            raw = (t.as_py() or "").encode()
            k = seen.setdefault(raw, len(seen))
            if k == len(low):
                low.append(self.ids[i])
                self.texts.append(raw)
            low[k] = min(low[k], self.ids[i])
            self.row_text.append(k)
        self.low = np.array(low, np.int64)
        copies = np.bincount(self.row_text, minlength=len(low)) if low else np.zeros(0, int)
        found = [anchors(np.frombuffer(t, np.uint8), length) for t in self.texts]
        self.of = np.repeat(np.arange(len(found)), [len(p) for p, _ in found]).astype(np.int64)
        self.pos = np.concatenate([p for p, _ in found]) if found else np.zeros(0, np.int64)
        h = np.concatenate([v for _, v in found]) if found else np.zeros(0, np.uint64)
        self.uniq, self.inv = np.unique(h, return_inverse=True)
        self.seen = np.bincount(self.inv, weights=copies[self.of], minlength=len(self.uniq)) if len(h) else np.zeros(0)

    def cut(self, hashes: np.ndarray, bits: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """Slices of sorted hashes by bucket, with 32 more bits of each."""
        bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
        rest = ((hashes >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(starts, np.append(starts[1:], len(bucket))):
            yield int(bucket[a]), int(a), int(b), rest[a:b]

    def _entries(self, want: np.ndarray, single: bool) -> Iterator[tuple]:
        """Slices (text index, position, key, bytes) of the strings over the
        wanted anchors, of STEP strings at most for each text."""
        at = np.flatnonzero(want)
        cuts = np.searchsorted(self.of[at], np.arange(len(self.texts) + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            sel = at[cuts[k]:cuts[k + 1]]
            data = np.frombuffer(self.texts[k], np.uint8)
            if single:
                cover = np.zeros(len(data) + 1, np.int32)
                np.add.at(cover, np.maximum(self.pos[sel] - self.side, 0), 1)
                np.add.at(cover, self.pos[sel] + 1, -1)
                places = np.flatnonzero(np.cumsum(cover)[:len(data) - self.length + 1] > 0)
                view = sliding_window_view(data, self.length)
            else:
                edge = np.full(self.side, PAD, np.uint8)
                places = self.pos[sel]
                view = sliding_window_view(np.concatenate([edge, data, edge]), 2 * self.side + GRAM)
            for lo in range(0, len(places), STEP):
                here = places[lo:lo + STEP]
                x = view[here]
                key = _row_hash(x) if single else self.uniq[self.inv[sel[lo:lo + STEP]]]
                yield np.full(len(here), k), here if single else here - self.side, key, x

    def surroundings(self, repeated: np.ndarray, hot: np.ndarray):
        """Two sets of strings: those around ordinary anchors, and single
        ``length``-byte strings over hot ones.  Each is (text index, position
        and string number of every occurrence; key, bytes and smallest id of
        every distinct string, by key).  Occurrences are made distinct slice by
        slice, so a long periodic text never has all its surroundings at once."""
        use = repeated[self.inv] if len(self.inv) else np.zeros(0, bool)
        is_hot = hot[self.inv] if len(self.inv) else use
        for want, single, width in ((use & ~is_hot, False, 2 * self.side + GRAM), (use & is_hot, True, self.length)):
            where, kept, held, n, base = [], [], [], 0, 0

            def settle() -> None:
                nonlocal held, n, base
                k, p, key, x = (np.concatenate([h[i] for h in held]) for i in range(4))
                ids = self.low[k]
                order, first = _distinct(key, x, ids)
                number = np.empty(len(k), np.int64)
                number[order] = base + np.cumsum(first) - 1
                reps = order[first]
                where.append((k, p, number))
                kept.append((key[reps], x[reps], ids[reps]))
                base += len(reps)
                held, n = [], 0

            for part in self._entries(want, single):
                held.append(part)
                n += len(part[0])
                if n >= STEP:
                    settle()
            if held:
                settle()
            if not where:
                none = np.zeros(0, np.int64)
                yield none, none, none, np.zeros(0, np.uint64), np.zeros((0, width), np.uint8), none
                continue
            k, p, number = (np.concatenate([w[i] for w in where]) for i in range(3))
            key, x, ids = (np.concatenate([w[i] for w in kept]) for i in range(3))
            order, first = _distinct(key, x, ids)
            final = np.empty(len(key), np.int64)
            final[order] = np.cumsum(first) - 1
            reps = order[first]
            yield k, p, final[number], key[reps], x[reps], ids[reps]


def _bits_from(replies: pa.Table, kind: int, bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Flags (repeated, hot) of a segment's sorted anchors from its buckets' answers."""
    rep, hot = [np.zeros(0, bool)], [np.zeros(0, bool)]
    for _, _, raw, cnt in _answers(replies, kind):
        flags = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
        half = -(-cnt // 8) * 8
        rep.append(flags[:cnt].astype(bool))
        hot.append(flags[half:half + cnt].astype(bool))
    return np.concatenate(rep), np.concatenate(hot)


def _answers(replies: pa.Table, kind: int):
    if replies.num_rows == 0:
        return []
    rows = zip(replies.column("kind").to_pylist(), replies.column("bucket").to_pylist(),
               replies.column("data").to_pylist(), replies.column("n").to_pylist())
    return sorted(((k, b, zstandard.decompress(d), n) for k, b, d, n in rows if k == kind), key=lambda r: r[1])


_PACKET = "seg int, bucket int, kind int, n int, data binary"
_PACKET_ARROW = pa.schema([("seg", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])


def _packets(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_PACKET_ARROW)], schema=_PACKET_ARROW)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50,
                   segment_bytes: int = 4 << 20, hot_limit: int = 1 << 17) -> DataFrame:
    """The input's columns plus ``_kept`` (string: the remaining bytes; a UTF-8
    sequence that lost some of its bytes goes whole), ``_spans`` (array of
    begin and end byte offsets of the maximal removed runs), ``_n_bytes``,
    ``_n_removed``, ``_n_spans`` and ``_kept_sha256`` (of the remaining bytes).

    Null texts count as empty; a null id ranks behind every id (such rows lose
    bytes to any document and cost none); rows that repeat an id are not
    smaller than each other, so they cost each other nothing; an empty table
    gives an empty result.  Other columns pass through under any name but the
    seven above, which the result replaces."""
    spark = df.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "repeats")
    names = df.columns
    plain = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    c_id, c_text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    total = plain.agg(F.sum(F.octet_length(c_text) + 64)).first()[0] or 0
    segs = max(int(total) // segment_bytes + 1, 2 * spark.sparkContext.defaultParallelism,
               int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits = max(0, min(30, segs.bit_length() - 1))

    # Documents are dealt to segments once, into a bucketed table: the later passes read it without a shuffle.
    dealt_cols = plain.columns
    table = f"repeats_{uuid.uuid4().hex}"
    (plain.withColumn("seg", F.expr(f"cast(pmod(xxhash64(monotonically_increasing_id()), {segs}) AS int)"))
     .repartition(segs, "seg").write.bucketBy(segs, "seg").option("path", scratch.path()).option("compression", "zstd")
     .format("parquet").saveAsTable(table))
    dealt = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files are external and stay; no entry is left in the catalogue
    slim = dealt.select("seg", F.col(c_id).cast("long").alias("id"), F.col(c_text).cast("string").alias("text"))

    def send_anchors(key, t):
        s = _Segment(t.column("id"), t.column("text"), length)
        times = s.seen.astype(np.uint32)
        seg = key[0].as_py()
        return _packets([(seg, b, 0, j - i, _pack(rest, times[i:j])) for b, i, j, rest in s.cut(s.uniq, bits)])

    def count_anchors(t: pa.Table) -> pa.Table:
        raws = [zstandard.decompress(d) for d in t.column("data").to_pylist()]
        ns = t.column("n").to_pylist()
        h = np.concatenate([np.frombuffer(r, np.uint32, n) for r, n in zip(raws, ns)])
        c = np.concatenate([np.frombuffer(r, np.uint32, n, 4 * n) for r, n in zip(raws, ns)])
        _, inv = np.unique(h, return_inverse=True)
        total = np.bincount(inv, weights=c)
        rep, hot = (total >= 2)[inv], (total > hot_limit)[inv]
        out, at = [], 0
        for seg, b, n in zip(t.column("seg").to_pylist(), t.column("bucket").to_pylist(), ns):
            out.append((seg, b, 0, n, _pack(np.packbits(rep[at:at + n], bitorder="little"),
                                            np.packbits(hot[at:at + n], bitorder="little"))))
            at += n
        return _packets(out)

    sent = slim.groupBy("seg").applyInArrow(send_anchors, _PACKET)
    flags = scratch.write(sent.groupBy("bucket").applyInArrow(count_anchors, _PACKET))

    def send_strings(key, docs, replies):
        if docs.num_rows == 0:
            return _packets([])
        s = _Segment(docs.column("id"), docs.column("text"), length)
        rep, hot = _bits_from(replies, 0, bits, len(s.uniq))
        rows = []
        for kind, (_, _, _, h, x, low) in enumerate(s.surroundings(rep, hot), 1):
            rows += [(key[0].as_py(), b, kind, j - i, _pack(low[i:j], rest, x[i:j])) for b, i, j, rest in s.cut(h, bits)]
        return _packets(rows)

    def mark_strings(t: pa.Table) -> pa.Table:
        out = []
        kinds = np.array(t.column("kind").to_pylist())
        for kind, width in ((1, 2 * length - GRAM), (2, length)):
            rows = t.filter(pa.array(kinds == kind))
            if not rows.num_rows:
                continue
            ns = rows.column("n").to_pylist()
            raws = [zstandard.decompress(d) for d in rows.column("data").to_pylist()]
            low = np.concatenate([np.frombuffer(r, np.int64, n) for r, n in zip(raws, ns)])
            h = np.concatenate([np.frombuffer(r, np.uint32, n, 8 * n) for r, n in zip(raws, ns)])
            x = np.concatenate([np.frombuffer(r, np.uint8, n * width, 12 * n).reshape(n, width) for r, n in zip(raws, ns)])
            del raws
            # The key of a hot string deals it to its bucket; the rounds decide which are equal.
            m = marks(h.astype(np.int64), x, low, length, settle=kind == 1)
            at = 0
            for seg, b, n in zip(rows.column("seg").to_pylist(), rows.column("bucket").to_pylist(), ns):
                out.append((seg, b, kind, n, _pack(m[at:at + n])))
                at += n
        return _packets(out)

    strings = slim.groupBy("seg").cogroup(flags.groupBy("seg")).applyInArrow(send_strings, _PACKET)
    answers = scratch.write(strings.groupBy("bucket").applyInArrow(mark_strings, _PACKET).union(flags))
    scratch.drop(flags)

    schema = T.StructType([f for f in plain.schema] + [
        T.StructField("kept", T.StringType()), T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()), T.StructField("sha", T.StringType())])

    def remove(key, docs, replies):
        res = {k: [] for k in ("kept", "spans", "n_bytes", "n_removed", "n_spans", "sha")}
        if docs.num_rows:
            s = _Segment(docs.column(c_id).cast(pa.int64()), docs.column(c_text).cast(pa.string()), length)
            rep, hot = _bits_from(replies, 0, bits, len(s.uniq))
            entries = []
            for kind, (k, p, number, _, x, low) in enumerate(s.surroundings(rep, hot), 1):
                got = np.concatenate([np.zeros(0, np.uint64)] + [np.frombuffer(r, np.uint64) for _, _, r, _ in _answers(replies, kind)])
                by = np.argsort(k, kind="stable")
                entries.append((p[by], got[number[by]], low[number[by]], np.searchsorted(k[by], np.arange(len(s.texts) + 1)),
                                x.shape[1] - length + 1))
        done: dict = {}
        for row in range(docs.num_rows):
            k, me = s.row_text[row], s.ids[row]
            if (k, me) not in done:
                done[k, me] = _cut_text(s.texts[k], [(p[c[k]:c[k + 1]], m[c[k]:c[k + 1]], lo[c[k]:c[k + 1]], w) for p, m, lo, c, w in entries], me, length)
            for name, v in done[k, me].items():
                res[name].append(v)
        types = {"kept": pa.string(), "spans": pa.list_(pa.int64()), "sha": pa.string()}
        return pa.table([docs.column(c) for c in dealt_cols] + [pa.array(v, types.get(n, pa.int64())) for n, v in res.items()],
                        names=dealt_cols + list(res))

    out = dealt.groupBy("seg").cogroup(answers.groupBy("seg")).applyInArrow(remove, schema)
    new = {"kept": "_kept", "spans": "_spans", "n_bytes": "_n_bytes", "n_removed": "_n_removed", "n_spans": "_n_spans", "sha": "_kept_sha256"}
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c not in new.values()],
                      *[F.col(k).alias(v) for k, v in new.items()])


def _cut_text(raw: bytes, entries: list, me: int, length: int) -> dict:
    """One document's result from the marks of its strings."""
    n = len(raw)
    begins = np.zeros(n + 1, np.int32)
    for pos, mark, low, offsets in entries:
        for lo in range(0, len(pos), STEP):
            here = slice(lo, lo + STEP)
            bits = np.where(low[here] < me, np.uint64((1 << offsets) - 1), mark[here])
            use = np.flatnonzero(bits)
            b = np.unpackbits(bits[use].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :offsets]
            r, o = np.nonzero(b)
            at = pos[here][use][r] + o
            begins[at[(at >= 0) & (at + length <= n)]] = 1
    if not begins.any():
        return {"kept": raw.decode(errors="ignore"), "spans": [], "n_bytes": n, "n_removed": 0, "n_spans": 0,
                "sha": hashlib.sha256(raw).hexdigest()}
    step = begins.copy()
    step[length:] -= begins[:n + 1 - length]
    gone = np.cumsum(step)[:n] > 0
    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    return {"kept": left.decode(errors="ignore"), "spans": edges.tolist(), "n_bytes": n, "n_removed": int(gone.sum()),
            "n_spans": len(edges) // 2, "sha": hashlib.sha256(left).hexdigest()}
