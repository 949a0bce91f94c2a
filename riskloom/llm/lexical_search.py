"""Ranked lexical search by dense blocked products.

The items (queries) are cut into blocks of bounded size in the order of item
and term; a block's terms are the only vocabulary that a task holds.  One scan
of the documents turns them into postings against that vocabulary; frequencies
come from the postings.  Then the postings are made into dense float64 tiles of
document impacts (terms x documents), item tiles are made into dense tiles of
repeat counts over their own compact vocabulary (items x terms), and BLAS
multiplies them.  A tile of terms holds at most TILE_REPEATS repeats of an
item, so that a partial sum is an integer below 2**53 and exact in any order;
partial sums are added as 64-bit integers.  Each task keeps the k best
documents of each item, ties by id, and two window steps merge the tasks.

An item whose terms lie in several blocks has its partial scores added by a
shuffle before the ranking, so an item of any length stays within the bound.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import running_sums
from .common import Scratch, by_bytes, ranges, utf8_buffers

BATCH = 4 << 20
PIECE = 1 << 20
BLOCK_BYTES = 32 << 20
TILE_DOCS = 512
TILE_ITEMS = 256
TILE_TERMS = 1024
#: An impact is below w * 10**6 and w below 45,000 (ln of a 64-bit ratio), so
#: this many repeats stay below 2**53.
TILE_REPEATS = 200_000
MERGE = 64
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def term_runs(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, some PIECE bytes at a time: maximal runs of
    ASCII letters (A-Z lower-cased), digits and non-ASCII characters."""
    text = text.translate(_LOWER)
    lo = 0
    while lo < len(text):
        gap = _GAP.search(text, lo + PIECE)
        hi = gap.start() if gap else len(text)
        yield _TERM.findall(text, lo, hi)
        lo = hi


def item_terms(items: DataFrame) -> DataFrame:
    """(item, term, repeats) of a table (item, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1, BATCH):
            data, off = utf8_buffers(b.column(1))
            for item, lo, hi in zip(b.column(0).to_pylist(), off[:-1], off[1:]):
                for words in term_runs(data[lo:hi].tobytes()):
                    seen = Counter(words)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(seen), pa.int64()), pa.array(list(seen), pa.binary()),
                         pa.array(list(seen.values()), pa.int64())], names=["item", "term", "repeats"])

    return (items.mapInArrow(run, "item long, term binary, repeats long")
            .groupBy("item", "term").agg(F.sum("repeats").alias("repeats")))


def postings(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, key, n, terms, tfs) of a table (doc_id, key, text): the number
    of terms with repeats, and the places in the broadcast, sorted
    ``vocabulary`` with their occurrences.  Texts without terms are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(vocabulary.value)}
        size = len(place)
        for b in by_bytes(batches, 2, BATCH):
            data, off = utf8_buffers(b.column(2))
            n, ids, tfs = np.zeros(b.num_rows, np.int64), [], []
            for i in range(b.num_rows):
                total = None
                for words in term_runs(data[off[i]:off[i + 1]].tobytes()):
                    at = np.fromiter(map(place.get, words, repeat(size)), np.int64, len(words))
                    n[i] += len(words)
                    if total is None:
                        total = np.unique(at[at < size], return_counts=True)
                    else:  # a long text: its pieces are summed
                        if isinstance(total, tuple):
                            total = np.bincount(total[0], total[1], minlength=size).astype(np.int64)
                        total += np.bincount(at, minlength=size + 1)[:size]
                if isinstance(total, np.ndarray):
                    total = np.flatnonzero(total), total[total > 0]
                ids.append(np.zeros(0, np.int64) if total is None else total[0])
                tfs.append(np.zeros(0, np.int64) if total is None else total[1])
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x).astype(np.int32))) for x in (ids, tfs)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), *lists],
                                             names=["doc_id", "key", "n", "terms", "tfs"]).filter(pa.array(n > 0))

    return docs.mapInArrow(run, "doc_id long, key long, n long, terms array<int>, tfs array<int>")


def document_frequencies(posted: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of the ``size`` terms of a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for b in batches:
            df += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["t", "df"])

    out = np.zeros(size, np.int64)
    for r in posted.select("terms").mapInArrow(run, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).collect():
        out[r["t"]] = r["df"]  # a row for each term of the block at most
    return out


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def length_parts(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of each document, in integers that do not overflow."""
    if 25 * int(n.max(initial=0)) * n_docs < 1 << 63:
        return 75 + 25 * n * n_docs // n_terms
    return np.array([75 + 25 * x * n_docs // n_terms for x in n.tolist()], np.int64)


class ItemTile:
    """Some items of a block over the terms that they use: ``cuts`` are the
    bounds of the term tiles among ``terms``."""

    def __init__(self, row: np.ndarray, term: np.ndarray, repeats: np.ndarray, n_items: int, size: int):
        self.n_items = n_items
        self.terms, col = np.unique(term, return_inverse=True)
        # A term with more repeats than a tile may hold takes several columns.
        most = np.zeros(len(self.terms), np.int64)
        np.maximum.at(most, col, repeats)
        copies = -(-most // TILE_REPEATS)
        first = np.cumsum(copies) - copies
        self.terms = np.repeat(self.terms, copies)
        need = -(-repeats // TILE_REPEATS)
        part = ranges(np.zeros(len(need), np.int64), need)
        self.row = np.repeat(row, need)
        self.col = np.repeat(first[col], need) + part
        self.repeats = np.minimum(np.repeat(repeats, need) - part * TILE_REPEATS, TILE_REPEATS)
        order = np.argsort(self.col, kind="stable")
        self.row, self.col, self.repeats = self.row[order], self.col[order], self.repeats[order]
        self.cuts = [0]
        held = np.zeros(n_items, np.int64)
        begin = np.searchsorted(self.col, np.arange(len(self.terms) + 1))
        for c in range(len(self.terms)):
            own = slice(begin[c], begin[c + 1])
            if c - self.cuts[-1] == TILE_TERMS or (held[self.row[own]] + self.repeats[own] > TILE_REPEATS).any():
                self.cuts.append(c)
                held[:] = 0
            held[self.row[own]] += self.repeats[own]
        self.cuts.append(len(self.terms))
        self.begin = begin
        # Where a block's term first stands among the columns, and how often.
        self.first = np.full(size, -1, np.int64)
        self.first[self.terms[::-1]] = np.arange(len(self.terms))[::-1]
        self.copies = np.bincount(self.terms, minlength=size)

    def scores(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
        """Items x documents, from the postings of a tile of documents."""
        own = self.copies[term]
        col = ranges(self.first[term], own)
        doc, impact = np.repeat(doc, own), np.repeat(impact, own)
        order = np.argsort(col, kind="stable")
        col, doc, impact = col[order], doc[order], impact[order]
        total = np.zeros((self.n_items, n_docs), np.int64)
        for a, b in zip(self.cuts[:-1], self.cuts[1:]):
            counts = np.zeros((self.n_items, b - a))
            q = slice(self.begin[a], self.begin[b])
            counts[self.row[q], self.col[q] - a] = self.repeats[q]
            d = slice(*np.searchsorted(col, (a, b)))
            impacts = np.zeros((b - a, n_docs))
            impacts[col[d] - a, doc[d]] = impact[d]
            total += (counts @ impacts).astype(np.int64)
        return total


class Best:
    """The ``k`` best documents of each item so far; equal scores by id, null last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.bar = k, np.ones(n_items, np.int64)
        self.held = [np.zeros(0, np.int64)] * 4  # item, score, id is null, id
        self.parts: list = []
        self.waiting = 0

    def add(self, scores: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.bar[:, None])
        self.parts.append([item, scores[item, doc], null[doc], ids[doc]])
        self.waiting += len(item)
        if self.waiting > 4 * self.k * len(self.bar):
            self.settle()

    def settle(self) -> None:
        item, score, null, ids = [np.concatenate(x) for x in zip(self.held, *self.parts)]
        order = np.lexsort((ids, null, -score, item))
        at = item[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        keep = order[rank < self.k]
        self.held, self.parts, self.waiting = [x[keep] for x in (item, score, null, ids)], [], 0
        last = order[rank == self.k - 1]
        self.bar[item[last]] = score[last]


def _documents(b: pa.RecordBatch, weights: np.ndarray, n_docs: int, n_terms: int) -> Iterator[tuple]:
    """Tiles of a batch of postings: slice, (term, document, impact)."""
    for lo in range(0, b.num_rows, TILE_DOCS):
        t = b.slice(lo, TILE_DOCS)
        terms, tf = (t.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4))
        doc = np.repeat(np.arange(t.num_rows), np.diff(t.column(3).offsets.to_numpy()))
        m = length_parts(t.column(2).to_numpy(), n_docs, n_terms)
        yield t, terms, doc, weights[terms] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
           item_text_col: str = "text", k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` best documents with a score above 0 for each row of
    ``items``: item id, rank (int, from 1), doc id (long) and score (long).

    Terms are the maximal runs of ASCII letters (A-Z lower-cased), digits and
    non-ASCII characters of whole texts.  With N documents that have terms, L
    terms in all of them, n in a document, df documents that hold a term and
    tf occurrences in a document, a term weighs w = floor(1000 * ln((2N + 2) /
    (2df + 1))), m = 75 + 25nN div L, and the score sums w * (10**9 tf div
    (1000 tf + 12m)) over an item's terms with repeats, in 64-bit integers.

    Null and empty texts have no terms: such a document never ranks and such
    an item has no rows.  Equal scores ascend by id, a null id last; rows that
    repeat an id or a text are ranked each for itself, and so are the rows of
    ``items`` (a null or repeated item id included).  Ids of documents have to
    be integers.  An empty table on either side gives no rows.  Columns that
    are not named are not read."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    rows = scratch.write(items.select(F.col(f"`{item_id_col}`").alias("item_id"), F.monotonically_increasing_id().alias("item"),
                                      F.col(f"`{item_text_col}`").cast("string").alias("text")))
    pairs = item_terms(rows.select("item", "text")).withColumn("cost", 64 + F.octet_length("term"))
    block = F.expr(f"(cum_cost - cost) div {block_bytes}").alias("block")
    pairs = scratch.write(running_sums(pairs, ["item", "term"], ["cost"]).select("item", "term", "repeats", block))
    over = scratch.write(pairs.groupBy("item").agg(F.min("block").alias("a"), F.max("block").alias("b")).filter("a < b").select("item"))
    pairs = pairs.join(over.withColumn("split", F.lit(True)), "item", "left")
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("key"),
                      F.col(f"`{text_col}`").cast("string").alias("text"))
    last = pairs.agg(F.max("block")).first()[0]
    whole, parts = [], []
    for i in range(0 if last is None else last + 1):
        best, partial = _block(scratch, src, pairs.filter(F.col("block") == i).collect(), k)  # block_bytes at most
        whole.append(best)
        parts += [partial.withColumn("block", F.lit(i))] if partial is not None else []
    found = spark.createDataFrame([], "item long, score long, doc_id long, task int")
    for df in whole:
        found = found.unionByName(df)
    if parts:
        part = parts[0]
        for df in parts[1:]:
            part = part.unionByName(df)
        # Rows of one id and text have equal scores: they are counted, summed once, and set side by side again.
        one = part.groupBy("item", "doc_id", "key", "block").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("rows"))
        all_parts = one.groupBy("item", "doc_id", "key").agg(F.sum("score").alias("score"), F.max("rows").alias("rows"))
        found = found.unionByName(all_parts.select(
            "item", "score", "doc_id", (F.xxhash64("key", "doc_id") % 4096 * MERGE).cast("int").alias("task"),
            F.explode(F.sequence(F.lit(1), F.least("rows", F.lit(k)).cast("int")))).drop("col"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    near = found.withColumn("group", F.expr(f"task div {MERGE}"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("item", "group").orderBy(*order))).filter(F.col("r") <= k)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    return (ranked.join(rows.select("item", "item_id"), "item")
            .select(F.col("item_id").alias(item_id_col), "rank", F.col("doc_id").alias(id_col), "score"))


def _block(scratch: Scratch, src: DataFrame, pairs: list, k: int) -> tuple[DataFrame, DataFrame | None]:
    """Candidates (item, score, doc_id, task) of a block's whole items, and
    partial scores (item, score, doc_id, key) of those that other blocks share."""
    spark = scratch.spark
    terms = sorted({bytes(r["term"]) for r in pairs})
    vocabulary = spark.sparkContext.broadcast(terms)
    posted = scratch.write(postings(src, vocabulary))
    n_docs, n_terms = posted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    place = {t: i for i, t in enumerate(terms)}
    tiles = []
    for split in (False, True):
        own = [r for r in pairs if bool(r["split"]) == split]
        numbers = sorted({r["item"] for r in own})
        at = {x: i for i, x in enumerate(numbers)}
        mine: list[list] = [[] for _ in range(0, len(numbers), TILE_ITEMS)]
        for r in own:
            mine[at[r["item"]] // TILE_ITEMS].append((at[r["item"]] % TILE_ITEMS, place[bytes(r["term"])], r["repeats"]))
        tiles += [(split, np.array(numbers[i * TILE_ITEMS:(i + 1) * TILE_ITEMS], np.int64), *np.array(x, np.int64).T) for i, x in enumerate(mine)]
    shared = spark.sparkContext.broadcast((term_weights(document_frequencies(posted, len(terms)), n_docs), tiles))

    def run(batches: Iterator[pa.RecordBatch], split: bool) -> Iterator[tuple]:
        weights, plan = shared.value
        plan = [(numbers, ItemTile(row, term, repeats, len(numbers), len(weights)))
                for s, numbers, row, term, repeats in plan if s == split]
        best = [Best(t.n_items, k) for _, t in plan]
        for b in batches:
            for t, term, doc, impact in _documents(b, weights, n_docs, n_terms):
                ids = t.column(0)
                for (numbers, tile), top in zip(plan, best):
                    yield numbers, top, t, tile.scores(term, doc, impact, t.num_rows), ids.is_null().to_numpy(zero_copy_only=False), \
                        ids.fill_null(0).to_numpy()
        yield [x[0] for x in plan], best, None, None, None, None

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, best, t, scores, null, ids in run(batches, False):
            if t is not None:
                best.add(scores, null, ids)
                continue
            for own, top in zip(numbers, best):
                top.settle()
                item, score, gone, doc = top.held
                yield pa.RecordBatch.from_arrays([pa.array(own[item]), pa.array(score), pa.array(doc, mask=gone.astype(bool))],
                                                 names=["item", "score", "doc_id"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, _, t, scores, null, ids in run(batches, True):
            if t is not None:
                item, doc = np.nonzero(scores)
                yield pa.RecordBatch.from_arrays([pa.array(numbers[item]), pa.array(scores[item, doc]), pa.array(ids[doc], mask=null[doc]),
                                                  t.column(1).take(pa.array(doc))], names=["item", "score", "doc_id", "key"])

    used = posted.filter(F.size("terms") > 0)
    found = scratch.write(used.mapInArrow(whole, "item long, score long, doc_id long").withColumn("task", F.spark_partition_id()))
    if not any(t[0] for t in tiles):
        return found, None
    return found, scratch.write(used.mapInArrow(partial, "item long, score long, doc_id long, key long"))
