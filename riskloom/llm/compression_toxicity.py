"""Toxicity by compression distance to zstandard dictionaries.

One dictionary is trained on ordinary text, one on toxic text.  A third holds
the ordinary content and, after it, the word stems that set toxic training
documents apart from ordinary ones (by likelihood ratio).  A document is cut
into windows of whole words; each is compressed with all three, and the bytes
that the stems and the toxic dictionary save are its distances.  How many
windows save 1, 2, ... 6 bytes or more is the document's evidence, and a
logistic curve that is calibrated on the training rows weighs these thresholds
into a score.

The fit uses a bounded sample of labelled rows: at most ``fit_rows`` of each
label, chosen by a hash of the id, of at most ``fit_bytes`` bytes each, and for
a dictionary at most ``fit_windows`` windows of them.  Scoring
covers whole texts and needs only the text; nothing is shuffled.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_position, by_bytes, prepare

WINDOW = 64
STEM = (3, 12)
SHARE = 0.04
LEVEL = 9
DICTIONARY_BYTES, STEMS_BYTES = 32 << 10, 2 << 10
THRESHOLDS = (1, 2, 3, 4, 5, 6)
TEXT_BYTES = 1 << 20
FIT_WINDOWS = 80_000
# Up to WINDOW bytes that end before white space; a longer word is cut.
_WINDOWS = re.compile(rb"(?s)\S.{0,%d}(?=\s|\Z)|\S{1,%d}" % (WINDOW - 2, WINDOW))


def windows(text: str | None) -> list[bytes]:
    """A text's windows, lower-case, with a blank at both ends."""
    return [b" %b " % w for w in _WINDOWS.findall((text or "").encode().lower())]


@dataclass
class Model:
    """The dictionaries (ordinary text, with toxic stems, toxic text) and the
    weights of the evidence."""

    ordinary: bytes
    stems: bytes
    toxic: bytes
    weights: list[float]

    def compressors(self):
        out = []
        for raw in (self.ordinary, self.stems, self.toxic):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))
        return out


def savings(texts: list[str | None], compressors) -> tuple[np.ndarray, np.ndarray]:
    """(bytes that the stems and the toxic dictionary save in every window, two
    rows; number of windows of each text)."""
    cut = [windows(t) for t in texts]
    flat = [w for ws in cut for w in ws]
    n = np.array([len(ws) for ws in cut], np.int64)
    size = [np.fromiter((len(c.compress(w)) for w in flat), np.int64, len(flat)) for c in compressors]
    return np.stack([size[0] - size[1], size[0] - size[2]]), n


def evidence(saved: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per text: 1, its windows, and for each dictionary the windows that save
    each of THRESHOLDS bytes or more (logarithms) and the savings for each
    window; for the toxic text also the mean difference."""
    of = np.repeat(np.arange(len(n)), n)
    parts = [np.ones(len(n)), np.log1p(n) / 4]
    for one in saved:
        parts += [np.log1p(np.bincount(of, one >= k, len(n))) for k in THRESHOLDS]
        rate = np.bincount(of, np.maximum(one, 0), len(n)) / np.maximum(n, 1)
        parts.append(np.log1p(1000 * rate / WINDOW) / 3)
    return np.stack([*parts, np.bincount(of, saved[1], len(n)) / np.maximum(n, 1)], axis=1)


def _trained(pool: list[bytes], most: int) -> bytes:
    """A dictionary of windows, of ``most`` of them at most, evenly spread."""
    pool = pool[::max(1, -(-len(pool) // most))]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pool).as_bytes()[-DICTIONARY_BYTES:]
    except zstandard.ZstdError:  # too little text to train on: its bytes are the dictionary
        return b"".join(pool)[-DICTIONARY_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    reg = np.eye(x.shape[1]) * ridge
    reg[0, 0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + reg, x.T @ (weight * (y - p)) - reg @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _stems(data: bytes) -> set[bytes]:
    """Beginnings of a text's words, each with the blank before it, and the
    whole words with the blank after."""
    out = set()
    for w in set(data.split()):
        out.update(b" " + w[:k] for k in range(STEM[0], min(len(w), STEM[1]) + 1))
        out.add(b" " + w[:STEM[1]] + b" ")
    return out


def contrast_passages(docs: list[bytes], others: list[bytes], limit: int, least: float) -> list[bytes]:
    """Word stems that set ``docs`` apart from ``others``: those with the highest
    log-likelihood ratio of document counts, none inside another, strongest last."""
    count, size, seen = [Counter(), Counter()], [0, 0], set()
    for k, group in enumerate((docs, others)):
        for d in group:
            stems = _stems(d)
            sketch = tuple(sorted(map(zlib.crc32, stems))[:4])
            if not stems or sketch in seen:  # a copy counts once
                continue
            seen.add(sketch)
            size[k] += 1
            count[k].update(stems)
        if not k:  # what is rarer than this cannot reach ``least``
            count[0] = Counter({s: c for s, c in count[0].items() if c >= 3})
    if not min(size):
        return []
    rated = []
    for s, a in count[0].items():
        b = count[1][s]
        if a / size[0] <= 3 * b / size[1]:
            continue
        rate = (a + b) / sum(size)
        ratio = 2 * (a * math.log(a / (rate * size[0])) + (b * math.log(b / (rate * size[1])) if b else 0))
        if ratio >= least:
            rated.append((-ratio, -len(s), s))
    picked: list[bytes] = []
    have = b""
    for ratio, _, s in sorted(rated):
        if len(have) + len(s) > limit or -ratio < SHARE * -min(rated)[0]:
            break
        if s not in have and not any(p in s for p in picked):
            picked.append(s)
            have += s
    return picked[::-1]


def fit(texts: list[str], labels: list[int], totals: tuple[int, int] | None = None, fit_windows: int = FIT_WINDOWS) -> Model:
    """A model of the given rows (a bounded sample); ``totals`` are the numbers
    of ordinary and toxic rows that the sample stands for.  A dictionary is
    trained on ``fit_windows`` windows of its label at most."""
    norm = [" ".join([" "] + t.lower().split() + [" "]).encode() for t in texts]
    y = np.array(labels, float)
    toxic, ordinary = [n for n, l in zip(norm, labels) if l], [n for n, l in zip(norm, labels) if not l]
    base, other = (_trained([w for t, l in zip(texts, labels) if bool(l) == k for w in windows(t)], fit_windows) or b" the and " for k in (False, True))
    mine = b"".join(contrast_passages(toxic, ordinary, STEMS_BYTES, 18.0))
    # Unused bytes stand in for the passages, so shared content keeps its distance in both.
    pad = b"\x01" * len(mine)
    model = Model(base + pad, base + mine, other + pad, [])
    if 0 < y.sum() < len(y):
        # A score is a probability among all labelled rows, whatever the sample's mix.
        mix = np.array([1 - y.mean(), y.mean()])
        share = mix if totals is None else np.array(totals) / sum(totals)
        model.weights = _logistic(evidence(*savings(texts, model.compressors())), y, (share / mix)[y.astype(int)]).tolist()
    else:
        share = (y.sum() + 1) / (len(y) + 2)
        model.weights = [float(np.log(share / (1 - share)))] + [0.0] * (2 * len(THRESHOLDS) + 4)
    return model


def is_held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def fit_from_tables(docs: DataFrame, labels: DataFrame, fit_rows: int = 3000, fit_bytes: int = 16384) -> Model:
    """Fit on the labelled rows that are not held out.  Null labels and ids
    are skipped; an id labelled twice counts as toxic if any label is."""
    usable = (labels.select(F.col("doc_id").alias("lid"), F.col("toxic").cast("int").alias("y"))
              .filter(F.col("lid").isNotNull() & F.col("y").isNotNull() & ~is_held_out("lid"))
              .groupBy("lid").agg(F.max("y").alias("y")))
    pick = lambda y: usable.filter(F.col("y") == y).orderBy(F.xxhash64("lid"), "lid").limit(fit_rows)
    count = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}  # a row per label
    chosen = F.broadcast(pick(1).union(pick(0)))  # 2 * fit_rows ids at most
    rows = (docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
            .filter(F.octet_length("text") <= fit_bytes)
            .join(chosen, F.col("id") == F.col("lid")).groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
            .orderBy("id").toPandas())
    return fit(rows["text"].tolist(), rows["y"].tolist(), (count.get(0, 0) or 1, count.get(1, 0) or 1))


def _scorer(model: Model, text_at: int, keep_below: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comp, w = model.compressors(), np.array(model.weights)
        for b in by_bytes(batches, text_at, TEXT_BYTES):
            saved, n = savings(b.column(text_at).to_pylist(), comp)
            score = 1 / (1 + np.exp(-np.clip(evidence(saved, n) @ w, -30, 30)))
            if keep_below is None:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], names=["id", "score"])
            else:
                yield b.filter(pa.array(score < keep_below))
    return run


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row, whole texts, labels not read.

    Null and empty texts get the score of no evidence; null and repeated ids
    stay rows of their own; an empty table gives an empty result."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = src.mapInArrow(_scorer(model, 1, None), f"id {src.schema['id'].dataType.simpleString()}, score double")
    return out.withColumnRenamed("id", id_col)


def keep_below(docs: DataFrame, model: Model, limit: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows with a score under ``limit``, with all their columns under any
    name, dotted or clashing.  Null and empty texts have the score of no
    evidence; repeated rows and null ids are rows of their own; an empty table
    gives an empty result."""
    prepare(docs.sparkSession)
    plain = by_position(docs)
    kept = plain.mapInArrow(_scorer(model, docs.columns.index(text_col), limit), plain.schema)
    return kept.toDF(*docs.columns)
