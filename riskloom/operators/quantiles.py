"""Exact quantiles of columns and groups without gathering either anywhere.

``percentile`` and ``median`` keep a value -> count map that is finally merged
in one task.  Here values are counted (partial aggregation: a repeated value
costs one row per task), put in order by range buckets with running sums
(``ordering.py``), and the values at the wanted ranks are picked.  Every size
and every group goes this one way.

For whole columns only the values around the wanted ranks are put in order: a
bounded sketch per task gives a bracket for each probability, one exact count
pass verifies it, and a bracket that misses its ranks is widened until it
holds them (at most to the whole range).

Interpolation follows ``percentile``: position ``p * (n - 1)``, linear between
the floor and ceiling order statistics.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import running_sums

_ACCURACY = 10000


def _interpolate(position: float, lo_v: float, hi_v: float) -> float:
    lower, higher = math.floor(position), math.ceil(position)
    if higher == lower or lo_v == hi_v:
        return float(lo_v)
    return (higher - position) * lo_v + (position - lower) * hi_v


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], **kw) -> list:
    """Exact ``percentile(col, p)`` for each p (NULLs skipped; NULL if no value)."""
    return exact_quantiles_multi(df, [col], probs, **kw)[col]


def exact_quantiles_multi(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                          margin: float = 4.0 / _ACCURACY) -> dict:
    """``{col: [percentile(col, p) for p in probs]}`` for several columns."""
    cols, probs = list(cols), list(probs)
    d = df.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    n: dict[int, int] = {}
    brackets: dict[tuple, tuple] = {}  # (column, probability) -> (lowest, highest, values below)
    wanted = [(i, p) for i in range(len(cols)) for p in probs]
    while wanted:
        at = sorted({min(1.0, max(0.0, p + s)) for _, p in wanted for s in (-margin, margin)})
        todo = sorted({i for i, _ in wanted})
        head = d.agg(*[F.count(f"_x{i}").alias(f"n{i}") for i in todo],
                     *[F.percentile_approx(f"_x{i}", at, _ACCURACY).alias(f"q{i}") for i in todo]).first()
        n.update({i: head[f"n{i}"] for i in todo})
        wanted = [(i, p) for i, p in wanted if n[i]]
        if not wanted:
            break
        guess = {}
        for i, p in wanted:
            approx = dict(zip(at, head[f"q{i}"]))
            whole = margin >= 1.0
            guess[i, p] = (float("-inf") if whole else approx[max(0.0, p - margin)],
                           float("inf") if whole else approx[min(1.0, p + margin)])
        row = d.agg(*[F.count_if(F.col(f"_x{i}") < lo).alias(f"b{j}") for j, ((i, _), (lo, _h)) in enumerate(guess.items())],
                    *[F.count_if(F.col(f"_x{i}").between(lo, hi)).alias(f"c{j}")
                      for j, ((i, _), (lo, hi)) in enumerate(guess.items())]).first()
        wanted = []
        for j, ((i, p), (lo, hi)) in enumerate(guess.items()):
            pos = p * (n[i] - 1)
            if row[f"b{j}"] <= math.floor(pos) and math.ceil(pos) < row[f"b{j}"] + row[f"c{j}"]:
                brackets[i, p] = (lo, hi, row[f"b{j}"])
            else:
                wanted.append((i, p))
        margin *= 8
    found: dict[tuple, float] = {}
    if brackets:
        keys = list(brackets)
        tags = [F.when(F.col(f"_x{i}").between(*brackets[i, p][:2]), F.struct(F.lit(j).alias("j"), F.col(f"_x{i}").alias("x")))
                for j, (i, p) in enumerate(keys)]
        inside = (d.select(F.explode(F.array(*tags)).alias("t")).where(F.col("t").isNotNull())
                  .groupBy("t.j", "t.x").agg(F.count(F.lit(1)).alias("k")))
        ranks = {j: (brackets[key][2], key[1] * (n[key[0]] - 1)) for j, key in enumerate(keys)}
        run = running_sums(inside, ["x"], ["k"], partition_cols=["j"])
        hit = None
        for j, (below, pos) in ranks.items():
            for r in {math.floor(pos), math.ceil(pos)}:
                c = (F.col("j") == j) & (F.col("cum_k") - F.col("k") + below <= r) & (r < F.col("cum_k") + below)
                hit = c if hit is None else hit | c
        # Two rows at most for each column and probability.
        for r in run.where(hit).collect():
            below = ranks[r["j"]][0]
            for pos in (math.floor(ranks[r["j"]][1]), math.ceil(ranks[r["j"]][1])):
                if below + r["cum_k"] - r["k"] <= pos < below + r["cum_k"]:
                    found[r["j"], pos] = r["x"]
        index = {key: j for j, key in enumerate(keys)}
    out = {}
    for i, c in enumerate(cols):
        if not n.get(i):
            out[c] = [None] * len(probs)
            continue
        out[c] = [_interpolate(p * (n[i] - 1), found[index[i, p], math.floor(p * (n[i] - 1))],
                               found[index[i, p], math.ceil(p * (n[i] - 1))]) for p in probs]
    return out


def group_quantiles(df: DataFrame, cols: Sequence[str] | str, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``(keys..., q)``: per group an array of exact ``percentile(col, p)`` (for
    one column), or ``(keys..., column, q)`` for several, in one pass.  NULL
    keys and values are dropped."""
    keys = list(keys)
    many = not isinstance(cols, str)
    names = list(cols) if many else [cols]
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in names]))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    data = (df.where(cond).select(*keys, values.alias("v")).where(F.col("v.x").isNotNull())
            .groupBy(*keys, F.col("v.column").alias("column"), F.col("v.x").alias("_x")).agg(F.count(F.lit(1)).alias("_k")))
    # A repeated value is one row; the order is by range, so a hot group is spread.
    run = running_sums(data, ["_x"], ["_k"], partition_cols=[*keys, "column"], totals_prefix="_all")
    first, last = F.col("cum__k") - F.col("_k"), F.col("cum__k")
    picks = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_all_k") - 1)
        for tag, r in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            picks.append(F.max(F.when((first <= r) & (r < last), F.col("_x"))).alias(f"{tag}{i}"))
    got = run.groupBy(*keys, "column").agg(F.first("_all_k").alias("_n"), *picks)
    out = []
    for i, p in enumerate(probs):
        pos, lo, hi = F.lit(float(p)) * (F.col("_n") - 1), F.col(f"lo{i}"), F.col(f"hi{i}")
        out.append(F.when((F.floor(pos) == F.ceil(pos)) | (lo == hi), lo)
                   .otherwise((F.ceil(pos) - pos) * lo + (pos - F.floor(pos)) * hi))
    return got.select(*keys, *(["column"] if many else []), F.array(*out).alias("q"))


def group_quantile(df: DataFrame, col: str, keys: Sequence[str], p: float = 0.5, name: str | None = None) -> DataFrame:
    """Exact ``percentile(col, p)`` per group (NULL keys and values dropped)."""
    q = cut_lineage(group_quantiles(df, col, keys, [p]))
    return q.select(*keys, F.col("q")[0].alias(name or f"q_{col}"))
