"""Label-conditioned synthetic cohort columns (A3, H14), derived row by row
from the keys of an existing table.

Each output row belongs to one input row (its key), so the cohort grows with
the table it is derived from and is spread over the same partitions.  The
randomness is a function of (key, column salt, seed) only - uniforms from
``xxhash64``, normals by Box-Muller, exponentials by inversion - so a row's
values do not depend on partitioning, task retries or executor loss.
Mixtures draw their component per row (the reference draws one value per
component for the whole table, which makes every positive share two values).
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TWO63 = float(2 ** 63)


def uniform(key: Column, salt: int, seed: int = 42) -> Column:
    """Uniform in (0, 1) from a hash of the key."""
    h = F.xxhash64(key, F.lit(salt), F.lit(seed))
    return (F.abs(h.cast("double")) + 0.5) / F.lit(_TWO63 + 1.0)


def normal(key: Column, salt: int, mean: float, sd: float, seed: int = 42) -> Column:
    u1, u2 = uniform(key, salt, seed), uniform(key, salt + 7919, seed)
    z = F.sqrt(-2.0 * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)
    return F.lit(float(mean)) + F.lit(float(sd)) * z


def exponential(key: Column, salt: int, scale: float, seed: int = 42) -> Column:
    return -F.log(F.lit(1.0) - uniform(key, salt, seed)) * F.lit(float(scale))


def bernoulli(key: Column, salt: int, p: float, seed: int = 42) -> Column:
    return F.when(uniform(key, salt, seed) < p, 1).otherwise(0)


def draw(key: Column, salt: int, spec, seed: int = 42) -> Column:
    """One draw from a spec: ("normal", mean, sd), ("exp", scale, shift),
    ("lognormal", mu, sigma), ("bernoulli", p), ("int", lo, hi),
    ("choice", [(weight, spec), ...])."""
    kind = spec[0]
    if kind == "normal":
        return normal(key, salt, spec[1], spec[2], seed)
    if kind == "exp":
        return exponential(key, salt, spec[1], seed) + F.lit(float(spec[2]))
    if kind == "lognormal":
        return F.exp(normal(key, salt, spec[1], spec[2], seed))
    if kind == "bernoulli":
        return bernoulli(key, salt, spec[1], seed)
    if kind == "int":
        return (F.lit(spec[1]) + F.floor(uniform(key, salt, seed) * (spec[2] - spec[1] + 1))).cast("int")
    if kind == "choice":
        u = uniform(key, salt + 104729, seed)
        acc = 0.0
        out = None
        for i, (w, sub) in enumerate(spec[1]):
            acc += w
            v = draw(key, salt + 31 * (i + 1), sub, seed)
            out = F.when(u < acc, v) if out is None else out.when(u < acc, v)
        return out.otherwise(draw(key, salt + 31 * len(spec[1]), spec[1][-1][1], seed))
    raise ValueError(f"unknown distribution {kind}")


def cohort(source: DataFrame, key: str, label: str, prevalence: float, columns: Sequence,
           seed: int = 42) -> DataFrame:
    """One synthetic patient per ``source`` row.

    ``columns``: (name, spec_if_negative, spec_if_positive, clip_lo, clip_hi)
    - a two-way select on the label (H14) followed by a clip (B16)."""
    k = F.col(key)
    out = source.select(k.alias(key)).withColumn(label, bernoulli(k, 1, prevalence, seed))
    cols = {}
    for i, (name, neg, pos, lo, hi) in enumerate(columns):
        salt = 1000 * (i + 2)
        v = F.when(F.col(label) == 1, draw(k, salt, pos, seed)).otherwise(draw(k, salt + 500, neg, seed))
        if lo is not None or hi is not None:
            v = F.least(F.greatest(v, F.lit(float(lo if lo is not None else -1e300))),
                        F.lit(float(hi if hi is not None else 1e300)))
        cols[name] = v
    return out.withColumns(cols)


# The sepsis cohort of the reference (negative / positive
# distributions and clip bounds), first block of variables.
SEPSIS = [
    ("age", ("normal", 60, 15), ("normal", 60, 15), 18, 95),
    ("temperature", ("normal", 37.0, 0.3),
     ("choice", [(0.7, ("normal", 38.5, 0.8)), (0.3, ("normal", 35.5, 0.5))]), None, None),
    ("heart_rate", ("normal", 75, 10), ("normal", 110, 15), None, None),
    ("respiratory_rate", ("normal", 16, 2), ("normal", 24, 4), None, None),
    ("systolic_bp", ("normal", 120, 10), ("normal", 95, 15), None, None),
    ("diastolic_bp", ("normal", 75, 8), ("normal", 55, 10), None, None),
    ("wbc", ("normal", 8, 2), ("choice", [(0.8, ("normal", 15, 3)), (0.2, ("normal", 3, 1))]), 0.5, 30),
    ("lactate", ("exp", 0.5, 0.5), ("exp", 3, 2), 0.5, 15),
    ("creatinine", ("normal", 1.0, 0.2), ("normal", 2.5, 0.8), None, None),
]
SEPSIS_PREVALENCE = 0.15
