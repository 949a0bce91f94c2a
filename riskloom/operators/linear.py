"""Linear models and their cross-validation from sufficient statistics.

One scan sums, per fold, the products of all pairs of columns; everything else
follows from these small matrices on the driver.  A fold's training statistics
are the total minus its own, so every fold's standardised ridge, lasso or
elastic net, and its error on the held-out rows, cost no further pass over the
data, whatever the number of penalties tried.

Products are of values less a first mean, so nothing is lost to cancellation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees as T

#: Columns beyond this make one aggregate of too many sums.
MAX_FEATURES = 64


@dataclass
class Moments:
    """n, sums and products of (features, label) less ``centre``."""
    centre: np.ndarray
    n: float
    s: np.ndarray
    xx: np.ndarray

    def __add__(self, o: Moments) -> Moments:
        return Moments(self.centre, self.n + o.n, self.s + o.s, self.xx + o.xx)

    def __sub__(self, o: Moments) -> Moments:
        return Moments(self.centre, self.n - o.n, self.s - o.s, self.xx - o.xx)

    def scatter(self) -> tuple[np.ndarray, np.ndarray]:
        """Means (less the centre) and centred products."""
        mean = self.s / self.n
        return mean, self.xx - self.n * np.outer(mean, mean)


@dataclass
class Linear:
    """Coefficients on the raw columns."""
    features: list[str]
    coef: np.ndarray
    intercept: float

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        e = F.lit(self.intercept)
        for c, b in zip(self.features, self.coef.tolist()):
            e = e + F.lit(b) * F.col(c)
        return df.withColumn(out, e)


def fold_moments(df: DataFrame, features: Sequence[str], label: str, fold: str | None = None) -> dict:
    """{fold: Moments} of the rows in which no column is missing (one scan and
    the means before it)."""
    cols = [*features, label]
    if len(cols) > MAX_FEATURES + 1:
        raise ValueError(f"{len(cols) - 1} features; at most {MAX_FEATURES}")
    whole = df.dropna(subset=cols)
    centre = np.array([x or 0.0 for x in whole.agg(*[F.avg(c) for c in cols]).first()])
    v = [F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(cols, centre)]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    g = whole.groupBy(F.col(fold).alias("fold") if fold else F.lit(0).alias("fold"))
    out = {}
    for r in g.agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(v)],
                   *[F.sum(v[i] * v[j]).alias(f"p{i}_{j}") for i, j in pairs]).collect():
        xx = np.zeros((len(cols), len(cols)))
        for i, j in pairs:
            xx[i, j] = xx[j, i] = r[f"p{i}_{j}"]
        out[r["fold"]] = Moments(centre, float(r["n"]), np.array([r[f"s{i}"] for i in range(len(cols))]), xx)
    return out


def solve(m: Moments, features: Sequence[str], ridge: float = 0.0, lasso: float = 0.0, sweeps: int = 10000, tolerance: float = 1e-12) -> Linear:
    """Least squares on standardised columns (population std; a constant column
    gets no weight) plus ``ridge`` * |b|^2 and ``2 n lasso`` * |b|_1, that is
    the objectives of ridge (alpha = ``ridge``) and of lasso and elastic net
    ((1 / 2n) squares + ``lasso`` |b|_1 + (``ridge`` / 2n) |b|^2)."""
    mean, c = m.scatter()
    d = len(features)
    std = np.sqrt(np.maximum(np.diag(c)[:d] / m.n, 0.0))
    use = std > 1e-12 * np.maximum(1.0, np.abs(mean[:d] + m.centre[:d]))
    inv = np.where(use, 1 / np.where(use, std, 1.0), 0.0)
    a = c[:d, :d] * np.outer(inv, inv)
    b = c[:d, d] * inv
    if lasso > 0:
        coef = np.zeros(d)
        for _ in range(sweeps):
            moved = 0.0
            for j in np.flatnonzero(use):
                rho = b[j] - a[j] @ coef + a[j, j] * coef[j]
                new = np.sign(rho) * max(abs(rho) - m.n * lasso, 0.0) / (a[j, j] + ridge)
                moved, coef[j] = max(moved, abs(new - coef[j])), new
            if moved <= tolerance:
                break
    else:
        coef = np.where(use, np.linalg.lstsq(a + ridge * np.eye(d), b, rcond=None)[0], 0.0)
    raw = coef * inv
    return Linear(list(features), raw, float(mean[d] + m.centre[d] - raw @ (mean[:d] + m.centre[:d])))


def rmse(m: Moments, model: Linear) -> float:
    """Root mean squared error of a model over the rows behind ``m``."""
    d = len(model.coef)
    off = model.intercept + model.coef @ m.centre[:d] - m.centre[d]  # residual = off + coef . x - y, all centred
    w = np.append(model.coef, -1.0)
    return float(np.sqrt(max(0.0, (m.n * off * off + 2 * off * (w @ m.s) + w @ m.xx @ w) / m.n)))


def cross_validate_linear(df: DataFrame, features: Sequence[str], label: str, fold: str, penalties: Sequence[tuple[float, float]]) -> list:
    """[(ridge, lasso, fold, rmse)] for every penalty and fold, from one scan.
    The standardisation of a fold's model is that of its training rows."""
    per = fold_moments(df, features, label, fold)
    if not per:
        return []
    total = None
    for m in per.values():
        total = m if total is None else total + m
    return [(r, a, f, rmse(per[f], solve(total - per[f], features, r, a)))
            for r, a in penalties for f in sorted(per) if total.n > per[f].n]


@dataclass
class Ridge:
    """Coefficients of a ridge without intercept."""
    features: list[str]
    coef: np.ndarray

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        coef = self.coef
        return T.scored(df, self.features, lambda x: coef @ x, out)


def fit_ridge(df: DataFrame, features: Sequence[str], label: str, alpha: float) -> Ridge:
    """Least squares plus ``alpha`` * |b|^2, without intercept, from one pass
    that sums the products of all pairs of columns with numpy; the columns are not
    written, so they may be many.  A missing value is an error."""
    d = len(features)

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((d + 1, d + 1))
        for b in batches:
            z = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
            total += z @ z.T
        return total

    columns = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*features, label])])
    xx = T.Packed.of(columns).summed(sums).reshape(d + 1, d + 1)
    if np.isnan(xx).any():
        raise ValueError("a missing value in the features or the label")
    return Ridge(list(features), np.linalg.lstsq(xx[:d, :d] + alpha * np.eye(d), xx[:d, d], rcond=None)[0])
