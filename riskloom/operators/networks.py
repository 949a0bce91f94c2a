"""A ReLU network with early stopping (N11) and kernel machines on random
Fourier features (N8), fitted by summed gradients.

The rows are packed (``trees.pack``) as raw values.  A pass sends the current
weights, which are small, to the tasks; each sums loss and gradient over its
rows with numpy, and the sums come back through ``Packed.summed``.

``fit_network``: Adam on the summed gradients; an epoch goes through the
chunks in ``batches`` passes, each over its share of them, and ends with the
loss of rows that are held out by a hash.  The shares and the held-out rows are
written apart, so a pass reads its own rows only; they and the products of a
pass are in single precision, the sums over chunks and the steps in double.  Without a better loss for
``patience`` epochs the fit ends with the best weights.

``fit_svm`` / ``fit_svr``: squared hinge and squared epsilon-insensitive loss
with an L2 penalty.  Both are piecewise quadratic, so Newton steps from summed
gradients and second derivatives end at the minimum.  Models without each of
the folds are fitted in the same passes; a sigmoid fitted to their scores of the
rows they have not seen gives probabilities (Platt scaling).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import trees as T

SMALL_CHUNK = 2048


def _sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


# -- network ---------------------------------------------------------------------

def _shapes(n_in: int, hidden: Sequence[int]) -> list[tuple[int, int]]:
    sizes = [n_in, *hidden, 1]
    return list(zip(sizes[:-1], sizes[1:]))


def _layers(flat: np.ndarray, shapes: list) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in shapes:
        out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def network_score(flat: np.ndarray, shapes: list, x: np.ndarray) -> np.ndarray:
    """The output before the sigmoid; ``x`` is rows x features."""
    layers = _layers(flat, shapes)
    for w, b in layers[:-1]:
        x = np.maximum(x @ w + b, 0)
    w, b = layers[-1]
    return (x @ w + b)[:, 0]


def loss_and_gradient(flat: np.ndarray, shapes: list, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed logistic loss of the rows and its gradient."""
    layers = _layers(flat, shapes)
    acts = [x]
    for w, b in layers[:-1]:
        acts.append(np.maximum(acts[-1] @ w + b, 0))
    w, b = layers[-1]
    s = (acts[-1] @ w + b)[:, 0].astype(np.float64)
    loss = float((weight * (np.logaddexp(0, s) - y * s)).sum())
    back = (weight * (_sigmoid(s) - y))[:, None].astype(x.dtype)
    grads = []
    for i in range(len(layers) - 1, -1, -1):
        grads.append(np.concatenate([(acts[i].T @ back).ravel(), back.sum(0, dtype=np.float64)]))
        if i:
            back = (back @ layers[i][0].T) * (acts[i] > 0)
    return loss, np.concatenate(grads[::-1])


@dataclass
class Network:
    features: list[str]
    shapes: list
    weights: np.ndarray
    held_out: list[float]  # loss of the held-out rows by epoch

    def predict(self, df: DataFrame, out: str = "prob") -> DataFrame:
        bc = df.sparkSession.sparkContext.broadcast((self.weights, self.shapes))
        return T.scored(df, self.features, lambda x: _sigmoid(network_score(*bc.value, x.T)), out)


def _shares(packed: T.Packed, n_f: int, batches: int, held: float, seed: int) -> list[T.Packed]:
    """The packed rows dealt to ``batches`` tables chunk by chunk, without those
    held out, which are the last table; a missing value is 0.  Each task begins
    with another table, so that few chunks a task are spread over all of them; with
    fewer chunks than tables some have no rows."""
    def deal(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for i, c in enumerate(T.chunks_of(read, n_f, binned=False), TaskContext.get().partitionId()):
            out = T.draw(c.u, seed) < held
            for share, use in ((i % batches, ~out), (batches, out)):
                if use.any():
                    x = np.nan_to_num(c.x[:, use].T.astype(np.float32))
                    yield pa.RecordBatch.from_arrays([pa.array([share], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in (x, c.y[use], c.w[use]))],
                                                     names=["share", "x", "y", "w"])

    dealt = cut_lineage(packed.df.mapInArrow(deal, "share int, x binary, y binary, w binary"), by="share", group_bytes=T.GROUP_BYTES)
    return [T.Packed.of(dealt.where(F.col("share") == i).select("x", "y", "w")) for i in range(batches + 1)]


def _rows_of(read: Iterator[pa.RecordBatch], n_f: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows x features, labels, weights) of the chunks of a share."""
    for b in read:
        for x, y, w in zip(*((v.as_buffer() for v in b.column(c)) for c in ("x", "y", "w"))):
            yield np.frombuffer(x, np.float32).reshape(-1, n_f), np.frombuffer(y), np.frombuffer(w)


def fit_network(train: DataFrame, features: Sequence[str], label: str, key: str | None = None, hidden: Sequence[int] = (100, 50, 25),
                epochs: int = 200, batches: int = 4, rate: float = 0.005, l2: float = 1e-4, held: float = 0.1, patience: int = 10,
                tolerance: float = 1e-4, weight: str | None = None, seed: int = 42) -> Network:
    """Fit a network to a 0/1 label.  The features should be scaled and whole
    (a missing value counts as 0); rows without a label are left out; without
    rows the weights are the random start."""
    features = list(features)
    n_f = len(features)
    shapes = _shapes(n_f, hidden)
    packed = T.pack(train.where(F.col(label).isNotNull()), features, label, None, key, weight, chunk=SMALL_CHUNK,
                    tasks=train.sparkSession.sparkContext.defaultParallelism)
    rng = np.random.default_rng(seed)
    flat = np.concatenate([np.concatenate([rng.uniform(-1, 1, a * b) * math.sqrt(6 / (a + b)), np.zeros(b)]) for a, b in shapes])
    # Penalised are the weights, not the offsets.
    penalised = np.concatenate([np.concatenate([np.ones(a * b), np.zeros(b)]) for a, b in shapes])

    *shares, apart = _shares(packed, n_f, batches, held, seed)

    def sums(flat: np.ndarray, learn: bool) -> Callable:
        single = flat.astype(np.float32)

        def run(read: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros(len(flat) + 2)
            for x, y, w in _rows_of(read, n_f):
                if learn:
                    loss, g = loss_and_gradient(single, shapes, x, y, w)
                    total[0] += loss
                    total[2:] += g
                else:
                    s = network_score(single, shapes, x).astype(np.float64)
                    total[0] += (w * (np.logaddexp(0, s) - y * s)).sum()
                total[1] += w.sum()
            return total

        return run

    m, v, step = np.zeros_like(flat), np.zeros_like(flat), 0
    best, best_flat, waited, history = math.inf, flat, 0, []
    for _ in range(epochs):
        for share in shares:
            got = share.summed(sums(flat, True))
            if got[1] <= 0:
                continue
            step += 1
            g = got[2:] / got[1] + l2 * penalised * flat
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            flat = flat - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        got = apart.summed(sums(flat, False))
        loss = got[0] / got[1] if got[1] > 0 else math.inf
        history.append(float(loss))
        if loss < best - tolerance:
            waited = 0
        else:
            waited += 1
        if loss < best:
            best, best_flat = loss, flat
        if waited >= patience or not step:
            break
    return Network(features, shapes, best_flat, history)


# -- kernel machines -----------------------------------------------------------------

@dataclass
class FourierMap:
    """Random features of the kernel exp(-gamma |x - z|^2), and an offset."""
    w: np.ndarray
    b: np.ndarray

    @classmethod
    def of(cls, n_f: int, components: int, gamma: float, seed: int) -> FourierMap:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0.0, math.sqrt(2 * gamma), (n_f, components)), rng.uniform(0, 2 * math.pi, components))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Rows x (components + 1) of features x rows."""
        m = len(self.b)
        z = np.empty((x.shape[1], m + 1))
        z[:, m] = 1.0
        x, w, b, scale = np.nan_to_num(x).T, self.w / (2 * math.pi), self.b / (2 * math.pi), math.sqrt(2.0 / m)
        for lo in range(0, len(z), 128):  # blocks that stay in a core's cache
            np.multiply(_cos_of_turns(x[lo:lo + 128] @ w + b), scale, out=z[lo:lo + 128, :m])
        return z


#: Of cos(pi t / 2) in powers of t^2, for t of at most a half.
_COS = [(-1) ** k * (math.pi / 2) ** (2 * k) / math.factorial(2 * k) for k in range(9)]


def _cos_of_turns(t: np.ndarray) -> np.ndarray:
    """cos(2 pi t), to some 1e-15: a power series of a quarter of the angle,
    doubled twice.  numpy's own takes four times as long."""
    t = t - np.rint(t)
    t *= t
    c = np.full_like(t, _COS[-1])
    for a in _COS[-2::-1]:
        c *= t
        c += a
    for _ in range(2):
        c *= c
        c *= 2
        c -= 1
    return c


@dataclass
class KernelMachine:
    features: list[str]
    map: FourierMap
    weights: np.ndarray
    sigmoid: tuple[float, float] | None  # probability = 1 / (1 + exp(a * score + b))
    gradient: float  # largest part of the objective's gradient at the end

    def predict(self, df: DataFrame, out: str = "prediction", score: bool = False) -> DataFrame:
        """The probability (of a classifier), or with ``score`` and for
        numbers the value itself."""
        bc = df.sparkSession.sparkContext.broadcast((self.map, self.weights))
        sig = None if score else self.sigmoid

        def of(x: np.ndarray) -> np.ndarray:
            f, w = bc.value
            s = f(x) @ w
            return s if sig is None else _sigmoid(-(sig[0] * s + sig[1]))

        return T.scored(df, self.features, of, out)


#: Rows of each model whose minimum is the start of the fit to all rows.
START_ROWS = 20_000


def _newton(packed: T.Packed, n_f: int, f: FourierMap, residual: Callable, c: float, folds: int, seed: int, steps: int, tolerance: float,
            start: np.ndarray | None = None, share: float = 1.0):
    """Minimise |w|^2 / 2 + c * sum of active residuals^2 for the whole table and
    without each fold, all in the same passes.  ``residual(y, s)`` gives the
    residual (0 where inactive), so that the loss' derivative by s is 2c times it.
    With ``share`` the sums are those of a share of the rows, taken as many times."""
    d = len(f.b) + 1
    models = folds + 1
    w = np.zeros((models, d)) if start is None else start
    penalty = np.ones(d)
    penalty[-1] = 0.0  # the offset is free
    # Of each model: the last weights that lowered the objective, its value there, and the step taken from them.
    base, objective, step, move = w.copy(), np.full(models, np.inf), np.zeros_like(w), np.ones(models)
    for _ in range(steps):
        def sums(read, w=w):
            total = np.zeros((models, d * d + d + 1))
            # Most rows are active in all models that see them: their products are summed once, by fold.
            common = np.zeros((max(1, folds), d * d))
            for k in T.chunks_of(read, n_f, binned=False):
                x, y, wt, u = k.x, k.y, k.w, k.u
                if share < 1:
                    use = np.flatnonzero(T.draw(u, seed + 1) < share)
                    x, y, wt, u = x[:, use], y[use], wt[use], u[use]
                z = f(x)
                fold = (T.draw(u, seed) * folds).astype(np.int64) if folds else np.zeros(len(y), np.int64)
                sees = fold[:, None] != (np.arange(models) - 1 if folds else np.array([-1]))
                r = np.where(sees, residual(y[:, None], z @ w.T), 0.0)
                total[:, d * d:-1] += (wt[:, None] * r).T @ z
                total[:, -1] += wt @ (r * r)
                on = r != 0
                every = (on | ~sees).all(1)
                if not (wt == 1).all():
                    z = z * np.sqrt(wt)[:, None]
                for into, own in [*((common[g], every & (fold == g)) for g in range(len(common))),
                                  *((total[j, :d * d], on[:, j] & ~every) for j in range(models))]:
                    a = z.take(np.flatnonzero(own), axis=0)
                    if len(a):
                        into += (a.T @ a).ravel()
            for j in range(models):
                total[j, :d * d] += sum((common[g] for g in range(len(common)) if not folds or g != j - 1), np.zeros(d * d))
            return total

        got = packed.summed(sums).reshape(models, -1) / share
        value = (w * w * penalty).sum(1) / 2 + c * got[:, -1]
        g = w * penalty + 2 * c * got[:, d * d:-1]
        if np.abs(g).max() <= tolerance * max(1.0, c * got[:, -1].max()):
            break
        for j in range(models):
            if value[j] > objective[j] + 1e-12 * abs(objective[j]):
                move[j] /= 2
            else:
                h = np.diag(penalty) + 2 * c * got[j, :d * d].reshape(d, d)
                h[-1, -1] += 1e-9
                base[j], objective[j], move[j] = w[j], value[j], 1.0
                step[j] = -np.linalg.solve(h, g[j])
        w = base + move[:, None] * step
    return w, float(np.abs(g).max())


def _minimum(packed: T.Packed, n_f: int, f: FourierMap, residual: Callable, c: float, folds: int, seed: int, steps: int, tolerance: float):
    """The minimum over all rows; of a large table from the minimum over START_ROWS of them, which saves passes."""
    n = packed.df.agg(F.sum("n")).first()[0] or 0
    start = None
    if n > 10 * START_ROWS:
        start, _ = _newton(packed, n_f, f, residual, c, folds, seed, steps, 1e-4, share=START_ROWS / n)
    return _newton(packed, n_f, f, residual, c, folds, seed, steps, tolerance, start)


def _platt(packed: T.Packed, n_f: int, f: FourierMap, w: np.ndarray, folds: int, seed: int, steps: int = 30) -> tuple[float, float]:
    """The sigmoid of scores that each row gets from the model without its
    fold, with Platt's targets, by Newton steps.  The scores are written once."""
    def score(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k in T.chunks_of(read, n_f, binned=False):
            fold = (T.draw(k.u, seed) * folds).astype(np.int64)
            s = np.einsum("ij,ij->i", f(k.x), w[1 + fold])
            yield pa.RecordBatch.from_arrays([pa.array([len(s)], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in (s, k.y, k.w, k.u, k.s))],
                                             names=["n", "x", "y", "w", "u", "s"])

    scores = T.Packed.of(cut_lineage(packed.df.mapInArrow(score, packed.df.schema), group_bytes=T.GROUP_BYTES))

    def count(read):
        total = np.zeros(2)
        for k in T.chunks_of(read, 1, binned=False):
            total += [(k.w * k.y).sum(), (k.w * (1 - k.y)).sum()]
        return total

    pos, neg = scores.summed(count)
    hi, lo = (pos + 1) / (pos + 2), 1 / (neg + 2)
    a, b = 0.0, math.log((neg + 1) / (pos + 1))
    for _ in range(steps):
        def sums(read, a=a, b=b):
            total = np.zeros(5)
            for k in T.chunks_of(read, 1, binned=False):
                s = k.x[0]
                p = _sigmoid(-(a * s + b))
                d1, d2 = k.w * (np.where(k.y > 0, hi, lo) - p), k.w * p * (1 - p)
                total += [(d1 * s).sum(), d1.sum(), (d2 * s * s).sum(), (d2 * s).sum(), d2.sum()]
            return total

        ga, gb, haa, hab, hbb = scores.summed(sums)
        det = (haa + 1e-12) * (hbb + 1e-12) - hab * hab
        da, db = -((hbb + 1e-12) * ga - hab * gb) / det, -((haa + 1e-12) * gb - hab * ga) / det
        a, b = a + da, b + db
        if max(abs(da), abs(db)) < 1e-7:
            break
    return float(a), float(b)


def _prepared(train: DataFrame, features: Sequence[str], label: str, key: str | None, weight: str | None, components: int, gamma: float | None,
              seed: int) -> tuple[T.Packed, FourierMap]:
    from .models import rbf_gamma

    train = train.where(F.col(label).isNotNull())
    packed = T.pack(train, features, label, None, key, weight, chunk=SMALL_CHUNK, tasks=train.sparkSession.sparkContext.defaultParallelism)
    return packed, FourierMap.of(len(features), components, rbf_gamma(train, features) if gamma is None else gamma, seed)


def fit_svm(train: DataFrame, features: Sequence[str], label: str, key: str | None = None, c: float = 1.0, components: int = 300,
            gamma: float | None = None, folds: int = 5, weight: str | None = None, steps: int = 60, tolerance: float = 1e-8,
            seed: int = 42) -> KernelMachine:
    """Squared hinge loss on a 0/1 label, with probabilities.  The features
    should be scaled (a missing value counts as 0); rows without a label are
    left out."""
    packed, f = _prepared(train, features, label, key, weight, components, gamma, seed)

    def residual(y: np.ndarray, s: np.ndarray) -> np.ndarray:
        t = 2 * y - 1
        return np.where(t * s < 1, s - t, 0.0)

    w, g = _minimum(packed, len(features), f, residual, c, folds, seed, steps, tolerance)
    return KernelMachine(list(features), f, w[0], _platt(packed, len(features), f, w, folds, seed), g)


def fit_svr(train: DataFrame, features: Sequence[str], label: str, key: str | None = None, c: float = 1.0, epsilon: float = 0.1,
            components: int = 300, gamma: float | None = None, weight: str | None = None, steps: int = 60, tolerance: float = 1e-8,
            seed: int = 42) -> KernelMachine:
    """Squared epsilon-insensitive loss on a number; otherwise as ``fit_svm``."""
    packed, f = _prepared(train, features, label, key, weight, components, gamma, seed)

    def residual(y: np.ndarray, s: np.ndarray) -> np.ndarray:
        r = s - y
        return np.sign(r) * np.maximum(np.abs(r) - epsilon, 0.0)

    w, g = _minimum(packed, len(features), f, residual, c, 0, seed, steps, tolerance)
    return KernelMachine(list(features), f, w[0], None, g)
