"""Multilayer perceptron for a whole population at once.

One hidden layer of 100 rectified units and a logistic output, L2 penalty
``alpha = 1e-4`` on the weights (the library defaults of the reference's model),
trained by full-batch L-BFGS, at most 200 iterations. The weights of all
chromosomes are one stack of tensors; a chromosome's missing genes have zero
weights and stay out of the first layer. Every optimiser step is ONE pass over the
training rows for all chromosomes that have not converged: a task runs its rows
forward and backward through the whole stack (batched matrix products) and
returns the gradients; converged members leave the stack. The number of passes
is that of the slowest member and does not grow with the population. Chromosomes of few
genes, whose distinct rounded inputs fit in a task, take the same steps there over
these inputs and their weights, without passes (``cells``).

Reproducible: inputs, hidden activations and errors are rounded to fixed-point
units before they are multiplied, so that the sums over rows are whole numbers
(``exact``). A fit is then the same for any partitioning, and the same alone or
in a population. Start weights are hashed draws by (seed, layer, unit, gene),
scaled as the library's (Glorot) by the number of genes the chromosome has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsearch.operators.models import cells, exact
from featsearch.operators.models.centroid import split_masks
from featsearch.session import Payload, bounded_tasks, ship_package

#: Units of inputs and activations, of errors, and of the loss.
VALUE, ERROR, LOSS = 12, 20, 24


def draws(seed: int, layer: int, shape: tuple[int, ...]) -> np.ndarray:
    """Numbers in [-1, 1), a hash of (seed, layer) expanded by position."""
    n = int(np.prod(shape))
    raw = hashlib.shake_128(f"{seed}:mlp:{layer}".encode()).digest(4 * n)
    return (np.frombuffer(raw, "<u4").astype(np.float64) / 2.0**31 - 1.0).reshape(shape)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


class Stack:
    """Parameter vectors (P, n) as tensors: first layer ``w1`` (P, d, H), ``b1``,
    output ``w2`` (P, H), ``b2``."""

    def __init__(self, d: int, hidden: int):
        self.d, self.hidden = d, hidden
        self.size = d * hidden + 2 * hidden + 1

    def split(self, theta: np.ndarray):
        d, h = self.d, self.hidden
        return (theta[:, : d * h].reshape(-1, d, h), theta[:, d * h : d * h + h], theta[:, d * h + h : d * h + 2 * h], theta[:, -1])

    def mask(self, bits: np.ndarray) -> np.ndarray:
        """1 for parameters a chromosome has, 0 for weights of missing genes."""
        first = np.repeat(bits.astype(np.float64), self.hidden, axis=1)
        return np.hstack([first, np.ones((len(bits), 2 * self.hidden + 1))])

    def penalised(self) -> np.ndarray:
        """1 for weights, 0 for intercepts."""
        d, h = self.d, self.hidden
        return np.concatenate([np.ones(d * h), np.zeros(h), np.ones(h), [0.0]])

    def forward(self, theta: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden activations (P, rows, H) and output (P, rows) of inputs ``x``;
        inputs and activations in whole units of 2^-VALUE."""
        w1, b1, w2, b2 = self.split(theta)
        hidden = np.matmul(x, w1)
        hidden += (b1 * 2.0**VALUE)[:, None, :]
        np.maximum(hidden, 0.0, out=hidden)
        np.rint(hidden, out=hidden)
        return hidden, np.matmul(hidden, w2[:, :, None])[:, :, 0] * 2.0**-VALUE + b2[:, None]


def _features(batch: pa.RecordBatch, d: int) -> np.ndarray:
    x = batch.column(batch.schema.get_field_index("features")).flatten().to_numpy(zero_copy_only=False)
    return exact.rounded(x.astype(np.float64).reshape(-1, d), VALUE)


def _plain(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


#: Numbers of a task's activations at a time.
CELLS = 4_000_000


def _pass_task(payload: Payload, stack: Stack):
    """Per problem: rows, loss and gradient, as whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        problems, theta, excl = payload.get()
        w2 = stack.split(theta)[2]
        totals = None
        for batch in batches:
            if not batch.num_rows:
                continue
            every, labels = _features(batch, stack.d), _plain(batch, "y").astype(np.float64)
            folds = None if excl is None else _plain(batch, "fold")
            step = max(1, CELLS // (len(problems) * stack.hidden))
            for at in range(0, len(every), step):
                x, y = every[at : at + step], labels[at : at + step]
                hidden, z = stack.forward(theta, x)
                used = np.ones((len(problems), len(x))) if folds is None else (folds[at : at + step] != excl[:, None]).astype(float)
                loss = exact.rounded(np.logaddexp(0.0, z) - y * z, LOSS) * used
                error = exact.rounded(sigmoid(z) - y, ERROR) * used
                back = error[:, :, None] * w2[:, None, :]
                np.rint(back, out=back)
                back *= hidden > 0
                g1 = np.stack([exact.product(x, b) for b in back])
                g2 = exact.product(hidden, error[:, :, None])[:, :, 0]
                parts = [used.sum(axis=1)[:, None], loss.sum(axis=1)[:, None], g1.reshape(len(problems), -1),
                         back.sum(axis=1), g2, error.sum(axis=1)[:, None]]
                here = np.hstack([p.astype(np.int64) for p in parts])
                totals = here if totals is None else totals + here
        if totals is not None:
            yield from exact.emitted({int(k): v for k, v in zip(problems, totals, strict=True)})

    return run


def mean(total: np.ndarray, stack: Stack, theta: np.ndarray, mask: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """Mean loss and gradient of a problem from its totals, penalty included."""
    d, h = stack.d, stack.hidden
    # units of the totals: inputs x errors, errors, activations x errors, errors
    units = np.concatenate([np.full(d * h, VALUE + ERROR), np.full(h, ERROR), np.full(h, VALUE + ERROR), [ERROR]])
    loss, grad = total[1] / 2.0**LOSS / total[0], total[2:] / 2.0**units / total[0]
    rest = alpha / total[0] * stack.penalised() * theta
    return loss + 0.5 * float(rest @ theta), (grad + rest) * mask


#: Cells that ``cell_totals`` takes at a time: their activations stay in a core's cache.
BLOCK = 512


def cell_totals(c: cells.Cells, weight: np.ndarray, stack: Stack, theta: np.ndarray) -> np.ndarray:
    """Rows, loss and gradient (whole numbers) as ``_pass_task`` adds them up, of one
    problem with the genes of ``c``; ``weight``: its rows per cell."""
    d, h, g = stack.d, stack.hidden, len(c.genes)
    w1, b1, w2, b2 = (t[0] for t in stack.split(theta[None]))
    w1, b1, widest = np.ascontiguousarray(w1[c.genes]), b1 * 2.0**VALUE, np.abs(w2).max(initial=0)
    loss, first, second, last = 0, np.zeros((g + 1, h), np.int64), np.zeros((1, h), np.int64), 0
    spare = np.empty((3, min(BLOCK, len(c.y)), h))
    for at in range(0, len(c.y), BLOCK):
        here = slice(at, at + BLOCK)
        x, y, wt = c.x[here].astype(np.float64), c.y[here], weight[here]
        hidden, back, on = spare[:, : len(y)]
        np.matmul(x, w1, out=hidden)
        hidden += b1
        np.maximum(hidden, 0.0, out=hidden)
        np.rint(hidden, out=hidden)
        z = np.matmul(hidden, w2) * 2.0**-VALUE + b2
        loss += int((exact.rounded(np.logaddexp(0.0, z) - y * z, LOSS).astype(np.int64) * wt).sum())
        error = exact.rounded(sigmoid(z) - y, ERROR)
        np.multiply(error[:, None], w2, out=back)
        np.rint(back, out=back)
        np.minimum(hidden, 1.0, out=on)  # whole numbers: 1 where a unit is active
        back *= on
        first += exact.weighted(np.hstack([x, np.ones((len(y), 1))]), wt[:, None], back, np.rint(np.abs(error).max() * widest) + 1)
        second += exact.weighted(error[:, None], wt[:, None], hidden, hidden.max())
        last += int((error.astype(np.int64) * wt).sum())
    total = np.zeros(stack.size + 2, np.int64)
    total[:2] = weight.sum(), loss
    total[2 : 2 + d * h].reshape(d, h)[c.genes] = first[:g]
    total[2 + d * h :] = np.concatenate([first[g], second[0], [last]])
    return total


def descend(evaluate, theta: np.ndarray, tol: float, max_iter: int, memory: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Parameters, largest gradient component and evaluations of L-BFGS fits from ``theta``
    over ``evaluate(problems, theta)``, which returns mean losses and gradients; converged
    problems leave."""
    p, theta = len(theta), theta.copy()
    f, grad = evaluate(np.arange(p), theta)
    evaluations = 1
    pairs: list[list] = [[] for _ in range(p)]
    way = -grad
    size = np.minimum(1.0, 1.0 / np.maximum(np.abs(grad).sum(axis=1), 1e-12))  # first step as the library's
    steps = np.zeros(p, np.int64)
    done = np.abs(grad).max(axis=1) <= tol
    while not done.all():
        live = np.flatnonzero(~done)
        trial = theta[live] + size[live, None] * way[live]
        f_new, g_new = evaluate(live, trial)
        evaluations += 1
        for i, k in enumerate(live.tolist()):
            if f_new[i] <= f[k] + 1e-4 * size[k] * float(grad[k] @ way[k]):
                s, y = trial[i] - theta[k], g_new[i] - grad[k]
                if s @ y > 1e-12:
                    pairs[k] = [*pairs[k], (s, y)][-memory:]
                theta[k], f[k], grad[k] = trial[i], f_new[i], g_new[i]
                way[k], size[k] = -MlpModel._direction(grad[k], pairs[k]), 1.0
                steps[k] += 1
                done[k] = np.abs(grad[k]).max() <= tol or steps[k] >= max_iter
            else:
                size[k] *= 0.5
                done[k] = size[k] < 1e-10
    return theta, np.abs(grad).max(axis=1), evaluations


class MlpModel:
    name = "mlp"
    batched = True

    def __init__(self, hidden: int = 100, alpha: float = 1e-4, max_iter: int = 200, tol: float = 1e-4, seed: int = 123,
                 fit_split: str = "train", memory: int = 10, max_doubles: int = 16_000_000):
        self.hidden, self.alpha, self.max_iter, self.tol, self.seed = hidden, alpha, max_iter, tol, seed
        self.fit_split, self.memory, self.max_doubles = fit_split, memory, max_doubles
        self.passes = 0
        self.converged: np.ndarray | None = None  # of the last fit
        self.payloads: list = []

    def release(self):
        for p in self.payloads:
            p.release()
        self.payloads = []

    def start(self, bits: np.ndarray) -> np.ndarray:
        d, h = bits.shape[1], self.hidden
        n = np.maximum(bits.sum(axis=1), 1).astype(np.float64)
        first = np.sqrt(6.0 / (n + h))[:, None] * np.concatenate([draws(self.seed, 0, (d * h,)), draws(self.seed, 1, (h,))])
        second = np.sqrt(2.0 / (h + 1)) * draws(self.seed, 2, (h + 1,))
        return np.hstack([first, np.broadcast_to(second, (len(bits), h + 1))])

    def _pass(self, rows: DataFrame, stack: Stack, problems: np.ndarray, theta: np.ndarray, mask: np.ndarray, excl):
        """Mean loss and gradient of every problem, penalty included: one pass
        (several where the stack would exceed ``max_doubles`` in a task)."""
        loss, grad = np.zeros(len(problems)), np.zeros_like(theta)
        step = max(1, self.max_doubles // stack.size)
        for lo in range(0, len(problems), step):
            part = slice(lo, lo + step)
            payload = Payload(rows.sparkSession, (problems[part], theta[part], None if excl is None else excl[part]), theta[part].nbytes)
            found = exact.sums(rows, _pass_task(payload, stack), length=stack.size + 2)
            payload.release()
            for i in range(lo, min(lo + step, len(problems))):
                total = found.get(int(problems[i]))
                if total is not None and total[0]:
                    loss[i], grad[i] = mean(total, stack, theta[i], mask[i], self.alpha)
        self.passes += 1
        return loss, grad

    def fit_rows(self, rows: DataFrame, bits: np.ndarray, excl: np.ndarray | None = None) -> np.ndarray:
        """Parameters (P, n) of every chromosome."""
        bits = np.asarray(bits, np.int8)
        p, d = bits.shape
        stack = Stack(d, self.hidden)
        mask = stack.mask(bits)
        theta = self.start(bits) * mask
        largest, found = np.zeros(p), self._in_tasks(rows, stack, bits, theta, mask, excl)
        for k, v in found.items():
            theta[k], largest[k] = v[: stack.size], v[stack.size]
        self.passes += int(max((v[-1] for v in found.values()), default=0))  # evaluations of the fit that took most
        left = np.array([k for k in range(p) if k not in found], np.int64)
        if len(left):

            def evaluate(live, trial):
                own = left[live]
                return self._pass(rows, stack, own, trial, mask[own], None if excl is None else excl[own])

            theta[left], largest[left], _ = descend(evaluate, theta[left], self.tol, self.max_iter, self.memory)
        self.converged = largest <= self.tol
        return theta * mask

    def _in_tasks(self, rows: DataFrame, stack: Stack, bits: np.ndarray, theta: np.ndarray, mask: np.ndarray, excl) -> dict[int, np.ndarray]:
        """Parameters, largest gradient component and evaluations of the problems that fit in a task."""
        alpha, tol, max_iter, memory = self.alpha, self.tol, self.max_iter, self.memory
        payload = Payload(rows.sparkSession, (theta, mask), theta.nbytes + mask.nbytes)

        def fit(c: cells.Cells, problems: np.ndarray, left_out) -> list[bytes]:
            weights = np.broadcast_to(c.weights(left_out), (len(c.y), len(problems)))
            start, masks = (a[problems] for a in payload.get())

            def evaluate(live, trial):
                loss, grad = np.zeros(len(live)), np.zeros_like(trial)
                for i, k in enumerate(live):
                    if (weight := weights[:, k]).any():
                        loss[i], grad[i] = mean(cell_totals(c, weight, stack, trial[i]), stack, trial[i], masks[k], alpha)
                return loss, grad

            out, largest, evaluations = descend(evaluate, start, tol, max_iter, memory)
            return [np.append(t, [m, evaluations]).tobytes() for t, m in zip(out, largest, strict=True)]

        found = cells.fitted(rows, bits, excl, VALUE, fit)
        payload.release()
        return {k: np.frombuffer(v, np.float64) for k, v in found.items()}

    @staticmethod
    def _direction(g: np.ndarray, pairs: list) -> np.ndarray:
        from featsearch.operators.models.logistic import _two_loop

        return _two_loop(g, [s for s, _ in pairs], [y for _, y in pairs])

    def confusion(self, abt: DataFrame, ids: np.ndarray, bits: np.ndarray, eval_splits=("val",)) -> DataFrame:
        ship_package(abt.sparkSession)
        bits = np.asarray(bits, np.int8)
        theta = self.fit_rows(bounded_tasks(abt.where(F.col("split") == self.fit_split).select("y", "features")), bits)
        rows = bounded_tasks(abt.where(F.col("split").isin(*eval_splits)).select("split", "y", "features"))
        return self._counts(rows, np.asarray(ids, np.int64), theta, bits.shape[1], "split", None)

    def cv_confusion(self, abt: DataFrame, ids, bits, folds: int = 5, seed: int = 0) -> DataFrame:
        """``(fold, chrom_id, tp, fp, fn, tn)``: all (chromosome, fold) problems
        share every pass; rows of a problem's own fold have no weight in it."""
        from featsearch.operators.split import fold_rows

        ship_package(abt.sparkSession)
        ids, bits = np.repeat(np.asarray(ids, np.int64), folds), np.repeat(np.asarray(bits, np.int8), folds, axis=0)
        excl = np.tile(np.arange(folds, dtype=np.int64), len(ids) // folds)
        rows = bounded_tasks(fold_rows(abt, "features", F.col("features"), folds, seed, self.fit_split))
        theta = self.fit_rows(rows, bits, excl)
        return self._counts(rows, ids, theta, bits.shape[1], "fold", excl)

    def cv_scores(self, abt: DataFrame, ids, bits, folds: int = 5, seed: int = 0, metric: str = "accuracy"):
        from featsearch.operators.fitness import cv_scores

        return cv_scores(self, abt, ids, bits, folds, seed, metric)

    def _counts(self, rows: DataFrame, ids: np.ndarray, theta: np.ndarray, d: int, group: str, excl) -> DataFrame:
        stack = Stack(d, self.hidden)
        payload = Payload(rows.sparkSession, theta, theta.nbytes)
        self.payloads.append(payload)
        kind = "string" if group == "split" else "int"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y, said = _features(batch, d), _plain(batch, "y").astype(bool), []
                step = max(1, CELLS // (len(ids) * stack.hidden))
                for at in range(0, len(x), step):
                    said.append(stack.forward(payload.get(), x[at : at + step])[1].T > 0)
                said = np.concatenate(said)
                if excl is None:
                    parts = [(s, sel, np.ones(len(ids), bool)) for s, sel in split_masks(batch)]
                else:
                    fold = _plain(batch, "fold")
                    parts = [(int(f), np.flatnonzero(fold == f), excl == f) for f in np.unique(fold)]
                for s, sel, own in parts:
                    here = found.setdefault(s, (np.zeros((4, len(ids)), np.int64), own))[0]
                    for i, (a, b) in enumerate(((1, 1), (0, 1), (1, 0), (0, 0))):
                        here[i] += ((y[sel] == a)[:, None] & (said[sel] == b)).sum(axis=0)
            for s, (counts, own) in found.items():
                k = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s] * len(k), pa.string() if excl is None else pa.int32()), pa.array(ids[k]), *(pa.array(c[k]) for c in counts)],
                    [group, "chrom_id", "tp", "fp", "fn", "tn"],
                )

        return (
            rows.mapInArrow(run, f"{group} {kind}, chrom_id bigint, tp bigint, fp bigint, fn bigint, tn bigint")
            .groupBy(group, "chrom_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
        )
