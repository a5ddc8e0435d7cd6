"""L2 logistic regression for a whole population at once.

Objective per chromosome (library defaults: C = 1, free intercept):
``sum_i logloss(w·x_i + b) + ||w||^2 / (2C)`` over the selected genes only.

Every optimiser iteration is ONE pass over the train rows that returns, for
every chromosome, the loss and the gradient of its masked problem: per task only
``P`` rows leave. Features, errors and losses are rounded to fixed-point units
first, so the sums are whole numbers (``exact``): they do not depend on how rows
are dealt to tasks. Masked genes have no gradient, so their weights stay exactly
zero and each solution is that of the subset fit. A chromosome stops when the
largest gradient component of the mean loss is below ``tol`` (the library's
lbfgs tolerance); ``certificate`` holds that component for every problem of the
last fit, ``converged`` whether it was reached.

The solver is batched L-BFGS for every width: ``P * d`` flops per row, ``P * (d+1)``
whole numbers per task, a halved step on the next pass where the loss did not
fall enough. Fits of few genes, whose distinct rounded inputs fit in a task, take the
same steps there over these inputs and their weights, without passes (``cells``). ``solver="newton"`` adds the Hessian (``P * d^2`` flops per row) and
needs fewer passes on few genes; the population is then processed in chunks so
that ``chunk * (d+1)^2`` numbers per task stay under ``max_hessian_doubles``.
"""

from __future__ import annotations

import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsearch.operators.models import cells, exact
from featsearch.operators.models.centroid import split_masks

#: Units (powers of two) of the features and of errors and losses.
VALUE, ERROR = 12, 20


def _feats(rb, d):
    col = rb.column(rb.schema.get_field_index("features"))
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


#: Chromosomes whose (rows, chromosomes) arrays a task holds at a time.
BLOCK = 256


def newton_batches(batches, theta, bits, hessian: bool = True, excl=None):
    """Per task and problem as whole numbers: rows, loss, gradient and (optionally) the
    Hessian's data part. With ``excl`` (one fold per problem), rows of that fold
    have weight 0 in it: one pass fits every (subset, fold) pair of a CV."""
    p_, d = bits.shape
    m = bits.astype(np.float64)
    w, b = theta[:, :d] * m, theta[:, d]
    size = (d + 1) * (d + 1) if hessian else 0
    totals, seen = np.zeros((p_, 2 + d + 1 + size), np.int64), False
    for rb in batches:
        if rb.num_rows == 0:
            continue
        seen = True
        x = exact.rounded(_feats(rb, d), VALUE)
        xa = np.hstack([x, np.full((len(x), 1), 2.0**VALUE)])
        y = rb.column(rb.schema.get_field_index("y")).to_numpy(zero_copy_only=False).astype(np.float64)
        fo = None if excl is None else rb.column(rb.schema.get_field_index("fold")).to_numpy(zero_copy_only=False)
        for lo in range(0, p_, BLOCK):  # bounds the (rows, chromosomes) arrays
            k = slice(lo, lo + BLOCK)
            wt = np.ones((len(x), len(b[k]))) if fo is None else (fo[:, None] != excl[None, k]).astype(np.float64)
            z = (x @ w[k].T) * 2.0**-VALUE + b[k]
            pr = 1.0 / (1.0 + np.exp(-z))
            loss = exact.rounded(np.logaddexp(0.0, z) - y[:, None] * z, ERROR) * wt
            r = exact.rounded(pr - y[:, None], ERROR) * wt
            totals[k, 0] += wt.sum(axis=0).astype(np.int64)
            totals[k, 1] += loss.sum(axis=0).astype(np.int64)
            totals[k, 2 : d + 3] += exact.product(r, xa)
            if hessian:
                s = pr * (1.0 - pr) * wt
                step = max(1, 4_000_000 // (z.shape[1] * (d + 1)))  # rows per batched product (~32 MB)
                for at in range(0, len(xa), step):
                    xs = xa[at : at + step]
                    weighted = np.rint(xs[None, :, :] * s[at : at + step].T[:, :, None])
                    totals[k, d + 3 :] += exact.product(weighted, xs).reshape(-1, size)
    if seen:
        yield from exact.emitted(dict(enumerate(totals)))


def cell_totals(c: cells.Cells, theta, weights, rows: int = 1 << 14):
    """Rows, losses and gradients (whole numbers) as ``newton_batches`` adds them up,
    of problems with the genes of ``c``; ``weights``: rows (cells, problems) of each."""
    d = theta.shape[1] - 1
    w, b = theta[:, c.genes], theta[:, d]
    g_at = np.append(c.genes, d)
    n, loss, g = np.zeros(len(theta), np.int64), np.zeros(len(theta), np.int64), np.zeros((len(theta), d + 1), np.int64)
    for at in range(0, len(c.y), rows):
        here = slice(at, at + rows)
        x, y, wt = c.x[here].astype(np.float64), c.y[here, None].astype(np.float64), weights[here]
        z = (x @ w.T) * 2.0**-VALUE + b
        pr = 1.0 / (1.0 + np.exp(-z))
        n += wt.sum(axis=0)
        loss += (exact.rounded(np.logaddexp(0.0, z) - y * z, ERROR).astype(np.int64) * wt).sum(axis=0)
        g[:, g_at] += exact.weighted(exact.rounded(pr - y, ERROR), wt, np.hstack([x, np.full((len(x), 1), 2.0**VALUE)]))
    return n, loss, g


def linear_confusion_batches(batches, ids, w, b):
    """Confusion counts of the linear decision ``w·x + b > 0`` for every chromosome."""
    d = w.shape[1]
    acc: dict = {}
    for rb in batches:
        if rb.num_rows == 0:
            continue
        x = _feats(rb, d)
        y = rb.column(rb.schema.get_field_index("y")).to_numpy(zero_copy_only=False).astype(np.int64)
        for s, sel in split_masks(rb):
            xs, ys = x[sel], y[sel]
            a = acc.setdefault(s, [np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), 0, 0])
            for lo in range(0, len(ids), BLOCK):
                k = slice(lo, lo + BLOCK)
                ps = (xs @ w[k].T + b[k]) > 0
                a[0][k] += ys @ ps
                a[1][k] += (1 - ys) @ ps
            a[2] += int(ys.sum())
            a[3] += int(len(ys) - ys.sum())
    for s, (tp, fp, n1, n0) in acc.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([s] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(tp, pa.int64()),
             pa.array(fp, pa.int64()), pa.array(n1 - tp, pa.int64()), pa.array(n0 - fp, pa.int64())],
            names=["split", "chrom_id", "tp", "fp", "fn", "tn"],
        )


class LogisticModel:
    name = "logistic"
    batched = True

    def __init__(self, C: float = 1.0, max_iter: int = 100, tol: float = 1e-4, fit_split: str = "train",
                 max_hessian_doubles: int = 8_000_000, solver: str = "lbfgs",
                 memory: int = 10, warm_start: bool = False, max_warm: int = 20_000):
        if solver not in ("lbfgs", "newton"):
            raise ValueError(f"unknown solver {solver!r}; valid: lbfgs, newton")
        self.C, self.max_iter, self.tol, self.fit_split = C, max_iter, tol, fit_split
        self.max_hessian_doubles = max_hessian_doubles
        self.solver, self.memory = solver, memory
        #: Of the last fit, per problem: the largest component of the mean
        #: loss's gradient at the returned weights, and whether it is within tol.
        self.certificate: np.ndarray | None = None
        self.converged: np.ndarray | None = None
        self.iterations = 0
        self.payloads: list = []
        # optional warm starts from the nearest fitted gene set (bounded,
        # driver side); off by default so that a fit depends only on its genes
        self.warm_start = warm_start
        self.max_warm = max_warm
        self._fitted = weakref.WeakKeyDictionary()  # per frame

    def release(self):
        for p in self.payloads:
            p.release()
        self.payloads = []

    def _in_tasks(self, rows: DataFrame, bits, theta0, excl) -> dict[int, np.ndarray]:
        """Weights, certificate and evaluations of the problems that fit in a task."""
        C, tol, max_iter, memory = self.C, self.tol, self.max_iter, self.memory

        def fit(c: cells.Cells, problems, left_out):
            weights = np.broadcast_to(c.weights(left_out), (len(c.y), len(problems)))

            def evaluate(act, theta):
                n, loss, g = cell_totals(c, theta, weights[:, act])
                return loss / 2.0**ERROR, g / 2.0 ** (VALUE + ERROR), n.astype(np.float64)

            theta, certificate, steps = descend(evaluate, bits[problems], theta0[problems], C, tol, max_iter, memory)
            return [np.append(t, [m, steps]).tobytes() for t, m in zip(theta, certificate, strict=True)]

        found = cells.fitted(rows, bits, excl, VALUE, fit)
        return {k: np.frombuffer(v, np.float64) for k, v in found.items()}

    def _pass(self, rows: DataFrame, theta, bits, hessian: bool = True, excl=None):
        from featsearch.session import Payload

        p_, d = bits.shape
        payload = Payload(rows.sparkSession, (theta, bits, excl), theta.nbytes + bits.nbytes)
        found = exact.sums(rows, lambda it: newton_batches(it, *payload.get()[:2], hessian, payload.get()[2]), length=3 + d + (d + 1) ** 2 * hessian)
        payload.release()
        self.iterations += 1
        loss, g, n = np.zeros(p_), np.zeros((p_, d + 1)), np.zeros(p_)
        h = np.zeros((p_, d + 1, d + 1)) if hessian else None
        ma = np.hstack([bits.astype(np.float64), np.ones((p_, 1))])
        for k, v in found.items():
            n[k], loss[k], g[k] = v[0], v[1] / 2.0**ERROR, v[2 : d + 3] / 2.0 ** (VALUE + ERROR)
            if hessian:
                h[k] = v[d + 3 :].reshape(d + 1, d + 1) / 2.0 ** (2 * VALUE)
        g *= ma
        if hessian:
            h *= ma[:, :, None] * ma[:, None, :]
        return loss, g, h, n

    def fit(self, abt: DataFrame, bits: np.ndarray) -> np.ndarray:
        """Coefficients ``(P, d+1)`` (last column: intercept) of every chromosome."""
        from featsearch.session import ship_package

        ship_package(abt.sparkSession)
        bits = np.asarray(bits, dtype=np.int8)
        p_, d = bits.shape
        from featsearch.session import bounded_tasks

        rows = bounded_tasks(abt.where(F.col("split") == self.fit_split).select("y", "features"))
        out = self._fit_rows(rows, bits, self._starts(abt, bits))
        self._remember(abt, bits, out)
        return out

    def _fit_rows(self, rows, bits, theta0=None, excl=None) -> np.ndarray:
        p_, d = bits.shape
        theta0 = np.zeros((p_, d + 1)) if theta0 is None else theta0
        self.certificate = np.full(p_, np.inf)
        if self.solver == "lbfgs":
            out = self._fit_lbfgs(rows, bits, theta0, excl)
            self.converged = self.certificate <= self.tol
            return out
        chunk = max(1, self.max_hessian_doubles // ((d + 1) ** 2))
        out = np.zeros((p_, d + 1))
        for lo in range(0, p_, chunk):
            ex = None if excl is None else excl[lo : lo + chunk]
            out[lo : lo + chunk] = self._fit_chunk(rows, bits[lo : lo + chunk], theta0[lo : lo + chunk], ex, lo)
        self.converged = self.certificate <= self.tol
        return out

    def _starts(self, key, bits) -> np.ndarray:
        """Initial coefficients: those of the nearest fitted gene set (Hamming),
        masked to each chromosome's genes; zeros when nothing is cached.

        The objective is strictly convex, so the start changes only the number
        of passes, not the optimum."""
        p_, d = bits.shape
        theta0 = np.zeros((p_, d + 1))
        known = self._fitted.get(key)
        if not self.warm_start or not known:
            return theta0
        kbits = np.stack([np.frombuffer(b, dtype=np.int8) for b in known])
        kth = np.stack(list(known.values()))
        b = bits.astype(np.int16)
        dist = (b[:, None, :] != kbits[None, :, :].astype(np.int16)).sum(axis=2)  # (P, cached)
        near = dist.argmin(axis=1)
        theta0[:, :d] = kth[near, :d] * bits
        theta0[:, d] = kth[near, d]
        return theta0

    def _remember(self, key, bits, theta) -> None:
        if not self.warm_start:
            return
        known = self._fitted.setdefault(key, {})
        for b, t in zip(bits, theta):
            known[np.asarray(b, dtype=np.int8).tobytes()] = t
        while len(known) > self.max_warm:  # oldest first
            known.pop(next(iter(known)))

    def _fit_lbfgs(self, rows, bits, theta0=None, excl=None):
        """Batched L-BFGS: fits that fit in a task there, the others over shared passes."""
        p_, d = bits.shape
        theta0 = np.zeros((p_, d + 1)) if theta0 is None else theta0
        out, evaluations = theta0.copy(), 0
        found = self._in_tasks(rows, bits, theta0, excl)
        for k, v in found.items():
            out[k], self.certificate[k], evaluations = v[: d + 1], v[d + 1], max(evaluations, int(v[d + 2]))
        self.iterations += evaluations  # of the fit that took most, as in passes
        left = np.array([k for k in range(p_) if k not in found], np.int64)
        if len(left):
            def evaluate(act, theta):
                own = left[act]
                loss, g, _, n = self._pass(rows, theta, bits[own], hessian=False, excl=None if excl is None else excl[own])
                return loss, g, n

            out[left], self.certificate[left], _ = descend(evaluate, bits[left], theta0[left], self.C, self.tol, self.max_iter, self.memory)
        return out

    def _fit_chunk(self, rows, bits, theta0=None, excl=None, first=0):
        """Batched Newton; every chromosome accepts or backtracks on its own."""
        p_, d = bits.shape
        m = np.hstack([bits.astype(np.float64), np.ones((p_, 1))])
        reg = np.hstack([np.ones(d), [0.0]]) / self.C  # intercept unpenalised
        theta = np.zeros((p_, d + 1)) if theta0 is None else theta0.copy()
        prev_theta, prev_obj, step = theta.copy(), np.full(p_, np.inf), np.zeros_like(theta)
        scale = np.ones(p_)
        done = np.zeros(p_, dtype=bool)
        eye = np.eye(d + 1)[None]
        nn = np.ones(p_)
        for _ in range(self.max_iter):
            act = ~done  # converged chromosomes leave the pass
            ia = np.flatnonzero(act)
            loss, g, h = np.zeros(p_), np.zeros((p_, d + 1)), np.zeros((p_, d + 1, d + 1))
            loss[ia], g[ia], h[ia], nn[ia] = self._pass(rows, theta[ia], bits[ia],
                                                       excl=None if excl is None else excl[ia])
            obj = loss + 0.5 * (reg * theta * theta).sum(axis=1)
            worse = act & (obj > prev_obj + 1e-12 * np.abs(prev_obj))
            scale[worse] *= 0.5  # backtrack: halve the step from the previous point
            theta[worse] = prev_theta[worse] - scale[worse, None] * step[worse]
            done |= worse & (scale < 1e-8)
            good = act & ~worse
            grad = (g + reg * theta) * m
            most = np.abs(grad).max(axis=1) / np.maximum(nn, 1.0)
            self.certificate[first + np.flatnonzero(good)] = most[good]
            conv = good & (most <= self.tol)
            done |= conv
            upd = np.flatnonzero(good & ~conv)
            if len(upd):
                hess = h[upd] + eye * reg[None, None, :] + eye * (1.0 - m[upd])[:, None, :]  # masked: unit diagonal
                new_step = np.linalg.solve(hess, grad[upd][:, :, None])[:, :, 0] * m[upd]
                prev_theta[upd], prev_obj[upd] = theta[upd], obj[upd]
                step[upd], scale[upd] = new_step, 1.0
                theta[upd] = theta[upd] - new_step
            if done.all():
                break
        return theta * m

    def cv_confusion(self, abt: DataFrame, ids, bits, folds: int = 5, seed: int = 0) -> DataFrame:
        """``(fold, chrom_id, tp, fp, fn, tn)`` of every (chromosome, fold) fit:
        all ``P * folds`` problems share each pass over the train rows."""
        from featsearch.operators.split import fold_rows
        from featsearch.session import Payload, ship_package

        ship_package(abt.sparkSession)
        ids = np.asarray(ids, dtype=np.int64)
        bits = np.asarray(bits, dtype=np.int8)
        vbits = np.repeat(bits, folds, axis=0)
        vids = np.repeat(ids, folds)
        excl = np.tile(np.arange(folds, dtype=np.int64), len(ids))
        from featsearch.session import bounded_tasks

        rows = bounded_tasks(fold_rows(abt, "features", F.col("features"), folds, seed, self.fit_split))
        theta = self._fit_rows(rows, vbits, None, excl)
        d = bits.shape[1]
        payload = Payload(abt.sparkSession, (vids, theta[:, :d], theta[:, d], excl), theta.nbytes)
        self.payloads.append(payload)
        return (
            rows.mapInArrow(lambda it: cv_confusion_batches(it, *payload.get()),
                            "fold int, chrom_id bigint, tp bigint, fp bigint, fn bigint, tn bigint")
            .groupBy("fold", "chrom_id")
            .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
        )

    def cv_scores(self, abt: DataFrame, ids, bits, folds: int = 5, seed: int = 0, metric: str = "accuracy"):
        from featsearch.operators.fitness import cv_scores

        return cv_scores(self, abt, ids, bits, folds, seed, metric)

    def confusion(self, abt: DataFrame, ids: np.ndarray, bits: np.ndarray, eval_splits=("val",)) -> DataFrame:
        theta = self.fit(abt, bits)
        d = np.asarray(bits).shape[1]
        w, b = theta[:, :d], theta[:, d]
        ids = np.asarray(ids, dtype=np.int64)
        from featsearch.session import Payload

        from featsearch.session import bounded_tasks

        rows = bounded_tasks(abt.where(F.col("split").isin(*eval_splits)).select("split", "y", "features"))
        payload = Payload(abt.sparkSession, (ids, w, b), w.nbytes)
        self.payloads.append(payload)
        return (
            rows.mapInArrow(lambda it: linear_confusion_batches(it, *payload.get()),
                            "split string, chrom_id bigint, tp bigint, fp bigint, fn bigint, tn bigint")
            .groupBy("split", "chrom_id")
            .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
        )


def cv_confusion_batches(batches, ids, w, b, excl):
    """Confusion counts of each (chromosome, fold) fit on its own held-out fold."""
    d = w.shape[1]
    tp = np.zeros(len(ids), np.int64)
    fp = np.zeros(len(ids), np.int64)
    n1 = np.zeros(len(ids), np.int64)
    n0 = np.zeros(len(ids), np.int64)
    seen = False
    for rb in batches:
        if rb.num_rows == 0:
            continue
        seen = True
        x = _feats(rb, d)
        y = rb.column(rb.schema.get_field_index("y")).to_numpy(zero_copy_only=False).astype(np.int64)
        fo = rb.column(rb.schema.get_field_index("fold")).to_numpy(zero_copy_only=False)
        for lo in range(0, len(ids), BLOCK):
            k = slice(lo, lo + BLOCK)
            own = fo[:, None] == excl[None, k]
            pred = ((x @ w[k].T + b[k]) > 0) & own
            tp[k] += y @ pred
            fp[k] += (1 - y) @ pred
            n1[k] += y @ own
            n0[k] += (1 - y) @ own
    if seen:
        yield pa.RecordBatch.from_arrays(
            [pa.array(excl.astype(np.int32)), pa.array(ids, pa.int64()), pa.array(tp), pa.array(fp),
             pa.array(n1 - tp), pa.array(n0 - fp)],
            names=["fold", "chrom_id", "tp", "fp", "fn", "tn"],
        )


def descend(evaluate, bits, theta0, C, tol, max_iter, memory):
    """Batched L-BFGS over ``evaluate(problems, theta)``, which returns sums of losses and
    gradients and the rows: weights, certificate and number of evaluations.
    Every chromosome advances by one step
    attempt per evaluation: accepted steps (Armijo) compute a new direction from
    its own curvature pairs, rejected ones halve their step length."""
    p_, d = bits.shape
    m = np.hstack([bits.astype(np.float64), np.ones((p_, 1))])
    reg = np.hstack([np.ones(d), [0.0]]) / C
    theta = theta0.copy()
    loss, g, n = evaluate(np.arange(p_), theta)
    evaluations = 1
    n = np.maximum(n, 1.0)
    f = (loss + 0.5 * (reg * theta * theta).sum(axis=1)) / n
    grad = (g + reg * theta) * m / n[:, None]
    hist_s: list[list] = [[] for _ in range(p_)]
    hist_y: list[list] = [[] for _ in range(p_)]
    direction = -grad
    alpha = np.ones(p_)
    done = np.abs(grad).max(axis=1) <= tol
    for _ in range(max_iter * 4):
        if done.all():
            break
        trial = np.where(done[:, None], theta, theta + alpha[:, None] * direction)
        act = np.flatnonzero(~done)  # converged chromosomes leave
        loss_t, g_t = np.zeros(p_), np.zeros((p_, d + 1))
        loss_t[act], g_t[act], _ = evaluate(act, trial[act])
        evaluations += 1
        f_t = (loss_t + 0.5 * (reg * trial * trial).sum(axis=1)) / n
        grad_t = (g_t + reg * trial) * m / n[:, None]
        slope = (grad * direction).sum(axis=1)
        ok = (f_t <= f + 1e-4 * alpha * slope) & ~done
        for k in np.flatnonzero(ok):
            s_k, y_k = trial[k] - theta[k], grad_t[k] - grad[k]
            if s_k @ y_k > 1e-12:
                hist_s[k].append(s_k)
                hist_y[k].append(y_k)
                if len(hist_s[k]) > memory:
                    hist_s[k].pop(0)
                    hist_y[k].pop(0)
            theta[k], f[k], grad[k] = trial[k], f_t[k], grad_t[k]
            direction[k] = -_two_loop(grad[k], hist_s[k], hist_y[k]) * m[k]
            alpha[k] = 1.0
            if np.abs(grad[k]).max() <= tol:
                done[k] = True
        bad = ~ok & ~done
        alpha[bad] *= 0.5
        done |= bad & (alpha < 1e-10)
    return theta * m, np.abs(grad).max(axis=1), evaluations


def _two_loop(g: np.ndarray, ss: list, ys: list) -> np.ndarray:
    """L-BFGS two-loop recursion: approximately H^-1 g from the curvature pairs."""
    q = g.copy()
    alphas = []
    for s_, y_ in zip(reversed(ss), reversed(ys)):
        rho = 1.0 / (y_ @ s_)
        a = rho * (s_ @ q)
        alphas.append((rho, a))
        q -= a * y_
    if ss:
        q *= (ss[-1] @ ys[-1]) / (ys[-1] @ ys[-1])
    for (s_, y_), (rho, a) in zip(zip(ss, ys), reversed(alphas)):
        b = rho * (y_ @ q)
        q += (a - b) * s_
    return q
