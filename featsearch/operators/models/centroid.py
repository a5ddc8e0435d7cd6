"""Nearest-centroid classifier on fixed-point standardized features.

Fit: per class and gene, ``m = floor(sum(q) / n)`` over the fit split, where
``q = floor(z * SCALE)``. The fit of any subset is the subset of these means,
so one aggregation serves every chromosome of every generation.

Predict: class 1 iff ``sum_g bit_g * ((q_g - m1_g)^2 - (q_g - m0_g)^2) < 0``.
The decision is linear in the bits, so a partition's rows are scored against
all chromosomes with one matrix product; all arithmetic is on exact integers.
"""

from __future__ import annotations

import weakref
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsearch.operators import scale
from featsearch.session import bounded_tasks, written

EXACT_F64 = 2.0**53


def gene_sums(rows: DataFrame, groups: list[str], d: int) -> list[dict]:
    """Per group and gene, the sum ``s`` and the number ``n`` of the entries of
    ``q``: one aggregation with map-side combine, without a row per gene up to
    ``scale.WIDE_AGG_MAX`` genes."""
    if d > scale.WIDE_AGG_MAX:
        long = rows.select(*groups, F.posexplode("q").alias("gene", "q")).groupBy(*groups, "gene")
        return [r.asDict() for r in long.agg(F.sum("q").alias("s"), F.count(F.lit(1)).alias("n")).collect()]
    sums = [F.sum(F.get("q", F.lit(j))).alias(f"s{j}") for j in range(d)]
    counts = [F.count(F.when(F.size("q") > j, 1)).alias(f"n{j}") for j in range(d)]
    out = []
    for r in rows.groupBy(*groups).agg(*sums, *counts).collect():
        out += [{**{g: r[g] for g in groups}, "gene": j, "s": r[f"s{j}"], "n": r[f"n{j}"]} for j in range(d) if r[f"n{j}"]]
    return out


def class_means(abt: DataFrame, d: int | None = None, fit_split: str = "train") -> tuple[np.ndarray, np.ndarray]:
    """Per-gene class means (int64) of the fit split."""
    rows = abt.where(F.col("split") == fit_split)
    if d is None:
        d = rows.select(F.max(F.size("features"))).first()[0] or 0
    rows = rows.select("y", scale.quantize(F.col("features"), d).alias("q"))
    m = {0: np.zeros(d, dtype=np.int64), 1: np.zeros(d, dtype=np.int64)}
    seen = set()
    for r in gene_sums(rows, ["y"], d):
        m[int(r["y"])][r["gene"]] = np.floor(float(r["s"]) / float(r["n"]))
        seen.add(int(r["y"]))
    if seen != {0, 1}:
        raise ValueError("the fit split must hold both classes")
    return m[0], m[1]


def _features(batch: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    vals = col.flatten().to_numpy(zero_copy_only=False)
    return vals.reshape(-1, d)


def split_masks(rb: pa.RecordBatch, name: str = "split"):
    """(value, row selector) per distinct value of a string column, via Arrow
    compute: no Python object per row."""
    import pyarrow.compute as pc

    col = rb.column(rb.schema.get_field_index(name))
    values = pc.unique(col).to_pylist()
    if len(values) == 1:
        yield values[0], slice(None)
        return
    for v in values:
        yield v, pc.equal(col, v).to_numpy(zero_copy_only=False)


def _keyed(batches, key: str, d: int):
    """``key, y, q`` of the rows of every batch, a part per value of ``key``."""
    for rb in batches:
        if rb.num_rows == 0:
            continue
        q = _features(rb, "q", d)
        y = rb.column(rb.schema.get_field_index("y")).to_numpy(zero_copy_only=False).astype(np.int64)
        for value, sel in split_masks(rb, key):
            yield value, y[sel], q[sel]


#: Bytes of features that a block holds at least, if a task has that many.
BLOCK_BYTES = 1 << 20
_WHOLE = (np.int8, np.int16, np.int32, np.int64)


def _packed(a: np.ndarray) -> tuple[str, bytes]:
    """Type and bytes of numbers, in the smallest whole type that holds them."""
    if a.dtype.kind == "i" and a.size:
        low, high = a.min(), a.max()
        a = a.astype(next(t for t in _WHOLE if np.iinfo(t).min <= low and high <= np.iinfo(t).max))
    return a.dtype.str, np.ascontiguousarray(a).tobytes()


def blocked(rows: DataFrame, key: str, d: int) -> DataFrame:
    """``rows`` (``key, y, q``) written as blocks of many rows of one ``key``.

    For rows that several passes read: a pass over blocks hands whole arrays to
    numpy, where a row with an array of its own costs more than its score.
    """
    kind = rows.schema[key].dataType

    def body(batches):
        held: dict = {}

        def block(value):
            ys, qs = zip(*held.pop(value), strict=True)
            (ty, y), (tq, q) = _packed(np.concatenate(ys)), _packed(np.concatenate(qs))
            names = [key, "ty", "y", "tq", "q"]
            return pa.RecordBatch.from_arrays([pa.array([value], arrow), *[pa.array([x]) for x in (ty, y, tq, q)]], names)

        for value, y, q in _keyed(batches, key, d):
            arrow = pa.string() if isinstance(value, str) else pa.int32()
            parts = held.setdefault(value, [])
            parts.append((y, q))
            if sum(q.nbytes for _, q in parts) >= BLOCK_BYTES:
                yield block(value)
        for value in list(held):
            yield block(value)

    return written(rows.mapInArrow(body, f"{key} {kind.simpleString()}, ty string, y binary, tq string, q binary"), "blocks")


def _opened(batches, key: str, d: int):
    """``key, y, q`` of every block."""
    for rb in batches:
        for row in zip(*[rb.column(rb.schema.get_field_index(c)) for c in (key, "ty", "y", "tq", "q")], strict=True):
            value, ty, y, tq, q = [x.as_py() for x in row]
            yield value, np.frombuffer(y, ty).astype(np.int64), _wide(np.frombuffer(q, tq)).reshape(-1, d)


def _wide(a: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) if a.dtype.kind == "i" else a


def confusion_batches(batches, ids, bits, m0, m1, block: int = 256, parts=_keyed):
    """mapInArrow body: per partition, confusion counts of every chromosome.

    Emits one row per (split, chromosome) per partition; the sum over
    partitions is a tiny shuffle of P rows per task.
    """
    d = bits.shape[1]
    acc: dict = {}
    for s, ys, q in parts(batches, "split", d):
        contrib = (q - m1) ** 2 - (q - m0) ** 2  # exact int64, (n, d)
        exact = float(np.abs(contrib).max(initial=0)) * d < EXACT_F64
        cs = contrib.astype(np.float64) if exact else contrib
        n1 = int(ys.sum())
        n0 = int(len(ys) - n1)
        tp = np.zeros(len(ids), dtype=np.int64)
        fp = np.zeros(len(ids), dtype=np.int64)
        for lo in range(0, len(ids), block):
            b = bits[lo : lo + block].astype(cs.dtype)
            pred = (cs @ b.T) < 0  # (n, block)
            tp[lo : lo + block] = ys @ pred
            fp[lo : lo + block] = (1 - ys) @ pred
        a = acc.setdefault(s, [np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), 0, 0])
        a[0] += tp
        a[1] += fp
        a[2] += n1
        a[3] += n0
    for s, (tp, fp, n1, n0) in acc.items():
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([s] * len(ids), pa.string()),
                pa.array(ids, pa.int64()),
                pa.array(tp, pa.int64()),
                pa.array(fp, pa.int64()),
                pa.array(n1 - tp, pa.int64()),
                pa.array(n0 - fp, pa.int64()),
            ],
            names=["split", "chrom_id", "tp", "fp", "fn", "tn"],
        )


CONF_SCHEMA = "split string, chrom_id bigint, tp bigint, fp bigint, fn bigint, tn bigint"


#: Class means found so far, per frame: they depend on its rows alone, so all
#: runs over a frame share them.
_STATISTICS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


class CentroidModel:
    name = "centroid"
    batched = True

    def __init__(self, fit_split: str = "train"):
        self.fit_split = fit_split
        self.payloads: list = []

    def release(self):
        """Drop broadcast payloads of jobs that have run."""
        for p in self.payloads:
            p.release()
        self.payloads = []

    def several_passes(self, abt: DataFrame) -> None:
        """The splits of ``abt`` will be scored more than once."""
        _STATISTICS.setdefault(abt, {})["several"] = True

    def means(self, abt: DataFrame, d: int | None = None):
        kept = _STATISTICS.setdefault(abt, {})
        if ("means", self.fit_split) not in kept:
            kept["means", self.fit_split] = class_means(abt, d, self.fit_split)
        return kept["means", self.fit_split]

    def _scored(self, abt: DataFrame, splits: tuple, d: int):
        """The rows to score and how to read them: the first time a split of a
        frame is scored as it is, from the second time on from blocks; from blocks
        at once after ``several_passes``."""
        rows = abt.where(F.col("split").isin(*splits)).select("split", "y", scale.quantize(F.col("features"), d).alias("q"))
        kept = _STATISTICS.setdefault(abt, {})
        passes = kept.setdefault("passes", Counter())
        passes.update(splits)
        if "several" not in kept and any(passes[s] < 2 for s in splits):
            return rows, _keyed
        for s in splits:
            if ("blocks", s) not in kept:
                kept["blocks", s] = blocked(rows.where(F.col("split") == s), "split", d)
        return reduce(DataFrame.union, [kept["blocks", s] for s in splits]), _opened

    def confusion(self, abt: DataFrame, ids: np.ndarray, bits: np.ndarray, eval_splits=("val",)) -> DataFrame:
        """Confusion counts ``(split, chrom_id, tp, fp, fn, tn)`` for every chromosome."""
        from featsearch.session import ship_package

        ship_package(abt.sparkSession)
        from featsearch.session import Payload

        ids = np.asarray(ids, dtype=np.int64)
        bits = np.asarray(bits, dtype=np.int8)
        m0, m1 = self.means(abt, bits.shape[1])
        payload = Payload(abt.sparkSession, (ids, bits, m0, m1), bits.nbytes + ids.nbytes)
        self.payloads.append(payload)

        def body(it):
            return confusion_batches(it, *payload.get(), parts=parts)

        rows, parts = self._scored(abt, tuple(eval_splits), bits.shape[1])
        return (
            bounded_tasks(rows).mapInArrow(body, CONF_SCHEMA)
            .groupBy("split", "chrom_id")
            .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
        )


# ------------------------------------------------------------------ cross-validation
# Folds are stratified over the train rows (``split.fold_of``).


def fold_sums(blocks: DataFrame, folds: int, d: int):
    """Per (class, fold, gene) sums and per (class, fold) counts of blocks by fold:
    one aggregation of a row per task, class, fold and gene."""
    genes = np.arange(d)

    def body(batches):
        acc: dict = {}
        for f, ys, q in _opened(batches, "fold", d):
            whole = np.nan_to_num(q).astype(np.int64)  # entries without a value add nothing
            for c in (0, 1):
                a = acc.setdefault((c, f), [np.zeros(d, np.int64), 0])
                a[0] += whole[ys == c].sum(axis=0)
                a[1] += int((ys == c).sum())
        for (c, f), (s, n) in acc.items():
            columns = [np.full(d, c), np.full(d, f), genes, s, np.full(d, n)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["y", "fold", "gene", "s", "n"])

    s = np.zeros((2, folds, d), dtype=np.int64)
    n = np.zeros((2, folds), dtype=np.int64)
    rows = bounded_tasks(blocks).mapInArrow(body, "y bigint, fold bigint, gene bigint, s bigint, n bigint")
    for r in rows.groupBy("y", "fold", "gene").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        s[r["y"], r["fold"], r["gene"]] = r["s"]
        n[r["y"], r["fold"]] = r["n"]
    return s, n


def cv_means(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Class means fitted without each fold: shape (folds, 2, d), int64."""
    folds = s.shape[1]
    out = np.zeros((folds, 2, s.shape[2]), dtype=np.int64)
    for f in range(folds):
        for c in (0, 1):
            num = s[c].sum(axis=0) - s[c, f]
            den = n[c].sum() - n[c, f]
            out[f, c] = np.floor(num.astype(np.float64) / float(den)).astype(np.int64)
    return out


def cv_batches(batches, ids, bits, means, block: int = 256):
    d = bits.shape[1]
    acc: dict = {}
    for f, ys, qf in _opened(batches, "fold", d):
        m0, m1 = means[f, 0], means[f, 1]
        contrib = (qf - m1) ** 2 - (qf - m0) ** 2
        exact = float(np.abs(contrib).max(initial=0)) * d < EXACT_F64
        cs = contrib.astype(np.float64) if exact else contrib
        tp = np.zeros(len(ids), dtype=np.int64)
        fp = np.zeros(len(ids), dtype=np.int64)
        for lo in range(0, len(ids), block):
            pred = (cs @ bits[lo : lo + block].astype(cs.dtype).T) < 0
            tp[lo : lo + block] = ys @ pred
            fp[lo : lo + block] = (1 - ys) @ pred
        n1 = int(ys.sum())
        a = acc.setdefault(f, [np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), 0, 0])
        a[0] += tp
        a[1] += fp
        a[2] += n1
        a[3] += len(ys) - n1
    for f, (tp, fp, n1, n0) in acc.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([f] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(tp, pa.int64()),
             pa.array(fp, pa.int64()), pa.array(n1 - tp, pa.int64()), pa.array(n0 - fp, pa.int64())],
            names=["fold", "chrom_id", "tp", "fp", "fn", "tn"],
        )


def _cv_confusion(self, abt: DataFrame, ids, bits, folds: int = 5, seed: int = 0) -> DataFrame:
    """``(fold, chrom_id, tp, fp, fn, tn)``: each fold's train rows scored with
    class means fitted on the other folds (all chromosomes, one pass)."""
    from featsearch.operators.split import fold_rows
    from featsearch.session import Payload, ship_package

    ship_package(abt.sparkSession)
    ids = np.asarray(ids, dtype=np.int64)
    bits = np.asarray(bits, dtype=np.int8)
    rows = fold_rows(abt, "q", scale.quantize(F.col("features"), bits.shape[1]), folds, seed, self.fit_split,
                     keep=lambda rows: blocked(rows, "fold", bits.shape[1]))
    kept, key = _STATISTICS.setdefault(abt, {}), (folds, seed, self.fit_split)
    if key not in kept:
        kept[key] = cv_means(*fold_sums(rows, folds, bits.shape[1]))
    means = kept[key]
    payload = Payload(abt.sparkSession, (ids, bits, means), bits.nbytes)
    self.payloads.append(payload)
    rows = bounded_tasks(rows)
    return (
        rows.mapInArrow(lambda it: cv_batches(it, *payload.get()),
                        "fold int, chrom_id bigint, tp bigint, fp bigint, fn bigint, tn bigint")
        .groupBy("fold", "chrom_id")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    )


def _cv_scores(self, abt: DataFrame, ids, bits, folds: int = 5, seed: int = 0, metric: str = "accuracy"):
    from featsearch.operators.fitness import cv_scores

    return cv_scores(self, abt, ids, bits, folds, seed, metric)


CentroidModel.cv_confusion = _cv_confusion
CentroidModel.cv_scores = _cv_scores
