"""Boosted trees for a whole population at once.

Gradient boosting of the logistic loss with the boosted-tree library's defaults:
100 trees of depth 6, step 0.3, L2 weight 1 on leaf values, least Hessian sum 1
in a child, no gain threshold, start at probability 0.5.

Genes are binned once into byte codes, by cut points taken from exact counts of
equal cells between a gene's least and largest training value. Every level of
every tree of ALL chromosomes is then one pass over the training rows (rows of
one fold and class with equal codes are one row with a weight: few genes have few
codes, whatever the number of rows): a task
routes its rows through the tree under construction, adds up the gradients and
Hessians by (chromosome, node, gene, bin), masked genes skipped, and one task
per chromosome adds those tables and chooses the splits. Only the chosen splits
reach the driver. So a population takes ``trees * depth`` passes, whatever its
size (more only where its tables would exceed ``max_cells`` in a task).

Gradients are rounded to units of 2^-24 per row and added as whole numbers:
the trees are the same for any partitioning and do not depend on which other
chromosomes share the passes. Ties between splits go to the smaller gene, then the
smaller bin.

A row's margins, one per chromosome, are written with its codes every
``store_every`` trees into the shared checkpoint folder; a pass adds the few trees
since. A lost executor re-reads that table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsearch.operators.models import exact
from featsearch.operators.models.centroid import split_masks
from featsearch.session import Payload, bounded_tasks, checkpoint_dir, ship_package

#: Cells between the least and the largest value of a gene, of which the cuts
#: are borders, and units of gradients.
CELLS, UNIT = 4096, 24


#: An inner node is ``gene * 256 + bin``; no code is above 255, so rows pass a
#: node without a split to the left.
CLOSED = 255


#: Rows (of distinct codes) worth a task of their own.
TASK_ROWS = 2048


@dataclass
class Forest:
    """``split`` (P, T, 2^depth - 1): the inner nodes; ``value`` (P, T, 2^depth):
    the leaves."""

    split: np.ndarray
    value: np.ndarray

    @property
    def nbytes(self) -> int:
        return self.split.nbytes + self.value.nbytes

    def part(self, problems, trees=slice(None)) -> Forest:
        return Forest(self.split[problems, trees], self.value[problems, trees])


def routed(codes: np.ndarray, split: np.ndarray, levels: int) -> np.ndarray:
    """Node (rows, P) that every row reaches after ``levels`` splits of one tree
    (P, nodes) of each chromosome."""
    n, d = codes.shape
    flat, own, row, cells = np.ascontiguousarray(split).ravel(), np.arange(len(split)) * split.shape[1], np.arange(n)[:, None] * d, codes.ravel()
    node = np.zeros((n, len(split)), np.int64)
    for _ in range(levels):
        s = flat.take(node + own)
        node = 2 * node + 1 + (cells.take(row + (s >> 8)) > (s & 255))
    return node


def added(margin: np.ndarray, codes: np.ndarray, forest: Forest) -> np.ndarray:
    """``margin`` (rows, P) plus the trees of ``forest``, in their order."""
    problems, trees, nodes = forest.split.shape
    depth = (nodes + 1).bit_length() - 1
    own = np.arange(problems) * (nodes + 1) - nodes
    for t in range(trees):
        value = np.ascontiguousarray(forest.value[:, t]).ravel()
        margin = margin + value.take(routed(codes, forest.split[:, t], depth) + own)
    return margin


def _column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _codes(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(_column(batch, "codes").to_pylist()), np.uint8).reshape(-1, d)


def _margins(batch: pa.RecordBatch, p: int) -> np.ndarray:
    raw = b"".join(x or b"" for x in _column(batch, "margins").to_pylist())
    return np.frombuffer(raw, np.float64).reshape(-1, p) if raw else np.zeros((batch.num_rows, p))


def _features(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return _column(batch, "features").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


# Cut points -------------------------------------------------------------------


def cuts_of(rows: DataFrame, d: int, bins: int) -> list[np.ndarray]:
    """At most ``bins - 1`` increasing cut points per gene; code = cuts below a value.

    Depends on the values alone: least and largest are exact, and so are the
    counts of the ``CELLS`` equal cells between them. A cut is set after each
    cell that completes another ``1 / bins`` of the rows.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(d, np.inf), np.full(d, -np.inf)
        for batch in batches:
            if batch.num_rows:
                x = _features(batch, d)
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(low), pa.array(high)], ["gene", "low", "high"])

    found = rows.mapInArrow(ranges, "gene long, low double, high double").groupBy("gene").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    low, width = np.zeros(d), np.zeros(d)
    for r in found.collect():  # a row per gene
        if np.isfinite(r.low):
            low[r.gene], width[r.gene] = r.low, (r.high - r.low) / CELLS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d * CELLS, np.int64)
        safe = np.where(width > 0, width, 1.0)
        for batch in batches:
            if batch.num_rows:
                cell = np.clip((_features(batch, d) - low) / safe, 0, CELLS - 1).astype(np.int64)
                total += np.bincount((cell + np.arange(d) * CELLS).ravel(), minlength=d * CELLS)
        yield from exact.emitted({g: total[g * CELLS : (g + 1) * CELLS] for g in range(d)})

    out = [np.zeros(0)] * d
    for gene, counts in exact.sums(rows, counted, length=CELLS).items():
        if width[gene] > 0:
            upto = np.cumsum(counts)
            share = upto * bins // max(int(upto[-1]), 1)
            ends = np.flatnonzero((np.diff(share, prepend=0) > 0) & (upto < upto[-1]))
            out[gene] = low[gene] + (ends + 1) * width[gene]
    return out


def _coded(cuts: list[np.ndarray], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _features(batch, len(cuts))
                codes = np.stack([np.searchsorted(c, x[:, g], "right") for g, c in enumerate(cuts)], axis=1).astype(np.uint8)
                kept = [_column(batch, c) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([c.tobytes() for c in codes], pa.binary())], [*names, "codes"])

    return run


def _tables(cell: np.ndarray, values: list[np.ndarray], size: int, weight: float) -> np.ndarray:
    """Sums of whole numbers by cell, exact: ``weight`` rows of at most 2^UNIT each."""
    if weight < 1 << (exact.EXACT_BITS - UNIT - 1):
        return np.concatenate([np.bincount(cell, v, size) for v in values]).astype(np.int64)
    out = np.zeros((len(values), size), np.int64)
    for total, v in zip(out, values, strict=True):
        np.add.at(total, cell, v.astype(np.int64))
    return out.ravel()


# One level --------------------------------------------------------------------


def _level_task(payload: Payload, d: int, p_all: int, bins: int):
    """Gradient and Hessian tables of the open nodes of one level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        problems, recent, split, level, open_, masks, excl = payload.get()
        first = (1 << level) - 1
        totals = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = _codes(batch, d)
            y = _column(batch, "y").to_numpy(zero_copy_only=False).astype(np.float64)
            margin = added(_margins(batch, p_all)[:, problems], codes, recent)
            p = 1.0 / (1.0 + np.exp(-margin))
            weight = _column(batch, "weight").to_numpy(zero_copy_only=False).astype(np.float64)
            g, h = (exact.rounded(v, UNIT) * weight[:, None] for v in (p - y[:, None], p * (1.0 - p)))
            if excl is not None:
                used = _column(batch, "fold").to_numpy(zero_copy_only=False)[:, None] != excl[None, :]
                g, h = g * used, h * used
            at = routed(codes, split, level) - first
            for k, (own, slots) in enumerate(zip(masks, open_, strict=True)):
                slot = slots[at[:, k]]
                rows = np.flatnonzero(slot >= 0)
                if not len(rows):
                    continue
                cell = (slot[rows, None] * len(own) + np.arange(len(own))) * bins + codes[rows][:, own]
                size = int(slots.max() + 1) * len(own) * bins
                here = _tables(cell.ravel(), [np.repeat(v[rows, k], len(own)) for v in (g, h)], size, weight.sum())
                totals[k] = totals[k] + here if k in totals else here
        yield from exact.emitted({int(problems[k]): v for k, v in totals.items()})

    return run


def best_splits(total: np.ndarray, genes: int, bins: int, l2: float, least: float) -> np.ndarray:
    """Per open node: gene place, bin (-1: no split), and as whole numbers the
    gradient and Hessian sums of the left child and of the node."""
    g, h = total.reshape(2, -1, genes, bins)
    left_g, left_h = np.cumsum(g, axis=2), np.cumsum(h, axis=2)
    all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]  # every gene sees all rows of a node
    scale = 2.0**-UNIT

    def worth(a, b):
        return (a * scale) ** 2 / (b * scale + l2)

    gain = worth(left_g, left_h) + worth(all_g - left_g, all_h - left_h) - worth(all_g, all_h)
    fits = (left_h * scale >= least) & ((all_h - left_h) * scale >= least)
    gain = np.where(fits, gain, -1.0).reshape(len(g), -1)
    best = gain.argmax(axis=1)  # the first of equals
    nodes = np.arange(len(g))
    place, cut = best // bins, best % bins
    found = gain[nodes, best] > 1e-9
    out = np.stack([place, np.where(found, cut, -1), left_g[nodes, place, cut], left_h[nodes, place, cut],
                    all_g[:, 0, 0], all_h[:, 0, 0]], axis=1)
    return out.astype(np.int64)


class TreesModel:
    """Boosted trees of every chromosome (and, with ``excl``, of every fold)."""

    name = "gbt"
    batched = True

    def __init__(self, trees: int = 100, depth: int = 6, step: float = 0.3, l2: float = 1.0, least: float = 1.0, bins: int = 64,
                 fit_split: str = "train", store_every: int = 10, max_cells: int = 16_000_000):
        if not 2 <= bins <= 256:
            raise ValueError("codes are bytes: 2 to 256 bins")
        self.trees, self.depth, self.step, self.l2, self.least, self.bins = trees, depth, step, l2, least, bins
        self.fit_split, self.store_every, self.max_cells = fit_split, store_every, max_cells
        self.passes = 0
        self.payloads: list = []

    def release(self):
        for p in self.payloads:
            p.release()
        self.payloads = []

    def _coded_rows(self, abt: DataFrame, d: int, splits, fold=None) -> tuple[DataFrame, list[np.ndarray]]:
        """Codes of all rows that are needed, equal ones together, written once."""
        ship_package(abt.sparkSession)
        train = abt.where(F.col("split") == self.fit_split).select("features")
        cuts = cuts_of(bounded_tasks(train), d, self.bins)
        fold = F.lit(0).cast("int") if fold is None else fold
        rows = abt.where(F.col("split").isin(*splits)).select(fold.alias("fold"), F.col("split"), F.col("y").cast("long").alias("y"), "features")
        names = ["fold", "split", "y"]
        coded = rows.mapInArrow(_coded(cuts, names), "fold int, split string, y long, codes binary")
        coded = coded.groupBy(*names, "codes").agg(F.count(F.lit(1)).alias("weight"))
        return self._written(abt.sparkSession, coded.withColumn("margins", F.lit(None).cast("binary"))), cuts

    @staticmethod
    def _written(spark, rows: DataFrame) -> DataFrame:
        path = f"{checkpoint_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
        rows.write.partitionBy("split").parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    def _spread(self, rows: DataFrame) -> DataFrame:
        """``rows``, written anew if they are in fewer tasks than their number is worth."""
        spark = rows.sparkSession
        tasks = min(spark.sparkContext.defaultParallelism, rows.count() // TASK_ROWS)
        if rows.rdd.getNumPartitions() < tasks:
            rows = self._written(spark, rows.repartition(tasks))
        return bounded_tasks(rows)

    def fit_rows(self, coded: DataFrame, bits: np.ndarray, excl: np.ndarray | None = None) -> Forest:
        """The forests of all problems over the ``fit_split`` rows of ``coded``."""
        spark = coded.sparkSession
        rows = self._spread(coded.where(F.col("split") == self.fit_split))
        p, d = bits.shape
        masks = [np.flatnonzero(b) for b in bits]
        inner, leaves = (1 << self.depth) - 1, 1 << self.depth
        forest = Forest(np.full((p, self.trees, inner), CLOSED, np.int32), np.zeros((p, self.trees, leaves)))
        live = np.array([k for k in range(p) if len(masks[k])], np.int64)
        stored = 0  # trees whose values are in the margins of ``rows``
        for t in range(self.trees):
            if t - stored >= self.store_every:
                rows = self._store(spark, rows, forest.part(slice(None), slice(stored, t)), p, d)
                stored = t
            open_ = {int(k): np.zeros(1, np.int64) for k in live}  # slot of every node of the level, -1 closed
            for level in range(self.depth):
                for part in self._chunks(open_, masks):
                    self._grow(rows, forest, t, stored, level, part, open_, masks, excl, d)
                open_ = {k: v for k, v in open_.items() if (v >= 0).any()}
                if not open_:
                    break
        return forest

    def _chunks(self, open_: dict, masks) -> Iterator[np.ndarray]:
        """Problems whose tables fit into a task together."""
        part, size = [], 0
        for k, slots in open_.items():
            cells = 2 * int(slots.max() + 1) * len(masks[k]) * self.bins
            if part and size + cells > self.max_cells:
                yield np.array(part)
                part, size = [], 0
            part.append(k)
            size += cells
        if part:
            yield np.array(part)

    def _grow(self, rows, forest, t, stored, level, part, open_, masks, excl, d) -> None:
        """One pass: splits of the open nodes of ``level`` of tree ``t``."""
        recent = forest.part(part, slice(stored, t))
        own_masks = [masks[k] for k in part]
        value = (part, recent, forest.split[part, t], level, [open_[int(k)] for k in part], own_masks,
                 None if excl is None else excl[part])
        payload = Payload(rows.sparkSession, value, recent.nbytes + sum(m.nbytes for m in own_masks))
        sizes = {int(k): len(masks[k]) for k in part}
        bins, l2, least = self.bins, self.l2, self.least
        found = exact.sums(
            rows, _level_task(payload, d, len(forest.split), bins),
            lambda k, total: best_splits(total, sizes[k], bins, l2, least).tobytes(),
            length=2 * bins * max(int(open_[int(k)].max() + 1) * sizes[int(k)] for k in part),
        )
        payload.release()
        self.passes += 1
        first = (1 << level) - 1
        for k in part.tolist():
            slots = open_[k]
            table = np.frombuffer(found[k], np.int64).reshape(-1, 6) if k in found else np.zeros((0, 6), np.int64)
            below = np.full(2 * len(slots), -1, np.int64)
            n = 0
            for at in np.flatnonzero(slots >= 0).tolist():
                if slots[at] >= len(table):
                    continue
                place, cut, left_g, left_h, all_g, all_h = table[slots[at]].tolist()
                if cut < 0:
                    self._leaf(forest, k, t, level, at, all_g, all_h)
                    continue
                forest.split[k, t, first + at] = masks[k][place] * 256 + cut
                for side, (g, h) in enumerate(((left_g, left_h), (all_g - left_g, all_h - left_h))):
                    if level + 1 == self.depth:
                        self._leaf(forest, k, t, level + 1, 2 * at + side, g, h)
                    else:
                        below[2 * at + side] = n
                        n += 1
            open_[k] = below

    def _leaf(self, forest, k, t, level, at, g, h) -> None:
        """A node without a split keeps its value in its leftmost leaf."""
        scale = 2.0**-UNIT
        forest.value[k, t, at << (self.depth - level)] = -self.step * (g * scale) / (h * scale + self.l2)

    def _store(self, spark, rows: DataFrame, recent: Forest, p: int, d: int) -> DataFrame:
        """``rows`` with the margins after the trees ``recent``, written anew."""
        payload = Payload(spark, recent, recent.nbytes)
        names = ["fold", "y", "codes", "weight", "split"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    margin = added(_margins(batch, p), _codes(batch, d), payload.get())
                    kept = [_column(batch, c) for c in names]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array([m.tobytes() for m in margin], pa.binary())], [*names, "margins"])

        out = self._written(spark, rows.mapInArrow(run, "fold int, y long, codes binary, weight long, split string, margins binary"))
        payload.release()
        return bounded_tasks(out)

    def confusion(self, abt: DataFrame, ids: np.ndarray, bits: np.ndarray, eval_splits=("val",)) -> DataFrame:
        bits = np.asarray(bits, np.int8)
        coded, _ = self._coded_rows(abt, bits.shape[1], {self.fit_split, *eval_splits})
        forest = self.fit_rows(coded, bits)
        rows = bounded_tasks(coded.where(F.col("split").isin(*eval_splits)))
        return self._counts(rows, np.asarray(ids, np.int64), forest, bits.shape[1], "split", None)

    def cv_confusion(self, abt: DataFrame, ids, bits, folds: int = 5, seed: int = 0) -> DataFrame:
        """``(fold, chrom_id, tp, fp, fn, tn)``: all (chromosome, fold) problems
        share every pass; rows of a problem's own fold do not train it."""
        from featsearch.operators.split import fold_of

        ids, bits = np.repeat(np.asarray(ids, np.int64), folds), np.repeat(np.asarray(bits, np.int8), folds, axis=0)
        excl = np.tile(np.arange(folds, dtype=np.int64), len(ids) // folds)
        coded, _ = self._coded_rows(abt, bits.shape[1], {self.fit_split}, fold_of(abt, folds, seed, self.fit_split))
        forest = self.fit_rows(coded, bits, excl)
        return self._counts(bounded_tasks(coded), ids, forest, bits.shape[1], "fold", excl)

    def cv_scores(self, abt: DataFrame, ids, bits, folds: int = 5, seed: int = 0, metric: str = "accuracy"):
        from featsearch.operators.fitness import cv_scores

        return cv_scores(self, abt, ids, bits, folds, seed, metric)

    def _counts(self, rows: DataFrame, ids, forest: Forest, d: int, group: str, excl) -> DataFrame:
        """Confusion counts by ``group`` (split, or a problem's own fold)."""
        payload = Payload(rows.sparkSession, forest, forest.nbytes)
        self.payloads.append(payload)
        kind = "string" if group == "split" else "int"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                codes = _codes(batch, d)
                y = _column(batch, "y").to_numpy(zero_copy_only=False).astype(bool)
                weight = _column(batch, "weight").to_numpy(zero_copy_only=False)
                said = added(np.zeros((len(codes), len(ids))), codes, payload.get()) > 0
                if excl is None:
                    parts = [(s, sel, np.ones(len(ids), bool)) for s, sel in split_masks(batch)]
                else:
                    fold = _column(batch, "fold").to_numpy(zero_copy_only=False)
                    parts = [(int(f), np.flatnonzero(fold == f), excl == f) for f in np.unique(fold)]
                for s, sel, own in parts:
                    here = found.setdefault(s, (np.zeros((4, len(ids)), np.int64), own))[0]
                    for i, (a, b) in enumerate(((1, 1), (0, 1), (1, 0), (0, 0))):
                        here[i] += weight[sel] @ ((y[sel] == a)[:, None] & (said[sel] == b))
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
