"""Nearest-centroid classifier over sparse rows (``operators/sparse.py``).

The same classifier as ``models/centroid.py`` with nothing made dense. A zero
of gene ``g`` has the fixed-point value ``z0_g = floor(-mean_g / sd_g * SCALE)``,
so with ``b = 2 (m0 - m1)`` a decision is

    sum_g bit_g (m0_g - m1_g)(2 z0_g - m0_g - m1_g)  +  sum_nonzero bit_g b_g (z_g - z0_g):

a constant per chromosome and a sum over the nonzeros of a row. Means and
deviations merge the moments of the nonzeros with those of the zeros, class
sums are ``n z0`` plus differences at the nonzeros. Widths are bounded by
the population check, since every chromosome holds a bit per gene.
"""

from __future__ import annotations

import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsearch.operators.models.centroid import CONF_SCHEMA, split_masks
from featsearch.operators.population import Pieces
from featsearch.operators.scale import SCALE
from featsearch.session import Payload, bounded_tasks, ship_package, written

#: Cells of one gathered block (entries x chromosomes), 8 bytes each.
CELLS = 1 << 22


#: Genes whose statistics and bits the driver holds at a time, and that one payload ships.
RANGE = 1 << 18


def gene_moments(rows: DataFrame) -> DataFrame:
    """``gene, k, s, m, v``: number, sum, mean and variance of the nonzeros of every gene that has one."""
    return (
        rows.select(F.explode(F.arrays_zip("indices", "values")).alias("e"))
        .groupBy(F.col("e.indices").alias("gene"))
        .agg(F.count(F.lit(1)).alias("k"), F.sum("e.values").alias("s"), F.avg("e.values").alias("m"), F.var_pop("e.values").alias("v"))
    )


def spread(found: DataFrame, n: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation, zeros included, of genes ``lo`` to ``hi`` from their ``gene_moments``."""
    got = found.where(F.col("gene").between(lo, hi - 1)).toArrow()
    gene, k, s, m, v = (got[c].to_numpy() for c in ("gene", "k", "s", "m", "v"))
    gene = gene - lo
    mean, sd = np.zeros(hi - lo), np.ones(hi - lo)
    mean[gene] = s / n
    k = k.astype(np.float64)
    var = (v * k + m * m * (k * (n - k)) / n) / n
    sd[gene] = np.where(var > 0, np.sqrt(np.maximum(var, 0)), 1.0)
    return mean, sd


def ranges(d: int) -> list[tuple[int, int]]:
    return [(lo, min(lo + RANGE, d)) for lo in range(0, d, RANGE)]


def moments(rows: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of every gene, zeros included."""
    return spread(gene_moments(rows), rows.count(), 0, d)


def fixed(x, mean, sd) -> np.ndarray:
    return np.floor((x - mean) / sd * SCALE).astype(np.int64)


def moved(x, mean, sd) -> np.ndarray:
    """Fixed-point distance of a value from the zero of its gene."""
    return fixed(x, mean, sd) - fixed(0.0, mean, sd)


def _entries(rb: pa.RecordBatch):
    """``row, gene, value`` of the nonzeros of a batch."""
    lists = rb.column(rb.schema.get_field_index("indices"))
    gene = lists.flatten().to_numpy()
    value = rb.column(rb.schema.get_field_index("values")).flatten().to_numpy()
    row = np.repeat(np.arange(rb.num_rows), np.diff(lists.offsets.to_numpy()))
    return row, gene, value


def at_genes(parts, gene: np.ndarray, columns) -> list[np.ndarray]:
    """Entries of ``gene`` in some of the arrays that ``parts`` holds by ``ranges``."""
    if len(parts) == 1:
        return [parts[0][c][gene] for c in columns]
    out = [np.empty((len(gene), *parts[0][c].shape[1:]), parts[0][c].dtype) for c in columns]
    of = gene // len(parts[0][columns[0]])
    for i in np.unique(of):
        here = np.flatnonzero(of == i)
        for o, c in zip(out, columns, strict=True):
            o[here] = parts[i][c][gene[here] - i * len(parts[0][c])]
    return out


class Statistics:
    """Moments and class sums of the nonzeros, as tables: the driver reads the genes of a range at a time."""

    def __init__(self, rows: DataFrame, d: int):
        self.d, self.n = d, rows.count()
        self.of_class = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
        self.found = written(gene_moments(rows), "moments")
        parts = []
        for lo, hi in ranges(d):
            mean, sd = spread(self.found, self.n, lo, hi)
            parts.append(Payload(rows.sparkSession, (mean, sd), 2 * mean.nbytes))
        if set(self.of_class) != {0, 1}:
            raise ValueError("the fit split must hold both classes")
        self.sums = written(class_sums(rows, parts, d), "sums")
        for p in parts:
            p.release()

    def part(self, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        """``mean, sd`` and fixed-point class means ``m0, m1`` of genes ``lo`` to ``hi``."""
        mean, sd = spread(self.found, self.n, lo, hi)
        got = self.sums.where(F.col("gene").between(lo, hi - 1)).toArrow()
        total, z0 = np.zeros((2, hi - lo), np.int64), fixed(0.0, mean, sd)
        total[got["y"].to_numpy(), got["gene"].to_numpy() - lo] = got["s"].to_numpy()
        means = [np.floor((total[c] + n * z0).astype(np.float64) / float(n)).astype(np.int64) for c, n in sorted(self.of_class.items())]
        return mean, sd, *means


def class_sums(rows: DataFrame, parts: list[Payload], d: int) -> DataFrame:
    """``y, gene, s``: fixed-point sums of the nonzeros; a task returns those that are not 0."""

    def body(batches):
        held = [p.get() for p in parts]
        total = np.zeros((2, d), np.int64)
        for rb in batches:
            row, gene, value = _entries(rb)
            y = rb.column(rb.schema.get_field_index("y")).to_numpy()[row]
            np.add.at(total, (y, gene), moved(value, *at_genes(held, gene, (0, 1))))
        for lo, hi in ranges(d):
            y, gene = np.nonzero(total[:, lo:hi])
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int64()), pa.array(gene + lo, pa.int64()), pa.array(total[y, gene + lo])], ["y", "gene", "s"])

    sums = bounded_tasks(rows.select("y", "indices", "values")).mapInArrow(body, "y bigint, gene bigint, s bigint")
    return sums.groupBy("y", "gene").agg(F.sum("s").alias("s"))


def by_gene(bits: np.ndarray, genes: int = 1 << 16) -> np.ndarray:
    """``bits`` (P, d) as (d, ceil(P / 8)) bytes, some genes at a time."""
    out = np.empty((bits.shape[1], -(-len(bits) // 8)), np.uint8)
    for at in range(0, len(out), genes):
        out[at : at + genes] = np.packbits(bits[:, at : at + genes].T, axis=1)
    return out


def confusion_batches(batches, ids, base, parts):
    """Confusion counts of every chromosome per split of a partition's rows;
    ``parts``: per range of genes, the bits of all chromosomes by gene, eight to a
    byte, mean, deviation and step."""
    p = len(ids)
    acc: dict = {}
    block = max(1, CELLS // max(p, 1))
    for rb in batches:
        if rb.num_rows == 0:
            continue
        row, gene, value = _entries(rb)
        mean, sd, step = at_genes(parts, gene, (1, 2, 3))
        weight = step * moved(value, mean, sd)
        decision = np.tile(base, (rb.num_rows, 1))
        for lo in range(0, len(row), block):  # a long row may span blocks
            r = row[lo : lo + block]
            cells = np.unpackbits(at_genes(parts, gene[lo : lo + block], (0,))[0], axis=1, count=p) * weight[lo : lo + block, None]
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            decision[r[first]] += np.add.reduceat(cells, first, axis=0)
        y = rb.column(rb.schema.get_field_index("y")).to_numpy().astype(np.int64)
        for s, sel in split_masks(rb):
            hit, ys = decision[sel] < 0, y[sel]
            a = acc.setdefault(s, [np.zeros(p, np.int64), np.zeros(p, np.int64), 0, 0])
            a[0] += ys @ hit
            a[1] += (1 - ys) @ hit
            a[2] += int(ys.sum())
            a[3] += int(len(ys) - ys.sum())
    for s, (tp, fp, n1, n0) in acc.items():
        counts = [pa.array(c, pa.int64()) for c in (ids, tp, fp, n1 - tp, n0 - fp)]
        yield pa.RecordBatch.from_arrays([pa.array([s] * p, pa.string()), *counts], ["split", "chrom_id", "tp", "fp", "fn", "tn"])


class SparseCentroidModel:
    """The centroid model for frames ``row_id, y, split, indices, values``."""

    name = "sparse_centroid"
    batched = True
    bits_per_byte = 8

    def __init__(self, fit_split: str = "train"):
        self.fit_split = fit_split
        self._cache = weakref.WeakKeyDictionary()
        self.payloads: list = []

    def release(self):
        for p in self.payloads:
            p.release()
        self.payloads = []

    def statistics(self, abt: DataFrame, d: int) -> Statistics:
        """Of the rows to fit, once per frame."""
        kept = self._cache.setdefault(abt, {})
        if d not in kept:
            kept[d] = Statistics(abt.where(F.col("split") == self.fit_split), d)
        return kept[d]

    def fitted(self, abt: DataFrame, d: int):
        """``mean, sd, m0, m1`` of ``d`` genes."""
        return self.statistics(abt, d).part(0, d)

    def confusion(self, abt: DataFrame, ids: np.ndarray, bits, eval_splits=("val",)) -> DataFrame:
        """``bits``: a matrix (P, d) or the population's ``Pieces``."""
        ship_package(abt.sparkSession)
        bits = bits if isinstance(bits, Pieces) else np.asarray(bits, np.int8)
        d = bits.d if isinstance(bits, Pieces) else bits.shape[1]
        known, parts, base = self.statistics(abt, d), [], np.zeros(len(bits), np.int64)
        for lo, hi in ranges(d):  # the driver holds one range at a time
            own = bits.part(lo, hi) if isinstance(bits, Pieces) else bits[:, lo:hi]
            mean, sd, m0, m1 = known.part(lo, hi)
            zero = (m0 - m1) * (2 * fixed(0.0, mean, sd) - m0 - m1)
            base += np.array([zero[b == 1].sum() for b in own], np.int64)
            values = (by_gene(own), mean, sd, 2 * (m0 - m1))
            parts.append(Payload(abt.sparkSession, values, sum(v.nbytes for v in values)))
        ids = np.asarray(ids, np.int64)
        whole = Payload(abt.sparkSession, (ids, base), ids.nbytes + base.nbytes)
        self.payloads += [whole, *parts]
        rows = bounded_tasks(abt.where(F.col("split").isin(*eval_splits)).select("split", "y", "indices", "values"))
        return (
            rows.mapInArrow(lambda it: confusion_batches(it, *whole.get(), [p.get() for p in parts]), CONF_SCHEMA)
            .groupBy("split", "chrom_id")
            .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
        )
