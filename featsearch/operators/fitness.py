"""Fitness of a whole population (M1, M2, M5, M6, M7).

One pass over the evaluation rows scores every chromosome: the population is
collected (bounded by config) and shipped to tasks; only ``P`` rows of
confusion counts per task are shuffled. Duplicate chromosomes are scored once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsearch.functions import bits, metrics
from featsearch.operators import population as popops

COUNTS = ("tp", "fp", "fn", "tn")


def distinct(mat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows of 0/1 and the place of every row among them, for any
    width (``np.unique`` makes a field per gene)."""
    keys = [row.tobytes() for row in np.packbits(mat, axis=1)]
    first = {k: i for i, k in reversed(list(enumerate(keys)))}
    order = {k: u for u, k in enumerate(sorted(first))}
    return mat[[first[k] for k in order]], np.array([order[k] for k in keys])


def in_pieces(model) -> bool:
    """Does ``model`` take chromosomes of any width, as packed pieces?"""
    return getattr(model, "bits_per_byte", 1) > 1


def confusion(abt: DataFrame, pop: DataFrame, model, eval_splits=("val",)) -> DataFrame:
    """``(split, chrom_id, tp, fp, fn, tn)`` for every chromosome of ``pop``."""
    spark = abt.sparkSession
    if in_pieces(model):
        found = popops.Pieces(pop, model.bits_per_byte)
        ids, (uniq, inverse) = found.ids, found.distinct()
    else:
        ids, mat = popops.to_matrix(pop)
        uniq, inverse = distinct(mat)
    if len(ids) == 0:
        return spark.createDataFrame([], "split string, chrom_id bigint, tp bigint, fp bigint, fn bigint, tn bigint")
    conf = model.confusion(abt, np.arange(len(uniq), dtype=np.int64), uniq, eval_splits)
    if len(uniq) == len(ids) and np.array_equal(inverse, np.arange(len(ids))) and np.array_equal(ids, np.arange(len(ids))):
        return conf
    mapping = spark.createDataFrame(
        [(int(i), int(u)) for i, u in zip(ids, inverse)], "chrom_id bigint, uid bigint"
    )
    return (
        F.broadcast(mapping)  # P rows
        .join(conf.withColumnRenamed("chrom_id", "uid"), "uid")
        .drop("uid")
    )


def score(abt: DataFrame, pop: DataFrame, model, metric: str = "f1", eval_split: str = "val") -> DataFrame:
    """``(chrom_id, genes, tp, fp, fn, tn, score)``; an empty subset scores null."""
    conf = confusion(abt, pop, model, (eval_split,)).where(F.col("split") == eval_split).drop("split")
    if in_pieces(model):  # P rows: no shuffle of wide chromosomes
        conf = F.broadcast(pop.sparkSession.createDataFrame([tuple(r) for r in conf.select("chrom_id", *COUNTS).collect()], ", ".join(f"{c} bigint" for c in ("chrom_id", *COUNTS))))
        model.release()
    j = pop.select("chrom_id", "genes").join(conf, "chrom_id", "left")
    j = j.select("chrom_id", "genes", *[F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in COUNTS])
    m = F.when(bits.n_selected(F.col("genes")) == 0, F.lit(None).cast("double")).otherwise(metrics.metric(metric))
    return j.withColumn("score", m)


def all_metrics(conf: DataFrame) -> DataFrame:
    return conf.select(
        "*",
        metrics.f1().alias("f1"),
        metrics.accuracy().alias("accuracy"),
        metrics.roc_auc().alias("roc_auc"),
    )


def _py_metric(name: str, tp: int, fp: int, fn: int, tn: int):
    """Same doubles as the Column expressions (exact integer operands)."""
    name = metrics.ALIASES.get(name, name)
    if name == "f1":
        den = 2 * tp + fp + fn
        return 0.0 if den == 0 else (2 * tp) / den
    if name == "accuracy":
        return (tp + tn) / (tp + fp + fn + tn)
    if name == "roc_auc":
        pos, neg = tp + fn, tn + fp
        return None if pos == 0 or neg == 0 else (tp / pos + tn / neg) / 2
    raise ValueError(f"unknown metric {name!r}")


def score_rows(abt: DataFrame, ids: np.ndarray, mat: np.ndarray, model, metric: str = "f1",
               eval_split: str = "val", cache: dict | None = None) -> list[dict]:
    """Driver-side twin of :func:`score` for a population already on the driver:
    one scoring job, ``P`` rows back; no second pass over the population plan.

    ``cache`` maps a chromosome's bytes to its confusion row; fitness is a
    deterministic function of the gene set, so cached chromosomes (elites,
    unchanged mutants, earlier duplicates) are not scored again.
    """
    cache = {} if cache is None else cache
    uniq, inverse = np.unique(mat, axis=0, return_inverse=True)
    inverse = np.asarray(inverse).reshape(-1)
    todo = [i for i in range(len(uniq)) if uniq[i].tobytes() not in cache]
    if todo:
        conf = model.confusion(abt, np.array(todo, dtype=np.int64), uniq[todo], (eval_split,)).collect()
        model.release()  # the job has run: broadcast payloads can go
        for r in conf:
            if r["split"] == eval_split:
                cache[uniq[r["chrom_id"]].tobytes()] = r
    by = {i: cache.get(uniq[i].tobytes()) for i in range(len(uniq))}
    out = []
    for cid, u, genes in zip(ids, inverse, mat):
        c = by.get(int(u))
        tp, fp, fn, tn = (c["tp"], c["fp"], c["fn"], c["tn"]) if c else (0, 0, 0, 0)
        sc = None if int(genes.sum()) == 0 or c is None else _py_metric(metric, tp, fp, fn, tn)
        out.append({"chrom_id": int(cid), "genes": [int(x) for x in genes], "tp": tp, "fp": fp, "fn": fn, "tn": tn,
                    "score": sc})
    return out


def cv_scores(model, abt: DataFrame, ids, bits, folds: int = 5, seed: int = 0, metric: str = "accuracy"):
    """Mean over folds (in fold order) of the metric of every chromosome,
    from the model's ``cv_confusion``; returns ``[(chrom_id, score)]``."""
    conf = model.cv_confusion(abt, ids, bits, folds, seed).collect()
    model.release()
    per: dict = {}
    for r in conf:
        per.setdefault(r["chrom_id"], {})[r["fold"]] = _py_metric(metric, r["tp"], r["fp"], r["fn"], r["tn"])
    out = []
    for cid in ids:
        found = per.get(int(cid), {})
        vals = [found[f] for f in range(folds) if f in found]  # a fold without rows has no score
        out.append((int(cid), sum(0.0 if v is None else v for v in vals) / max(1, len(vals))))
    return out
