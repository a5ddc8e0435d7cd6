"""MLP and gradient-boosted trees through MLlib.

These models are not additive across chromosomes, so each chromosome is one
MLlib fit on its column subset (``VectorSlicer``), on the distributed train
rows. Several fits run concurrently from a small driver thread pool (Spark
schedules jobs from different threads in parallel). Defaults follow the
reference's libraries where MLlib has the same knob: MLP with one hidden
layer of 100 units (MLlib uses sigmoid units and L-BFGS), 200 iterations;
boosted trees with 100 trees of depth 6 and step 0.3; seed 123.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class MLlibModel:
    batched = False

    def __init__(self, kind: str, fit_split: str = "train", threads: int = 8, seed: int = 123,
                 mlp_iter: int = 200, gbt_trees: int = 100, gbt_depth: int = 6, gbt_step: float = 0.3):
        if kind not in ("mlp", "gbt"):
            raise ValueError(kind)
        self.name = kind
        self.fit_split, self.threads, self.seed = fit_split, threads, seed
        self.mlp_iter, self.gbt_trees, self.gbt_depth, self.gbt_step = mlp_iter, gbt_trees, gbt_depth, gbt_step

    def release(self):
        pass

    def _estimator(self, k: int):
        from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier

        if self.name == "mlp":
            return MultilayerPerceptronClassifier(layers=[k, 100, 2], maxIter=self.mlp_iter, seed=self.seed,
                                                  featuresCol="sub", labelCol="label")
        return GBTClassifier(maxIter=self.gbt_trees, maxDepth=self.gbt_depth, stepSize=self.gbt_step,
                             seed=self.seed, featuresCol="sub", labelCol="label")

    def _fit_counts(self, train: DataFrame, evals: DataFrame, idx: list[int], group: str):
        """Counts of one fit, grouped by ``group`` of the evaluation rows."""
        from pyspark.ml.feature import VectorSlicer

        if not idx:  # an empty subset cannot be fitted (Q9): predict class 0
            pred = evals.select(group, "label", F.lit(0.0).alias("prediction"))
        else:
            sl = VectorSlicer(inputCol="fv", outputCol="sub", indices=idx)
            model = self._estimator(len(idx)).fit(sl.transform(train))
            pred = model.transform(sl.transform(evals)).select(group, "label", "prediction")
        return pred.groupBy(group).agg(
            F.sum(((F.col("label") == 1) & (F.col("prediction") == 1)).cast("long")).alias("tp"),
            F.sum(((F.col("label") == 0) & (F.col("prediction") == 1)).cast("long")).alias("fp"),
            F.sum(((F.col("label") == 1) & (F.col("prediction") == 0)).cast("long")).alias("fn"),
            F.sum(((F.col("label") == 0) & (F.col("prediction") == 0)).cast("long")).alias("tn"),
        ).collect()

    def cv_confusion(self, abt: DataFrame, ids, bits, folds: int = 5, seed: int = 0) -> DataFrame:
        """One MLlib fit per (chromosome, fold) on the other folds' train rows."""
        from pyspark.ml.functions import array_to_vector

        from featsearch.operators.split import fold_of

        spark = abt.sparkSession
        rows = abt.where(F.col("split") == self.fit_split).select(
            fold_of(abt, folds, seed, self.fit_split).alias("fold"), F.col("y").cast("double").alias("label"),
            array_to_vector("features").alias("fv"),
        ).persist(StorageLevel.MEMORY_AND_DISK)
        jobs = [(int(i), [int(j) for j in np.flatnonzero(b)], f) for i, b in zip(ids, bits) for f in range(folds)]

        def one(job):
            cid, idx, f = job
            c = self._fit_counts(rows.where(F.col("fold") != f), rows.where(F.col("fold") == f), idx, "fold")
            return [(r["fold"], cid, r["tp"], r["fp"], r["fn"], r["tn"]) for r in c]

        try:
            with ThreadPoolExecutor(max_workers=self.threads) as ex:
                parts = list(ex.map(one, jobs))
        finally:
            rows.unpersist()
        return spark.createDataFrame(
            [row for p in parts for row in p], "fold int, chrom_id bigint, tp bigint, fp bigint, fn bigint, tn bigint"
        )

    def cv_scores(self, abt: DataFrame, ids, bits, folds: int = 5, seed: int = 0, metric: str = "accuracy"):
        from featsearch.operators.fitness import cv_scores

        return cv_scores(self, abt, ids, bits, folds, seed, metric)

    def confusion(self, abt: DataFrame, ids: np.ndarray, bits: np.ndarray, eval_splits=("val",)) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        spark = abt.sparkSession
        rows = abt.select("split", F.col("y").cast("double").alias("label"), array_to_vector("features").alias("fv"))
        # every fit iterates over these rows: keep them (iterative MLlib input)
        train = rows.where(F.col("split") == self.fit_split).persist(StorageLevel.MEMORY_AND_DISK)
        evals = rows.where(F.col("split").isin(*eval_splits)).persist(StorageLevel.MEMORY_AND_DISK)

        def one(i):
            idx = [int(j) for j in np.flatnonzero(bits[i])]
            c = self._fit_counts(train, evals, idx, "split")
            return [(r["split"], int(ids[i]), r["tp"], r["fp"], r["fn"], r["tn"]) for r in c]

        try:
            with ThreadPoolExecutor(max_workers=self.threads) as ex:
                parts = list(ex.map(one, range(len(ids))))
        finally:
            train.unpersist()
            evals.unpersist()
        return spark.createDataFrame(
            [row for p in parts for row in p], "split string, chrom_id bigint, tp bigint, fp bigint, fn bigint, tn bigint"
        )
