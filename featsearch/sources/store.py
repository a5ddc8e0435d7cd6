"""Run store: Parquet tables of experiment results.

History and populations are partitioned by run and generation, and a
generation that is written again replaces itself: a run that stopped between
two writes and is resumed leaves no row twice.

Layout under one root (any Hadoop path; shared storage on a cluster)::

    configs/       run_id, started_at, dataset, algorithm, model, ... (one row per run)
    history/       run_id, gen, time_s, avg, best, worst, best_so_far, best_genes
    populations/   run_id, gen, chrom_id, genes (population to score at ``gen``; for resume)
    test_metrics/  run_id, f1, accuracy, roc_auc, best_genes, best_ever_genes, status

Chromosomes are stored exactly as ``ARRAY<INT>``; ``export_csv`` encodes them
as bit strings because the CSV writer refuses arrays.
"""

from __future__ import annotations

import os
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featsearch.functions.bits import bitstring

CONFIG_SCHEMA = (
    "run_id string, started_at timestamp, dataset string, algorithm string, model string, metric string, "
    "crossover string, mutation_rate double, population_size int, elitism int, max_generation int, "
    "stopping_threshold double, backend string, seed int"
)
HISTORY_SCHEMA = (
    "run_id string, gen int, time_s double, avg double, best double, worst double, best_so_far double, "
    "best_genes array<int>"
)
POPULATION_SCHEMA = "run_id string, gen int, chrom_id bigint, genes array<int>"
TEST_SCHEMA = (
    "run_id string, f1 double, accuracy double, roc_auc double, best_genes array<int>, "
    "best_ever_genes array<int>, status string"
)


class RunStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root
        self._lock = threading.Lock()  # concurrent runs of one application write one at a time

    def _path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def _append(self, name: str, rows: list, schema: str) -> None:
        with self._lock:
            self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(self._path(name))

    def write_config(self, cfg) -> None:
        r = cfg.row()
        self._append(
            "configs",
            [(
                r["run_id"], r["started_at"], r["dataset"], r["algorithm"], r["model"], r["metric"], r["crossover"],
                float(r["mutation_rate"]), int(r["population_size"]), int(r["elitism"]), int(r["max_generation"]),
                float(r["stopping_threshold"]), r["backend"], int(r["seed"]),
            )],
            CONFIG_SCHEMA,
        )

    def _replace(self, name: str, df: DataFrame) -> None:
        """Write whole ``(run_id, gen)`` partitions: writing one again replaces it."""
        with self._lock:
            df.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                "run_id", "gen"
            ).parquet(self._path(name))

    def append_history(self, run_id: str, rows: list[dict]) -> None:
        self._replace(
            "history",
            self.spark.createDataFrame(
                [(run_id, r["gen"], r["time_s"], r["avg"], r["best"], r["worst"], r.get("best_so_far"), r["best_genes"])
                 for r in rows],
                HISTORY_SCHEMA,
            ),
        )

    def write_population(self, run_id: str, gen: int, pop: DataFrame) -> None:
        """The (P-row) population to be scored at ``gen``; lets a run resume."""
        self._replace(
            "populations", pop.select(F.lit(run_id).alias("run_id"), F.lit(gen).alias("gen"), "chrom_id", "genes")
        )

    def populations(self) -> DataFrame:
        return self._read("populations", POPULATION_SCHEMA)

    def write_test(self, run_id: str, m: dict) -> None:
        self._append(
            "test_metrics",
            [(run_id, m["f1"], m["accuracy"], m["roc_auc"], m["best_genes"], m.get("best_ever_genes"), m["status"])],
            TEST_SCHEMA,
        )

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def exists(self) -> bool:
        """Whether any run was written here."""
        return self._exists(self.root)

    def _read(self, name: str, schema: str) -> DataFrame:
        """A table; empty if the store exists and has no such table yet.

        A store that does not exist or cannot be read raises.
        """
        if self._exists(self.root) and not self._exists(self._path(name)):
            return self.spark.createDataFrame([], schema)
        columns = [f.strip().split()[0] for f in schema.split(",")]
        return self.spark.read.schema(schema).parquet(self._path(name)).select(*columns)

    def configs(self) -> DataFrame:
        return self._read("configs", CONFIG_SCHEMA)

    def history(self) -> DataFrame:
        return self._read("history", HISTORY_SCHEMA)

    def test_metrics(self) -> DataFrame:
        return self._read("test_metrics", TEST_SCHEMA)

    def export_csv(self, out: str) -> None:
        """CSV copies of the three tables, chromosomes as bit strings."""
        self.configs().write.mode("overwrite").option("header", True).csv(os.path.join(out, "configs"))
        h = self.history().withColumn("best_genes", bitstring(F.col("best_genes")))
        h.write.mode("overwrite").option("header", True).csv(os.path.join(out, "history"))
        t = self.test_metrics().withColumn("best_genes", bitstring(F.col("best_genes"))).withColumn(
            "best_ever_genes", bitstring(F.col("best_ever_genes"))
        )
        t.write.mode("overwrite").option("header", True).csv(os.path.join(out, "test_metrics"))
