"""Import result folders written in the reference's CSV layout.

Layout: ``<root>/<dd.mm.YYYY_HH.MM.SS.ffffff>/{config,benchmark,test_metrics}.csv``.
Each table is ONE glob read over all runs; the run id is the folder name,
taken from ``_metadata.file_path`` (no directory listing loop on the driver).
Chromosomes stored as numpy text (``[0 1 1\\n 0]``) are decoded without
``eval``; text numpy abbreviated with ``...`` (over 1,000 genes) is lossy and
becomes null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featsearch.plans.report import decode_genes

# Column names of the reference's files (fixed values) -> run-store columns.
CONFIG_TEXT = {"dataset": "dataset", "crossover_choice": "crossover", "metric_choice": "metric",
               "model": "model", "algorithm": "algorithm", "backend_prefer": "backend"}
CONFIG_NUMBERS = {"mutation_rate": ("mutation_rate", "double"), "population_size": ("population_size", "int"),
                  "elitism": ("elitism", "int"), "evolution_rounds": ("max_generation", "int"),
                  "stopping_threshold": ("stopping_threshold", "double")}
HISTORY_COLUMNS = ("Gen", "Time", "Avg", "Best", "Worst", "Best Chromosome")
TEST_COLUMNS = ("F1", "Accuracy", "ROC AUC", "Best Chromosome")
FOLDER_TIME_FORMAT = "dd.MM.yyyy_HH.mm.ss.SSSSSS"


def _read(spark: SparkSession, root: str, name: str) -> DataFrame:
    df = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        .csv(f"{root.rstrip('/')}/*/{name}")
    )
    run = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return df.withColumn("run_id", run)


def genes_from_text(col: str) -> Column:
    c = F.col(f"`{col}`")
    return F.when(c.contains("..."), F.lit(None).cast("array<int>")).otherwise(decode_genes(c))


def read_results(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(configs, history, test_metrics)`` in the run-store schema."""
    cfg = _read(spark, root, "config.csv")
    configs = cfg.select(
        "run_id",
        F.to_timestamp("run_id", FOLDER_TIME_FORMAT).alias("started_at"),
        *[F.col(src).alias(dst) for src, dst in CONFIG_TEXT.items()],
        *[F.col(src).cast(t).alias(dst) for src, (dst, t) in CONFIG_NUMBERS.items()],
        F.lit(0).alias("seed"),  # the reference seeds every run with 0
    )
    hist = _read(spark, root, "benchmark.csv")
    w = Window.partitionBy("run_id").orderBy("gen").rowsBetween(Window.unboundedPreceding, 0)  # <= generations
    history = hist.select(
        "run_id",
        F.col("Gen").cast("int").alias("gen"),
        F.col("Time").cast("double").alias("time_s"),
        F.col("Avg").cast("double").alias("avg"),
        F.col("Best").cast("double").alias("best"),
        F.col("Worst").cast("double").alias("worst"),
        genes_from_text("Best Chromosome").alias("best_genes"),
    ).withColumn("best_so_far", F.max("best").over(w))
    tst = _read(spark, root, "test_metrics.csv")
    test = tst.select(
        "run_id",
        F.col("F1").cast("double").alias("f1"),
        F.col("Accuracy").cast("double").alias("accuracy"),
        F.col("`ROC AUC`").cast("double").alias("roc_auc"),
        genes_from_text("Best Chromosome").alias("best_genes"),
        F.lit(None).cast("array<int>").alias("best_ever_genes"),
        F.lit("done").alias("status"),
    )
    return configs, history, test
