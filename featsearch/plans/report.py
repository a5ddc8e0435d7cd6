"""Reports over the run store.

Every report is a keyed Spark plan over the three run tables; nothing is
read in listing order and nothing depends on a previous loop turn (Q19).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsearch.functions import bits

METRIC_COLS = ("f1", "accuracy", "roc_auc")
# Display order of the reference's result tables (fixed values).
MODEL_ORDER = ("mlp", "xgboost", "logistic")
ALGORITHM_ORDER = ("ga_spark", "ga_joblib", "random", "ga_seq", "rfs", "baseline_metrics")


def display_name(col) -> F.Column:
    """``ga_spark`` -> ``GA SPARK``; the baseline is shown as ``BASELINE``."""
    c = F.upper(F.translate(F.translate(F.col(col) if isinstance(col, str) else col, "\\", ""), "_", " "))
    return F.when(c == "BASELINE METRICS", F.lit("BASELINE")).otherwise(c)


def in_order(found, order) -> list[str]:
    """``found`` in the fixed display order, others after it by name (T5)."""
    return sorted(found, key=lambda x: (order.index(x) if x in order else len(order), x))


def run_label(col: str = "started_at") -> F.Column:
    """A run's start time in the reference's folder-name format."""
    return F.date_format(F.col(col), "dd.MM.yyyy_HH.mm.ss.SSSSSS")


def complete_runs(configs: DataFrame, history: DataFrame, test: DataFrame) -> DataFrame:
    """Runs with config, history and test metrics (F8, J8: left semi joins)."""
    return configs.join(test, "run_id", "left_semi").join(history, "run_id", "left_semi")


def incomplete_runs(configs: DataFrame, history: DataFrame, test: DataFrame) -> DataFrame:
    return configs.join(complete_runs(configs, history, test), "run_id", "left_anti")


def history_summary(history: DataFrame) -> DataFrame:
    """Mean time per generation and the last generation's avg / best / worst."""
    return history.groupBy("run_id").agg(
        F.avg("time_s").alias("time_s"),
        F.max_by("avg", "gen").alias("avg"),
        F.max_by("best", "gen").alias("best"),
        F.max_by("worst", "gen").alias("worst"),
        F.max("gen").alias("last_gen"),
    )


def compiled(configs: DataFrame, history: DataFrame, test: DataFrame) -> DataFrame:
    """test ⊕ history summary ⊕ config, keyed by run_id."""
    t = test.select("run_id", *METRIC_COLS, "best_genes")
    return complete_runs(configs, history, test).join(t, "run_id").join(history_summary(history), "run_id")


def with_placeholders(configs: DataFrame, history: DataFrame, test: DataFrame, algorithm: str = "rfs") -> DataFrame:
    """Compiled runs plus unfinished runs of ``algorithm`` with null metrics."""
    inc = incomplete_runs(configs, history, test).where(F.col("algorithm") == algorithm)
    return compiled(configs, history, test).unionByName(inc, allowMissingColumns=True)


def filtered(df: DataFrame, **equals) -> DataFrame:
    cond = F.lit(True)
    for k, v in equals.items():
        cond = cond & (F.col(k) == F.lit(v))
    return df.where(cond)


def duplicate_runs(df: DataFrame, ignore=("run_id", "started_at", "time_s")) -> DataFrame:
    """Second and later copies of identical result rows.

    Rows are keyed by a hash of their content; one aggregation finds the first
    copy of each key, so no group is ever collected into one task.
    """
    cols = [c for c in df.columns if c not in ignore]
    keyed = df.withColumn("_k", F.sha2(F.to_json(F.struct(*[F.col(c) for c in cols])), 256))
    order = [c for c in ("started_at", "run_id") if c in df.columns]  # ids begin with the day of the month
    first = keyed.groupBy("_k").agg(F.min_by("run_id", F.struct(*order)).alias("_first"))
    return keyed.join(first, "_k").where(F.col("run_id") != F.col("_first")).drop("_k", "_first")


def metrics_long(df: DataFrame) -> DataFrame:
    """Mean metrics by (dataset, model, algorithm) in long form."""
    agg = df.groupBy("dataset", "model", "algorithm").agg(*[F.avg(m).alias(m) for m in METRIC_COLS])
    return agg.unpivot(["dataset", "model", "algorithm"], list(METRIC_COLS), "metric", "value")


def metrics_pivot(df: DataFrame, datasets: list[str], models=None, algorithms=None) -> DataFrame:
    """Rows (model, algorithm, metric), one column per dataset; combinations
    without runs are kept as nulls by joining onto the label grid (R5, J7, T5)."""
    models = list(models or in_order((r[0] for r in df.select("model").distinct().collect()), MODEL_ORDER))
    algorithms = list(
        algorithms or in_order((r[0] for r in df.select("algorithm").distinct().collect()), ALGORITHM_ORDER)
    )
    spark = df.sparkSession
    grid = spark.createDataFrame(
        [(m, a, k, i * 10_000 + j * 10 + n) for i, m in enumerate(models) for j, a in enumerate(algorithms)
         for n, k in enumerate(METRIC_COLS)],
        "model string, algorithm string, metric string, pos bigint",
    )
    piv = metrics_long(df).groupBy("model", "algorithm", "metric").pivot("dataset", datasets).agg(F.first("value"))
    return F.broadcast(grid).join(piv, ["model", "algorithm", "metric"], "left")  # grid: labels only


def times_pivot(df: DataFrame, datasets: list[str]) -> DataFrame:
    """Mean seconds per generation by (model, algorithm), one column per dataset."""
    return df.groupBy("model", "algorithm").pivot("dataset", datasets).agg(F.avg("time_s"))


def round_display(df: DataFrame, cols: list[str], digits: int = 3) -> DataFrame:
    """Rounded text for tables (X5); missing values print as ``NaN``."""
    return df.select(*[
        F.coalesce(F.round(F.col(c), digits).cast("string"), F.lit("NaN")).alias(c) if c in cols else F.col(c)
        for c in df.columns
    ])


def convergence(history: DataFrame, run_id: str) -> DataFrame:
    """Avg / best / worst by generation of one run."""
    return history.where(F.col("run_id") == run_id).select("gen", "avg", "best", "worst").orderBy("gen")


def latest_per(df: DataFrame, keys: list[str]) -> DataFrame:
    """Latest run per key by (started_at, run_id) (Q20).

    A ``max_by`` aggregation (combined map-side), not a window: one
    configuration run many times never lands in one task.
    """
    others = [c for c in df.columns if c not in keys]
    latest = F.max_by(F.struct(*[F.col(c) for c in others]), F.struct("started_at", "run_id"))
    return df.groupBy(*keys).agg(latest.alias("_r")).select(*keys, "_r.*")


def jaccard_overlap(df: DataFrame) -> DataFrame:
    """Overlap of the selected genes of every algorithm pair per (model, dataset).

    One run per (model, dataset, algorithm) is kept first, so each group holds
    at most one row per algorithm and the self-join emits |algorithms|^2 pairs.
    """
    one = latest_per(df, ["model", "dataset", "algorithm"]).select("model", "dataset", "algorithm", "best_genes")
    a = one.select("model", "dataset", F.col("algorithm").alias("algo1"), F.col("best_genes").alias("g1"))
    b = one.select("model", "dataset", F.col("algorithm").alias("algo2"), F.col("best_genes").alias("g2"))
    return a.join(b, ["model", "dataset"]).select(
        "model", "dataset", "algo1", "algo2", bits.jaccard_overlap(F.col("g1"), F.col("g2")).alias("overlap")
    )


def jaccard_matrix(overlap: DataFrame, algorithms: list[str]) -> DataFrame:
    """Square matrix per (model, dataset): rows algo1, one column per algo2; missing pairs null."""
    return overlap.groupBy("model", "dataset", "algo1").pivot("algo2", list(algorithms)).agg(F.first("overlap"))


def decode_genes(text) -> F.Column:
    """Chromosome from stored text: a bit string ``0110`` or numpy's ``[0 1 1 0]`` (X4); never ``eval``."""
    t = F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"[\[\]\s,]", "")
    return bits.from_bitstring(t)
