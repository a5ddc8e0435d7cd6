"""Experiment grid (A10, F12): every combination of the option lists.

Each option list is exploded in turn (a generator, not a join), then the
invalid combinations are pruned: the thread backend applies only to the
process-pool genetic search. ``run_grid`` executes the rows within one
Spark application, several at a time, appending to one run store.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featsearch.config import SearchConfig
from featsearch.plans import search
from featsearch.plans.search import SearchResult
from featsearch.session import checkpoint_dir, ship_package

# The reference's full grid (fixed values).
FULL_GRID = {
    "model": ["logistic", "mlp", "xgboost"],
    "dataset": ["gina_agnostic", "hiva_agnostic", "sylva_agnostic"],
    "algorithm": ["baseline_metrics", "ga_seq", "ga_joblib", "random", "rfs", "ga_spark"],
    "metric": ["f1"],
    "crossover": ["onepoint"],
    "population_size": [150],
    "elitism": [2],
    "mutation_rate": [0.2],
    "max_generation": [150],
    "backend": ["processes"],
    "stopping_threshold": [0.99999],
}


def grid(spark: SparkSession, options: dict) -> DataFrame:
    df = spark.range(1).select()
    for name, values in options.items():
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return df.where(~((F.col("algorithm") != "ga_joblib") & (F.col("backend") == "threads")))


def configs(df: DataFrame, **fixed) -> list[SearchConfig]:
    """Grid rows as validated configs (the grid is bounded by its option lists)."""
    return [SearchConfig(**{**r.asDict(), **fixed}).validate() for r in df.collect()]


@dataclass
class GridRun:
    """One grid row: its result, or the error that ended it."""

    config: SearchConfig
    result: SearchResult | None = None
    error: Exception | None = None
    skipped: bool = False  # a complete run of the same options was in the store


#: Options that tell grid rows apart in a run store.
OPTIONS = ("dataset", "algorithm", "model", "metric", "crossover", "mutation_rate", "population_size", "elitism",
           "max_generation", "stopping_threshold", "backend", "seed")


def _stored(store) -> dict:
    """Options -> ``(complete, run_id)`` of the runs of a store, a complete one
    first, else the latest (a row per run)."""
    done = store.test_metrics().select("run_id").distinct().withColumn("complete", F.lit(True))
    runs = store.configs().join(done, "run_id", "left").select("run_id", "started_at", *OPTIONS, F.coalesce("complete", F.lit(False)).alias("complete"))
    out: dict = {}
    for r in sorted(runs.collect(), key=lambda r: (r["complete"], r["started_at"])):
        out[tuple(r[o] for o in OPTIONS)] = (r["complete"], r["run_id"])
    return out


def run_grid(spark: SparkSession, abts: dict, df: DataFrame, store, workers: int = 4, scores=None, **fixed) -> list[GridRun]:
    """Run every grid row on its dataset in ``abts`` (name -> prepared ABT, best
    written once with ``abt.load(path=)``, since all its runs share it).

    ``workers`` rows run at a time, each in its own scheduler pool and job group
    (``spark.scheduler.mode=FAIR`` shares the executors between them), so the
    driver-side steps of one overlap with the passes of others. A row that fails
    is reported in its ``GridRun`` and does not stop the rest. A grid that runs
    again on its store skips complete rows and resumes genetic ones. Raises
    before the first run if a dataset of the grid is not prepared.
    """
    rows = configs(df, **fixed)
    missing = sorted({c.dataset for c in rows} - set(abts))
    if missing:
        raise ValueError(f"datasets of the grid are not prepared: {', '.join(missing)}")
    checkpoint_dir(spark)
    ship_package(spark)
    stored = _stored(store) if store is not None and store.exists() else {}

    def one(i: int) -> GridRun:
        cfg = rows[i]
        complete, run_id = stored.get(tuple(getattr(cfg, o) for o in OPTIONS), (False, None))
        if complete:
            return GridRun(cfg, skipped=True)
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"grid-{i % workers}")
        spark.sparkContext.setJobGroup(run_id or cfg.run_id, f"{cfg.model} {cfg.dataset} {cfg.algorithm}", True)
        try:
            if run_id is not None and cfg.search == "ga":
                return GridRun(cfg, search.resume(spark, abts[cfg.dataset], store, run_id, scores=scores))
            return GridRun(cfg, search.run(spark, abts[cfg.dataset], cfg, store, scores=scores))
        except Exception as e:  # one row's failure is its own result
            return GridRun(cfg, error=e)

    with ThreadPoolExecutor(max_workers=workers) as pool:
        return list(pool.map(inheritable_thread_target(spark)(one), range(len(rows))))
