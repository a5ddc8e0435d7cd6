"""Compile runs into the comparison tables: ``python -m featsearch.compile``.

Input: a run store (``--store``) or a results folder in the reference's CSV
layout (``--results``, read with one glob per table).

Writes, under ``--out`` (CSV, one folder per table):

* ``runs``          every complete run: config + test metrics + history summary,
                    plus unfinished forward-selection runs with null metrics
* ``metrics``       mean F1 / accuracy / ROC AUC by (model, algorithm, metric),
                    one column per dataset, rounded for display
* ``times``         mean seconds per generation, same layout
* ``overlap``       Jaccard overlap of selected genes, per (model, dataset)
* ``convergence``   avg / best / worst by generation of every genetic run
* ``duplicates``    repeated result rows
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from featsearch.functions.bits import bitstring
from featsearch.plans import report as R
from featsearch.sources.store import RunStore


def compile_store(spark: SparkSession, store_root: str | None, out: str, backend: str | None = "processes",
                  results_root: str | None = None) -> dict:
    """Tables from a run store, or from a results folder in the reference's layout."""
    if results_root:
        from featsearch.sources.results_folder import read_results

        c, h, t = read_results(spark, results_root)
    else:
        store = RunStore(spark, store_root)
        c, h, t = store.configs(), store.history(), store.test_metrics()
    if backend:
        c = c.where(F.col("backend") == backend)
    runs = R.with_placeholders(c, h, t)
    comp = R.compiled(c, h, t)
    datasets = sorted(r[0] for r in comp.select("dataset").distinct().collect())
    algorithms = R.in_order((r[0] for r in comp.select("algorithm").distinct().collect()), R.ALGORITHM_ORDER)
    tables = {
        "runs": runs.withColumn("best_genes", bitstring(F.col("best_genes"))),
        "metrics": R.round_display(
            R.metrics_pivot(comp, datasets).withColumn("algorithm", R.display_name("algorithm")), datasets
        ).orderBy("pos"),
        "times": R.round_display(R.times_pivot(comp, datasets).withColumn("algorithm", R.display_name("algorithm")),
                                 datasets),
        "overlap": R.jaccard_matrix(R.jaccard_overlap(comp), algorithms),
        "convergence": h.join(c.where(F.col("algorithm").isin("ga", "ga_seq", "ga_joblib", "ga_spark")), "run_id",
                              "left_semi").select("run_id", "gen", "avg", "best", "worst").orderBy("run_id", "gen"),
        "duplicates": R.duplicate_runs(comp).withColumn("best_genes", bitstring(F.col("best_genes"))),
    }
    counts = {}
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(os.path.join(out, name))
        counts[name] = spark.read.option("header", True).csv(os.path.join(out, name)).count()
    return counts


def main(argv=None):
    p = argparse.ArgumentParser(prog="featsearch.compile")
    src = p.add_mutually_exclusive_group(required=True)
    src.add_argument("--store", help="run store root")
    src.add_argument("--results", help="results folder in the reference's CSV layout")
    p.add_argument("--out", required=True)
    p.add_argument("--backend", default="processes", help="keep runs of this backend ('' for all)")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("featsearch-compile").getOrCreate()
    print(compile_store(spark, a.store, a.out, a.backend or None, results_root=a.results))


if __name__ == "__main__":
    main()
