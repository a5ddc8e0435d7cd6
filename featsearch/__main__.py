"""Job entry point: ``spark-submit -m featsearch`` or ``python -m featsearch``.

Options mirror the reference's command line (same names, same defaults);
the dataset is a fixture name over a table folder, or a Parquet/CSV path with
a label column. Results are appended to a run store.

    python -m featsearch --tables /root/testdata/sf0.01 --dataset lineitem \\
        --algorithm ga_spark --model centroid --metric_choice f1 --store /shared/runs
    python -m featsearch --input data.parquet --label_col label --dataset mydata ...
"""

from __future__ import annotations

import argparse
import json

from featsearch.config import SearchConfig


def parse(argv=None):
    d = SearchConfig()
    p = argparse.ArgumentParser(prog="featsearch", formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    p.add_argument("--dataset", default=d.dataset, help="fixture name, or a name for --input")
    p.add_argument("--tables", default=None, help="folder of <table>.parquet for fixture datasets")
    p.add_argument("--input", default=None, help="Parquet or CSV path of a labelled dataset")
    p.add_argument("--label_col", default="label")
    p.add_argument("--id_col", default=None)
    p.add_argument("--positive", default=None, help="positive class (binarises multi-class labels)")
    p.add_argument("--drop_cols", default="", help="comma-separated columns to drop")
    p.add_argument("--fill_value", type=float, default=None, help="value for null numeric features")
    p.add_argument("--crossover_choice", default=d.crossover)
    p.add_argument("--mutation_rate", type=float, default=d.mutation_rate)
    p.add_argument("--metric_choice", default=d.metric)
    p.add_argument("--population_size", type=int, default=d.population_size)
    p.add_argument("--elitism", type=int, default=d.elitism)
    p.add_argument("--evolution_rounds", type=int, default=d.max_generation)
    p.add_argument("--stopping_threshold", type=float, default=d.stopping_threshold)
    p.add_argument("--model", default=d.model)
    p.add_argument("--algorithm", default=d.algorithm)
    p.add_argument("--backend_prefer", default=d.backend)
    p.add_argument("--seed", type=int, default=d.seed)
    p.add_argument("--store", required=True, help="run store root (shared storage on a cluster)")
    return p.parse_args(argv)


def main(argv=None):
    from pyspark.sql import SparkSession

    from featsearch.plans import search
    from featsearch.sources import abt as A
    from featsearch.sources.store import RunStore

    a = parse(argv)
    cfg = SearchConfig(dataset=a.dataset, crossover=a.crossover_choice, mutation_rate=a.mutation_rate,
                       metric=a.metric_choice, population_size=a.population_size, elitism=a.elitism,
                       max_generation=a.evolution_rounds, stopping_threshold=a.stopping_threshold, model=a.model,
                       algorithm=a.algorithm, backend=a.backend_prefer, seed=a.seed).validate()
    spark = SparkSession.builder.appName(f"featsearch-{cfg.run_id}").getOrCreate()
    from featsearch.session import apply_cluster_conf

    apply_cluster_conf(spark)
    if a.input:
        reader = spark.read.option("header", True).option("inferSchema", True)
        df = reader.csv(a.input) if a.input.endswith(".csv") else spark.read.parquet(a.input)
        raw, names = A.prepare(df, a.label_col, id_col=a.id_col, positive=a.positive,
                               drop_cols=[c for c in a.drop_cols.split(",") if c], fill_value=a.fill_value)
        abt = A.build(raw, names, seed=cfg.seed, path=search.shared_path(spark, "abt"))
    else:
        abt = A.load(spark, a.tables, a.dataset, cfg.seed, path=search.shared_path(spark, "abt"))
    res = search.run(spark, abt, cfg, RunStore(spark, a.store))
    print(json.dumps({"run_id": cfg.run_id, "status": res.status, "generations": len(res.history),
                      "best_genes": "".join(map(str, res.best_genes)), "test": res.test}))


if __name__ == "__main__":
    main()
