"""Benchmark the headline operators; prints ONE JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Workload follows the reference's full grid: population 150, elitism 2,
mutation 0.2, one-point crossover, F1; random search runs its 151 rounds as
one scoring pass. Times are wall-clock seconds, warm session.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from featsearch.config import SearchConfig  # noqa: E402
from featsearch.operators import fitness, population as popops  # noqa: E402
from featsearch.operators import models  # noqa: E402
from featsearch.plans import search  # noqa: E402
from featsearch.session import checkpoint_dir, local_session  # noqa: E402
from featsearch.sources import abt as A  # noqa: E402


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="featsearch-bench")
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark, tempfile.mkdtemp(prefix="featsearch-bench-"))
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.time()
        out = fn()
        times[name] = round(time.time() - t0, 3)
        return out

    # warm-up: JVM, Python workers, package shipping
    warm = A.load(spark, sf_dir, "orders")
    fitness.score(warm.df, popops.init(spark, 4, warm.d), models.get("centroid"), "f1").collect()

    li = timed("abt_lineitem", lambda: A.load(spark, sf_dir, "lineitem", path=search.shared_path(spark, "abt")))
    cen = models.get("centroid")
    timed("train_stats", lambda: cen.means(li.df))
    pop = popops.init(spark, 150, li.d)
    timed("fitness_p150", lambda: fitness.score(li.df, pop, cen, "f1").collect())

    def ga():
        cfg = SearchConfig(dataset="lineitem", algorithm="ga", model="centroid", metric="f1", population_size=150,
                           max_generation=4, stopping_threshold=0.99999)
        base = search.baseline(li, cen, "f1")
        return search.genetic(li, cfg, cen, base)

    res = timed("ga_5_generations", ga)
    times["ga_sec_per_generation"] = round(times["ga_5_generations"] / max(len(res.history), 1), 3)
    # share of fits the score cache saved (elites, unchanged mutants, duplicates)
    times["ga_cache_saved_fraction"] = round(1 - res.scored / (150 * max(len(res.history), 1)), 3)

    def rnd():
        cfg = SearchConfig(dataset="lineitem", algorithm="random", model="centroid", metric="f1",
                           population_size=150, max_generation=150, stopping_threshold=0.99999)
        return search.random_plan(li, cfg, cen, None).collect()

    timed("random_151x150", rnd)

    def rfs():
        cfg = SearchConfig(dataset="lineitem", algorithm="rfs", model="centroid", metric="f1")
        return search.forward_selection(li, cfg, cen, {"val": None})

    timed("forward_selection", rfs)

    def rfs_logistic():
        cfg = SearchConfig(dataset="lineitem", algorithm="rfs", model="logistic", metric="f1")
        return search.forward_selection(li, cfg, models.get("logistic"), {"val": None})

    timed("forward_selection_logistic", rfs_logistic)

    def docs():
        d = A.load(spark, sf_dir, "documents")
        return search.baseline(d, models.get("centroid"), "f1")

    timed("documents_abt_baseline", docs)

    def logistic():
        e = A.load(spark, sf_dir, "embeddings")
        m = models.get("logistic")
        return fitness.score(e.df, popops.init(spark, 150, e.d), m, "f1").collect()

    timed("logistic_p150_embeddings", logistic)  # d = 64: batched L-BFGS

    def logistic_li():
        m = models.get("logistic")  # d = 9: batched Newton over 420k train rows
        out = fitness.score(li.df, pop, m, "f1").collect()
        times["logistic_lineitem_passes"] = m.iterations
        return out

    timed("logistic_p150_lineitem", logistic_li)

    def mllib_per_chromosome():
        """The reference's shape: one library fit per chromosome (3 of them, MLlib)."""
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorSlicer
        from pyspark.ml.functions import array_to_vector
        from pyspark.sql import functions as F

        tr = li.df.where("split = 'train'").select(F.col("y").cast("double").alias("label"),
                                                   array_to_vector("features").alias("fv"))
        n = tr.count()
        for genes in popops.to_matrix(pop)[1][:3]:
            idx = [int(i) for i, b in enumerate(genes) if b]
            sub = VectorSlicer(inputCol="fv", outputCol="features", indices=idx).transform(tr)
            LogisticRegression(regParam=1.0 / n, standardization=False).fit(sub).summary.accuracy

    timed("mllib_logistic_3_fits", mllib_per_chromosome)
    times["batched_logistic_speedup_vs_per_chromosome"] = round(
        times["mllib_logistic_3_fits"] / 3 * 150 / times["logistic_p150_lineitem"], 1
    )

    derived = ("ga_sec_per_generation", "logistic_lineitem_passes", "ga_cache_saved_fraction",
               "mllib_logistic_3_fits", "batched_logistic_speedup_vs_per_chromosome")
    headline = [k for k in times if k not in derived]
    total = round(sum(times[k] for k in headline), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_sec", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
