"""The job entry point with the reference's option names."""

import json

from featsearch.__main__ import main, parse
from featsearch.sources.store import RunStore
from conftest import SF001


def test_defaults_mirror_reference_options():
    a = parse(["--store", "/x"])
    assert (a.crossover_choice, a.mutation_rate, a.metric_choice, a.population_size, a.elitism,
            a.evolution_rounds, a.stopping_threshold, a.model, a.algorithm) == (
        "onepoint", 0.2, "accuracy", 200, 2, 15, 0.99, "logistic", "ga_joblib")


def test_run_from_input_file(spark, tmp_path, capsys):
    src = spark.read.parquet(f"{SF001}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderpriority",
                                                                 "o_orderstatus")
    path = str(tmp_path / "orders_in.parquet")
    src.write.parquet(path)
    store = str(tmp_path / "runs")
    main(["--input", path, "--label_col", "o_orderstatus", "--positive", "F", "--id_col", "o_orderkey",
          "--dataset", "orders_file", "--algorithm", "ga_spark", "--model", "centroid", "--metric_choice", "f1",
          "--population_size", "6", "--evolution_rounds", "1", "--store", store])
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["status"] == "done" and out["generations"] == 2
    assert RunStore(spark, store).history().count() == 2


def test_compile_store(spark, tmp_path):
    from featsearch.compile import compile_store
    from featsearch.config import SearchConfig
    from featsearch.plans import search
    from featsearch.sources import abt as A

    ab = A.load(spark, SF001, "orders", path=str(tmp_path / "abt"))
    store = RunStore(spark, str(tmp_path / "runs"))
    for alg in ("baseline_metrics", "ga_spark", "random"):
        search.run(spark, ab, SearchConfig(dataset="orders", algorithm=alg, model="centroid", metric="f1",
                                           population_size=6, max_generation=1), store)
    store.write_config(SearchConfig(dataset="orders", algorithm="rfs", model="centroid"))
    counts = compile_store(spark, store.root, str(tmp_path / "out"))
    assert counts["runs"] == 4 and counts["metrics"] == 9 and counts["convergence"] == 2
    assert counts["overlap"] == 3 and counts["duplicates"] == 0
