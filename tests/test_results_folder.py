"""Reading result folders in the reference's CSV layout."""

import csv
import os

from featsearch.plans import report as R
from featsearch.sources.results_folder import read_results

CONFIG_HEADER = ["dataset", "crossover_choice", "mutation_rate", "metric_choice", "population_size", "elitism",
                 "evolution_rounds", "stopping_threshold", "model", "algorithm", "backend_prefer"]


def _write(path, header, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)


def test_read_reference_layout(spark, tmp_path):
    root = str(tmp_path / "results")
    a, b = "01.02.2024_10.11.12.123456", "01.02.2024_11.00.00.000001"
    _write(f"{root}/{a}/config.csv", CONFIG_HEADER,
           [["gina_agnostic", "onepoint", 0.2, "f1", 150, 2, 150, 0.99999, "mlp", "ga_joblib", "processes"]])
    _write(f"{root}/{a}/benchmark.csv", ["Gen", "Time", "Avg", "Best", "Worst", "Best Chromosome"],
           [[0, 1.5, 0.5, 0.6, 0.4, "[0 1 1\n 0]"], [1, 1.7, 0.55, 0.58, 0.5, "[1 1 1\n 0]"]])
    _write(f"{root}/{a}/test_metrics.csv", ["F1", "Accuracy", "ROC AUC", "Best Chromosome"],
           [[0.61, 0.7, 0.65, "[1 1 1\n 0]"]])
    _write(f"{root}/{b}/config.csv", CONFIG_HEADER,
           [["gina_agnostic", "onepoint", 0.2, "f1", 150, 2, 150, 0.99999, "mlp", "rfs", "processes"]])
    c, h, t = read_results(spark, root)
    assert c.count() == 2 and c.where("run_id = '%s'" % a).first()["started_at"].year == 2024
    hist = {r["gen"]: r for r in h.collect()}
    assert hist[0]["best_genes"] == [0, 1, 1, 0] and hist[1]["best_so_far"] == 0.6
    assert t.first()["best_genes"] == [1, 1, 1, 0]
    comp = R.compiled(c, h, t).first()
    assert comp["run_id"] == a and comp["best"] == 0.58 and comp["last_gen"] == 1 and abs(comp["time_s"] - 1.6) < 1e-12
    ph = R.with_placeholders(c, h, t).where("algorithm = 'rfs'").first()
    assert ph["run_id"] == b and ph["f1"] is None

    from featsearch.compile import compile_store

    counts = compile_store(spark, None, str(tmp_path / "out"), results_root=root)
    assert counts["runs"] == 2 and counts["convergence"] == 2
