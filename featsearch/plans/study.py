"""A small experiment study over the given tables, and its SQL twin.

The Spark side runs real experiments through :mod:`featsearch.plans.search`
into a :class:`~featsearch.sources.store.RunStore` in the shared checkpoint
folder; reports then read that store. The SQL side recomputes the same runs
from the raw tables, so every report column except run ids and wall-clock
times is checked value for value.

Runs: for each dataset, baseline, random search, genetic search and forward
selection with the centroid model; plus one repeated baseline (a duplicate)
and one forward-selection run whose config was written but which never
finished (as the reference's timed-out runs).
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

from featsearch.config import SearchConfig
from featsearch.operators import split
from featsearch.plans import search
from featsearch.plans import sqltwin as T
from featsearch.session import checkpoint_dir, ship_package
from featsearch.sources import abt as A
from featsearch.sources.store import RunStore

# Study configuration: small rounds of this study's own, so that its SQL twin stays readable.
DATASETS = ("embeddings", "orders", "lineitem")  # widths fixed by schema: 64, 7, 9
ALGORITHMS = ("baseline_metrics", "random", "ga", "rfs")
POP = 10
RANDOM_ROUNDS = 2  # rounds 0..2
GA_ROUNDS = 1  # generations 0..1
SEED = 0
METRIC = "f1"
MODEL = "centroid"

_STORES: dict = {}


def configs():
    out = []
    for ds in DATASETS:
        for alg in ALGORITHMS:
            rounds = RANDOM_ROUNDS if alg == "random" else GA_ROUNDS
            out.append(SearchConfig(dataset=ds, algorithm=alg, model=MODEL, metric=METRIC, population_size=POP,
                                    max_generation=rounds, stopping_threshold=0.99999, seed=SEED))
    out.append(SearchConfig(dataset="embeddings", algorithm="baseline_metrics", model=MODEL, metric=METRIC,
                            population_size=POP, max_generation=GA_ROUNDS, stopping_threshold=0.99999, seed=SEED))
    return out


def run_study(spark: SparkSession, sf_dir: str) -> RunStore:
    """Run the study once per application and data folder; returns its store.

    The datasets run side by side, the runs of one in their order: the planning
    and the small passes of one overlap with the long passes of another.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _STORES:
        return _STORES[key]
    root = f"{checkpoint_dir(spark).rstrip('/')}/study-{uuid.uuid4().hex[:12]}"
    store = RunStore(spark, root)
    ship_package(spark)
    runs: dict = {}
    for cfg in configs():
        runs.setdefault(cfg.dataset, []).append(cfg)

    def of_dataset(name: str) -> None:
        abt = A.load(spark, sf_dir, name, SEED, path=search.shared_path(spark, "abt"))
        for cfg in runs[name]:
            search.run(spark, abt, cfg, store)

    with ThreadPoolExecutor(max_workers=len(runs)) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(of_dataset), name) for name in runs]:
            done.result()
    unfinished = SearchConfig(dataset="orders", algorithm="rfs", model="logistic", metric=METRIC,
                              population_size=POP, max_generation=GA_ROUNDS, seed=SEED)
    store.write_config(unfinished)  # started, never finished: config only
    _STORES[key] = store
    return store


# ------------------------------------------------------------------ SQL twin


def sql_study(q: T.Sql) -> dict[str, str]:
    """Define ``st_runs(dataset, algorithm, model, backend, f1, accuracy, roc_auc,
    genes, avg, best, worst, last_gen, complete)`` and ``st_hist`` CTEs."""
    from featsearch.functions.metrics import metric_sql

    runs, hists = [], []

    def test_row(ds, alg, pop_best, p, summary_sql):
        c = T.centroid_conf(q, f"{p}_{alg}_t{len(runs)}", p, pop_best, "test")
        runs.append(
            f"SELECT '{ds}' AS dataset, '{alg}' AS algorithm, '{MODEL}' AS model, {metric_sql('f1')} AS f1, "
            f"{metric_sql('accuracy')} AS accuracy, {metric_sql('roc_auc')} AS roc_auc, k.genes, s.avg, s.best, "
            f"s.worst, s.last_gen FROM {c}, {T.packed(pop_best)} k, ({summary_sql}) s"
        )

    for ds in DATASETS:
        p = T.abt(q, ds)
        d = T.n_genes(p)
        # baseline
        ones = q.add(f"{p}_ones", f"SELECT CAST(0 AS BIGINT) AS chrom_id, gene, 1 AS bit FROM {T.genes_of(q, p)}")
        bc = T.centroid_conf(q, f"{p}_bv", p, ones, "val")
        bs = T.scored(q, f"{p}_bs", bc, ones, METRIC)
        hists.append(f"SELECT '{ds}' AS dataset, 'baseline_metrics' AS algorithm, 0 AS gen, score AS avg, score AS best, score AS worst FROM {bs}")
        copies = 2 if ds == "embeddings" else 1  # the repeated baseline run
        for _ in range(copies):
            test_row(ds, "baseline_metrics", ones, p,
                     f"SELECT score AS avg, score AS best, score AS worst, 0 AS last_gen FROM {bs}")
        # random search: rounds 0..R, one population
        n, r = POP, RANDOM_ROUNDS + 1
        rp = T.population_init(q, f"{p}_rp", p, n * r, SEED, 0, "random")
        rc = T.centroid_conf(q, f"{p}_rc", p, rp)
        rs = T.scored(q, f"{p}_rs", rc, rp, METRIC)
        q.add(f"{p}_rg", f"SELECT *, chrom_id // {n} AS gen, row_number() OVER (PARTITION BY chrom_id // {n} "
                         f"ORDER BY score DESC NULLS LAST, chrom_id) AS r FROM {rs}")
        q.add(f"{p}_rh", f"SELECT gen, avg(score) AS avg, max(score) AS best, min(score) AS worst, "
                         f"any_value(CASE WHEN r = 1 THEN chrom_id END) AS best_id FROM {p}_rg GROUP BY gen")
        hists.append(f"SELECT '{ds}', 'random', gen, avg, best, worst FROM {p}_rh")
        rb = T.single(q, f"{p}_rb", rp, f"SELECT best_id FROM {p}_rh ORDER BY best DESC NULLS LAST, gen LIMIT 1")
        test_row(ds, "random", rb, p, f"SELECT avg, best, worst, gen AS last_gen FROM {p}_rh WHERE gen = {r - 1}")
        # genetic: generations 0..G
        pop = T.population_init(q, f"{p}_g0", p, POP, SEED)
        nn = POP
        for g in range(GA_ROUNDS + 1):
            gc = T.centroid_conf(q, f"{p}_gc{g}", p, pop)
            gs = T.scored(q, f"{p}_gs{g}", gc, pop, METRIC)
            hists.append(f"SELECT '{ds}', 'ga', {g}, avg(score), max(score), min(score) FROM {gs}")
            if g < GA_ROUNDS:
                pop_next = T.next_generation(q, f"{p}_g{g + 1}", gs, pop, nn, d, g + 1, SEED, "onepoint", 0.2, 2)
                last_sc, last_pop = gs, pop
                pop = pop_next
                nn = 2 * (nn // 2)
            else:
                last_sc, last_pop = gs, pop
        grk = T.ranked(q, f"{p}_grk", last_sc)
        gb = T.single(q, f"{p}_gb", last_pop, f"SELECT chrom_id FROM {grk} WHERE rank = 1")
        test_row(ds, "ga", gb, p, f"SELECT avg(score) AS avg, max(score) AS best, min(score) AS worst, "
                                  f"{GA_ROUNDS} AS last_gen FROM {last_sc}")
        # forward selection: half of the genes, 5-fold CV accuracy, rescored on val
        sel = _sql_forward(q, p, ds)
        fpop = q.add(f"{p}_fp", f"SELECT CAST(0 AS BIGINT) AS chrom_id, g.gene, "
                                f"CASE WHEN g.gene IN (SELECT gene FROM {sel}) THEN 1 ELSE 0 END AS bit FROM {T.genes_of(q, p)} g")
        fc = T.centroid_conf(q, f"{p}_fv", p, fpop, "val")
        fs = T.scored(q, f"{p}_fs", fc, fpop, METRIC)
        hists.append(f"SELECT '{ds}', 'rfs', 0, score, score, score FROM {fs}")
        test_row(ds, "rfs", fpop, p, f"SELECT score AS avg, score AS best, score AS worst, 0 AS last_gen FROM {fs}")
    q.add("st_runs", "\nUNION ALL ".join(runs))
    q.add("st_hist", "\nUNION ALL ".join(hists))
    return {"runs": "st_runs", "hist": "st_hist"}


def _sql_forward(q: T.Sql, p: str, ds: str) -> str:
    q.add(f"{p}_trr", f"SELECT DISTINCT row_id, y FROM {p}_q WHERE split = 'train'")
    q.add(f"{p}_fold", split.fold_sql(f"{p}_trr", 5, SEED))
    q.add(f"{p}_trf", f"SELECT r.row_id, r.y, r.gene, r.q, f.fold FROM {p}_q r JOIN {p}_fold f ON r.row_id = f.row_id WHERE r.split = 'train'")
    q.add(f"{p}_fsum", f"SELECT y, fold, gene, sum(q) AS s, count(*) AS n FROM {p}_trf GROUP BY y, fold, gene")
    q.add(f"{p}_ftot", f"SELECT y, gene, sum(s) AS st, sum(n) AS nt FROM {p}_fsum GROUP BY y, gene")
    q.add(f"{p}_fm", f"""SELECT f.fold, f.gene,
  max(CASE WHEN f.y = 0 THEN CAST(floor((t.st - f.s) / (t.nt - f.n)) AS BIGINT) END) AS m0,
  max(CASE WHEN f.y = 1 THEN CAST(floor((t.st - f.s) / (t.nt - f.n)) AS BIGINT) END) AS m1
FROM {p}_fsum f JOIN {p}_ftot t ON f.y = t.y AND f.gene = t.gene GROUP BY f.fold, f.gene""")
    q.add(f"{p}_cc", f"""SELECT r.row_id, r.y, r.fold, r.gene,
  (r.q - m.m1) * (r.q - m.m1) - (r.q - m.m0) * (r.q - m.m0) AS c
FROM {p}_trf r JOIN {p}_fm m ON r.fold = m.fold AND r.gene = m.gene""")
    sel = q.add(f"{p}_sel0", "SELECT CAST(NULL AS BIGINT) AS gene WHERE false")
    picks = []
    n_rounds = {"embeddings": 64, "orders": 7, "lineitem": 9}[ds] // 2  # half of the width
    for k in range(n_rounds):
        q.add(f"{p}_r{k}b", f"SELECT row_id, sum(c) AS b FROM {p}_cc WHERE gene IN (SELECT gene FROM {sel}) GROUP BY row_id")
        q.add(f"{p}_r{k}a", f"""SELECT cc.gene AS cand, cc.fold,
  CAST(sum(CASE WHEN (coalesce(b.b, 0) + cc.c < 0) = (cc.y = 1) THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS acc
FROM {p}_cc cc LEFT JOIN {p}_r{k}b b ON cc.row_id = b.row_id
WHERE cc.gene NOT IN (SELECT gene FROM {sel}) GROUP BY cc.gene, cc.fold""")
        folds = " + ".join(f"max(CASE WHEN fold = {f} THEN acc END)" for f in range(5))
        picks.append(q.add(f"{p}_pk{k}", f"SELECT cand AS gene FROM (SELECT cand, ({folds}) / 5 AS cv FROM {p}_r{k}a "
                                         f"GROUP BY cand) ORDER BY cv DESC, cand ASC LIMIT 1"))
        sel = q.add(f"{p}_sel{k + 1}", " UNION ALL ".join(f"SELECT gene FROM {x}" for x in picks))
    return sel
