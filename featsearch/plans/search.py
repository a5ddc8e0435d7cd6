"""Search drivers (A1-A7): baseline, genetic, random and forward selection.

The data never leaves the executors: each generation is one scoring pass
over the partitioned ABT, and only the population's ``P`` score rows come
back to the driver for the stop test and the history row. Breeding is a
Spark plan over those ``P`` rows (the same plan the SQL oracle checks).
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featsearch.config import SearchConfig
from featsearch.functions import metrics
from featsearch.operators import fitness
from featsearch.operators import models as model_registry
from featsearch.operators import population as popops
from featsearch.session import checkpoint_dir
from featsearch.sources.abt import Abt
from featsearch.sources.scores import fingerprint, model_key


@dataclass
class SearchResult:
    config: SearchConfig
    history: list[dict] = field(default_factory=list)
    best_genes: list[int] | None = None
    best_ever_genes: list[int] | None = None
    test: dict = field(default_factory=dict)
    baseline: dict = field(default_factory=dict)
    status: str = "done"
    scored: int = 0  # distinct chromosomes actually fitted


def materialize(abt: Abt, spark: SparkSession, tag: str = "abt") -> Abt:
    """Write the ABT into the shared checkpoint folder, partitioned by split.

    Later passes read only the split they need (partition pruning), and a
    lost executor re-reads files instead of recomputing the preparation.
    """
    path = f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"
    df = abt.df
    par = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < par:  # small inputs only: give every core a slice
        df = df.repartition(par)
    df.write.partitionBy("split").parquet(path)
    df = spark.read.parquet(path).select("row_id", "y", "split", "features")
    return Abt(df, abt.names, abt.means, abt.sds)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


def summarize(rows: list, gen: int, seconds: float) -> dict:
    """History row of one generation: mean / max / min and argmax (first on ties)."""
    scores = [r["score"] for r in rows if r["score"] is not None]
    ordered = sorted(rows, key=lambda r: (r["score"] is None, -(r["score"] or 0.0), r["chrom_id"]))
    best = ordered[0]
    return {
        "gen": gen,
        "time_s": seconds,
        "avg": float(np.mean(scores)) if scores else None,
        "best": max(scores) if scores else None,
        "worst": min(scores) if scores else None,
        "best_genes": list(best["genes"]),
    }


def test_metrics(abt: Abt, model, genes: list[int]) -> dict:
    """Refit on train, all three metrics on test (M7)."""
    spark = abt.df.sparkSession
    pop = popops.from_rows(spark, [(0, list(genes))])
    conf = fitness.confusion(abt.df, pop, model, ("test",)).collect()
    if sum(genes) == 0 or not conf:
        return {"f1": None, "accuracy": None, "roc_auc": None}
    c = conf[0]
    return _metrics_of(c["tp"], c["fp"], c["fn"], c["tn"])


def _metrics_of(tp, fp, fn, tn) -> dict:
    den = 2 * tp + fp + fn
    pos, neg = tp + fn, tn + fp
    return {
        "f1": 0.0 if den == 0 else 2 * tp / den,
        "accuracy": (tp + tn) / (tp + fp + fn + tn),
        "roc_auc": None if pos == 0 or neg == 0 else (tp / pos + tn / neg) / 2,
    }


def baseline(abt: Abt, model, metric: str) -> dict:
    """All-features fit scored on val and test in one pass (M6)."""
    spark = abt.df.sparkSession
    t0 = time.time()
    conf = {r["split"]: r for r in fitness.confusion(abt.df, popops.ones(spark, abt.d), model, ("val", "test")).collect()}
    out = {"time_s": time.time() - t0}
    name = metrics.ALIASES.get(metric, metric)
    for s in ("val", "test"):
        c = conf.get(s)
        out[s] = _metrics_of(c["tp"], c["fp"], c["fn"], c["tn"])[name] if c else None
        out[s + "_all"] = _metrics_of(c["tp"], c["fp"], c["fn"], c["tn"]) if c else {}
    return out


def _continues(last_best, next_gen: int, cfg: SearchConfig) -> bool:
    """The stop rule (A5): go on while the last maximum is below the threshold
    and the generation count allows another one."""
    return (last_best is None or last_best < cfg.stopping_threshold) and next_gen <= cfg.max_generation


def genetic(abt: Abt, cfg: SearchConfig, model, base: dict, store=None, start: dict | None = None,
            scores=None) -> SearchResult:
    """Genetic search (A3): score -> history -> breed, until the stop rule (A5).

    With a store, each bred population is appended before the next
    generation starts, so ``resume`` can continue an interrupted run. With a
    ``sources.scores.ScoreTable``, gene sets that any run scored are looked up.
    """
    spark = abt.df.sparkSession
    res = SearchResult(cfg, baseline=base)
    n, d = cfg.population_size, abt.d
    pop = popops.init(spark, n, d, cfg.seed)
    last_max = base["val"]
    best_ever = (None, None)
    gen = 0
    if start:  # resume: population to score at start["gen"], prior history
        pop, gen, res.history = start["pop"], start["gen"], list(start["history"])
        last_max = res.history[-1]["best"] if res.history else last_max
        bests = [(h["best"], h["best_genes"]) for h in res.history if h["best"] is not None]
        for b in bests:
            if best_ever[0] is None or b[0] > best_ever[0]:
                best_ever = b
    cache: dict = {}  # gene set -> confusion counts, bounded by P x generations
    res.scored = 0
    ids = mat = None
    key = (fingerprint(abt.df), model_key(model), "val") if scores is not None else None
    while _continues(last_max, gen, cfg):
        t0 = time.time()
        if ids is None:
            ids, mat = popops.to_matrix(pop)
        if scores is not None:
            unseen = [g for g in np.unique(mat, axis=0) if g.tobytes() not in cache]
            cache.update(scores.known(*key, unseen))
        before = set(cache)
        rows = fitness.score_rows(abt.df, ids, mat, model, cfg.metric, cache=cache)
        fresh = {k: c for k, c in cache.items() if k not in before}
        res.scored += len(fresh)
        if scores is not None:
            scores.add(*key, fresh, d)
        h = summarize(rows, gen, 0.0)
        if _continues(h["best"], gen + 1, cfg):  # breed only when another generation follows
            scored = popops.literal_frame(spark, [r["chrom_id"] for r in rows], [r["genes"] for r in rows],
                                          [r["score"] for r in rows])
            nxt = popops.next_generation(
                scored, len(rows), d, gen + 1, cfg.seed, cfg.crossover, cfg.mutation_rate, cfg.elitism
            )
            ids, mat = popops.to_matrix(nxt)  # this generation's breeding, inside its timed span (Q18)
            if store is not None:
                store.write_population(cfg.run_id, gen + 1, popops.literal_frame(spark, list(ids), list(mat)))
        h["time_s"] = time.time() - t0
        if h["best"] is not None and (best_ever[0] is None or h["best"] > best_ever[0]):
            best_ever = (h["best"], h["best_genes"])
        h["best_so_far"] = best_ever[0]
        res.history.append(h)
        if store is not None:
            store.append_history(cfg.run_id, [h])
        last_max = h["best"]
        gen += 1
    if not res.history:  # Q5: the baseline already meets the threshold
        res.status = "baseline_met"
        res.best_genes = [1] * d
    else:
        res.best_genes = res.history[-1]["best_genes"]  # Q6: last generation's best
    res.best_ever_genes = best_ever[1] or res.best_genes
    return res


# ------------------------------------------------------------------ random search


#: Rounds of a random search that one scoring pass covers.
ROUNDS_PER_PASS = 16


def random_plan(abt: Abt, cfg: SearchConfig, model, baseline_val, rounds: range | None = None) -> DataFrame:
    """Random search as ONE plan (A4, A5, A7): every round's population is
    independent, so all ``(R+1) * P`` candidates are scored in a single pass;
    the stop rule becomes a running maximum over rounds.

    Returns ``gen, avg, best, worst, best_so_far, best_genes`` of the rounds
    the reference's loop would have run.
    """
    spark = abt.df.sparkSession
    n = cfg.population_size
    pop = popops.init(spark, n * (cfg.max_generation + 1), abt.d, cfg.seed, 0, "random")
    if rounds is not None:
        pop = pop.where(F.col("chrom_id").between(rounds.start * n, rounds.stop * n - 1))
    sc = fitness.score(abt.df, pop, model, cfg.metric).withColumn("gen", (F.col("chrom_id") / n).cast("int"))
    w = Window.partitionBy("gen").orderBy(F.col("score").desc_nulls_last(), F.col("chrom_id"))  # P rows per round
    firsts = sc.withColumn("r", F.row_number().over(w)).where("r = 1").select("gen", F.col("genes").alias("best_genes"))
    per = sc.groupBy("gen").agg(
        F.avg("score").alias("avg"), F.max("score").alias("best"), F.min("score").alias("worst")
    ).join(firsts, "gen")
    wr = Window.orderBy("gen")  # one row per round
    per = per.withColumn("best_so_far", F.max("best").over(wr.rowsBetween(Window.unboundedPreceding, 0)))
    per = per.withColumn("prev_max", F.max("best").over(wr.rowsBetween(Window.unboundedPreceding, -1)))
    thr = cfg.stopping_threshold
    if baseline_val is not None and baseline_val >= thr:
        return per.where(F.lit(False)).drop("prev_max")
    return per.where(F.col("prev_max").isNull() | (F.col("prev_max") < thr)).drop("prev_max")


def random_search(abt: Abt, cfg: SearchConfig, model, base: dict, store=None) -> SearchResult:
    """Random search in passes of ``ROUNDS_PER_PASS`` rounds; the pass that
    meets the threshold is the last, and no round is scored if the baseline
    meets it. A round's time is its share of the rounds its pass scored."""
    res = SearchResult(cfg, baseline=base)
    last = base["val"]
    for first in range(0, cfg.max_generation + 1, ROUNDS_PER_PASS):
        if last is not None and last >= cfg.stopping_threshold:
            break
        rounds = range(first, min(first + ROUNDS_PER_PASS, cfg.max_generation + 1))
        t0 = time.time()
        hist = random_plan(abt, cfg, model, None, rounds).orderBy("gen").collect()  # a row per round
        per_round = (time.time() - t0) / len(rounds)
        so_far = res.history[-1]["best_so_far"] if res.history else None
        for r in hist:
            best = [v for v in (so_far, r["best_so_far"]) if v is not None]
            res.history.append({
                "gen": r["gen"], "time_s": per_round, "avg": r["avg"], "best": r["best"], "worst": r["worst"],
                "best_so_far": max(best, default=None), "best_genes": list(r["best_genes"]),
            })
        last = res.history[-1]["best_so_far"] if res.history else last
    if store is not None and res.history:
        store.append_history(cfg.run_id, res.history)
    if not res.history:
        res.status, res.best_genes = "baseline_met", [1] * abt.d
    else:
        top = sorted(res.history, key=lambda h: (h["best"] is None, -(h["best"] or 0.0), h["gen"]))[0]
        res.best_genes = top["best_genes"]  # strictly greater replaces: earliest maximum
    res.best_ever_genes = res.best_genes
    return res


# ------------------------------------------------------------------ forward selection


def forward_selection(abt: Abt, cfg: SearchConfig, model, base: dict, store=None, n_select: int | None = None):
    """Sequential forward selection (A2): half of the features by default,
    ``cv_folds``-fold CV on train, ``cv_metric`` (accuracy, the library default).

    Each round scores every remaining candidate on every fold at once: one
    pass for the centroid model, one optimiser run over all (candidate, fold)
    problems for the logistic model, one fit per pair for MLlib models.
    """
    if not hasattr(model, "cv_confusion"):
        raise NotImplementedError(f"model {model.name!r} has no cross-validation")
    res = SearchResult(cfg, baseline=base)
    d = abt.d
    k = d // 2 if n_select is None else n_select
    selected: list[int] = []
    t0 = time.time()
    steps = []
    for rnd in range(k):
        cands = [g for g in range(d) if g not in selected]
        mat = np.zeros((len(cands), d), dtype=np.int8)
        for i, g in enumerate(cands):
            mat[i, selected + [g]] = 1
        cv = fitness.cv_scores(model, abt.df, np.array(cands, dtype=np.int64), mat, cfg.cv_folds, cfg.seed,
                               cfg.cv_metric)
        best = sorted(cv, key=lambda r: (-r[1], r[0]))[0]
        selected.append(int(best[0]))
        steps.append({"round": rnd, "gene": int(best[0]), "cv_score": best[1]})
    genes = [1 if g in selected else 0 for g in range(d)]
    spark = abt.df.sparkSession
    row = fitness.score(abt.df, popops.from_rows(spark, [(0, genes)]), model, cfg.metric).first()
    h = {"gen": 0, "time_s": time.time() - t0, "avg": row["score"], "best": row["score"], "worst": row["score"],
         "best_so_far": row["score"], "best_genes": genes}
    res.history.append(h)
    if store is not None:
        store.append_history(cfg.run_id, [h])
    res.best_genes = res.best_ever_genes = genes
    res.steps = steps
    return res


# ------------------------------------------------------------------ resume


def resume(spark: SparkSession, abt: Abt, store, run_id: str, model=None, scores=None) -> SearchResult:
    """Continue a genetic run from its last stored generation (driver loss).

    Scoring is deterministic and every draw is keyed by (seed, generation,
    slot), so the continued run equals an uninterrupted one.
    """
    row = store.configs().where(F.col("run_id") == run_id).first()
    if row is None:
        raise ValueError(f"unknown run {run_id!r}")
    fields = {k: row[k] for k in ("dataset", "algorithm", "model", "metric", "crossover", "mutation_rate",
                                  "population_size", "elitism", "max_generation", "stopping_threshold",
                                  "backend", "seed")}
    cfg = SearchConfig(**fields, started_at=row["started_at"], run_id=run_id).validate()
    if cfg.search != "ga":
        raise ValueError("only genetic runs resume; the others are single passes")
    model = model or model_registry.get(cfg.model)
    hist = [r.asDict() for r in store.history().where(F.col("run_id") == run_id).orderBy("gen").collect()]
    pops = store.populations().where(F.col("run_id") == run_id)
    gen = (hist[-1]["gen"] + 1) if hist else 0
    pop = None
    if gen == 0:
        pop = popops.init(spark, cfg.population_size, abt.d, cfg.seed)
    elif _continues(hist[-1]["best"], gen, cfg):  # otherwise the run had already stopped
        pop = pops.where(F.col("gen") == gen).select("chrom_id", "genes")
        if (stored := pop.count()) != cfg.population_size:
            raise ValueError(f"run {run_id!r} has {stored} of {cfg.population_size} chromosomes for generation {gen}")
    base = baseline(abt, model, cfg.metric)
    res = genetic(abt, cfg, model, base, store, start={"pop": pop, "gen": gen, "history": hist}, scores=scores)
    res.best_genes = res.best_genes if res.history else [1] * abt.d
    res.test = test_metrics(abt, model, res.best_genes)
    if store.test_metrics().where(F.col("run_id") == run_id).limit(1).count() == 0:  # once per run
        store.write_test(run_id, {**res.test, "best_genes": res.best_genes, "best_ever_genes": res.best_ever_genes,
                                  "status": res.status})
    return res


# ------------------------------------------------------------------ entry point


def run(spark: SparkSession, abt: Abt, cfg: SearchConfig, store=None, model=None, scores=None) -> SearchResult:
    """One experiment run: config row, search, history rows, test metrics."""
    cfg.validate()
    model = model or model_registry.get(cfg.model)
    if store is not None:
        store.write_config(cfg)
    if hasattr(model, "several_passes"):  # the baseline, the search and the test
        model.several_passes(abt.df)
    base = baseline(abt, model, cfg.metric)
    if cfg.search == "baseline_metrics":
        res = SearchResult(cfg, baseline=base, best_genes=[1] * abt.d, best_ever_genes=[1] * abt.d)
        res.history.append({"gen": 0, "time_s": base["time_s"], "avg": base["val"], "best": base["val"],
                            "worst": base["val"], "best_so_far": base["val"], "best_genes": [1] * abt.d})
        if store is not None:
            store.append_history(cfg.run_id, res.history)
    elif cfg.search == "ga":
        res = genetic(abt, cfg, model, base, store, scores=scores)
    elif cfg.search == "random":
        res = random_search(abt, cfg, model, base, store)
    elif cfg.search == "rfs":
        res = forward_selection(abt, cfg, model, base, store)
    else:  # validate() already refused it
        raise ValueError(cfg.algorithm)
    res.test = test_metrics(abt, model, res.best_genes)
    if store is not None:
        store.write_test(cfg.run_id, {**res.test, "best_genes": res.best_genes,
                                      "best_ever_genes": res.best_ever_genes, "status": res.status})
    return res
