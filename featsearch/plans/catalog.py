"""Registered queries: Spark plans (``SPARK``) and their DuckDB twins (``ORACLE``).

Every query reads the given tables. Chromosomes are reported as bit strings
(``genes``), counts as BIGINT and scores as DOUBLE on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featsearch.functions import bits
from featsearch.functions.rng import u32, u32_sql
from featsearch.operators import encode, fitness, population as popops, scale, sparse, split
from featsearch.operators import models as MODELS
from featsearch.operators.models.centroid import CentroidModel
from featsearch.plans import report as R
from featsearch.plans import search
from featsearch.plans import sqltwin as T
from featsearch.plans import study as ST
from featsearch.sources import abt as A
from featsearch.sources.tables import table

# Search configuration of the reference's full experiment grid (fixed values).
P = 150
ELITISM = 2
RATE = 0.2
CROSSOVER = "onepoint"
METRIC = "f1"
ROUNDS = 150
THRESHOLD = 0.99999
SEED = 0
# Widths of the fixture ABTs, fixed by the table schemas (embedding length;
# 2 numeric + 5 order priorities; 6 numeric + 3 return flags).
EMB_D = 64
ORDERS_D = 7
LINEITEM_D = 9

SPARK: dict = {}
ORACLE: dict = {}


def spark_query(name):
    def deco(fn):
        SPARK[name] = fn
        return fn

    return deco


def oracle(name):
    def deco(fn):
        ORACLE[name] = fn
        return fn

    return deco


def _written(spark, sf, dataset):
    """The ABT written once: every pass of an iterative query reads its split."""
    return A.load(spark, sf, dataset, SEED, path=search.shared_path(spark, "abt"))


def _genes(col="genes"):
    return bits.bitstring(F.col(col)).alias("genes")


# ------------------------------------------------------------------ basics


@spark_query("rng_u32")
def q_rng(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), u32(SEED, "split", F.col("vec_id")).alias("h"))


@oracle("rng_u32")
def o_rng() -> str:
    return f"SELECT vec_id AS row_id, {u32_sql(str(SEED), chr(39) + 'split' + chr(39), 'vec_id')} AS h FROM embeddings"


@spark_query("population_init")
def q_population_init(spark, sf):
    _, _, sc = _scored0(spark, sf, "embeddings")
    return sc.select("chrom_id", _genes(), bits.n_selected(F.col("genes")).alias("n_selected"), "score")


@oracle("population_init")
def o_population_init():
    q = T.Sql()
    _, pop, sc = _o_scored0(q, "embeddings")
    return q.render(
        f"SELECT s.chrom_id, g.genes, CAST(length(replace(g.genes, '0', '')) AS BIGINT) AS n_selected, s.score "
        f"FROM {sc} s JOIN {T.packed(pop)} g ON s.chrom_id = g.chrom_id"
    )


@spark_query("stratified_split")
def q_split(spark, sf):
    raw, _ = A.raw_lineitem(spark, sf)
    from featsearch.operators.split import stratified_split

    return stratified_split(raw.select("row_id", "y"), seed=SEED)


@oracle("stratified_split")
def o_split():
    from featsearch.operators.split import stratified_split_sql

    rows, _ = A.raw_sql("lineitem")
    return f"SELECT row_id, y, split FROM {stratified_split_sql('(' + rows + ')', SEED)}"


@spark_query("scaler_fit")
def q_scaler_fit(spark, sf):
    ab = A.load(spark, sf, "lineitem", SEED)
    rows = [(i, ab.means[i], ab.sds[i]) for i in range(ab.d)]
    return spark.createDataFrame(rows, "gene bigint, mean double, sd double").select(
        "gene", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd")
    )


@oracle("scaler_fit")
def o_scaler_fit():
    q = T.Sql()
    p = T.abt(q, "lineitem")
    return q.render(f"SELECT gene, round(mean, 6) AS mean, round(sd, 6) AS sd FROM {p}_st")


@spark_query("scaler_apply")
def q_scaler_apply(spark, sf):
    ab = A.load(spark, sf, "orders", SEED)
    return ab.df.select(
        "row_id", "split", F.posexplode(scale.quantize(F.col("features"))).alias("gene", "q")
    ).withColumn("gene", F.col("gene").cast("bigint"))


@oracle("scaler_apply")
def o_scaler_apply():
    q = T.Sql()
    p = T.abt(q, "orders")
    return q.render(f"SELECT row_id, split, gene, q FROM {p}_q")


@spark_query("dataset_load")
def q_dataset_load(spark, sf):
    ab = A.load(spark, sf, "documents", SEED)
    return ab.df.select(
        "row_id", "y", "split", F.posexplode(scale.quantize(F.col("features"))).alias("gene", "q")
    ).withColumn("gene", F.col("gene").cast("bigint"))


@oracle("dataset_load")
def o_dataset_load():
    q = T.Sql()
    p = T.abt(q, "documents")
    return q.render(f"SELECT row_id, y, split, gene, q FROM {p}_q")


@spark_query("one_hot_encode")
def q_one_hot(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderpriority")
    wide, names = encode.one_hot(o, ["o_orderpriority"])
    return wide.select(
        "row_id",
        F.posexplode(F.array(*[F.col(f"`{n}`") for n in names])).alias("pos", "v"),
    ).select(
        "row_id",
        F.element_at(F.array(*[F.lit(n) for n in names]), F.col("pos") + 1).alias("feature"),
        "v",
    )


@oracle("one_hot_encode")
def o_one_hot():
    return """SELECT o.o_orderkey AS row_id, 'o_orderpriority_' || lv.lvl AS feature,
  CASE WHEN o.o_orderpriority = lv.lvl THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS v
FROM orders o, (SELECT DISTINCT o_orderpriority AS lvl FROM orders) lv"""


@spark_query("label_encode")
def q_label_encode(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("label"))
    return encode.coded(o, ["label"], encode.dictionary(o, ["label"])).withColumnRenamed("label_code", "code")


@oracle("label_encode")
def o_label_encode():
    return """SELECT o.o_orderkey AS row_id, o.o_orderstatus AS label, lv.code
FROM orders o JOIN (SELECT lvl, CAST(row_number() OVER (ORDER BY lvl) - 1 AS BIGINT) AS code
                    FROM (SELECT DISTINCT o_orderstatus AS lvl FROM orders)) lv ON o.o_orderstatus = lv.lvl"""


@spark_query("level_dictionary")
def q_level_dictionary(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").cast("string").alias("customer"),
        F.col("o_orderpriority").alias("priority"),
    )
    cols = ["customer", "priority"]
    return encode.coded(o, cols, encode.dictionary(o, cols)).drop(*cols)


@oracle("level_dictionary")
def o_level_dictionary():
    return """SELECT o_orderkey AS row_id,
  CAST(dense_rank() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) - 1 AS BIGINT) AS customer_code,
  CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS priority_code
FROM orders"""


@spark_query("prepare_orders")
def q_prepare_orders(spark, sf):
    o = table(spark, sf, "orders").drop("o_orderdate")
    raw, names = A.prepare(o, "o_orderstatus", id_col="o_orderkey", positive="F", drop_cols=["o_custkey"])
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("gene") + 1)
    return raw.select("row_id", "y", F.posexplode("features").alias("gene", "x")).select(
        "row_id", "y", F.col("gene").cast("bigint").alias("gene"), named.alias("feature"), "x"
    )


@oracle("prepare_orders")
def o_prepare_orders():
    return """WITH lv AS (
  SELECT lvl, row_number() OVER (ORDER BY lvl) AS gene FROM (SELECT DISTINCT o_orderpriority AS lvl FROM orders)
)
SELECT o_orderkey AS row_id, CAST(o_orderstatus = 'F' AS INTEGER) AS y, CAST(0 AS BIGINT) AS gene,
       'o_totalprice' AS feature, o_totalprice AS x FROM orders
UNION ALL
SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER), CAST(gene AS BIGINT), 'o_orderpriority_' || lvl,
       CAST(o_orderpriority = lvl AS DOUBLE)
FROM orders, lv"""


@spark_query("prepare_without_ids")
def q_prepare_without_ids(spark, sf):
    c = table(spark, sf, "conversations").select("role", "text").withColumn("n_chars", F.length("text").cast("long"))
    raw, _ = A.prepare(c, "role", positive="assistant", drop_cols=["text"], fill_value=0.0)
    return split.stratified_split(raw, seed=SEED).select("row_id", "y", "split", F.col("features")[0].alias("n_chars"))


@oracle("prepare_without_ids")
def o_prepare_without_ids():
    rows = """(SELECT key || ':' || CAST(row_number() OVER (PARTITION BY key) - 1 AS VARCHAR) AS row_id, y, n_chars
  FROM (SELECT md5(length(role) || ':' || role || coalesce(length(n) || ':' || n, 'n')) AS key,
               CAST(role = 'assistant' AS INTEGER) AS y, n_chars
        FROM (SELECT role, CAST(length(text) AS VARCHAR) AS n, CAST(length(text) AS DOUBLE) AS n_chars
              FROM conversations)))"""
    return (
        f"SELECT row_id, y, split, coalesce(n_chars, 0) AS n_chars "
        f"FROM {split.stratified_split_sql(rows, SEED)}"
    )


def _sparse_orders(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), "o_totalprice",
        F.col("o_custkey").cast("string").alias("customer"), F.col("o_orderpriority").alias("priority"),
    )
    return sparse.features(o, ["o_totalprice"], ["customer", "priority"])


@spark_query("sparse_centroid")
def q_sparse_centroid(spark, sf):
    rows, _, d = _sparse_orders(spark, sf)
    ab = sparse.build(rows.select("row_id", "y", "indices", "values"), d, search.shared_path(spark, "abt"), SEED)
    sc = fitness.score(ab.df, popops.init(spark, P, d, SEED), MODELS.get("sparse_centroid"), METRIC)
    return sc.select("chrom_id", bits.n_selected(F.col("genes")).alias("n_selected"), "tp", "fp", "fn", "tn", "score")


@oracle("sparse_centroid")
def o_sparse_centroid():
    q = T.Sql()
    q.add("o", """SELECT o_orderkey AS row_id, CAST(o_orderstatus = 'F' AS INTEGER) AS y, o_totalprice,
  CAST(o_custkey AS VARCHAR) AS customer, o_orderpriority AS priority FROM orders""")
    q.add("sp_rows", "SELECT row_id, y FROM o")
    q.add("coded", """SELECT *, dense_rank() OVER (ORDER BY customer) AS c,
  (SELECT count(DISTINCT customer) FROM o) + dense_rank() OVER (ORDER BY priority) AS p FROM o""")
    q.add("sp_long", """SELECT row_id, CAST(0 AS BIGINT) AS gene, o_totalprice AS x FROM o WHERE o_totalprice <> 0
UNION ALL SELECT row_id, CAST(c AS BIGINT), CAST(1 AS DOUBLE) FROM coded
UNION ALL SELECT row_id, CAST(p AS BIGINT), CAST(1 AS DOUBLE) FROM coded""")
    q.add("sp", "SELECT * FROM " + split.stratified_split_sql("sp_rows", SEED))
    q.add("nz", "SELECT l.*, s.y, s.split FROM sp_long l JOIN sp s ON l.row_id = s.row_id")
    q.add("cls", """SELECT count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1,
  CAST(count(*) AS DOUBLE) AS n FROM sp WHERE split = 'train'""")
    q.add("mom", """SELECT gene, s / n AS mean, sqrt((v * k + m * m * (k * (n - k)) / n) / n) AS sd
FROM (SELECT gene, CAST(count(*) AS DOUBLE) AS k, sum(x) AS s, avg(x) AS m, var_pop(x) AS v
      FROM nz WHERE split = 'train' GROUP BY gene), cls""")
    q.add("st", f"""SELECT *, CAST(floor((0 - mean) / sd * {scale.SCALE}) AS BIGINT) AS z0
FROM (SELECT g.gene, coalesce(mean, CAST(0 AS DOUBLE)) AS mean, CASE WHEN sd > 0 THEN sd ELSE CAST(1 AS DOUBLE) END AS sd
      FROM (SELECT DISTINCT gene FROM sp_long) g LEFT JOIN mom ON g.gene = mom.gene)""")
    q.add("z", f"""SELECT nz.*, CAST(floor((x - mean) / sd * {scale.SCALE}) AS BIGINT) - z0 AS dz
FROM nz JOIN st ON nz.gene = st.gene""")
    q.add("mm", """SELECT st.gene, z0,
  CAST(floor(CAST(n0 * z0 + coalesce(s0, 0) AS DOUBLE) / n0) AS BIGINT) AS m0,
  CAST(floor(CAST(n1 * z0 + coalesce(s1, 0) AS DOUBLE) / n1) AS BIGINT) AS m1
FROM st LEFT JOIN (SELECT gene, sum(dz) FILTER (WHERE y = 0) AS s0, sum(dz) FILTER (WHERE y = 1) AS s1
                   FROM z WHERE split = 'train' GROUP BY gene) t ON st.gene = t.gene, cls""")
    pop = T.population_init(q, "pop0", "sp", P, SEED)
    q.add("bs", f"""SELECT chrom_id, CAST(sum(bit) AS BIGINT) AS n_selected,
  sum(bit * (m0 - m1) * (2 * z0 - m0 - m1)) AS base FROM {pop} p JOIN mm ON p.gene = mm.gene GROUP BY chrom_id""")
    q.add("dec", f"""SELECT p.chrom_id, z.row_id, any_value(z.y) AS y, sum(p.bit * 2 * (m0 - m1) * dz) AS d
FROM z JOIN mm ON z.gene = mm.gene JOIN {pop} p ON p.gene = z.gene WHERE z.split = 'val' GROUP BY p.chrom_id, z.row_id""")
    q.add("conf", """SELECT bs.chrom_id, any_value(n_selected) AS n_selected,
  count(*) FILTER (WHERE base + d < 0 AND y = 1) AS tp, count(*) FILTER (WHERE base + d < 0 AND y = 0) AS fp,
  count(*) FILTER (WHERE base + d >= 0 AND y = 1) AS fn, count(*) FILTER (WHERE base + d >= 0 AND y = 0) AS tn
FROM dec JOIN bs ON dec.chrom_id = bs.chrom_id GROUP BY bs.chrom_id""")
    return q.render(f"SELECT chrom_id, n_selected, tp, fp, fn, tn, {T.metric_sql(METRIC)} AS score FROM conf")


@spark_query("feature_subset")
def q_feature_subset(spark, sf):
    raw, names = A.raw_lineitem(spark, sf)
    pop = popops.init(spark, 1, len(names), SEED)
    mask = pop.first()["genes"]
    kept = [i for i, b in enumerate(mask) if b]
    return raw.select(
        "row_id",
        F.posexplode(encode.subset_static(F.col("features"), mask)).alias("pos", "x"),
    ).select(
        "row_id",
        F.element_at(F.array(*[F.lit(i).cast("bigint") for i in kept]), F.col("pos") + 1).alias("gene"),
        "x",
    )


@oracle("feature_subset")
def o_feature_subset():
    q = T.Sql()
    rows, long = A.raw_sql("lineitem")
    q.add("lineitem_long", long)
    pop = T.population_init(q, "pop0", "lineitem", 1, SEED)
    return q.render(f"SELECT l.row_id, l.gene, l.x FROM lineitem_long l JOIN {pop} p ON l.gene = p.gene AND p.bit = 1")


# ------------------------------------------------------------------ fitness


def _scored0(spark, sf, dataset, metric=METRIC, n=P):
    ab = _written(spark, sf, dataset)
    pop = popops.init(spark, n, ab.d, SEED)
    return ab, pop, fitness.score(ab.df, pop, CentroidModel(), metric)


def _o_scored0(q, dataset, metric=METRIC, n=P):
    p = T.abt(q, dataset)
    pop = T.population_init(q, "pop0", p, n, SEED)
    conf = T.centroid_conf(q, "conf0", p, pop)
    sc = T.scored(q, "sc0", conf, pop, metric)
    return p, pop, sc


@spark_query("fitness_population")
def q_fitness_population(spark, sf):
    _, _, sc = _scored0(spark, sf, "embeddings")
    return sc.select("chrom_id", "tp", "fp", "fn", "tn", "score")


@oracle("fitness_population")
def o_fitness_population():
    q = T.Sql()
    _, _, sc = _o_scored0(q, "embeddings")
    return q.render(f"SELECT chrom_id, tp, fp, fn, tn, score FROM {sc}")


@spark_query("fitness_single")
def q_fitness_single(spark, sf):
    ab = _written(spark, sf, "lineitem")
    pop = popops.init(spark, 1, ab.d, SEED)
    sc = fitness.score(ab.df, pop, CentroidModel(), METRIC)
    return sc.select("chrom_id", _genes(), "tp", "fp", "fn", "tn", "score")


@oracle("fitness_single")
def o_fitness_single():
    q = T.Sql()
    p, pop, sc = _o_scored0(q, "lineitem", n=1)
    return q.render(
        f"SELECT s.chrom_id, g.genes, s.tp, s.fp, s.fn, s.tn, s.score FROM {sc} s JOIN {T.packed(pop)} g ON s.chrom_id = g.chrom_id"
    )


@spark_query("metrics_confusion")
def q_metrics_confusion(spark, sf):
    _, _, sc = _scored0(spark, sf, "orders")
    return fitness.all_metrics(sc.select("chrom_id", "tp", "fp", "fn", "tn"))


@oracle("metrics_confusion")
def o_metrics_confusion():
    from featsearch.functions.metrics import metric_sql

    q = T.Sql()
    _, _, sc = _o_scored0(q, "orders")
    return q.render(
        f"SELECT chrom_id, tp, fp, fn, tn, {metric_sql('f1')} AS f1, {metric_sql('accuracy')} AS accuracy, "
        f"{metric_sql('roc_auc')} AS roc_auc FROM {sc}"
    )


@spark_query("selection_topk")
def q_selection_topk(spark, sf):
    _, _, sc = _scored0(spark, sf, "embeddings")
    return popops.select_top(sc, P // 2).select(F.col("rank").cast("bigint").alias("rank"), "chrom_id", "score")


@oracle("selection_topk")
def o_selection_topk():
    q = T.Sql()
    _, _, sc = _o_scored0(q, "embeddings")
    rk = T.ranked(q, "rk", sc)
    return q.render(f"SELECT CAST(rank AS BIGINT) AS rank, chrom_id, score FROM {rk} WHERE rank <= {P // 2}")


@spark_query("generation_best")
def q_generation_best(spark, sf):
    _, _, sc = _scored0(spark, sf, "lineitem")
    return popops.select_top(sc, 1).select("chrom_id", "score", _genes())


@oracle("generation_best")
def o_generation_best():
    q = T.Sql()
    _, pop, sc = _o_scored0(q, "lineitem")
    rk = T.ranked(q, "rk", sc)
    return q.render(
        f"SELECT r.chrom_id, r.score, g.genes FROM {rk} r JOIN {T.packed(pop)} g ON r.chrom_id = g.chrom_id WHERE r.rank = 1"
    )


# ------------------------------------------------------------------ breeding


def _survivors(spark, sf):
    """The better half of the population scored on the table, by rank from 0,
    and the number of genes."""
    ab, _, sc = _scored0(spark, sf, "embeddings")
    best = popops.select_top(sc, P // 2)
    return best.select((F.col("rank") - 1).cast("bigint").alias("chrom_id"), "genes"), ab.d


def _o_survivors(q):
    _, pop, sc = _o_scored0(q, "embeddings")
    rk = T.ranked(q, "rk", sc)
    return q.add(
        "surv",
        f"SELECT CAST(r.rank - 1 AS BIGINT) AS chrom_id, p.gene, p.bit FROM {rk} r JOIN {pop} p ON r.chrom_id = p.chrom_id "
        f"WHERE r.rank <= {P // 2}",
    )


def _pairs(spark, sf, method):
    surv, d = _survivors(spark, sf)
    # every survivor crossed with the next in rank; a window over P rows reads the scores once
    after = F.lead("genes").over(Window.orderBy("chrom_id"))
    pairs = surv.select("chrom_id", F.col("genes").alias("a"), after.alias("b")).where("b is not null")
    return pairs.select("chrom_id", bits.bitstring(bits.crossover(F.col("a"), F.col("b"), d, method)).alias("genes"))


def _o_pairs(method):
    q = T.Sql()
    surv = _o_survivors(q)
    d_expr = "(SELECT count(DISTINCT gene) FROM embeddings_long)"
    pick = f"CASE WHEN a.gene < {d_expr} // 2 THEN a.bit ELSE b.bit END" if method == "onepoint" else (
        "CASE WHEN a.gene % 2 = 0 THEN a.bit ELSE b.bit END"
    )
    q.add(
        "child",
        f"SELECT a.chrom_id, a.gene, {pick} AS bit FROM {surv} a JOIN {surv} b "
        f"ON b.chrom_id = a.chrom_id + 1 AND a.gene = b.gene",
    )
    return q.render(f"SELECT * FROM {T.packed('child')}")


@spark_query("crossover_onepoint")
def q_cross1(spark, sf):
    return _pairs(spark, sf, "onepoint")


@oracle("crossover_onepoint")
def o_cross1():
    return _o_pairs("onepoint")


@spark_query("crossover_multipoint")
def q_cross2(spark, sf):
    return _pairs(spark, sf, "multipoint")


@oracle("crossover_multipoint")
def o_cross2():
    return _o_pairs("multipoint")


@spark_query("mutation")
def q_mutation(spark, sf):
    surv, _ = _survivors(spark, sf)
    return popops.mutate(surv, RATE, 1, SEED).select("chrom_id", _genes())


def _o_mutated(q):
    surv = _o_survivors(q)
    from featsearch.functions.rng import threshold

    h = u32_sql(str(SEED), "'mutate'", "1", "chrom_id", "gene")
    q.add("mut", f"SELECT chrom_id, gene, CASE WHEN {h} < {threshold(RATE)} THEN 1 - bit ELSE bit END AS bit FROM {surv}")
    return surv, "mut"


@oracle("mutation")
def o_mutation():
    q = T.Sql()
    _o_mutated(q)
    return q.render(f"SELECT * FROM {T.packed('mut')}")


@spark_query("mutation_drift")
def q_drift(spark, sf):
    surv, d = _survivors(spark, sf)
    both = surv.select(F.col("genes").alias("a"), bits.mutate(F.col("genes"), RATE, SEED, 1, F.col("chrom_id")).alias("b"))
    return popops.changed(both, d)


@oracle("mutation_drift")
def o_drift():
    q = T.Sql()
    pop, mut = _o_mutated(q)
    return q.render(
        f"SELECT CAST(sum(CASE WHEN a.bit <> b.bit THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS changed_fraction "
        f"FROM {pop} a JOIN {mut} b ON a.chrom_id = b.chrom_id AND a.gene = b.gene"
    )


@spark_query("mating")
def q_mating(spark, sf):
    ab, pop, sc = _scored0(spark, sf, "embeddings")
    m = popops.mating(sc, P, ab.d, 1, SEED, CROSSOVER, ELITISM)
    return m.select("chrom_id", F.col("p1").cast("bigint").alias("p1"), F.col("p2").cast("bigint").alias("p2"), _genes())


@oracle("mating")
def o_mating():
    q = T.Sql()
    p, pop, sc = _o_scored0(q, "embeddings")
    T.next_generation(q, "nx", sc, pop, P, EMB_D, 1, SEED, CROSSOVER, RATE, ELITISM)
    q.add(
        "kids",
        f"SELECT m.slot AS chrom_id, a.gene, CASE WHEN a.gene < {EMB_D // 2} THEN a.bit ELSE b.bit END AS bit, m.p1, m.p2 "
        f"FROM nx_mt m JOIN nx_sv a ON a.rank = m.p1 JOIN nx_sv b ON b.rank = m.p2 AND b.gene = a.gene",
    )
    return q.render(
        "SELECT CAST(chrom_id AS BIGINT) AS chrom_id, CAST(any_value(p1) AS BIGINT) AS p1, CAST(any_value(p2) AS BIGINT) AS p2, "
        "string_agg(CAST(bit AS VARCHAR), '' ORDER BY gene) AS genes FROM kids GROUP BY chrom_id"
    )


@spark_query("next_population")
def q_next_population(spark, sf):
    ab, pop, sc = _scored0(spark, sf, "embeddings")
    nxt = popops.next_generation(sc, P, ab.d, 1, SEED, CROSSOVER, RATE, ELITISM)
    return nxt.select("chrom_id", _genes())


@oracle("next_population")
def o_next_population():
    q = T.Sql()
    p, pop, sc = _o_scored0(q, "embeddings")
    nx = T.next_generation(q, "nx", sc, pop, P, EMB_D, 1, SEED, CROSSOVER, RATE, ELITISM)
    return q.render(f"SELECT * FROM {T.packed(nx)}")


@spark_query("population_diversity")
def q_diversity(spark, sf):
    ab, pop, sc = _scored0(spark, sf, "embeddings")
    nxt = popops.next_generation(sc, P, ab.d, 1, SEED, CROSSOVER, RATE, ELITISM)
    return (
        popops.diversity(pop).select(F.lit(0).cast("bigint").alias("gen"), "n_distinct")
        .unionByName(popops.diversity(nxt).select(F.lit(1).cast("bigint").alias("gen"), "n_distinct"))
    )


@oracle("population_diversity")
def o_diversity():
    q = T.Sql()
    p, pop, sc = _o_scored0(q, "embeddings")
    nx = T.next_generation(q, "nx", sc, pop, P, EMB_D, 1, SEED, CROSSOVER, RATE, ELITISM)
    return q.render(
        f"SELECT CAST(0 AS BIGINT) AS gen, count(DISTINCT genes) AS n_distinct FROM {T.packed(pop)} "
        f"UNION ALL SELECT CAST(1 AS BIGINT), count(DISTINCT genes) FROM {T.packed(nx)}"
    )


# ------------------------------------------------------------------ searches

BASELINE_SETS = ("embeddings", "lineitem", "orders", "documents")


@spark_query("baseline_metrics")
def q_baseline(spark, sf):
    out = None
    for ds in BASELINE_SETS:
        ab = _written(spark, sf, ds)
        conf = fitness.confusion(ab.df, popops.ones(spark, ab.d), CentroidModel(), ("val", "test"))
        part = fitness.all_metrics(conf.select(F.lit(ds).alias("dataset"), "split", "tp", "fp", "fn", "tn"))
        out = part if out is None else out.unionByName(part)
    return out


@oracle("baseline_metrics")
def o_baseline():
    from featsearch.functions.metrics import metric_sql

    q = T.Sql()
    parts = []
    for ds in BASELINE_SETS:
        p = T.abt(q, ds)
        ones = q.add(f"{p}_ones", f"SELECT CAST(0 AS BIGINT) AS chrom_id, gene, 1 AS bit FROM {T.genes_of(q, p)}")
        for s in ("val", "test"):
            c = T.centroid_conf(q, f"{p}_b{s}", p, ones, s)
            parts.append(
                f"SELECT '{ds}' AS dataset, '{s}' AS split, tp, fp, fn, tn, {metric_sql('f1')} AS f1, "
                f"{metric_sql('accuracy')} AS accuracy, {metric_sql('roc_auc')} AS roc_auc FROM {c}"
            )
    return q.render("\nUNION ALL ".join(parts))


def _ga_unrolled(spark, sf, dataset, generations):
    """Scored populations of generations 0..generations-1 (lazy breeding between)."""
    ab = _written(spark, sf, dataset)
    model = CentroidModel()
    pop = popops.init(spark, P, ab.d, SEED)
    n = P
    out = []
    for g in range(generations):
        # P-bounded rows: re-created locally so later generations do not
        # re-run earlier scoring passes (lineage cut per generation)
        rows = fitness.score(ab.df, pop, model, METRIC).collect()
        sc = spark.createDataFrame(rows, "chrom_id bigint, genes array<int>, tp bigint, fp bigint, fn bigint, tn bigint, score double")
        out.append(sc.withColumn("gen", F.lit(g).cast("bigint")))
        pop = popops.next_generation(sc, n, ab.d, g + 1, SEED, CROSSOVER, RATE, ELITISM)
        n = 2 * (n // 2)
    return ab, out


def _o_ga_unrolled(q, dataset, generations, d):
    return _o_ga_unrolled_n(q, dataset, generations, d, P)


@spark_query("ga_generation")
def q_ga_generation(spark, sf):
    _, scs = _ga_unrolled(spark, sf, "embeddings", 2)
    return scs[0].unionByName(scs[1]).select("gen", "chrom_id", _genes(), "tp", "fp", "fn", "tn", "score")


@oracle("ga_generation")
def o_ga_generation():
    q = T.Sql()
    scs = _o_ga_unrolled(q, "embeddings", 2, EMB_D)
    parts = [
        f"SELECT CAST({g} AS BIGINT) AS gen, s.chrom_id, k.genes, s.tp, s.fp, s.fn, s.tn, s.score "
        f"FROM {sc} s JOIN {T.packed(pop)} k ON s.chrom_id = k.chrom_id"
        for g, (sc, pop) in enumerate(scs)
    ]
    return q.render("\nUNION ALL ".join(parts))


HIST_GENS = 3


def _history_of(scs):
    out = None
    for sc in scs:
        best = popops.select_top(sc, 1).select("gen", _genes())
        agg = sc.groupBy("gen").agg(
            F.round(F.avg("score"), 10).alias("avg"), F.max("score").alias("best"), F.min("score").alias("worst")
        )
        part = agg.join(best, "gen")
        out = part if out is None else out.unionByName(part)
    return out


def _o_history_of(q, scs):
    parts = []
    for g, (sc, pop) in enumerate(scs):
        rk = T.ranked(q, f"hrk{g}", sc)
        parts.append(
            f"SELECT CAST({g} AS BIGINT) AS gen, round(avg(s.score), 10) AS avg, max(s.score) AS best, "
            f"min(s.score) AS worst, (SELECT k.genes FROM {rk} r JOIN {T.packed(pop)} k ON r.chrom_id = k.chrom_id "
            f"WHERE r.rank = 1) AS genes FROM {sc} s"
        )
    return "\nUNION ALL ".join(parts)


@spark_query("ga_history")
def q_ga_history(spark, sf):
    _, scs = _ga_unrolled(spark, sf, "orders", HIST_GENS)
    return _history_of(scs)


@oracle("ga_history")
def o_ga_history():
    q = T.Sql()
    scs = _o_ga_unrolled(q, "orders", HIST_GENS, ORDERS_D)
    return q.render(_o_history_of(q, scs))


@spark_query("best_test_metrics")
def q_best_test(spark, sf):
    ab, scs = _ga_unrolled(spark, sf, "orders", HIST_GENS)
    best = popops.select_top(scs[-1], 1).select(F.lit(0).cast("bigint").alias("chrom_id"), "genes")
    conf = fitness.confusion(ab.df, best, CentroidModel(), ("test",)).drop("split", "chrom_id")
    genes = "".join(str(x) for x in best.first()["genes"])  # one chromosome
    return fitness.all_metrics(conf.withColumn("genes", F.lit(genes)))


@oracle("best_test_metrics")
def o_best_test():
    from featsearch.functions.metrics import metric_sql

    q = T.Sql()
    scs = _o_ga_unrolled(q, "orders", HIST_GENS, ORDERS_D)
    sc, pop = scs[-1]
    rk = T.ranked(q, "brk", sc)
    q.add("bpop", f"SELECT CAST(0 AS BIGINT) AS chrom_id, pp.gene, pp.bit FROM {rk} r JOIN {pop} pp ON r.chrom_id = pp.chrom_id WHERE r.rank = 1")
    c = T.centroid_conf(q, "bconf", "orders", "bpop", "test")
    return q.render(
        f"SELECT c.tp, c.fp, c.fn, c.tn, k.genes, {metric_sql('f1')} AS f1, {metric_sql('accuracy')} AS accuracy, "
        f"{metric_sql('roc_auc')} AS roc_auc FROM {c} c, {T.packed('bpop')} k"
    )


def _random_cfg(n=P, rounds=ROUNDS, thr=THRESHOLD):
    from featsearch.config import SearchConfig

    return SearchConfig(dataset="embeddings", algorithm="random", model="centroid", metric=METRIC,
                        population_size=n, max_generation=rounds, stopping_threshold=thr, seed=SEED)


def _random_query(spark, sf, cfg):
    from featsearch.plans.search import baseline, random_plan

    ab = _written(spark, sf, cfg.dataset)
    model = CentroidModel()
    base = baseline(ab, model, cfg.metric)
    h = random_plan(ab, cfg, model, base["val"])
    return h.select(
        F.col("gen").cast("bigint").alias("gen"), F.round("avg", 10).alias("avg"), "best", "worst", "best_so_far",
        _genes("best_genes"),
    )


def _o_random(cfg):
    q = T.Sql()
    p = T.abt(q, cfg.dataset)
    n, rounds = cfg.population_size, cfg.max_generation + 1
    pop = T.population_init(q, "rpop", p, n * rounds, SEED, 0, "random")
    conf = T.centroid_conf(q, "rconf", p, pop)
    sc = T.scored(q, "rsc", conf, pop, METRIC)
    ones = q.add("ones", f"SELECT CAST(0 AS BIGINT) AS chrom_id, gene, 1 AS bit FROM {T.genes_of(q, p)}")
    bconf = T.centroid_conf(q, "bconf", p, ones)
    bsc = T.scored(q, "bsc", bconf, ones, METRIC)
    q.add("rg", f"SELECT *, chrom_id // {n} AS gen, row_number() OVER (PARTITION BY chrom_id // {n} "
                f"ORDER BY score DESC NULLS LAST, chrom_id) AS r FROM {sc}")
    q.add("per", f"""SELECT gen, round(avg(score), 10) AS avg, max(score) AS best, min(score) AS worst,
  any_value(CASE WHEN r = 1 THEN chrom_id END) AS best_id FROM rg GROUP BY gen""")
    q.add("per2", f"""SELECT p.*, max(best) OVER (ORDER BY gen ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far,
  max(best) OVER (ORDER BY gen ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max FROM per p""")
    thr = repr(float(cfg.stopping_threshold))
    return q.render(
        f"""SELECT CAST(p.gen AS BIGINT) AS gen, p.avg, p.best, p.worst, p.best_so_far, k.genes
FROM per2 p JOIN {T.packed(pop)} k ON k.chrom_id = p.best_id
WHERE (SELECT score FROM {bsc}) < {thr} AND (p.prev_max IS NULL OR p.prev_max < {thr})"""
    )


@spark_query("random_search")
def q_random(spark, sf):
    return _random_query(spark, sf, _random_cfg())


@oracle("random_search")
def o_random():
    return _o_random(_random_cfg())


# The reference's smoke grid (population 10, 10 rounds) with a threshold the
# search can reach, so that the stop rule truncates the rounds.
STOP_CFG = dict(n=10, rounds=10, thr=0.6)


@spark_query("stop_rule")
def q_stop(spark, sf):
    return _random_query(spark, sf, _random_cfg(**STOP_CFG))


@oracle("stop_rule")
def o_stop():
    return _o_random(_random_cfg(**STOP_CFG))


# ------------------------------------------------------------------ forward selection

FOLDS = 5


@spark_query("forward_selection_round")
def q_fs_round(spark, sf):
    import numpy as np

    ab = _written(spark, sf, "lineitem")
    mat = np.eye(ab.d, dtype=np.int8)
    cv = CentroidModel().cv_scores(ab.df, np.arange(ab.d, dtype=np.int64), mat, FOLDS, SEED, "accuracy")
    return spark.createDataFrame(cv, "gene bigint, cv_score double")


@spark_query("forward_selection")
def q_fs(spark, sf):
    from featsearch.config import SearchConfig
    from featsearch.plans.search import forward_selection

    ab = _written(spark, sf, "lineitem")
    cfg = SearchConfig(dataset="lineitem", algorithm="rfs", model="centroid", metric=METRIC, seed=SEED, cv_folds=FOLDS)
    res = forward_selection(ab, cfg, CentroidModel(), {"val": None})
    return spark.createDataFrame([(s["round"], s["gene"], s["cv_score"]) for s in res.steps],
                                 "round bigint, gene bigint, cv_score double")


def _o_cv_base(q, dataset):
    p = T.abt(q, dataset)
    q.add("trr", f"SELECT DISTINCT row_id, y FROM {p}_q WHERE split = 'train'")
    q.add("tr_fold", split.fold_sql("trr", FOLDS, SEED))
    q.add("trf", f"SELECT r.row_id, r.y, r.gene, r.q, f.fold FROM {p}_q r JOIN tr_fold f ON r.row_id = f.row_id WHERE r.split = 'train'")
    q.add("fs", "SELECT y, fold, gene, sum(q) AS s, count(*) AS n FROM trf GROUP BY y, fold, gene")
    q.add("ft", "SELECT y, gene, sum(s) AS st, sum(n) AS nt FROM fs GROUP BY y, gene")
    q.add("fm", """SELECT f.fold, f.gene,
  max(CASE WHEN f.y = 0 THEN CAST(floor((t.st - f.s) / (t.nt - f.n)) AS BIGINT) END) AS m0,
  max(CASE WHEN f.y = 1 THEN CAST(floor((t.st - f.s) / (t.nt - f.n)) AS BIGINT) END) AS m1
FROM fs f JOIN ft t ON f.y = t.y AND f.gene = t.gene GROUP BY f.fold, f.gene""")
    q.add("cc", """SELECT r.row_id, r.y, r.fold, r.gene,
  (r.q - m.m1) * (r.q - m.m1) - (r.q - m.m0) * (r.q - m.m0) AS c
FROM trf r JOIN fm m ON r.fold = m.fold AND r.gene = m.gene""")
    return p


def _o_cv_round(q, k, sel):
    q.add(f"r{k}_base", f"SELECT row_id, sum(c) AS b FROM cc WHERE gene IN (SELECT gene FROM {sel}) GROUP BY row_id")
    q.add(f"r{k}_cand", f"""SELECT cc.row_id, cc.y, cc.fold, cc.gene AS cand, coalesce(b.b, 0) + cc.c AS dec
FROM cc LEFT JOIN r{k}_base b ON cc.row_id = b.row_id WHERE cc.gene NOT IN (SELECT gene FROM {sel})""")
    q.add(f"r{k}_acc", f"""SELECT cand, fold,
  CAST(sum(CASE WHEN (dec < 0) = (y = 1) THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS acc
FROM r{k}_cand GROUP BY cand, fold""")
    folds = " + ".join(f"max(CASE WHEN fold = {f} THEN acc END)" for f in range(FOLDS))
    return q.add(f"r{k}_cv", f"SELECT cand, ({folds}) / {FOLDS} AS cv FROM r{k}_acc GROUP BY cand")


@oracle("forward_selection_round")
def o_fs_round():
    q = T.Sql()
    _o_cv_base(q, "lineitem")
    q.add("sel0", "SELECT CAST(NULL AS BIGINT) AS gene WHERE false")
    cv = _o_cv_round(q, 0, "sel0")
    return q.render(f"SELECT CAST(cand AS BIGINT) AS gene, cv AS cv_score FROM {cv}")


@oracle("forward_selection")
def o_fs():
    q = T.Sql()
    _o_cv_base(q, "lineitem")
    q.add("sel0", "SELECT CAST(NULL AS BIGINT) AS gene WHERE false")
    picks = []
    for k in range(LINEITEM_D // 2):
        sel = f"sel{k}"
        cv = _o_cv_round(q, k, sel)
        picks.append(q.add(f"pick{k}", f"SELECT CAST({k} AS BIGINT) AS round, CAST(cand AS BIGINT) AS gene, cv AS cv_score "
                                       f"FROM {cv} ORDER BY cv DESC, cand ASC LIMIT 1"))
        q.add(f"sel{k + 1}", " UNION ALL ".join(f"SELECT gene FROM {p}" for p in picks))
    return q.render("\nUNION ALL ".join(f"SELECT * FROM {p}" for p in picks))


# ------------------------------------------------------------------ reports over a study of runs



def _study(spark, sf):
    store = ST.run_study(spark, sf)
    return store.configs(), store.history(), store.test_metrics()


def _compiled(spark, sf):
    c, h, t = _study(spark, sf)
    return R.compiled(c, h, t)


def _o_study():
    q = T.Sql()
    ST.sql_study(q)
    return q


RUN_COLS = ("dataset", "algorithm", "model")


@spark_query("runs_count")
def q_runs_count(spark, sf):
    c, _, _ = _study(spark, sf)
    return c.select(F.countDistinct("run_id").alias("n_runs"))


@oracle("runs_count")
def o_runs_count():
    q = _o_study()
    return q.render("SELECT (SELECT count(*) FROM st_runs) + 1 AS n_runs")  # + the unfinished run


@spark_query("runs_complete")
def q_runs_complete(spark, sf):
    c, h, t = _study(spark, sf)
    return R.complete_runs(c, h, t).select(*RUN_COLS)


@oracle("runs_complete")
def o_runs_complete():
    return _o_study().render("SELECT dataset, algorithm, model FROM st_runs")


@spark_query("history_summary")
def q_history_summary(spark, sf):
    c, h, t = _study(spark, sf)
    s = R.history_summary(h).join(R.complete_runs(c, h, t), "run_id")
    return s.select(*RUN_COLS, F.round("avg", 10).alias("avg"), "best", "worst", F.col("last_gen").cast("bigint").alias("last_gen"))


@oracle("history_summary")
def o_history_summary():
    return _o_study().render(
        "SELECT dataset, algorithm, model, round(avg, 10) AS avg, best, worst, CAST(last_gen AS BIGINT) AS last_gen FROM st_runs"
    )


@spark_query("runs_compiled")
def q_runs_compiled(spark, sf):
    return _compiled(spark, sf).select(
        *RUN_COLS, "f1", "accuracy", "roc_auc", _genes("best_genes"), F.round("avg", 10).alias("avg"), "best", "worst"
    )


@oracle("runs_compiled")
def o_runs_compiled():
    return _o_study().render(
        "SELECT dataset, algorithm, model, f1, accuracy, roc_auc, genes, round(avg, 10) AS avg, best, worst FROM st_runs"
    )


@spark_query("runs_with_placeholders")
def q_placeholders(spark, sf):
    c, h, t = _study(spark, sf)
    return R.with_placeholders(c, h, t).select(*RUN_COLS, "f1", "accuracy", "roc_auc")


@oracle("runs_with_placeholders")
def o_placeholders():
    return _o_study().render(
        "SELECT dataset, algorithm, model, f1, accuracy, roc_auc FROM st_runs "
        "UNION ALL SELECT 'orders', 'rfs', 'logistic', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)"
    )


@spark_query("runs_filtered")
def q_runs_filtered(spark, sf):
    df = R.filtered(_compiled(spark, sf), backend="processes", model="centroid")
    return df.groupBy("algorithm").agg(F.count(F.lit(1)).alias("n_runs"))


@oracle("runs_filtered")
def o_runs_filtered():
    return _o_study().render("SELECT algorithm, count(*) AS n_runs FROM st_runs WHERE model = 'centroid' GROUP BY algorithm")


@spark_query("metrics_pivot")
def q_metrics_pivot(spark, sf):
    piv = R.metrics_pivot(_compiled(spark, sf), list(ST.DATASETS), ["centroid"], list(ST.ALGORITHMS))
    return piv.withColumn("algorithm", R.display_name("algorithm"))


@oracle("metrics_pivot")
def o_metrics_pivot():
    q = _o_study()
    grid = " UNION ALL ".join(
        f"SELECT 'centroid' AS model, '{a}' AS algorithm, '{m}' AS metric, CAST({j * 10 + n} AS BIGINT) AS pos"
        for j, a in enumerate(ST.ALGORITHMS) for n, m in enumerate(R.METRIC_COLS)
    )
    q.add("grid", grid)
    q.add("mlong", " UNION ALL ".join(
        f"SELECT dataset, model, algorithm, '{m}' AS metric, avg({m}) AS value FROM st_runs GROUP BY dataset, model, algorithm"
        for m in R.METRIC_COLS
    ))
    cols = ", ".join(
        f"max(CASE WHEN l.dataset = '{d}' THEN l.value END) AS {d}" for d in ST.DATASETS
    )
    disp = "CASE WHEN upper(replace(g.algorithm, '_', ' ')) = 'BASELINE METRICS' THEN 'BASELINE' ELSE upper(replace(g.algorithm, '_', ' ')) END"
    return q.render(
        f"SELECT g.model, {disp} AS algorithm, g.metric, g.pos, {cols} FROM grid g LEFT JOIN mlong l "
        f"ON g.model = l.model AND g.algorithm = l.algorithm AND g.metric = l.metric GROUP BY g.model, g.algorithm, g.metric, g.pos"
    )


@spark_query("times_pivot")
def q_times_pivot(spark, sf):
    return R.times_pivot(_compiled(spark, sf), list(ST.DATASETS))


@spark_query("duplicate_runs")
def q_duplicates(spark, sf):
    comp = _compiled(spark, sf)
    return R.duplicate_runs(comp).select(*RUN_COLS, "f1", "accuracy", "roc_auc", _genes("best_genes"))


@oracle("duplicate_runs")
def o_duplicates():
    return _o_study().render(
        "SELECT dataset, algorithm, model, f1, accuracy, roc_auc, genes FROM (SELECT *, row_number() OVER "
        "(PARTITION BY dataset, algorithm, model, f1, accuracy, roc_auc, genes, avg, best, worst, last_gen) AS rn "
        "FROM st_runs) WHERE rn > 1"
    )


@spark_query("convergence_series")
def q_convergence(spark, sf):
    c, h, _ = _study(spark, sf)
    rid = c.where((F.col("dataset") == "embeddings") & (F.col("algorithm") == "ga")).first()["run_id"]
    return R.convergence(h, rid).select(F.col("gen").cast("bigint").alias("gen"), F.round("avg", 10).alias("avg"), "best", "worst")


@oracle("convergence_series")
def o_convergence():
    return _o_study().render(
        "SELECT CAST(gen AS BIGINT) AS gen, round(avg, 10) AS avg, best, worst FROM st_hist "
        "WHERE dataset = 'embeddings' AND algorithm = 'ga'"
    )


def _o_overlap(q):
    q.add("one", "SELECT DISTINCT model, dataset, algorithm, genes FROM st_runs")
    return q.add("ov", """SELECT a.model, a.dataset, a.algorithm AS algo1, b.algorithm AS algo2,
  CASE WHEN bit_count(CAST(a.genes AS BIT) | CAST(b.genes AS BIT)) = 0 THEN CAST(1 AS DOUBLE)
       ELSE CAST(bit_count(CAST(a.genes AS BIT) & CAST(b.genes AS BIT)) AS DOUBLE)
            / bit_count(CAST(a.genes AS BIT) | CAST(b.genes AS BIT)) END AS overlap
FROM one a JOIN one b ON a.model = b.model AND a.dataset = b.dataset""")


@spark_query("jaccard_overlap")
def q_jaccard(spark, sf):
    return R.jaccard_overlap(_compiled(spark, sf))


@oracle("jaccard_overlap")
def o_jaccard():
    q = _o_study()
    ov = _o_overlap(q)
    return q.render(f"SELECT * FROM {ov}")


@spark_query("jaccard_matrix")
def q_jaccard_matrix(spark, sf):
    return R.jaccard_matrix(R.jaccard_overlap(_compiled(spark, sf)), list(ST.ALGORITHMS))


@oracle("jaccard_matrix")
def o_jaccard_matrix():
    q = _o_study()
    ov = _o_overlap(q)
    cols = ", ".join(f"max(CASE WHEN algo2 = '{a}' THEN overlap END) AS {a}" for a in ST.ALGORITHMS)
    return q.render(f"SELECT model, dataset, algo1, {cols} FROM {ov} GROUP BY model, dataset, algo1")


@spark_query("display_names")
def q_display_names(spark, sf):
    c, _, _ = _study(spark, sf)
    return c.select("algorithm").distinct().select("algorithm", R.display_name("algorithm").alias("display"))


@oracle("display_names")
def o_display_names():
    return _o_study().render(
        "SELECT algorithm, CASE WHEN upper(replace(algorithm, '_', ' ')) = 'BASELINE METRICS' THEN 'BASELINE' "
        "ELSE upper(replace(algorithm, '_', ' ')) END AS display FROM (SELECT DISTINCT algorithm FROM st_runs)"
    )


@spark_query("chromosome_decode")
def q_decode(spark, sf):
    import os

    store = ST.run_study(spark, sf)
    out = os.path.join(store.root, "csv")
    if not os.path.exists(out) and not out.startswith(("hdfs:", "s3", "gs:", "abfs")):
        store.export_csv(out)
    elif out.startswith(("hdfs:", "s3", "gs:", "abfs")):
        store.export_csv(out)
    text = spark.read.option("header", True).schema(
        "run_id string, f1 double, accuracy double, roc_auc double, best_genes string, best_ever_genes string, status string"
    ).csv(os.path.join(out, "test_metrics"))
    dec = text.select("run_id", R.decode_genes("best_genes").alias("g"))
    return dec.join(store.configs(), "run_id").select(
        "dataset", "algorithm", bits.n_selected(F.col("g")).alias("n_selected"), _genes("g")
    )


@oracle("chromosome_decode")
def o_decode():
    return _o_study().render(
        "SELECT dataset, algorithm, CAST(bit_count(CAST(genes AS BIT)) AS BIGINT) AS n_selected, genes FROM st_runs"
    )


# ------------------------------------------------------------------ other models (rows-only checks)


SMOKE_P = 10  # the reference's smoke grid population


@spark_query("fitness_logistic")
def q_fitness_logistic(spark, sf):
    ab = _written(spark, sf, "embeddings")
    pop = popops.init(spark, P, ab.d, SEED)
    return fitness.score(ab.df, pop, MODELS.get("logistic"), METRIC).select("chrom_id", "tp", "fp", "fn", "tn", "score")


@spark_query("fitness_mlp")
def q_fitness_mlp(spark, sf):
    ab = _written(spark, sf, "orders")
    pop = popops.init(spark, P, ab.d, SEED)
    return fitness.score(ab.df, pop, MODELS.get("mlp"), METRIC).select("chrom_id", "tp", "fp", "fn", "tn", "score")


@spark_query("fitness_gbt")
def q_fitness_gbt(spark, sf):
    ab = _written(spark, sf, "orders")
    pop = popops.init(spark, P, ab.d, SEED)
    return fitness.score(ab.df, pop, MODELS.get("gbt"), METRIC).select("chrom_id", "tp", "fp", "fn", "tn", "score")


# ------------------------------------------------------------------ full driver runs

# The reference's smoke grid: population 10, 10 evolution rounds (fixed values).
SMOKE_ROUNDS = 10


def _smoke_cfg(**kw):
    from featsearch.config import SearchConfig

    base = dict(dataset="embeddings", algorithm="ga_spark", model="centroid", metric=METRIC, crossover=CROSSOVER,
                mutation_rate=RATE, population_size=SMOKE_P, elitism=ELITISM, max_generation=SMOKE_ROUNDS,
                stopping_threshold=THRESHOLD, seed=SEED)
    base.update(kw)
    return SearchConfig(**base)


@spark_query("ga_search")
def q_ga_search(spark, sf):
    """The genetic driver loop itself (A3, A5, K1): history of every generation."""
    from featsearch.plans import search

    cfg = _smoke_cfg()
    ab = _written(spark, sf, cfg.dataset)
    model = CentroidModel()
    res = search.genetic(ab, cfg, model, search.baseline(ab, model, cfg.metric))
    rows = [(h["gen"], round(h["avg"], 10), h["best"], h["worst"], "".join(map(str, h["best_genes"])))
            for h in res.history]
    return spark.createDataFrame(rows, "gen bigint, avg double, best double, worst double, genes string")


@oracle("ga_search")
def o_ga_search():
    q = T.Sql()
    scs = _o_ga_unrolled_n(q, "embeddings", SMOKE_ROUNDS + 1, EMB_D, SMOKE_P)
    return q.render(_o_history_of(q, scs))


def _o_ga_unrolled_n(q, dataset, generations, d, n0):
    p = T.abt(q, dataset)
    pop = T.population_init(q, "pop0", p, n0, SEED)
    n = n0
    scs = []
    for g in range(generations):
        conf = T.centroid_conf(q, f"conf{g}", p, pop)
        sc = T.scored(q, f"sc{g}", conf, pop, METRIC)
        scs.append((sc, pop))
        if g + 1 < generations:
            pop = T.next_generation(q, f"pop{g + 1}", sc, pop, n, d, g + 1, SEED, CROSSOVER, RATE, ELITISM)
            n = 2 * (n // 2)
    return scs


@spark_query("forward_selection_logistic")
def q_fs_logistic(spark, sf):
    """Forward selection with the reference's default model (iterative fits: rows-only check)."""
    from featsearch.config import SearchConfig
    from featsearch.plans.search import forward_selection

    ab = _written(spark, sf, "lineitem")
    cfg = SearchConfig(dataset="lineitem", algorithm="rfs", model="logistic", metric=METRIC, seed=SEED,
                       cv_folds=FOLDS)
    res = forward_selection(ab, cfg, MODELS.get("logistic"), {"val": None})
    return spark.createDataFrame([(s["round"], s["gene"], s["cv_score"]) for s in res.steps],
                                 "round bigint, gene bigint, cv_score double")
