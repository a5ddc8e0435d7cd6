"""Property tests: invariance to shuffle partitions, algebra vs a plain model."""

import hashlib

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from featsearch.functions import bits
from featsearch.functions.rng import threshold
from featsearch.operators import fitness, population as P
from featsearch.operators.models.centroid import CentroidModel
from featsearch.sources import abt as A
from conftest import SF001


def _u32(*parts) -> int:
    return int(hashlib.md5(":".join(str(p) for p in parts).encode()).hexdigest()[:8], 16)


def test_scores_independent_of_shuffle_partitions(spark):
    ab = A.load(spark, SF001, "orders")
    pop = P.init(spark, 30, ab.d)
    out = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "50"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            sc = fitness.score(ab.df, pop, CentroidModel(), "f1")
            nxt = P.next_generation(sc, 30, ab.d, 1)
            out.append((sorted((r["chrom_id"], r["score"]) for r in sc.collect()),
                        sorted((r["chrom_id"], tuple(r["genes"])) for r in nxt.collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert out[0] == out[1]


bitlists = st.integers(min_value=1, max_value=24).flatmap(
    lambda d: st.tuples(st.lists(st.integers(0, 1), min_size=d, max_size=d),
                        st.lists(st.integers(0, 1), min_size=d, max_size=d)))


@settings(max_examples=15, deadline=None)
@given(pair=bitlists, rate=st.sampled_from([0.0, 0.2, 0.5, 1.0]), slot=st.integers(0, 10**6))
def test_crossover_and_mutation_match_plain_model(spark, pair, rate, slot):
    a, b = pair
    d = len(a)
    df = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
    r = df.select(
        bits.crossover_onepoint(F.col("a"), F.col("b"), d).alias("one"),
        bits.crossover_multipoint(F.col("a"), F.col("b")).alias("multi"),
        bits.mutate(F.col("a"), rate, 7, 3, F.lit(slot)).alias("mut"),
    ).first()
    assert r["one"] == a[: d // 2] + b[d // 2:]
    assert r["multi"] == [a[i] if i % 2 == 0 else b[i] for i in range(d)]
    t = threshold(rate)
    assert r["mut"] == [1 - x if _u32(7, "mutate", 3, slot, i) < t else x for i, x in enumerate(a)]


def test_bounded_scoring_tasks_same_results(spark):
    """Coalescing scoring inputs to few tasks (bounded shuffle) changes nothing."""
    from featsearch.operators.models.logistic import LogisticModel
    from featsearch.session import bounded_tasks

    ab = A.load(spark, SF001, "planted")
    ids, mat = P.to_matrix(P.init(spark, 12, ab.d))
    runs = []
    try:
        for cap in (None, "2"):
            if cap:
                spark.conf.set("spark.featsearch.maxScoringTasks", cap)
                assert bounded_tasks(ab.df).rdd.getNumPartitions() <= 2
            runs.append([fitness.score_rows(ab.df, ids, mat, m, "f1")
                         for m in (CentroidModel(), LogisticModel(solver="newton"))])
    finally:
        spark.conf.unset("spark.featsearch.maxScoringTasks")
    assert runs[0][0] == runs[1][0]
    assert [r["score"] for r in runs[0][1]] == [r["score"] for r in runs[1][1]]
