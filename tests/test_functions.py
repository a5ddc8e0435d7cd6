"""Literal unit tables (FIXTURES C): crossover, metrics, Jaccard, RNG parity."""

import duckdb
from pyspark.sql import functions as F

from featsearch.functions import bits, metrics
from featsearch.functions.rng import u32, u32_sql


def test_crossover_literal(spark):
    df = spark.createDataFrame([([1, 1, 1, 1, 1], [0, 0, 0, 0, 0])], "a array<int>, b array<int>")
    r = df.select(
        bits.crossover_onepoint(F.col("a"), F.col("b"), 5).alias("one"),
        bits.crossover_multipoint(F.col("a"), F.col("b")).alias("multi"),
    ).first()
    assert r["one"] == [1, 1, 0, 0, 0]
    assert r["multi"] == [1, 0, 1, 0, 1]


def test_confusion_metrics_literal(spark):
    df = spark.createDataFrame([(31, 24, 19, 25), (0, 0, 0, 5)], "tp long, fp long, fn long, tn long")
    rows = df.select(metrics.f1().alias("f1"), metrics.roc_auc().alias("auc"), metrics.accuracy().alias("acc")).collect()
    assert rows[0]["f1"] == 0.5904761904761905
    assert rows[0]["auc"] == 0.5651020408163265
    assert rows[1]["f1"] == 0.0 and rows[1]["auc"] is None and rows[1]["acc"] == 1.0


def test_metric_sql_twins_match(spark):
    con = duckdb.connect()
    for tp, fp, fn, tn in [(31, 24, 19, 25), (0, 0, 0, 5), (7, 3, 0, 0), (1, 2, 3, 4)]:
        df = spark.createDataFrame([(tp, fp, fn, tn)], "tp long, fp long, fn long, tn long")
        for m in ("f1", "accuracy", "roc_auc"):
            s = df.select(metrics.metric(m)).first()[0]
            o = con.execute(f"SELECT {metrics.metric_sql(m)} FROM (SELECT {tp} AS tp, {fp} AS fp, {fn} AS fn, {tn} AS tn)").fetchone()[0]
            assert s == o, (m, tp, fp, fn, tn)


def test_jaccard_literal(spark):
    df = spark.createDataFrame(
        [([0, 1, 1], [1, 1, 0]), ([0, 0, 0], [0, 0, 0]), ([0, 0, 0], [0, 1, 1])], "a array<int>, b array<int>"
    )
    got = [r[0] for r in df.select(bits.jaccard_overlap(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 1 / 3) < 1e-15 and got[1] == 1.0 and got[2] == 0.0


def test_bitstring_roundtrip(spark):
    df = spark.createDataFrame([([0, 1, 1, 0, 1],)], "g array<int>")
    r = df.select(bits.bitstring(F.col("g")).alias("s")).select("s", bits.from_bitstring(F.col("s")).alias("g")).first()
    assert r["s"] == "01101" and r["g"] == [0, 1, 1, 0, 1]


def test_u32_parity_with_duckdb(spark):
    df = spark.range(50).select("id", u32(7, "init", 3, F.col("id"), 11).alias("h"))
    spark_vals = {r["id"]: r["h"] for r in df.collect()}
    con = duckdb.connect()
    duck = dict(con.execute(f"SELECT range, {u32_sql('7', chr(39) + 'init' + chr(39), '3', 'range', '11')} FROM range(50)").fetchall())
    assert spark_vals == duck
    assert all(0 <= v < 2**32 for v in spark_vals.values())


def test_mutation_rates(spark):
    from featsearch.operators import population as P

    pop = P.init(spark, 200, 50, seed=1)
    for rate in (0.0, 1.0, 0.2):
        mut = P.mutate(pop, rate, 1, seed=1)
        frac = P.drift(pop, mut, 50).first()[0]
        if rate in (0.0, 1.0):
            assert frac == rate
        else:  # 10,000 bits: within 4 sigma of the rate
            assert abs(frac - rate) < 4 * (rate * (1 - rate) / 10000) ** 0.5
