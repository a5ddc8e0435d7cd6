"""Physical-plan checks: pruning reaches the scan, no cross joins in the hot path."""

from pyspark.sql import functions as F

from featsearch.operators import scale
from featsearch.plans import search
from featsearch.sources import abt as A
from conftest import SF001


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_scan_prunes_split_and_columns(spark):
    ab = search.materialize(A.load(spark, SF001, "lineitem"), spark)
    rows = ab.df.where(F.col("split").isin("val")).select("split", "y", scale.quantize(F.col("features")).alias("q"))
    plan = _plan(rows)
    assert "PartitionFilters: [isnotnull(split" in plan and "(split#" in plan
    assert "ReadSchema: struct<y:int,features:array<double>>" in plan


def test_raw_scan_reads_only_used_columns(spark):
    raw, _ = A.raw_orders(spark, SF001)
    plan = _plan(raw)
    assert "o_custkey" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_next_generation_has_no_cartesian_product(spark):
    from featsearch.operators import population as P

    pop = P.init(spark, 20, 8).withColumn("score", F.col("chrom_id").cast("double"))
    plan = _plan(P.next_generation(pop, 20, 8, 1))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_cluster_conf_keeps_explicit_settings(spark):
    from featsearch.session import CLUSTER_CONF, apply_cluster_conf

    keys = list(CLUSTER_CONF)
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1234")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        apply_cluster_conf(spark)
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1234"
        assert spark.conf.get("spark.sql.shuffle.partitions") == "8"  # set by the test session
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == CLUSTER_CONF["spark.sql.files.maxPartitionBytes"]
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
