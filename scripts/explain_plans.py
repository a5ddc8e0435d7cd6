"""Print the formatted physical plans of the hot paths.

Usage: python scripts/explain_plans.py [sf_dir]  (writes Markdown to stdout)
"""

from __future__ import annotations

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from featsearch.functions.rng import u32  # noqa: E402
from featsearch.operators import population as P, scale  # noqa: E402
from featsearch.plans import search  # noqa: E402
from featsearch.session import bounded_tasks, checkpoint_dir, local_session  # noqa: E402
from featsearch.sources import abt as A  # noqa: E402


def show(title: str, df) -> None:
    print(f"## {title}\n\n```")
    df.explain(mode="formatted")
    print("```\n")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark, tempfile.mkdtemp(prefix="featsearch-plans-"))
    print(f"# Physical plans of the hot paths ({os.path.basename(sf)}, local[8])\n")
    ab = A.load(spark, sf, "lineitem", path=search.shared_path(spark, "abt"))
    rows = bounded_tasks(ab.df.where(F.col("split").isin("val")).select(
        "split", "y", scale.quantize(F.col("features")).alias("q")))
    show("Scoring pass input (partition-pruned, column-pruned, scaled on read)", rows)
    from featsearch.operators.models.centroid import CONF_SCHEMA

    conf = rows.mapInArrow(lambda it: iter(()), CONF_SCHEMA).groupBy("split", "chrom_id").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    show("Scoring pass: per-task confusion counts, P rows per task, summed", conf)
    raw, _ = A.raw_lineitem(spark, sf)
    hist = raw.withColumn("_h", u32(0, "split", F.col("row_id"))).groupBy(
        "y", F.shiftright(F.col("_h"), 16).alias("_b")).count()
    show("Split level-1 histogram (partial aggregation, bounded output)", hist)
    sc = P.init(spark, 150, ab.d).withColumn("score", F.col("chrom_id").cast("double"))
    show("Breeding plan over P rows (top-K, broadcast parent joins, union)", P.next_generation(sc, 150, ab.d, 1))
    docs, _ = A.raw_documents(spark, sf)
    show("documents ⋈ labels with whole-text features", docs)


if __name__ == "__main__":
    main()
