"""Mixing sources to target weights: systematic sampling over prefix sums.

Each source gets a word target; every document of a source then expects
``target / source size`` copies. The documents of a source are ordered by size
and id, their expected copies are summed to a prefix, one random offset in
[0, 1) is added, and a document is emitted once for each integer boundary its
interval crosses. The order by size spreads the boundaries evenly over short
and long documents, so the words taken come close to the target.

Prefix sums are distributed: rows are range-partitioned by (source, size, id),
numbered inside their partition, and shifted by the counts of the partitions
before; only the table of counts per partition meets in one task. A source
that holds a third of all rows is thus cut into many ranges.

Defined results: a null text has size 0 and expects as many copies as any
other document of its source; a null source is a source of its own, last in
the order; a source whose documents all have no word has target 0 and rate 0;
repeated rows and null ids are documents like any other; an empty table gives
an empty mix. Runs with the same seed agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featsearch.llm.common import stored, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_RATE = 2
SEED = 17


def _placed(df: DataFrame, order: list) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, written once, with
    its partition ``__part`` and the row's place there ``__row`` (from 0)."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = F.monotonically_increasing_id()
    return stored(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order)
        .withColumn("__part", F.shiftright(at, 33).cast("int"))
        .withColumn("__row", at.bitwiseAND(F.lit((1 << 33) - 1)))
    )


def prefix(df: DataFrame, order: list, values: dict[str, Column]) -> DataFrame:
    """``df`` with inclusive running sums ``values`` in ``order``, distributed."""
    placed = _placed(df, order)
    inside = Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    sums = placed.groupBy(F.col("__part").alias("p")).agg(*[F.sum(v).alias(f"s_{k}") for k, v in values.items()])
    shift = sums.select("p", *[F.coalesce(F.sum(f"s_{k}").over(before), F.lit(0)).alias(f"s_{k}") for k in values])
    rows = placed.withColumns({k: F.sum(v).over(inside) for k, v in values.items()})
    return rows.join(shift, F.col("__part") == F.col("p")).select(
        *df.columns, *[(F.col(k) + F.col(f"s_{k}")).alias(k) for k in values]
    )


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, max_rate=MAX_RATE) -> DataFrame:
    """``source, source_size, target, rate`` from rows ``source, size``.

    Sources take the weights in turn, by code point, null last. The words
    wanted are ``share`` of all; a source stops at ``max_rate`` times its size
    and the rest is shared by weight among the others until none is above.
    That fixed point has a closed form: with sources sorted by cap per weight,
    the first whose cap exceeds its share of what the ones before leave over
    sets the level for itself and all after it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranked = prefix(per, [F.col("source").asc_nulls_last()], {"rank": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (((F.col("rank") - 1) % len(weights)) + 1).cast("int"))
    capped = ranked.withColumn("w", weight).withColumn("cap", (F.col("source_size") * max_rate).cast("double"))
    summed = prefix(
        capped.withColumn("ratio", F.col("cap") / F.col("w")),
        [F.col("ratio"), F.col("rank")],
        {"caps": F.col("cap"), "ws": F.col("w")},
    )
    total = summed.agg(
        (F.sum("source_size") * F.lit(share)).alias("wanted"), F.sum("w").alias("all_w")
    )
    level = (F.col("wanted") - (F.col("caps") - F.col("cap"))) / (F.col("all_w") - (F.col("ws") - F.col("w")))
    leveled = summed.crossJoin(F.broadcast(total)).withColumn("level", level)  # one row
    first = leveled.where(F.col("ratio") > F.col("level")).agg(F.min(F.struct("ratio", "rank", "level")).alias("f"))
    target = F.when(
        F.col("f").isNull() | (F.col("ratio") <= F.col("f.level")), F.col("cap")
    ).otherwise(F.col("w") * F.col("f.level"))
    return (
        leveled.crossJoin(F.broadcast(first))  # one row
        .withColumn("target", target)
        .select(
            "source", "source_size", "target",
            F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
        )
    )


def offset(source: Column, seed: int) -> Column:
    """One number in [0, 1) per source, from a hash of seed and source."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def plan(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=SHARE,
         max_rate=MAX_RATE, seed=SEED, key: Column | None = None) -> DataFrame:
    """Copies per document: ``id, size, source_size, target, copies`` (and ``key``).

    Every partition of the ordered rows holds few sources, so the table of
    (partition, source) starts carries the source's rate to its rows and no
    join is on the source alone.
    """
    extra = {"key": key} if key is not None else {}
    sized = stored(docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        word_count(F.col(f"`{text_col}`").cast("string")).cast("long").alias("size"),
        *[c.alias(k) for k, c in extra.items()],
    ))
    goal = targets(sized, weights, share, max_rate).select(
        F.col("source").alias("of"), "source_size", "target", "rate", offset(F.col("source"), seed).alias("u")
    )
    placed = _placed(
        sized, [F.col("source").asc_nulls_last(), "size", F.col("id").asc_nulls_last(), *extra]
    )
    starts = placed.groupBy("__part", "source").agg(F.min("__row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        starts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first"))
        .join(goal, F.col("source").eqNullSafe(F.col("of")))
        .select(F.col("__part").alias("p"), "of", "before", "source_size", "target", "rate", "u")
    )
    on = (F.col("__part") == F.col("p")) & F.col("source").eqNullSafe(F.col("of"))
    nth = F.col("__row") + F.col("before") + 1
    start = F.floor((nth - 1) * F.col("rate") + F.col("u"))
    end = F.floor(nth * F.col("rate") + F.col("u"))
    return placed.join(shift, on).select(
        "id", "size", "source_size", "target", (end - start).cast("long").alias("copies"), *extra
    )


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **options) -> DataFrame:
    """The mixed rows of ``docs``: each document as often as its copies say.

    Copies reach the rows by a digest of the whole row, so null or repeated
    ids do no harm: equal rows are interchangeable and take their copies
    together. The texts are shuffled once, by that digest.
    """
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    key = F.md5(F.to_json(row))
    copies = (
        plan(docs, id_col, text_col, source_col, key=key, **options)
        .groupBy("key").agg(F.sum("copies").alias("copies")).where("copies > 0")
    )
    rows = docs.select(key.alias("key"), row.alias("row")).groupBy("key").agg(F.any_value("row").alias("row"))
    out = rows.join(copies, "key").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])
